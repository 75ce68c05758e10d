"""Operators that prepare text for training: one module each, queries in ``queries``."""
