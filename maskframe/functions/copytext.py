r"""COPY text: tab-separated fields, ``\N`` for NULL, backslash escapes.

Encoding and decoding are column expressions. Values that the database writes in
its own notation (booleans, bytes, arrays) are written and read in that notation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .transforms import source_column

# Control characters and the letters that stand for them.
ESCAPES = {"\b": "b", "\f": "f", "\n": "n", "\r": "r", "\t": "t", "\v": "v"}

NULL_FIELD = "\\N"
_ARRAY_ITEM = r'"((?:[^"\\]|\\.)*)"|([^,{}"]+)'


# Types whose text holds no character that is escaped.
_PLAIN = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def encode_line(schema: T.StructType) -> Column:
    fields = []
    for f in schema.fields:
        text = to_text(source_column(f.name), f.dataType)
        text = text if isinstance(f.dataType, _PLAIN) else escape(text)
        fields.append(F.coalesce(text, F.lit(NULL_FIELD)))
    return F.concat_ws("\t", *fields)


def split_line(line: Column, schema: T.StructType) -> Column:
    """The raw fields. A line with another number of fields is an error, not a guess."""
    n = len(schema.fields)
    parts = F.split(line, "\t", -1)
    found = F.size(parts).cast("string")
    message = F.concat(F.lit(f"expected {n} fields, found "), found)
    return F.when(F.size(parts) == n, parts).otherwise(F.raise_error(message))


def decode_fields(fields: Column, schema: T.StructType) -> list[Column]:
    out = []
    for i, f in enumerate(schema.fields):
        raw = F.get(fields, F.lit(i))
        text = raw if isinstance(f.dataType, _PLAIN) else unescape(raw)
        out.append(F.when(raw != NULL_FIELD, from_text(text, f.dataType)).alias(f.name))
    return out


def escape(text: Column) -> Column:
    """Most text holds newlines and nothing else to escape, so that case takes one replacement."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, letter in ESCAPES.items():
        out = F.replace(out, F.lit(control), F.lit("\\" + letter))
    newlines = F.replace(text, F.lit("\n"), F.lit("\\n"))
    return F.when(text.rlike(r"[\\\t\r\f\x08\x0b]"), out).otherwise(newlines)


def unescape(field: Column) -> Column:
    """Escapes to characters, without arrays or lambdas so that it stays in generated code.

    A field holds no raw tab, so a tab can stand for an escaped backslash while the
    other escapes are replaced. What still has a backslash after that is a tab's
    escape, or a backslash before an ordinary character, which stands for that character.
    """
    out = F.replace(field, F.lit("\\\\"), F.lit("\t"))
    for control, letter in ESCAPES.items():
        if control != "\t":
            out = F.replace(out, F.lit("\\" + letter), F.lit(control))
    swapped = F.replace(F.regexp_replace(out, r"\\(?!t)", ""), F.lit("\\t"), F.lit("\\"))
    return (
        F.when(~F.contains(field, F.lit("\\")), field)
        .when(~field.rlike(r"\\[^n]|\\$"), F.replace(field, F.lit("\\n"), F.lit("\n")))
        .when(F.contains(out, F.lit("\\")), F.translate(swapped, "\\\t", "\t\\"))
        .otherwise(F.replace(out, F.lit("\t"), F.lit("\\")))
    )


def to_text(value: Column, t: T.DataType) -> Column:
    if isinstance(t, T.BooleanType):
        return F.when(value, "t").when(~value, "f")
    if isinstance(t, T.BinaryType):
        return F.concat(F.lit("\\x"), F.lower(F.hex(value)))
    if isinstance(t, T.TimestampType):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSSxxx")
    if isinstance(t, T.ArrayType):
        return _array_to_text(value, t)
    if isinstance(t, (T.StructType, T.MapType)):
        return F.to_json(value)
    return value.cast("string")


def from_text(text: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StringType):
        return text
    if isinstance(t, T.BinaryType):
        return F.unhex(F.substring(text, 3, 2147483647))
    if isinstance(t, T.ArrayType):
        return _array_from_text(text, t)
    if isinstance(t, (T.StructType, T.MapType)):
        return F.from_json(text, t)
    return text.cast(t)


_QUOTED_ITEMS = (T.StringType, T.BinaryType, T.TimestampType, T.TimestampNTZType, T.DateType)
_NESTED_ITEMS = (T.ArrayType, T.StructType, T.MapType)


def _array_to_text(value: Column, t: T.ArrayType) -> Column:
    """Text items are always quoted, so that a text NULL and a missing item stay apart."""
    if isinstance(t.elementType, _NESTED_ITEMS):
        raise TypeError(f"COPY text holds one-dimensional arrays of plain values, not {t.simpleString()}")

    def quoted(e: Column) -> Column:
        text = F.replace(to_text(e, t.elementType), F.lit("\\"), F.lit("\\\\"))
        return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))

    items = value.cast("array<string>")
    if isinstance(t.elementType, _QUOTED_ITEMS):
        items = F.transform(value, quoted)
    return F.concat(F.lit("{"), F.array_join(items, ",", "NULL"), F.lit("}"))


def _array_from_text(text: Column, t: T.ArrayType) -> Column:
    def item(e: Column) -> Column:
        inner = F.regexp_replace(e.substr(F.lit(2), F.length(e) - 2), r"\\(.)", "$1")
        plain = F.when(F.lower(e) != "null", e)
        return from_text(F.when(F.startswith(e, F.lit('"')), inner).otherwise(plain), t.elementType)

    any_items = F.transform(F.regexp_extract_all(text, F.lit(_ARRAY_ITEM), F.lit(0)), item)
    if isinstance(t.elementType, (*_QUOTED_ITEMS, *_NESTED_ITEMS)):
        return any_items
    # Numbers without a missing item, the common case: cut and cast as a whole.
    numbers = F.split(F.translate(text, "{}", ""), ",", -1).cast(t)
    simple = (F.length(text) > 2) & ~F.contains(F.upper(text), F.lit("NULL"))
    return F.when(simple, numbers).otherwise(any_items)
