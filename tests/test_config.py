import itertools

import pytest

from maskframe import ConfigError, ScrubConfig, split_qualified

RULES = """
version: 1
fk_mode: not_valid
tables:
  sales.customer:
    where: "c_acctbal >= 0 AND c_mktsegment <> 'HOUSEHOLD'"
    columns:
      c_name: md5
      c_phone: "'+00 ' || right(c_phone, 2)"
  sales.lineitem: {}
  web.pages:
    mode: skip
"""


def test_parse():
    cfg = ScrubConfig.parse(RULES)
    assert (cfg.fk_mode, cfg.table_names()) == ("not_valid", ["sales.customer", "sales.lineitem", "web.pages"])
    customer = cfg.rules_for("sales.customer")
    assert customer.columns == {"c_name": "md5", "c_phone": "'+00 ' || right(c_phone, 2)"}
    assert customer.where == "c_acctbal >= 0 AND c_mktsegment <> 'HOUSEHOLD'" and not customer.skip
    assert cfg.rules_for("web.pages").skip
    for name in ("sales.lineitem", "sales.part"):
        assert not cfg.rules_for(name).columns and not cfg.rules_for(name).where


def valid():
    """A rule set with every key there is."""
    return {
        "version": 1, "fk_mode": "not_valid",
        "tables": {
            "sales.part": {"where": "p_size > 3", "columns": {"p_name": "redact", "p_type": "upper(p_type)"}},
            "web.pages": {"mode": "skip"},
        },
    }


def changed(path, value):
    """The valid set with another value at a path; a path that ends in a new key adds it."""
    out = valid()
    place = out
    for key in path[:-1]:
        place = place[key]
    place[path[-1]] = value
    return out


def paths(body, at=()):
    for key, value in body.items():
        yield (*at, key)
        if isinstance(value, dict):
            yield from paths(value, (*at, key))


def problems(document):
    try:
        ScrubConfig.parse(document)
    except ConfigError as e:
        return e.problems
    return []


def test_the_valid_set_is_valid():
    assert problems(valid()) == []


@pytest.mark.parametrize("value", ["  ", 12, "nonsense"])
@pytest.mark.parametrize("path", [p for p in paths(valid()) if p[-1] in ("version", "fk_mode", "mode")], ids=".".join)
def test_a_word_that_means_nothing(path, value):
    found = problems(changed(path, value))
    assert len(found) == 1 and (str(value).strip() in found[0] or "blank" in found[0])


def test_an_empty_mode_is_the_usual_one():
    cfg = ScrubConfig.parse(changed(("fk_mode",), "") | {"tables": {"web.pages": {"mode": ""}}})
    assert cfg.fk_mode == "validate" and not cfg.rules_for("web.pages").skip


@pytest.mark.parametrize("place", [(), ("tables", "sales.part"), ("tables", "web.pages")], ids=str)
def test_a_key_that_is_not_known(place):
    assert [("surprise" in p) for p in problems(changed((*place, "surprise"), {}))] == [True]


@pytest.mark.parametrize("rule", ["", "\n", None])
def test_a_rule_without_content(rule):
    found = problems(changed(("tables", "sales.part", "columns", "p_type"), rule))
    assert len(found) == 1 and "p_type" in found[0]


@pytest.mark.parametrize("key, value", list(valid()["tables"]["sales.part"].items()))
def test_a_skipped_table_has_no_rules(key, value):
    found = problems(changed(("tables", "web.pages", key), value))
    assert len(found) == 1 and key in found[0]


def test_each_change_adds_its_own_problem():
    """All problems are told at once, so two changes in different places have the problems of both."""
    one, two = ("fk_mode", "nonsense"), ("tables", {"part": {}})
    both = valid() | dict([one, two])
    assert sorted(problems(both)) == sorted(problems(valid() | dict([one])) + problems(valid() | dict([two])))
    assert len(problems(both)) == 2


@pytest.mark.parametrize("text", ["version: [1", "- 1", "version: 1\nversion: 1", "tables: {a.b: {where: x, where: y}}"])
def test_text_that_is_no_rule_set(text):
    assert problems(text)


def test_scalars_stay_text():
    cfg = ScrubConfig.parse("version: 1\ntables: {public.u: {columns: {a: 042, b: yes, c: 1.50}}}")
    assert cfg.rules_for("public.u").columns == {"a": "042", "b": "yes", "c": "1.50"}


def test_validate_is_the_default_fk_mode():
    assert ScrubConfig.parse("version: 1").fk_mode == "validate"
    assert ScrubConfig.parse("version: 1\nfk_mode: validate").fk_mode == "validate"


def test_hash_ignores_order_and_sees_content():
    a = ScrubConfig.parse({"version": 1, "tables": {"p.a": {"columns": {"x": "md5", "y": "email"}}, "p.b": {}}})
    b = ScrubConfig.parse({"version": 1, "tables": {"p.b": {}, "p.a": {"columns": {"y": "email", "x": "md5"}}}})
    c = ScrubConfig.parse({"version": 1, "tables": {"p.b": {}, "p.a": {"columns": {"y": "email", "x": "null"}}}})
    assert a.sha256() == b.sha256() != c.sha256()


@pytest.mark.parametrize("parts", list(itertools.chain.from_iterable(itertools.product(["", "x", "a b"], repeat=n) for n in (1, 2, 3))), ids=".".join)
def test_a_name_is_a_schema_and_a_table(parts):
    name = ".".join(parts)
    if len(parts) == 2 and all(parts):
        assert split_qualified(name) == parts
    else:
        with pytest.raises(ValueError):
            split_qualified(name)


def test_rules_frame(spark):
    got = {tuple(r) for r in ScrubConfig.parse(RULES).frame(spark).collect()}
    assert got == {
        ("sales.customer", "c_name", "md5"), ("sales.customer", "c_phone", "'+00 ' || right(c_phone, 2)"),
        ("sales.lineitem", None, None), ("web.pages", None, None),
    }
