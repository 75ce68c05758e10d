import random
from dataclasses import replace

import pytest

from maskframe.operators import catalog, publications
from maskframe.operators.closure import CycleError, reachable, roots
from maskframe.plans.specs import TableSpec
from maskframe.sources.tables import leaves_of, read_parent, roots_of


def test_roots_of_deep_and_wide_trees(spark):
    parent = {i: i - 1 for i in range(1, 70)} | {i: 5 for i in range(100, 400)} | {500: 501}
    links = spark.createDataFrame([(d, n, p) for d in ("a", "b") for n, p in parent.items()], "database string, node int, parent int")
    expected = set()
    for n in parent:
        top, depth = n, 0
        while top in parent:
            top, depth = parent[top], depth + 1
        expected |= {(d, n, top, depth) for d in ("a", "b")}
    assert {tuple(r) for r in roots(links).collect()} == expected
    assert roots(links.limit(0)).count() == 0


def test_trees_that_bite_their_tail(spark):
    links = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("a", 3, 1), ("a", 9, 1)], "database string, node int, parent int")
    with pytest.raises(CycleError):
        roots(links)


def test_reachable_over_circles(spark):
    rnd = random.Random(2)
    edges = [(rnd.choice("ab"), rnd.randrange(40), rnd.randrange(40)) for _ in range(70)]
    expected = set()
    for d in "ab":
        for start in (1, 2):
            seen, todo = {start}, [start]
            while todo:
                n = todo.pop()
                for e, s, t in edges:
                    if (e, s) == (d, n) and t not in seen:
                        seen.add(t)
                        todo.append(t)
            expected |= {(d, start, n) for n in seen}
    frame = spark.createDataFrame(edges, "database string, source int, target int")
    starts = spark.createDataFrame([(d, n) for d in "ab" for n in (1, 2)], "database string, node int")
    assert {tuple(r) for r in reachable(frame, starts).collect()} == expected


def test_leaves_however_far_down(spark):
    frame = spark.createDataFrame([(1,), (2,)], "id int")
    whole = TableSpec.from_df("s.whole", frame)
    parts = {"s.a": "s.whole", "s.b": "s.whole", "s.b1": "s.b", "s.b2": "s.b", "s.b21": "s.b2"}
    inner = set(parts.values())
    specs = [replace(whole, kind="partitioned")] + [
        replace(whole, name=n[2:], parent=p, kind="partitioned" if n in inner else "table") for n, p in parts.items()
    ]
    assert [s.qualified for s in leaves_of(specs, "s.whole")] == ["s.a", "s.b1", "s.b21"]
    assert roots_of(specs) == dict.fromkeys(("s.a", "s.b1", "s.b21"), "s.whole")
    frames = {n: frame for n in parts if n not in inner}
    assert read_parent(frames, specs, "s.whole").count() == 6 and read_parent(frames, specs, "s.b2").count() == 2
    with pytest.raises(ValueError, match="no leaf"):
        read_parent(frames, [s for s in specs if s.partitioned], "s.whole")
    with pytest.raises(ValueError, match="below itself"):
        read_parent(frames, [replace(s, parent="s.b2") if s.name == "b" else s for s in specs], "s.b")


def test_partition_trees_end_at_plain_inheritance(spark):
    classes = spark.createDataFrame(
        [("d", 1, "s", "top", "p", False), ("d", 2, "s", "mid", "p", True), ("d", 3, "s", "leaf", "r", True),
         ("d", 4, "s", "child", "p", False), ("d", 5, "s", "low", "r", True)],
        "database string, oid int, nspname string, relname string, relkind string, relispartition boolean",
    )
    inherits = spark.createDataFrame([("d", 2, 1), ("d", 3, 2), ("d", 4, 2), ("d", 5, 4)], "database string, inhrelid int, inhparent int")
    found = {tuple(r)[1:] for r in catalog.partition_trees(classes, inherits).collect()}
    assert found == {("s.mid", "p", "s.top", 1), ("s.leaf", "r", "s.top", 2), ("s.low", "r", "s.child", 1)}


def test_privileges_follow_inherited_grants_only(spark):
    roles = [("me", True, False, False), ("a", True, False, False), ("b", False, False, False), ("c", True, False, False), ("x", True, False, True)]
    grants = [("a", "me", None), ("b", "a", True), ("c", "b", None), ("x", "me", False), ("a", "c", True)]
    role_list = spark.createDataFrame([("d", *r) for r in roles], "database string, rolname string, rolinherit boolean, rolsuper boolean, rolbypassrls boolean")
    members = spark.createDataFrame([("d", *g) for g in grants], "database string, role string, member string, inherit_option boolean")
    current = spark.createDataFrame([("d", "me")], "database string, rolname string")
    got = {r["owner"]: (r["is_member"], r["bypass_rls"]) for r in catalog.role_privileges(role_list, members, current).collect()}
    assert got == {"me": (True, False), "a": (True, False), "b": (True, False), "c": (False, False), "x": (False, False)}


TYPES = "database string, oid int, typname string, typnamespace int, typtype string, typbasetype int, typtypmod int, typelem int, typcategory string"


def test_types_made_of_types(spark):
    names = spark.createDataFrame([("d", 1, "pg_catalog"), ("d", 2, "app")], "database string, oid int, nspname string")
    rows = [
        (10, "varchar", 1, "b", 0, -1, 0, "S"), (11, "_varchar", 1, "b", 0, -1, 10, "A"), (20, "code", 2, "d", 10, 12, 0, "S"),
        (21, "short", 2, "d", 20, 9, 0, "S"), (22, "plain", 2, "d", 20, -1, 0, "S"), (23, "_short", 2, "b", 0, -1, 21, "A"), (24, "list", 2, "d", 11, 16, 0, "A"),
    ]
    types = spark.createDataFrame([("d", *r) for r in rows], TYPES)
    got = {r["oid"]: tuple(r)[2:] for r in catalog.resolved_types(types, names).collect()}
    assert got == {
        10: ("varchar", "varchar", -1, 0, False), 11: ("character varying[]", "varchar", -1, 0, True),
        20: ("app.code", "varchar", 12, 1, False), 21: ("app.short", "varchar", 9, 2, False), 22: ("app.plain", "varchar", 12, 2, False),
        23: ("app.short[]", "varchar", 9, 2, True), 24: ("app.list", "varchar", 16, 1, True),
    }
    circle = spark.createDataFrame([("d", 30, "x", 2, "d", 31, -1, 0, "S"), ("d", 31, "y", 2, "d", 30, -1, 0, "S")], TYPES)
    with pytest.raises(CycleError):
        catalog.resolved_types(circle, names)


def test_gaps_part_by_part(spark):
    rnd = random.Random(6)
    classes = [(d, 100 * k + i, rnd.choice(["s", "T"]), f"r{i}", "r", False) for k, (d, n) in enumerate([("a", 23), ("b", 7), ("c", 5)]) for i in range(n)]
    pubs = [(d, p, p == "all") for d in "ab" for p in ("few", "none", "full", "all")] + [("z", "lost", False)]
    named = [(d, "full", oid, None) for d, oid, *_ in classes] + [(d, "few", oid, None) for d, oid, *_ in classes if rnd.random() < 0.5]
    frame = spark.createDataFrame
    found = publications.gaps(
        frame(classes, "database string, oid int, nspname string, relname string, relkind string, relispartition boolean"),
        frame(pubs, "database string, pubname string, all_tables boolean"), frame([], "database string, pubname string, nspname string"),
        frame(named, "database string, pubname string, oid int, attnums array<int>"), part=5,
    ).collect()
    for d, p, whole in pubs:
        rows = sorted((c[2], c[3], c[1]) for c in classes if c[0] == d)
        has = {x[2] for x in named if x[:2] == (d, p)}
        missing = [(i // 5, ('"T"' if s == "T" else s) + "." + n) for i, (s, n, oid) in enumerate(rows) if oid not in has and not whole]
        got = sorted((r["part"], r["tables"]) for r in found if (r["database"], r["pubname"]) == (d, p))
        assert [(part, t) for part, names in got for t in names] == missing
        assert all(names for _, names in got)


def test_lists_of_missing_tables_are_cut_after_the_last_exchange(spark):
    """Publications times tables is what comes out, not what is shuffled: nothing is exchanged once a list is cut."""
    frame = spark.createDataFrame
    found = publications.gaps(
        frame([("a", 1, "s", "t", "r", False)], "database string, oid int, nspname string, relname string, relkind string, relispartition boolean"),
        frame([("a", "p", False)], "database string, pubname string, all_tables boolean"), frame([], "database string, pubname string, nspname string"),
        frame([], "database string, pubname string, oid int, attnums array<int>"),
    )
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" in plan and plan.index("flatten") < plan.index("Join") and "Generate" not in plan[: plan.index("Join")]
