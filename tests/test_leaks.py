import random

import pytest

from maskframe.operators import leaks


def by_hand(raw, texts):
    """(source, target): how many values stand in texts, and in how many of them."""
    out = {}
    for source, values in raw.items():
        for target, rows in texts.items():
            found = {(v, i) for v in set(values) if v for i, text in enumerate(rows) if text and v in text}
            out[source, target] = (len({v for v, _ in found}), len({i for _, i in found}))
    return out


def audited(spark, raw, texts, **more):
    """One table for each list."""
    frames = {n: spark.createDataFrame([(v,) for v in values], "c string").repartition(3) for n, values in {**raw, **texts}.items()}
    found = leaks.audit_leak_anywhere(frames, {n: ["c"] for n in raw}, {n: frames[n] for n in texts}, **more)
    return {(r["source"].removesuffix(".c"), r["target"].removesuffix(".c")): (r["leaked_values"], r["leaked_rows"]) for r in found.collect()}


def made(rnd, alphabet, n, longest):
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("alphabet, longest", [("ab", 12), ("abcdefgh é☃", 70), ("ab", 90)])
def test_every_value_is_found_wherever_it_stands(spark, monkeypatch, alphabet, longest):
    monkeypatch.setattr(leaks, "BATCH_BYTES", 300)
    monkeypatch.setattr(leaks, "SCAN_BYTES", 64)
    rnd = random.Random(longest)
    raw = {"x": made(rnd, alphabet, 25, longest), "y": made(rnd, alphabet, 25, 5) + [None, ""]}
    texts = {"t": made(rnd, alphabet, 40, 200) + [None, ""], "u": ["", None]}
    for i in range(30):
        value = rnd.choice(raw["x"] + raw["y"][:25])
        texts["t"].append(made(rnd, alphabet, 1, 50)[0] + value[: rnd.choice([len(value), max(0, len(value) - 1)])] + made(rnd, alphabet, 1, 50)[0])
        texts["u"].append(value)
    assert audited(spark, raw, texts) == by_hand(raw, texts)


def test_values_that_share_long_parts(spark):
    """Pieces in common, in another order, or at other distances are not the value."""
    a, b, c = "A" * 32, "B" * 32, "C" * 20
    raw = {"x": [a + b, b + a, a + a, a + b + c, a + b + "D" * 20]}
    texts = {"t": [a + "." + b, a + b, "x" + a + a + a, b + a + b + c, a + b + c[:-1], "A" * 63, "A" * 64]}
    assert audited(spark, raw, texts) == by_hand(raw, texts)


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BITMAP_BITS", (16, 16))
    monkeypatch.setattr(leaks, "_bitmap", lambda pieces: (16, b"\xff" * (1 << 13)))
    rnd = random.Random(8)
    raw, texts = {"x": made(rnd, "abc", 30, 45)}, {"t": made(rnd, "abc", 30, 60)}
    assert audited(spark, raw, texts) == by_hand(raw, texts)


def test_what_is_looked_for_and_where(spark):
    frame = spark.createDataFrame([(1, "Ann", "x"), (2, None, "y Ann"), (2, "", "Ann"), (3, "Al", "also Al")], "id long, name string, note string")
    found = leaks.audit_leak_anywhere({"p": frame}, {"p": ["name", "id"]}, {"p": frame, "q": frame.select("id")}, shortest=3)
    assert {tuple(r) for r in found.collect()} == {
        ("p.name", "p.name", 1, 1), ("p.name", "p.note", 1, 2), ("p.id", "p.name", 0, 0), ("p.id", "p.note", 0, 0),
    }
    assert audited(spark, {"x": []}, {"t": ["a"]}) == {("x", "t"): (0, 0)}
    assert audited(spark, {"x": ["a"]}, {"t": []}) == {("x", "t"): (0, 0)}


def test_texts_are_shuffled_by_hash_only(spark):
    """The text goes no further than the scan; what is joined are hashes and places."""
    frame = spark.createDataFrame([("a long text",)], "c string")
    hits = leaks._hits(leaks._texts({"t": frame}, {"t": ["c"]}), leaks.value_pieces(frame.selectExpr("'x' AS name", "c AS text")))
    assert "text" not in hits.columns and "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()


def test_windows_that_are_no_piece_stay_in_the_scan(spark):
    """The bitmap lets few others through: what is written and shuffled grows with the finds, not with the text."""
    rnd = random.Random(5)
    values = [f"Name#{i:09d}" for i in range(3000)] + made(rnd, "abcdefgh", 300, 90)
    texts = made(rnd, "0123456789abcdefgh #N", 400, 2000) + ["x" + v for v in values[::100]]
    pieces = leaks.value_pieces(spark.createDataFrame([("x", v) for v in set(values) if v], "name string, text string")).cache()
    hits = leaks._hits(spark.createDataFrame([("t", v) for v in texts], "name string, text string"), pieces)
    key, whole = ["h1", "h2", "size"], pieces.where("size = 14").select("h1", "h2", "size")
    found = hits.where("size = 14")
    assert found.join(whole, key, "left_semi").count() == 30
    assert found.join(whole, key, "left_anti").count() < len("".join(texts)) / 1000
