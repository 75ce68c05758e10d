import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from maskframe.llm import pii
from maskframe.llm.queries import QUERIES

from . import brute
from .conftest import SF, texts


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(3)
    for alphabet in ("a.@-_b 1", "1.2 -+()3", "0123456789 -", "+1234567890 ().-"):
        for _ in range(4000):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 45)))
            assert pii.base_spans(text) == brute.base_spans(text), repr(text)


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "@a" * 100_000, "1 " * 100_000, "+" + "1-" * 90_000])
def test_long_runs_take_linear_time(text):
    pii.base_spans(text)


def test_query(spark):
    found = {r["doc_id"]: r for r in QUERIES["op1_pii"](spark, SF).collect()}
    docs = dict(texts(spark.read.parquet(f"{SF}/documents.parquet")))
    assert found.keys() == docs.keys()
    for i, text in docs.items():
        spans = brute.base_spans(text or "")
        count = Counter(k for k, _, _ in spans)
        r = found[i]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [count[k] for k in pii.KINDS]
        assert r["base_sha256"] == brute.base_sha256(text or "")
        assert set(r["spans"].split(",")) >= {f"{k}:{a}:{b}" for k, a, b in spans} - {""}


def story(n):
    """Documents in which one address always stands beside a rare name, and common words stand everywhere."""
    rows = []
    for i in range(n):
        text = f"the meeting of the day number {i} was held in town"
        if i % 20 == 0:
            text += " and Zebulon Quist wrote from zq@mail.example today"
        elif i % 80 == 1:
            text += " and Zebulon spoke"
        elif i % 20 == 2:
            text += f" and others wrote from p{i}@mail.example today"
        elif i % 20 == 3:
            text += " and Quist left"
        rows.append((i, text, "en", "s", len(text)))
    return rows[:3] + [(3, "the town", "en", "s", 8)] + [r for r in rows[4:] if r[0] % 20 != 3]


def low_end(k, n, z=1.645):
    """The smallest probability for which k of n is not more than z deviations high, by halving."""
    low, high = 0.0, k / n
    for _ in range(200):
        p = (low + high) / 2
        low, high = (low, p) if k / n - p < z * math.sqrt(p * (1 - p) / n) else (p, high)
    return low


def disclosing_by_hand(rows, window=8):
    owners, near, has = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, text in rows:
        for w in set(re.findall(r"\w+", text.lower())):
            has[w].add(i)
        spans = brute.base_spans(text)
        for k, a, b in spans:
            e = text[a:b].lower()
            owners[e].add(i)
            outside = [m for m in re.finditer(r"\w+", text) if all(m.end() <= x or m.start() >= y for _, x, y in spans)]
            before, after = [m for m in outside if m.end() <= a][-window:], [m for m in outside if m.start() >= b][:window]
            for m in before + after:
                near[e, m[0].lower()].add(i)
    out = {}
    for (e, t), both in near.items():
        ic = math.log2(len(rows) / len(owners[e]))
        if ic > 0:
            share = 1 + math.log2(low_end(len(both), len(has[t]))) / ic
            if share >= pii.GENERALISE_AT:
                out[e, t] = ("removed" if share >= pii.REMOVE_AT and len(both) > 1 else "generalised", len(both))
    return out


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], DOCUMENTS)


def test_words_that_disclose_an_entity(spark):
    rows = story(400)
    docs = spark.createDataFrame(rows, DOCUMENTS)
    expected = disclosing_by_hand([(r[0], r[1]) for r in rows])
    assert expected["zq@mail.example", "quist"] == ("removed", 20)
    assert expected["zq@mail.example", "zebulon"] == ("generalised", 20)
    seen = pii.found(docs).cache()
    got = {(bytes(r["entity"]), r["term"]): (r["kind"], r["both"]) for r in pii.disclosing(docs, seen).collect()}
    assert got == {(pii.entity("email", e), t): k for (e, t), k in expected.items()}
    clean = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert "and [NAME]  wrote from [EMAIL] today" in clean[0]["text"]
    assert clean[1]["text"].endswith("and [NAME] spoke")  # it tells the address here too
    assert clean[4]["text"] == rows[4][1]
    assert all(r["n_chars"] == len(r["text"]) for r in clean.values())
    assert len(clean) == len(rows)


def marked_by_hand(rows):
    """(doc_id, kind, start, end): terms that several documents speak for wherever they stand, others in documents that hold the entity."""
    pairs, out = disclosing_by_hand(rows), set()
    for i, text in rows:
        spans = brute.base_spans(text)
        here = {text[a:b].lower() for _, a, b in spans}
        for m in re.finditer(r"\w+", text):
            if all(m.end() <= x or m.start() >= y for _, x, y in spans):
                kinds = {kind for (e, t), (kind, both) in pairs.items() if t == m[0].lower() and (both > 1 or e in here)}
                if kinds:
                    out.add((i, max(kinds), *m.span()))
    return out


def test_disclosing_words_go_wherever_they_stand(spark):
    far = ". It was then discussed at length by all of those who had come to town on that day. "
    rows = [(i, f"the meeting of the day number {i} was held in town") for i in range(400)]
    for i in range(0, 400, 20):
        rows[i] = (i, f"Zebulon Quist wrote from zq@mail.example today{far}Quist agreed{far}Was QUIST, or Zebulon, right?")
    rows[20] = (20, f"We wrote to zq@mail.example today{far}Quist agreed")
    rows[40] = (40, f"{far}Later Quist agreed and Quist left{far}")
    docs = frame(spark, rows)
    expected = marked_by_hand(rows)
    got = {(r["doc_id"], s["kind"], s["start"], s["end"]) for r in pii.private_spans(docs).collect() for s in r["terms"]}
    assert {rows[i][1][a:b].lower() for i, _, a, b in expected} >= {"quist", "zebulon"} and {i for i, *_ in expected} >= {0, 20, 40}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert not any("quist" in text.lower() for text in clean.values())
    assert got == expected


def test_one_document_is_little_evidence(spark):
    rows = [(i, f"the meeting of the day number {i} was held in town") for i in range(400)]
    rows[7] = (7, "Orla Vantongeren can be reached at ov@mail.example for the meeting")
    rows[8], rows[9], rows[10] = (8, "Orla spoke"), (9, "Orla left"), (10, "others can be reached for years at sea")
    docs = frame(spark, rows)
    pairs = disclosing_by_hand(rows)
    assert pairs == {("ov@mail.example", "vantongeren"): ("generalised", 1)}
    got = {(bytes(r["entity"]), r["term"]): (r["kind"], r["both"]) for r in pii.disclosing(docs, pii.found(docs).cache()).collect()}
    assert got == {(pii.entity("email", e), t): k for (e, t), k in pairs.items()}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[7] == "Orla [NAME] can be reached at [EMAIL] for the meeting" and clean[8] == "Orla spoke"


def test_ordinary_words_stay_beside_a_value(spark):
    """Words of a small corpus that happen to be there once, beside a value that is there once."""
    rows = [(i, f"the meeting of the day number {i % 7} was held in town on tuesday") for i in range(30)]
    rows.append((30, "call the plumber unclogging pipes at 10.0.0.7 on tuesday"))
    assert {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, rows)).collect()}[30] == "call the plumber unclogging pipes at [IP] on tuesday"


def test_secrets(spark):
    token, other = "5aad00685accefdd91653537b82ad0dab34e35e3", "Zk9_x7Qp+2mLr8VtB4sN"
    words = "Donaudampfschifffahrtsgesellschaftskapitaen 98765432109876543210987 aaaaaaaaaaaaaaaaaaaaaaaa1 x2y3z4 " + "ab1" * 30
    text = f'token = "{token}" and {other}, {words} a{token}@mail.example'
    spans = pii.all_spans(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [("email", f"a{token}@mail.example"), ("secret", token), ("secret", other)]
    rows = [(i, "nothing to see") for i in range(40)] + [(40, text)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, rows)).collect()}
    assert token not in clean[40] and other not in clean[40] and clean[40].count("[SECRET]") == 2 and words in clean[40]


@pytest.mark.parametrize("gap", [" " * 400, " " + "-" * 300 + " ", " " + "x" * 400 + " "])
def test_words_count_however_far_they_reach(gap):
    text = f"Orla{gap}Quist wrote from oq@mail.example today{gap}Zeb"
    near = pii.neighbours(text, pii.base_spans(text), 8)
    assert [t for _, t, _, _ in near] == [w.lower() for w in re.findall(r"\w+", text.replace("oq@mail.example", ""))]
    assert all(text[a:b].lower() == t for _, t, a, b in near)


def test_documents_with_a_bare_value_count_for_it(spark):
    rows = [(i, f"the meeting of the day number {i} was held in town") for i in range(400)]
    for i in range(30):
        rows[i] = (i, "oq@mail.example") if i % 3 else (i, "Orla wrote from oq@mail.example")
    docs = frame(spark, rows)
    got = {r["term"]: (r["own"], r["kind"], r["both"]) for r in pii.disclosing(docs, pii.found(docs).cache()).collect()}
    assert {own for own, _, _ in got.values()} == {30}
    assert {("oq@mail.example", t): k for t, (_, *k) in got.items()} == {k: list(v) for k, v in disclosing_by_hand(rows).items()}


def test_unusual_rows(spark, odd, with_clashes, empty):
    for df in (odd, with_clashes):
        found = pii.private_spans(df).collect()
        assert len(found) == df.count()
        out = pii.sanitise(df)
        assert out.columns == df.columns and out.count() == df.count()
        kept = {r["doc_id"]: r["text"] for r in out.collect()}
        assert kept[1] is None and kept[2] == "" and "[CARD]" in kept[14] and "[PHONE]" in kept[14] and "[IP]" in kept[14] and "999.1.1.1" in kept[14]
    assert pii.sanitise(empty).count() == 0 and pii.private_spans(empty).count() == 0


def test_no_spans_digest():
    assert brute.base_sha256("") == hashlib.sha256(b"").hexdigest()
