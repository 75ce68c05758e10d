"""URLs judged by listed rules, and where none fits by association rules mined from the URLs that listed rules decide.

A URL has at most one token of each kind in ``KINDS``: parts of its host, path and query. URLs with a known
verdict are the labels; each is a basket of its tokens and its verdict. Spark's FP-growth finds the token
combinations that occur with a verdict in at least ``SUPPORT`` of the labelled URLs; of those, combinations whose
URLs have that verdict in at least ``CONFIDENCE`` of all cases become rules, unless a part of the combination is a rule
for the same verdict with no less confidence. Rules are posted in an inverted index under their rarest token. A
URL looks up its own tokens there and keeps the rules all of whose tokens it has. The rule with the highest confidence wins, then the
one with more support, then the shorter one, then ``block``.

Only DataFrame functions run here, and Spark's own FP-growth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("tld", "site", "host", "sub", "dir", "lead", "ext", "ask")
SUPPORT, CONFIDENCE = 0.01, 0.8
DEFAULT = "allow"
LONGEST_TOKEN = 64  # a longer part of a URL is named by its MD5, so the tokens that go through the driver are bounded
_VERDICT = "verdict:"
_URL = "://([^/?#]*)([^?#]*)"

#: (verdict, host, path)
Listed = Sequence[tuple[str, str, str]]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null and for what has no ``://``."""
    known = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(known, _URL, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(known, _URL, 2)


def listed_rule(host: Column, path: Column, listed: Listed) -> Column:
    """(rule, verdict) of the longest listed rule that fits; of equally long ones that with the longer host; or null.

    A rule fits its host and all subdomains, where the path starts with the rule's.
    """
    order = sorted(listed, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    found = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in order
    ]
    return F.coalesce(*found, F.lit(None).cast("struct<rule:string,verdict:string>"))


def _token(kind: str, value: Column) -> Column:
    short = F.when(F.char_length(value) <= LONGEST_TOKEN, value).otherwise(F.md5(value))
    return F.concat(F.lit(f"{kind}:"), short)


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """At most one token of each kind, sorted; none without a host.

    The host's last label, its last two, all of it, and the first of three or more; the path's first segment,
    the first character of its second, and the last one's extension; the name of the query's first parameter.
    """
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    names = F.split(F.element_at(parts, -1), r"\.")
    ask = F.regexp_extract(url, r"://[^?#]*\?([^=&#]*)", 1)
    values = {
        "tld": F.element_at(labels, -1),
        "site": F.when(F.size(labels) >= 2, F.concat_ws(".", F.slice(labels, -2, 2))),
        "host": host,
        "sub": F.when(F.size(labels) >= 3, F.element_at(labels, 1)),
        "dir": F.when(F.size(parts) >= 1, F.element_at(parts, 1)),
        "lead": F.when(F.size(parts) >= 2, F.substring(F.element_at(parts, 2), 1, 1)),
        "ext": F.when((F.size(parts) >= 1) & (F.size(names) >= 2), F.element_at(names, -1)),
        "ask": F.when(ask != "", ask),
    }
    tokens = F.array_compact(F.array(*[_token(k, values[k]) for k in KINDS]))
    return F.when(host != "", F.array_sort(tokens)).otherwise(F.array().cast("array<string>"))


def _parts(items: Column) -> Column:
    """All subsets of an array, the empty one and the array itself included."""
    none = F.array(F.array().cast("array<string>"))
    return F.aggregate(items, none, lambda found, x: F.concat(found, F.transform(found, lambda part: F.array_append(part, x))))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``antecedent``, ``verdict``, ``support`` (labelled URLs with both), ``confidence`` and ``post``, the rarest token.

    ``labelled`` has ``tokens`` and ``verdict``, and every row of it counts, repeated ones too. Rows without tokens
    or verdict say nothing. An empty table gives no rules. A basket has at most nine items, so it is in at most 2^9
    sets; a rule has at most 2^8 parts to be compared with.
    """
    known = labelled.where(F.col("verdict").isNotNull() & (F.size("tokens") > 0))
    baskets = known.select(F.array_append("tokens", F.concat(F.lit(_VERDICT), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(baskets)
    is_verdict = lambda item: item.startswith(_VERDICT)
    sets = written(
        model.freqItemsets.select(
            F.array_sort(F.filter("items", lambda i: ~is_verdict(i))).alias("antecedent"),
            F.substring_index(F.get(F.filter("items", is_verdict), 0), _VERDICT, -1).alias("verdict"),
            "freq",
        ).where(F.size("antecedent") > 0),
        "url-sets",
    )
    alone = sets.where("verdict is null").select("antecedent", F.col("freq").alias("n"))
    rules = sets.where("verdict is not null").join(alone, "antecedent")
    rules = rules.select("antecedent", "verdict", F.col("freq").alias("support"), (F.col("freq") / F.col("n")).alias("confidence"))
    rules = written(rules.where(F.col("confidence") >= confidence), "url-rules")

    parts = rules.select(
        F.col("antecedent").alias("whole"), "verdict", F.col("confidence").alias("own"),
        F.explode(F.filter(_parts(F.col("antecedent")), lambda p: (F.size(p) > 0) & (F.size(p) < F.size("antecedent")))).alias("antecedent"),
    )
    needless = parts.join(rules, ["antecedent", "verdict"]).where("confidence >= own").select(F.col("whole").alias("antecedent"), "verdict")
    kept = rules.join(needless.distinct(), ["antecedent", "verdict"], "left_anti")
    single = alone.where(F.size("antecedent") == 1).select(F.element_at("antecedent", 1).alias("token"), "n")
    posts = (
        kept.select("antecedent", "verdict", F.explode("antecedent").alias("token")).join(single, "token")
        .groupBy("antecedent", "verdict").agg(F.min(F.struct("n", "token"))["token"].alias("post"))
    )
    return kept.join(posts, ["antecedent", "verdict"])


def best_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens``, ``verdict`` and ``confidence`` of the best rule for each of the distinct token sets that has one."""
    looked_up = token_sets.select("tokens", F.explode("tokens").alias("post")).join(rules, "post")
    fits = looked_up.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", (-F.size("antecedent")).alias("shorter"), "verdict"))
    return fits.groupBy("tokens").agg(best.alias("best")).select("tokens", "best.verdict", "best.confidence")


def judge(
    pages: DataFrame, listed: Listed, support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = DEFAULT
) -> DataFrame:
    """For each row of ``pages``: ``page_id``, ``url``, ``host``, ``path``, ``rule``, ``verdict`` and ``confidence``.

    ``confidence`` is that of the association rule, null where a listed one decided or no rule fits; then the verdict is
    ``default``.

    - A null URL, an empty one and one without ``://`` have an empty host and path, no tokens and the default verdict.
    - Equal URLs have equal verdicts; repeated rows count as often as they occur, in the result and as labels.
    - Any text is a URL, however long; no other column is looked at. An empty table gives an empty one.

    What goes through the driver are the tokens that occur in rules: at most ``len(KINDS) / support``, each of at most 64
    characters and its kind, as each is in that share of the labelled URLs.
    """
    host, path = split_url(F.col("url"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path"))
    seen = split.withColumn("listed", listed_rule(F.col("host"), F.col("path"), listed)).withColumn("tokens", tokens)
    rules = written(mine(seen.select("tokens", "listed.verdict"), support, confidence), "url-index")

    words = sorted(r["token"] for r in rules.select(F.explode("antecedent").alias("token")).distinct().collect())
    told = F.filter("tokens", lambda t: t.isin(words)) if words else F.array().cast("array<string>")
    seen = seen.withColumn("tokens", told)
    known = F.size("tokens") > 0
    open_ = seen.where(F.col("listed").isNull() & known)
    best = best_rules(open_.select("tokens").distinct(), rules)
    columns = ["page_id", "url", "host", "path"]
    decided = seen.where(F.col("listed").isNotNull() | ~known).select(
        *columns, "listed.rule", F.coalesce("listed.verdict", F.lit(default)).alias("verdict"), F.lit(None).cast("double").alias("confidence")
    )
    mined = open_.join(best, "tokens", "left").select(
        *columns, F.lit(None).cast("string").alias("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict"), "confidence"
    )
    return decided.unionByName(mined)
