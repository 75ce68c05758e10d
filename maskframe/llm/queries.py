"""The operators over the given tables, and SQL for those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import new_folder
from . import fingerprints, language, near_dedup, packing, pieces, pii, runs, tokencounts, tokenfiles, topk, url_rules, warc, whitening
from .common import table
from .tokens import tokenizer_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if oracle is not None:
            ORACLES[run.__name__] = oracle
        return run

    return register


def _is(kind: str, span: F.Column) -> F.Column:
    return span["kind"] == kind


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query()
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data and of what discloses it."""
    found = pii.private_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", partial(_is, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    order = F.array(*[F.lit(k) for k in pii.KINDS + tuple(sorted(pii.TERM_KINDS))])
    every = F.array_sort(
        F.concat("base", "terms"),
        lambda a, b: F.when(
            F.array_position(order, a["kind"]) == F.array_position(order, b["kind"]), (a["start"] - b["start"]).cast("int")
        ).otherwise((F.array_position(order, a["kind"]) - F.array_position(order, b["kind"])).cast("int")),
    )
    return found.select(
        "doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined(every).alias("spans"),
        F.size("terms").cast("long").alias("n_terms"), F.size(F.concat("base", "terms")).cast("long").alias("n_spans"),
    )


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query()
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query()
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best piece sequences of all documents, and what they decode to."""
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), place=pieces.FILE_PLACE)


@query("""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hash,
                 min(page_id) OVER (PARTITION BY html) AS first FROM p),
    b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
            ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
            [instr('0123456789abcdef', substr(hash, CAST(i AS INTEGER), 1))]), '') AS bits FROM d)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST(1 + list_sum(list_transform(range(1, 6), lambda j:
                   CAST(substr(bits, CAST(5 * i + j AS INTEGER), 1) AS INTEGER) * (1 << CAST(5 - j AS INTEGER)))) AS INTEGER), 1)), '')
               AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
    FROM b""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back."""
    found = warc.archive_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, each distinct text encoded once."""
    docs = table(spark, sf_dir, "documents")
    return tokencounts.token_counts(docs, tokenizer_file("byte_bpe_50k.json"), new_folder(spark, "token-cache"))


@query()
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of edited ones, and how alike they are."""
    return fingerprints.neighbour_fingerprints(table(spark, sf_dir, "documents"))


@query()
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to files and read back."""
    return tokenfiles.stored_ids(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query(r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
            lambda x: x <> '') AS words FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
            ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i:
                array_to_string(words[CAST(i AS BIGINT):CAST(i + 3 AS BIGINT)], ' '))) END AS items FROM w),
    n AS (SELECT doc_id, len(items) AS n_shingles FROM s),
    e AS (SELECT doc_id, unnest(items) AS item FROM s),
    c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM e x JOIN e y ON x.item = y.item AND x.doc_id <> y.doc_id
          GROUP BY 1, 2),
    l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
          WHERE 100 * shared >= 80 * (na.n_shingles + nb.n_shingles - shared)),
    r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id WHERE r.root < l.b)
    SELECT n.doc_id, n.n_shingles, min(r.root) AS component_id, min(r.root) = n.doc_id AS kept
    FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n_shingles""")
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their four-word shingles."""
    return near_dedup.near_components(table(spark, sf_dir, "documents"), width=4, percent=80)


@query("""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS n FROM embeddings),
    p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.n, c.n), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op10_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector."""
    return topk.top_products(table(spark, sf_dir, "embeddings"))


#: fixed values: verdict, host and path of the listed rules
LISTED = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_LISTED_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in LISTED)
_TOKEN_SQL = ", ".join(
    f"CASE WHEN length({v}) <= {url_rules.LONGEST_TOKEN} THEN '{k}:' || {v} ELSE '{k}:' || md5({v}) END"
    for k, v in zip(url_rules.KINDS, ("tld", "site", "host", "sub", "dir", "lead", "ext", "ask"), strict=True)
)


@query(rf"""
    WITH s AS (
        SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path,
               regexp_extract(coalesce(url, ''), '://[^?#]*\?([^=&#]*)', 1) AS query FROM pages),
    l AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM s),
    t AS (SELECT page_id, host, path, labels[-1] AS tld,
                 CASE WHEN len(labels) >= 2 THEN labels[-2] || '.' || labels[-1] END AS site,
                 CASE WHEN len(labels) >= 3 THEN labels[1] END AS sub, parts[1] AS dir, substr(parts[2], 1, 1) AS lead,
                 CASE WHEN contains(parts[-1], '.') THEN string_split(parts[-1], '.')[-1] END AS ext, nullif(query, '') AS ask FROM l),
    r(verdict, h, p) AS (VALUES {_LISTED_SQL}),
    f AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
          FROM t JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
    u AS (SELECT t.page_id, host, path, rule, verdict,
                 CASE WHEN host = '' THEN [] ELSE list_sort(list_filter([{_TOKEN_SQL}], lambda x: x IS NOT NULL)) END AS tokens
          FROM t LEFT JOIN f ON f.page_id = t.page_id),
    n AS (SELECT count(*) AS total FROM u WHERE verdict IS NOT NULL AND len(tokens) > 0),
    b AS (SELECT unnest(list_transform(range(1, 1 << len(tokens)), lambda m: list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1)))
                 AS part, verdict FROM u WHERE verdict IS NOT NULL AND len(tokens) > 0),
    c AS (SELECT part, verdict, count(*) AS support, sum(count(*)) OVER (PARTITION BY part) AS every FROM b GROUP BY part, verdict),
    a AS (SELECT part, verdict, support, CAST(support AS DOUBLE) / CAST(every AS DOUBLE) AS confidence FROM c, n
          WHERE support >= ceil(CAST({url_rules.SUPPORT} AS DOUBLE) * total) AND CAST(support AS DOUBLE) / CAST(every AS DOUBLE) >= {url_rules.CONFIDENCE}),
    d AS (SELECT DISTINCT tokens FROM u WHERE rule IS NULL AND len(tokens) > 0),
    e AS (SELECT tokens, unnest(list_transform(range(1, 1 << len(tokens)), lambda m: list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1)))
                 AS part FROM d),
    m AS (SELECT tokens, a.*, row_number() OVER (PARTITION BY tokens ORDER BY confidence DESC, support DESC, len(e.part), verdict DESC) AS place
          FROM e JOIN a ON a.part = e.part)
    SELECT page_id, host, path, rule, coalesce(u.verdict, m.verdict, '{url_rules.DEFAULT}') AS verdict, confidence
    FROM u LEFT JOIN m ON m.tokens = u.tokens AND place = 1 AND u.rule IS NULL""")
def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the listed rules or by association rules mined from what those decide."""
    return url_rules.judge(table(spark, sf_dir, "pages"), LISTED).drop("url")


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, a tenth of which are made to repeat themselves."""
    found = runs.periodic_runs(runs.with_repeats(table(spark, sf_dir, "documents")))
    best = runs.longest_repeat(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first eight principal axes, each to variance 1."""
    found = whitening.whitened_components(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))
