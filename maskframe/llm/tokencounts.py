"""Token counts through a cache that is keyed by what decides them: the text and the tokenizer.

A document's key is the SHA-256 of its normalised content, the tokenizer's is that of its file and of the
library's version. Counts that the cache has are joined; of the contents it lacks, each is encoded once
and its count appended to the cache, a folder of Parquet files, partitioned by tokenizer.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import path_exists
from .common import slices
from .tokens import encoder

LIMIT = 512
_COUNTS = "content binary, n_tokens long, tokenizer string"


def tokenizer_digest(path: str) -> str:
    import sentencepiece
    import tokenizers

    with open(path, "rb") as f:
        data = f.read()
    library = sentencepiece if path.endswith(".model") else tokenizers
    return hashlib.sha256(data + f"\n{library.__name__} {library.__version__}".encode()).hexdigest()


def count_tokens(texts: list[str], path: str) -> list[int]:
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(ids) for ids in model.encode(texts, num_threads=1)]
    encode = encoder(path)
    return [len(encode.ids(text)) // 4 for text in texts]


def cached(spark, cache: str, tokenizer: str) -> DataFrame:
    """The cache's ``content`` and ``n_tokens`` for one tokenizer; empty if there is none."""
    if not path_exists(spark, f"{cache}/tokenizer={tokenizer}"):
        return spark.createDataFrame([], "content binary, n_tokens long")
    stored = spark.read.schema(_COUNTS).parquet(cache).where(F.col("tokenizer") == tokenizer)
    # Two runs at once may both have appended a content; its counts are equal.
    return stored.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT, normalise=None) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` for each row; ``cache`` grows by the contents it lacked.

    ``normalise`` maps the text column to another that has the same ids, where a tokenizer ignores differences;
    by default the text counts as it is. ``n_bytes`` is of the text itself.

    - A null text is an empty one, with no token. Repeated rows each get their count; the content is encoded once.
    - A null ``doc_id`` is kept. Other columns are not looked at. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    content = normalise(F.col("text")) if normalise else F.col("text")
    digest = F.unhex(F.sha2(content.cast("binary"), 256)).alias("content")
    schema = pa.schema([("content", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches):
        for batch in slices(batches, most=4 << 20):
            counts = count_tokens(batch.column("text").to_pylist(), tokenizer)
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counts, pa.int64())], schema=schema)

    distinct = plain.select(digest, content.alias("text")).dropDuplicates(["content"])
    missing = distinct.join(cached(spark, cache, version), "content", "left_anti")
    fresh = missing.mapInArrow(run, "content binary, n_tokens long")
    fresh.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    sized = plain.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest)
    counted = sized.join(cached(spark, cache, version), "content")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
