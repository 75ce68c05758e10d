from conftest import SALT, rows
from pyspark.sql import functions as F

from maskframe import ScrubConfig, TableSpec, scrub
from maskframe.streaming.feeds import read_folder, scrub_stream, write_folder

RULES = ScrubConfig.parse({"version": 1, "tables": {"public.t": {"where": "id % 2 = 0", "columns": {"c": "md5"}}}})


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    made = spark.range(100).select("id", F.col("id").cast("string").alias("c"))
    made.filter("id < 60").write.parquet(source)
    spec = TableSpec.from_df("public.t", made)

    def run():
        stream = scrub_stream(read_folder(spark, source, made.schema, 1), spec, RULES, SALT)
        assert stream.isStreaming
        write_folder(stream, sink, checkpoint).awaitTermination()
        return spark.read.parquet(sink)

    assert rows(run()) == rows(scrub(made.filter("id < 60"), spec, RULES, SALT))
    made.filter("id >= 60").write.mode("append").parquet(source)
    assert rows(run()) == rows(scrub(made, spec, RULES, SALT))
    assert run().count() == 50
