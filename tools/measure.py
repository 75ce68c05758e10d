"""

    python tools/measure.py [sf_dir]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from maskframe import ScrubConfig, scrub, snapshot  # noqa: E402
from maskframe.operators.audits import fk_orphans  # noqa: E402
from maskframe.plans.specs import ForeignKey, TableSpec  # noqa: E402
from maskframe.queries.base import open_tables, rules, spec_of, table  # noqa: E402
from maskframe.queries.snapshots import FLEET_RULES  # noqa: E402
from maskframe.session import builder  # noqa: E402
from maskframe.sources.copyfiles import read_copytext, write_copytext  # noqa: E402
from maskframe.workspace import new_folder  # noqa: E402


def best(run, times=3):
    out = []
    for _ in range(times):
        start = time.perf_counter()
        run()
        out.append(time.perf_counter() - start)
    return min(out)


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("part-*"))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = (
        builder("measure").master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    lineitem = table(spark, sf, "lineitem")
    spec, n = spec_of(lineitem, "lineitem"), lineitem.count()
    for rule in (None, "null", "redact", "md5", "email"):
        cfg = ScrubConfig() if rule is None else rules("lineitem", l_returnflag=rule, l_linestatus=rule)
        took = best(lambda: scrub(lineitem, spec, cfg, "grain-of-7").write.parquet(new_folder(spark, "m")))
        print(f"scrub of 2 columns, {rule or 'plain read and write'}: {took:.2f} s, {n / took:,.0f} rows/s")

    frames = open_tables(spark, sf)
    specs = [TableSpec.from_df(name, df) for name, df in frames.items()]
    for workers in (1, 4):
        took = best(lambda: snapshot(
            spark, frames, specs, FLEET_RULES, new_folder(spark, "s"), "core", salt="grain-of-7", workers=workers
        ), 2)
        print(f"snapshot of {len(frames)} tables, {workers} at a time: {took:.2f} s")

    orders = table(spark, sf, "orders").filter("o_orderdate >= date '1999-01-01'")
    key = ForeignKey(("l_orderkey",), "public.orders", ("o_orderkey",))
    took = best(lambda: fk_orphans(lineitem, orders, key).write.format("noop").mode("overwrite").save())
    print(f"foreign-key audit lineitem->orders: {took:.2f} s")

    for name in ("documents", "lineitem"):
        df = table(spark, sf, name)
        copy, parquet = new_folder(spark, "c"), new_folder(spark, "p")
        start = time.perf_counter()
        write_copytext(df, copy)
        copy_write = time.perf_counter() - start
        start = time.perf_counter()
        df.write.parquet(parquet)
        parquet_write = time.perf_counter() - start

        def noop(frame):
            frame.write.format("noop").mode("overwrite").save()

        copy_read = best(lambda: noop(read_copytext(spark, copy, df.schema)))
        parquet_read = best(lambda: noop(spark.read.parquet(parquet)))
        print(f"{name} COPY text: {size(copy):,} bytes, write {copy_write:.2f} s, read {copy_read:.2f} s")
        print(f"{name} Parquet: {size(parquet):,} bytes, write {parquet_write:.2f} s, read {parquet_read:.2f} s")
    spark.stop()


if __name__ == "__main__":
    main()
