import hashlib

import pytest
from conftest import SALT, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe import ColumnSpec, PlanError, ScrubConfig, TableSpec, plan, scrub
from maskframe.functions.transforms import lookup_builtin, new_salt, sql_expression
from maskframe.queries import QUERIES
from maskframe.sources.snapshot import scrubbed_frames


def md5(text, salt=SALT):
    return hashlib.md5((text + salt).encode()).hexdigest()


def config(columns=None, table="public.suppliers", **more):
    body = {**({"columns": columns} if columns else {}), **more}
    return ScrubConfig.parse({"version": 1, "tables": {table: body}})


def spec(*columns, **kwargs):
    return TableSpec("public", "suppliers", tuple(columns), **kwargs)


TEXT = ColumnSpec("c")
INT = ColumnSpec("c", T.IntegerType(), "integer")


def varchar(n):
    return ColumnSpec("c", T.StringType(), "character varying", max_len=n)


def one(spark, column, rule, value="Alpha", kind="string"):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    return scrub(df, spec(column), config({"c": rule}), SALT).first()["c"]


def test_builtins(spark):
    assert one(spark, TEXT, "md5") == md5("Alpha")
    assert one(spark, varchar(20), "md5") == md5("Alpha")[:20]
    assert one(spark, varchar(40), "md5") == md5("Alpha")
    assert one(spark, TEXT, "email") == f"user_{md5('Alpha')}@example.invalid"
    assert one(spark, varchar(30), "email") == f"user_{md5('Alpha')[:9]}@example.invalid"
    assert one(spark, varchar(22), "email") == f"user_{md5('Alpha')[:1]}@example.invalid"
    assert one(spark, TEXT, "redact") == "REDACTED"
    assert one(spark, varchar(4), "redact") == "REDA"
    assert one(spark, TEXT, "null") is None
    assert one(spark, TEXT, " NULL ") is None
    assert one(spark, INT, "42", 7, "int") == 42
    assert one(spark, TEXT, "c || '!'") == "Alpha!"


def test_fixed_length_text_is_padded(spark):
    col = ColumnSpec("c", T.StringType(), "character", max_len=40)
    assert one(spark, col, "md5") == md5("Alpha") + " " * 8
    short = ColumnSpec("c", T.StringType(), "character", max_len=5)
    assert one(spark, short, "redact") == "REDAC"


def test_null_handling(spark):
    assert one(spark, TEXT, "md5", None) is None
    assert one(spark, TEXT, "email", None) is None
    assert one(spark, TEXT, "redact", None) == "REDACTED"


def test_typed_nulls_can_be_written(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0])], "c int, d array<double>")
    table = TableSpec.from_df("public.suppliers", df)
    out = scrub(df, table, config({"c": "null", "d": "null"}), SALT)
    assert out.dtypes == df.dtypes
    out.write.parquet(str(tmp_path / "x"))


def test_builtin_names_are_exact():
    assert lookup_builtin(" Email ") == "email"
    assert lookup_builtin("mdf5") is None
    assert lookup_builtin("md5(c)") is None


def test_salt_in_sql(spark):
    df = spark.createDataFrame([("x",)], "c string")
    quoted = df.select(sql_expression("c || ':salt' || :salt || '''' || :salt", "a'b\\c").alias("v"))
    assert quoted.first()["v"] == "x:salta'b\\c'a'b\\c"
    cast = df.select(sql_expression("'5'::int + length(:salt)", "abc").alias("v"))
    assert cast.first()["v"] == 8


def test_salts_rotate(spark, suppliers):
    table = TableSpec.from_df("public.suppliers", suppliers)
    cfg = config({"contact": "email"})
    a, b = new_salt(), new_salt()
    assert len(a) == 32 and a != b
    first = {r["contact"] for r in scrub(suppliers, table, cfg, a).collect()}
    again = {r["contact"] for r in scrub(suppliers, table, cfg, a).collect()}
    other = {r["contact"] for r in scrub(suppliers, table, cfg, b).collect()}
    assert first == again and not first & other


def test_a_table_with_every_kind_of_rule(suppliers):
    """Filtered on a raw value that is scrubbed itself; the generated column is left for the load to make."""
    table = TableSpec.from_df(
        "public.suppliers", suppliers, not_null=["suppkey", "contact"], identity=["suppkey"],
        max_len={"contact": 32, "firm": 12}, generated={"label": "firm || ' / ' || tax_no"},
    )
    cfg = config(
        {"contact": "email", "firm": "md5", "tax_no": "left(tax_no, 2)", "remark": "redact"}, where="remark = 'pays late'"
    )
    got = [tuple(r) for r in scrub(suppliers, table, cfg, SALT).orderBy("suppkey").collect()]
    raw = {r["suppkey"]: r for r in suppliers.collect()}
    assert got == [
        (k, f"user_{md5(raw[k]['contact'])[:11]}@example.invalid", md5(raw[k]["firm"])[:12], raw[k]["tax_no"][:2], "REDACTED")
        for k in (4, 9)
    ]


@pytest.mark.parametrize(
    "column, rule, message",
    [
        (INT, "md5", "md5 makes text and the column is integer"),
        (INT, "email", "makes text"),
        (INT, "redact", "makes text"),
        (varchar(21), "email", "room for 21"),
        (ColumnSpec("c", not_null=True), "null", "must have a value"),
        (ColumnSpec("c", base_type="uuid"), "md5", "is uuid"),
        (ColumnSpec("c", generated="x"), "md5", "generated from other columns"),
    ],
)
def test_rejected_at_plan_time(column, rule, message):
    with pytest.raises(PlanError, match=message):
        plan([spec(ColumnSpec("id"), column)], config({"c": rule}))


def test_text_bases_take_builtins():
    for base in ("text", "character varying", "character", "citext", "name"):
        plan([spec(ColumnSpec("c", base_type=base))], config({"c": "md5"}))


def test_every_problem_is_reported():
    tables = [
        spec(INT, ColumnSpec("g", generated="c")),
        TableSpec("public", "parent", (TEXT,), kind="partitioned"),
        TableSpec("public", "made", (ColumnSpec("g", generated="1"),)),
    ]
    cfg = ScrubConfig.parse({"version": 1, "tables": {
        "public.suppliers": {"columns": {"c": "md5", "g": "md5", "gone": "md5"}},
        "public.parent": {"mode": "skip"},
        "public.absent": {"mode": "skip"},
    }})
    with pytest.raises(PlanError) as e:
        plan(tables, cfg)
    text = str(e.value)
    assert len(e.value.problems) == 6
    for part in ("suppliers.c: md5 makes text", "suppliers.g: generated", "suppliers.gone: no such column",
                 "parent: rules on a partitioned table", "absent: no such table", "every column is generated"):
        assert part in text


def test_empty_plan_is_an_error():
    with pytest.raises(PlanError, match="no table to export"):
        plan([], ScrubConfig())
    with pytest.raises(PlanError, match="no table to export"):
        plan([TableSpec("public", "p", (TEXT,), kind="partitioned")], ScrubConfig())


def test_manifest_side_of_a_plan():
    (p,) = plan([spec(ColumnSpec("id", identity=True), TEXT)], config({"c": "md5"}))
    assert p.columns == ["id", "c"] and p.transforms == {"c": "md5"}
    (skipped,) = plan([spec(TEXT)], config(mode="skip"))
    assert skipped.skipped and skipped.columns == []


def test_bad_sql_is_found_before_any_job(spark, suppliers):
    table = TableSpec.from_df("public.suppliers", suppliers)
    plans = plan([table], config({"contact": "no_such_column || 'x'"}))
    with pytest.raises(PlanError, match="public.suppliers"):
        scrubbed_frames({"public.suppliers": suppliers}, plans, SALT)


def test_rules_see_raw_values(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "d")], "x string, y string")
    table = TableSpec.from_df("public.suppliers", df)
    cfg = config({"x": "y", "y": "x"}, where="x = 'a'")
    assert rows(scrub(df, table, cfg, SALT)) == [("b", "a")]


def test_metadata_beats_the_spark_type(spark):
    schema = T.StructType([
        T.StructField("u", T.StringType(), True, {"base_type": "uuid"}),
        T.StructField("v", T.StringType(), True, {"max_len": 12}),
    ])
    table = TableSpec.from_schema("public.t", schema)
    assert not table.column("u").textual
    assert table.column("v").type_name == "character varying(12)"


def test_declared_lengths_are_read():
    hidden = {"__CHAR_VARCHAR_TYPE_STRING": "varchar(9)"}
    table = TableSpec.from_schema("public.t", T.StructType([
        T.StructField("v", T.VarcharType(7)), T.StructField("c", T.CharType(3)),
        T.StructField("h", T.StringType(), True, hidden),
    ]))
    assert [c.type_name for c in table.columns] == ["character varying(7)", "character(3)", "character varying(9)"]


@pytest.mark.parametrize("name", ["scrub_md5", "scrub_raw_sql", "scrub_documents", "filter_where"])
def test_scrub_never_shuffles(spark, name):
    text = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


def test_filters_and_columns_reach_the_scan(spark):
    df = QUERIES["filter_before_scrub"](spark, "/root/testdata/sf0.001")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in text
    redacted = QUERIES["scrub_redact"](spark, "/root/testdata/sf0.001")
    text = redacted._jdf.queryExecution().executedPlan().toString()
    assert "p_name:string" not in text and "p_brand:string" in text


def test_generated_salt_is_not_in_rendered_plans(spark, suppliers):
    salt = new_salt()
    df = scrub(suppliers, TableSpec.from_df("public.suppliers", suppliers), config({"contact": "md5"}), salt)
    shown = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "extended")
    assert salt not in shown


def test_hot_value_keeps_every_row(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 1000, "hot").otherwise(F.col("id").cast("string")).alias("c"))
    out = scrub(df, TableSpec.from_df("public.suppliers", df), config({"c": "md5"}), SALT)
    assert out.filter(F.col("c") == md5("hot")).count() == 1000
