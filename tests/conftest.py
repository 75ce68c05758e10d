import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from maskframe.session import builder  # noqa: E402

SALT = "grain-of-7"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        builder("tests").master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def suppliers(spark):
    """Three suppliers with something to hide in every text column; the label is made of two of them."""
    rows = [
        (4, "sales@north-mill.test", "North Mill", "DE-4410-77", "pays late"),
        (5, "office@harbour.test", "Harbour & Sons", "FR-0093-12", "calls on Mondays"),
        (9, "hello@quarry.test", "Quarry", "ES-7120-03", "pays late"),
    ]
    made = [(*r, f"{r[2]} / {r[3]}") for r in rows]
    return spark.createDataFrame(made, "suppkey bigint, contact string, firm string, tax_no string, remark string, label string")


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)
