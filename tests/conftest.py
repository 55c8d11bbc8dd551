import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from hirelake import configure

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate a column function on one value, or on a list of them."""

    def run(function, data, kind="string"):
        from pyspark.sql import functions as F

        many = isinstance(data, list)
        rows = [(i, x) for i, x in enumerate(data if many else [data])]
        df = spark.createDataFrame(rows, f"i int, x {kind}")
        out = df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
        return [r.y for r in out] if many else out[0].y

    return run


def listing(**given):
    """A listing row as a dict with defaults."""
    base = dict(
        title="Software Engineer", company="Acme", location="", url="https://x.test/1",
        description="", source="s", posted_date=None, job_id="1", seniority="", yoe_required=None,
        salary="", team="", metadata={},
    )
    return {**base, **given}


@pytest.fixture
def listings(spark):
    from hirelake.schema import LISTING

    def build(*rows):
        return spark.createDataFrame([tuple(listing(**r)[n] for n in LISTING.names) for r in rows], LISTING)

    return build
