import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lodestrand.runtime import local_session

    session = local_session(8, 8)
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def emptied(spark, data, tmp_path_factory):
    """The tables without rows, with further columns whose names clash with those that operators use inside."""
    import glob

    from pyspark.sql import functions as F

    out = tmp_path_factory.mktemp("empty")
    for p in glob.glob(f"{data}/*.parquet"):
        rows = spark.read.parquet(p).limit(0)
        for c in ("id", "key", "class", "bucket", "n", "score", "rank", "a", "b", "value", "path", "keep"):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast("string"))
        rows.write.parquet(f"{out}/{os.path.basename(p)}")
    return str(out)


@pytest.fixture(scope="session")
def doubled(spark, data, tmp_path_factory):
    """The tables with every row twice, a null row, and further columns."""
    import glob

    from pyspark.sql import functions as F

    out = tmp_path_factory.mktemp("doubled")
    for p in glob.glob(f"{data}/*.parquet"):
        rows = spark.read.parquet(p)
        nulls = rows.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
        rows = rows.union(rows).union(nulls)
        for c in ("id", "key", "class", "bucket", "n", "score", "rank", "a", "b", "value", "path", "keep"):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit("?"))
        rows.coalesce(2).write.parquet(f"{out}/{os.path.basename(p)}")
    return str(out)
