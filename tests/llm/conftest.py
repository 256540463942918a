import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) rows, with columns whose names operators use inside."""
    def build(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], SCHEMA)
        if extra:
            for name in ("node", "label", "kept", "row", "token", "size"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df
    return build


@pytest.fixture(scope="session")
def sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in rows]
