import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """``frame("a int, b string", (1, "x"), …)``: timestamps may be given as text."""
    from datetime import datetime
    from decimal import Decimal

    from pyspark.sql import types as T

    def convert(value, kind):
        if value is None:
            return None
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType)) and isinstance(value, str):
            return datetime.fromisoformat(value)
        if isinstance(kind, T.DecimalType):
            return Decimal(str(value))
        return value

    def make(schema, *rows):
        fields = spark.createDataFrame([], schema).schema
        data = [tuple(convert(v, f.dataType) for v, f in zip(r, fields.fields, strict=True)) for r in rows]
        return spark.createDataFrame(data, fields)

    return make


def as_dicts(df, key=None):
    found = [r.asDict(recursive=True) for r in df.collect()]
    return found if key is None else {r[key]: r for r in found}


def column(df, value, key="id"):
    return {r[key]: r[value] for r in df.select(key, value).collect()}
