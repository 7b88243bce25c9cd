from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of ``(doc_id, text)`` rows, with extra columns whose names operators use inside."""

    def make(rows):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
        for name in ("rank", "digest", "class_id", "bands", "label_0", "length", "piece"):
            df = df.withColumn(name, F.lit("clash"))
        return df

    return make
