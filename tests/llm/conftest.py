import os

import pytest
from pyspark.sql import Row

os.environ.setdefault("PYTHONDONTWRITEBYTECODE", "1")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) as a documents table, with columns whose names the operators use themselves."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        if extra:
            for name in ("text_", "n", "key", "rep", "found", "ids", "bucket", "kind", "score", "_key", "start"):
                df = df.withColumn(name, df.lang)
        return df.repartition(3)

    return make


@pytest.fixture(scope="session")
def rows_of():
    def collect(df) -> list[Row]:
        return sorted(df.collect(), key=lambda r: tuple((x is None, str(x)) for x in r))

    return collect
