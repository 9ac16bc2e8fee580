import pytest
from pyspark.sql import functions as F


@pytest.fixture
def hard_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and a column with a clashing name."""
    rows = [(1, "a b c"), (2, None), (3, ""), (None, "x y z"), (4, "  \n "), (5, "w " * 30_000), (5, "w " * 30_000), (6, "é" * 50)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"source": F.lit(None).cast("string"), "score": F.lit(1), "spans": F.lit("s"), "word": F.lit("w")})
