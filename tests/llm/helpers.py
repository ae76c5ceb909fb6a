"""Small tables for the operators' tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, rows) -> DataFrame:
    """Rows of (doc_id, text[, lang[, source]])."""
    full = [(*r, *(("en", "s") [len(r) - 2 :]))[:4] for r in rows]
    return spark.createDataFrame([(i, t, k, s, len(t or "")) for i, t, k, s in full], DOCS)


#: Nulls, empty and blank texts, odd white space and letters, repeated rows, a repeated id, a long text.
EDGES = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "a b c d e f g h i j k"), (5, "a b c d e f g h i j k"), (6, "A b c d e f g h i j k"), (7, "x\u00a0y\u0085z \u2003w"),
    (8, "éÉß 中文 🙂 \U0001d11e"), (None, "no id here at all"), (9, "long " * 6000), (10, None, None, None), (10, "same id, other text", None, None),
]
