import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_key long, row long, size long, words string, _q int, grp long"


@pytest.fixture(scope="session")
def frame(spark, tmp_path_factory):
    """Rows (doc_id, text[, source[, lang]]) as a table of files, with extra columns whose names clash with the operators' own."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))

    def make(rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s0", None, 1, 2, 3, "x", 4, 5) for r in rows]
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        spark.createDataFrame(full, SCHEMA).coalesce(2).write.parquet(path)
        return spark.read.parquet(path)
    return make


LONG = " ".join(f"w{i * i % 977}x{i % 13}" for i in range(6000))
#: null and empty texts, null ids, repeated rows, white space only, signs only, a very long text, other spaces
EDGES = [(1, None), (2, ""), (3, " \t\n\r\x0b\f "), (None, "alone here"), (None, None), (4, "one"), (5, "one two"), (6, "one two three"), (6, "one two three"),
         (7, LONG), (8, LONG), (9, "a b c \U0001F600 é"), (10, "### *** $$$"), (11, "x" * 30000), (12, LONG + " tail")]


@pytest.fixture(scope="session")
def edges(frame):
    return frame(EDGES)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
