import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

# Columns that operators use inside, to see that a table's own columns of that name do no harm.
CLASHING = ["key", "row", "node", "size", "spans", "copies", "score", "_text", "label", "n"]
DOCUMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING])


def _odd_rows() -> list[tuple]:
    rng = random.Random(3)
    long = " ".join(rng.choice(["the", "of", "and", "river", "stone", "light", "q" + str(i)]) for i in range(60_000))
    again = "one two three four five six seven eight nine ten eleven"
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (9001, None, None, None, None), (9002, "", "en", None, 0), (9003, " \t\n ", None, "src1", 3),
        (9004, "Word", "en", "src1", 4), (9005, "word", "en", "", 4), (9006, "123 456 789 ...", "en", "src2", 15),
        (9007, long, "en", "src3", len(long)), (9008, long + " end", "en", "src3", len(long)),
        (9009, again, "en", "src4", 1), (9009, again, "en", "src4", 1), (9010, again + " twelve", "en", "src4", 1),
        (9011, "before it " + passage + " after it", "fr", "src5", 1), (9012, passage + " other end", "fr", "src5", 1),
        (9013, "the " * 100, "en", "src6", 1), (None, "a row without id", "en", "src6", 1),
        (9014, "<|endoftext|> it's ÉTÉ İstanbul Σίσυφος é \x1c x y <|startoftext|>", None, "src7", 1),
        (9015, "你好 \U0001f600 naïve ß", "de", "src7", 1),
    ]
    return [(*r, *[f"{c}!" for c in CLASHING]) for r in rows]


@pytest.fixture(scope="session")
def rows() -> list[dict]:
    """The given documents and odd ones."""
    given = [(*r.values(), *[None for _ in CLASHING]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    return [dict(zip(DOCUMENTS.names, r, strict=True)) for r in given + _odd_rows()]


@pytest.fixture(scope="session")
def documents(spark, rows):
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], DOCUMENTS).repartition(3)
    return frame.cache()


@pytest.fixture(scope="session")
def none(spark):
    """No documents."""
    return spark.createDataFrame([], DOCUMENTS)
