import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def texts(spark):
    """(doc_id, text, source) of the small table."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()
    return [tuple(r) for r in rows]


@pytest.fixture
def odd_rows(texts):
    """Nulls, empty, blank and very long texts, repeated rows, one id for two texts, ties."""
    long = " ".join(t for _, t, _ in texts if t)
    first = texts[0][1]
    return [
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, " \n\t\x0b ", "en", None, 4),
        (None, first, None, None, 5),
        (4, long, "en", "b", len(long)),
        (5, first, "en", "b", len(first)),
        (5, first, "en", "b", len(first)),
        (5, "another text of the same id", "en", "b", 3),
        (6, first, "en", "c", len(first)),
        (7, "word", "en", "c", 4),
        (8, "𝔘nicode \u0085 　 ñandú ABC", "en", "c", 4),
        *[(100 + i, t, "en", s, len(t)) for i, t, s in texts[:60]],
    ]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing():
    """Adds columns that are named like the operators' own."""
    from pyspark.sql import functions as F

    names = (
        "key size crc tie range shard slot before row total p n th unit mass copies target rows w n_words matches items id"
        " fp a b u v root own_id kept_id line site paragraph entities c0 c1 conv msg score path text_hash words pairs"
    ).split()
    return lambda df: df.select("*", *[F.lit(-1).alias(x) for x in names if x not in df.columns])
