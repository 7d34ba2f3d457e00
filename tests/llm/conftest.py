import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from cairn.session import build_session
    yield build_session("local[4]", shuffle_partitions=4)


#: Texts with every awkward kind: null, empty, blanks only, ties, repeats, non-ASCII, special strings.
TEXTS = [
    None, "", " \n\t ", "one", "One two three four", "the quick brown fox jumps over the lazy dog",
    "The quick  brown fox\tjumps over the LAZY dog", "the quick brown fox jumps over the lazy dog",
    "Élan vital naïve façade — Straße ΑΣ İ <|endoftext|> 😀 it's ½ …\r\nline\x0btwo\x1c\x85end",
    "x" * 3000, "word " * 500, "\n\n\nabc\n", "a" * 50 + "\n" + "b" * 45,
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with nulls in any column, repeated rows, repeated ids, and extra columns with clashing names."""
    rows = [(i, t, "n", i, "k") for i, t in enumerate(TEXTS)]
    rows += [(3, "one", None, None, None), (3, "one", None, None, None), (None, "null id", "x", 1, "y"), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, id string, n bigint, `key` string")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


def write_tables(spark, tmp, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp}/{name}.parquet")
    return str(tmp)
