"""The registered queries: names, oracles on given tables, and what the library is without this folder."""

import os
import subprocess
import sys

import pytest

from tests.llm.conftest import ROOT
from tests.oracle_check import compare

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    import __spark_entry__ as entry
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


def test_oracles(spark):
    import __spark_entry__ as entry
    keys = [k for k in entry.oracle_sql() if k.startswith("op")]
    assert keys
    res = compare(spark, SF, keys, verbose=False)
    assert all(v[0] == "ok" for v in res.values()), res


@pytest.mark.parametrize("name", ["op1_", "op2_", "op3_", "op5_", "op6_", "op7_", "op8_", "op9_"])
def test_other_queries_give_a_row_per_document(spark, name):
    import __spark_entry__ as entry
    key = next(k for k in entry.queries() if k.startswith(name))
    df = entry.queries()[key](spark, SF)
    assert df.columns[0] == "doc_id"
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    assert df.select("doc_id").exceptAll(docs).count() == 0 if name != "op1_" else df.select("doc_id").distinct().count() == docs.count()
    assert name == "op1_" or df.count() == docs.count()


def test_the_rest_stands_without_this_folder(tmp_path):
    code = ("import sys; sys.path.insert(0, %r)\n"
            "import importlib.util as u; find = u.find_spec\n"
            "u.find_spec = lambda n, *a: None if n in ('cairn.llm', 'corpus_pipeline') else find(n, *a)\n"
            "import __spark_entry__ as e\n"
            "assert e.queries() and not [k for k in e.queries() if k.startswith('op') or k == 'pipeline']\n"
            "assert e.oracle_sql() and not [m for m in sys.modules if m.startswith('cairn.llm')]\n") % ROOT
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(tmp_path), env={**os.environ, "PYTHONDONTWRITEBYTECODE": "1"})
