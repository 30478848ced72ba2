"""Every registered query against DuckDB, value for value."""

import re
import subprocess
import sys
from pathlib import Path

import compare
import pytest

import __spark_entry__ as entry

# The optional operators have tests of their own.
QUERIES = {k: q for k, q in entry.queries().items() if not re.match(r"op\d+_|pipeline$", k)}
SQL = {k: q for k, q in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck(sf):
    con = compare.connect(sf)
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, sf, name):
    assert compare.differences(QUERIES[name](spark, sf), duck, SQL[name]) == []


def test_entry(spark):
    assert entry.entry(spark).columns == ["Sentiment", "n", "pct"]


BLOCKED = """
import sys
class Finder:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == "{0}" or name == "{0}":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Finder())
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()))
"""


@pytest.mark.parametrize("missing", ["ahocorasick", "sentencepiece", "tokenizers", "opinara.llm", "corpus_pipeline"])
def test_the_rest_works_without_the_optional_part(missing):
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(missing)], capture_output=True, text=True,
                          cwd=Path(entry.__file__).parent, timeout=120, check=True)
    assert int(done.stdout.split()[0]) >= len(QUERIES) and int(done.stdout.split()[1]) >= len(SQL)
