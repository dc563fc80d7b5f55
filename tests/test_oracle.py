"""Each registered query against its SQL in DuckDB, on the same whole tables."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from millrace.sources.tables import SCHEMAS

#: No HUGEINT: integer sums must be cast to BIGINT in the SQL.
DUCK_TO_SPARK = {
    "BOOLEAN": "boolean",
    "FLOAT": "float",
    "FLOAT[]": "array<float>",
    "DATE": "date",
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "TIMESTAMP": "timestamp_ntz",
}


#: Queries that SQL cannot express; each is tested otherwise.
NO_SQL = {
    "op1_decontaminate",  # greedy tiling; brute force
    "op5_suffix_tree_lm",  # tree scores; brute force for counts, sums to one
    "op6_sentence_spans",  # sentence runs of varying length; brute force
    "op7_sentencepiece",  # the library's tokenizer; compared with the library
    "op8_pii",  # iterative scores; brute force
    "op10_language_id",  # learnt model; held-out accuracy
    "pipeline",  # holds three of these
}


def null_safe(row):
    return [(value is not None, value) for value in row]


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    return con.sql(sql)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, name, sf):
    sf_dir = f"/root/testdata/{sf}"
    got = __spark_entry__.queries()[name](spark, sf_dir)
    want = duck(sf_dir, __spark_entry__.oracle_sql()[name])
    columns = sorted(got.columns)

    assert columns == sorted(want.columns)
    want_types = {c: DUCK_TO_SPARK[str(t)] for c, t in zip(want.columns, want.types)}
    assert dict(got.dtypes) == want_types

    got_rows = sorted((tuple(r) for r in got.select(columns).collect()), key=null_safe)
    want_rows = sorted(want.select(*columns).fetchall(), key=null_safe)
    assert got_rows
    assert got_rows == want_rows


def test_every_oracle_has_a_query():
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) == names - NO_SQL


def test_entry_returns_rows_and_a_stable_schema(spark):
    first, second = __spark_entry__.entry(spark), __spark_entry__.entry(spark)
    assert first.schema == second.schema
    assert first.count() > 0


def test_entry_file_loads_by_path_from_another_directory(tmp_path):
    path = Path(__spark_entry__.__file__).resolve()
    code = (
        "import importlib.util as u; "
        f"s = u.spec_from_file_location('contract', {str(path)!r}); "
        "m = u.module_from_spec(s); s.loader.exec_module(m); "
        "assert m.queries() and m.oracle_sql()"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60)
