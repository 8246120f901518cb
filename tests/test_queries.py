"""Every registered core query against its SQL."""

from __future__ import annotations

import pytest

from mnemark.plans import archive, general, intake, people, retrieval  # noqa: F401

from .conftest import DATA
from .oracle import connect, rows

ALL = {**archive.QUERIES, **general.QUERIES}
SQL = {**archive.SQL, **general.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    got = ALL[name](spark, DATA)
    cur = connect(DATA).execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, cur.fetchall())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_nested_loops(spark):
    for name in ("candidate_prefilter", "timeline_digest", "event_link", "resolve_prefix", "duplicate_names", "p4_found"):
        p = plan_of(ALL[name](spark, DATA))
        assert "NestedLoop" not in p and "Cartesian" not in p, name


def test_scan_reads_only_what_it_needs(spark):
    p = plan_of(ALL["extension_types"](spark, DATA))
    assert "ReadSchema: struct<type:string>" in p


def test_core_stands_without_llm():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "mnemark"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            for n in ast.walk(ast.parse(f.read_text())):
                names = [n.module or ""] if isinstance(n, ast.ImportFrom) else [a.name for a in n.names] if isinstance(n, ast.Import) else []
                assert not any(x.startswith("mnemark.llm") for x in names), f
