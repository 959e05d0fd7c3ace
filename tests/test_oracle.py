"""Registered queries against their SQL twins in DuckDB at the smallest scale.

The default run covers one query per family; set DOCKETRY_ALL=1 for all of them.
"""

import datetime as dt
import decimal
import os

import duckdb
import pytest

from docketry.plans import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMOKE = ("keyword_classify", "signal_classify", "intake_outcomes", "rule_analysis", "field_evaluate", "supplement_outcomes", "bm25_topk", "evidence_gate",
         "pii_residual", "chunk_documents", "routes_created", "staff_choice", "case_changes", "case_status", "related_cases",
         "nested_contracts", "stream_classification", "draft_repairs", "draft_checks", "case_states", "citations", "policy_redaction", "event_log", "document_records", "admin_view", "hybrid_retrieve")
CHOSEN = sorted(SQL) if os.environ.get("DOCKETRY_ALL") else SMOKE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, dt.datetime)):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 6) + 0.0
    return value


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = [tuple(plain(row[i]) for i in order) for row in table]
    return sorted(flat, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    assert not [c for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))]
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_every_query_without_sql_is_known():
    assert set(QUERIES) == set(SQL)


def test_names():
    assert not [n for n in QUERIES if "pipeline" in n or n.startswith("op")]


def test_claim_patterns_bind_together(duck):
    """A joined condition in front of the claim patterns holds for all of them."""
    from docketry.plans.retrieval_queries import _CLAIM_SQL

    for text in ("the token = 5", "Year 12345 x", "nothing"):
        assert duck.execute(f"SELECT FALSE AND {_CLAIM_SQL('$1')}", [text]).fetchone() == (False,)
