"""Queries with SQL against DuckDB, the others for their columns, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from sparkloom.llm.queries import QUERIES
from sparkloom.llm.sql import SQL

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
FOUND = {
    "p1_found": {"item_kind", "item_key", "para_no", "sent_no"}, "p2_found": {"source_table", "kept_id", "copy_id"}, "p3_found": {"plan_id", "category"}, "p4_found": {"pred_id", "defect"},
    "p5_found": {"triple_id", "field_name", "entity_id"}, "p6_found": {"doc_id"}, "p7_found": {"doc_id", "item_id"}, "p8_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, str(DATA))
    rows = df.collect()
    assert rows
    if name in FOUND:
        assert set(df.columns) == FOUND[name] and len(rows) == len(set(rows))
    if name in SQL:
        con = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from '{p}'")
        result = con.execute(SQL[name])
        at = [[x[0] for x in result.description].index(c) for c in df.columns]
        assert sorted(map(str, (tuple(r[i] for i in at) for r in result.fetchall()))) == sorted(map(str, (tuple(r) for r in rows)))
