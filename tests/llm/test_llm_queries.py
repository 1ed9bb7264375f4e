from pathlib import Path

import duckdb
import pytest

from marginalia.llm import queries
from tests.conftest import plain


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, tiny, name):
    con = duckdb.connect()
    for p in Path(tiny).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr) == expected


FOUND = {
    "p1_found": ["item_key", "normalized_name"],
    "p2_found": ["kind", "name_a", "name_b"],
    "p4_found": ["kind", "left_value", "right_value"],
    "p6_found": ["item_key", "seg_no", "language"],
    "p7_found": ["attachment_key", "line_no", "kind", "fixed"],
    "p9_found": ["item_id", "doc_id"],
    "p10_found": ["doc_id", "span_start", "span_end"],
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns_and_distinct_rows(spark, tiny, name):
    df = queries.QUERIES[name](spark, tiny)
    assert df.columns == FOUND[name]
    rows = df.collect()
    assert len(rows) == len(set(rows))
