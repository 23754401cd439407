"""A few registered queries against their SQL at the smallest scale; tools/check.py runs them all."""
import os

import duckdb
import pytest

from vacancia.catalog import load_all

SF = "/root/testdata/sf0.001"
NAMES = ["plan_ranked_new_postings", "flt02_location_filter", "tgt08_fit", "jon09_addition_match", "dup07_office_merge", "agg04_archetypes",
         "agg23_feed_audit", "win04_entry_numbers", "src09_markdown_table", "enr12_liveness", "set04_ledger_merge", "str05_weekly_activity"]
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def flat(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    q = load_all()[name]
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = q.run(spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(flat(v) for v in r) for r in df.select(*cols).collect()), key=str)
    picked = ", ".join(f'"{c}"' for c in cols)
    want = sorted((tuple(flat(v) for v in r) for r in con.sql(f"SELECT {picked} FROM ({q.oracle()})").fetchall()), key=str)
    assert got == want and got


def test_every_query_is_registered_once():
    queries = load_all()
    assert len(queries) > 230
    assert {n for n, q in queries.items() if not q.sql} == {"jon03_first_wins", "dup08_tracker_clusters", "enr03_experience"}
