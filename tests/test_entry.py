"""Driver contract and a fast oracle sample at sf0.001."""

import duckdb

from conftest import SF

TABLES = ["customer", "orders", "events"]
SAMPLE = ["minimal_slice", "W1_W9_split_forced", "J1_J2_matchup_join", "A11_J8_edge_sweep",
          "D2_S4_ingest_feed", "J3_L9_serve_features", "W12_ts_folds"]


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns[0] == "season" and df.count() > 0


def test_oracle_keys_subset(spark):
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(rows):
    key = lambda v: (0, "") if v is None else ((1, round(v, 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else (2, str(v)))
    return sorted(tuple(key(v) for v in r) for r in rows)


def test_oracle_sample(spark):
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in SAMPLE:
        df = E.queries()[name](spark, SF)
        cols = sorted(df.columns)
        s = _norm(df.select(*cols).collect())
        cur = con.execute(E.oracle_sql()[name])
        names = [d[0] for d in cur.description]
        idx = [names.index(c) for c in cols]
        o = _norm([tuple(r[i] for i in idx) for r in cur.fetchall()])
        assert s == o, name
