"""Runs a query and its SQL on the same tables and compares the rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted([columns[k] for k in order]), sorted(([str(show(r[k])) for k in order] for r in rows))


def assert_same(spark, query, sql, sf_dir="/root/testdata/sf0.001"):
    got = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    want = _rows([d[0] for d in found.description], found.fetchall())
    have = _rows(got.columns, [tuple(r) for r in got.collect()])
    assert have[0] == want[0]
    assert have[1] == want[1]
