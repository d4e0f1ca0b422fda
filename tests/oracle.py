"""Rows of a query held against the rows of its SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings moderation_labels entities relations canonical_entities alias_map rules rule_json sections chunk_texts".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    theirs = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert ours[0] == theirs[0], (ours[0], theirs[0])
    assert len(ours[1]) == len(theirs[1]), (len(ours[1]), len(theirs[1]))
    for a, b in zip(ours[1], theirs[1]):
        assert a == b, (a, b)
    return len(ours[1])
