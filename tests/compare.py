"""Run registered queries in Spark and their SQL in DuckDB and compare the results whole."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def compare(spark, con, name, sf_dir):
    """None if both sides agree, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_names, want = [c[0] for c in cur.description], cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    a, b = canonical(got, got_names), canonical(want, want_names)
    if a == b:
        return None if got else "no rows on either side"
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    return f"{len(a)} rows / {len(b)}; columns {sorted(got_names)}; Spark only {only_a}; SQL only {only_b}"


def main(sf_dir, names):
    from tests.session import session

    spark, con = session(), connect(sf_dir)
    bad = 0
    for name in names or entry.queries():
        t = time.time()
        try:
            diff = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            diff = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += diff is not None
        tag = "ok  " if diff is None else "BAD "
        if name not in entry.oracle_sql():
            tag = tag[:2] + "R "
        print(f"{tag} {time.time() - t:6.2f}s {name} {diff or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
