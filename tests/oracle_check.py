"""Compare registered queries with their SQL twins: ``python tests/oracle_check.py SF [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _canon(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, int):
        return ("n", value)
    if isinstance(value, float):
        return ("f", value + 0.0)
    return (type(value).__name__, str(value))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_canon(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, query, sql):
    """Empty text if equal, otherwise the first differences."""
    result = query(spark, sf_dir)
    mine = _rows(result.columns, result.collect())
    other = con.sql(sql)
    theirs = _rows(other.columns, other.fetchall())
    if sorted(result.columns) != sorted(other.columns):
        return f"columns {sorted(result.columns)} / {sorted(other.columns)}"
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    duck_kinds = dict(zip(other.columns, map(str, other.types)))
    wrong = [(c, k, duck_kinds[c]) for c, k in result.dtypes if kinds.get(k) != duck_kinds[c]]
    if wrong:
        return f"types {wrong}"
    if mine == theirs:
        return "" if mine else "no rows on either side"
    only_mine = [r for r in mine if r not in set(theirs)][:3]
    only_theirs = [r for r in theirs if r not in set(mine)][:3]
    return f"rows {len(mine)} / {len(theirs)}\n  spark {only_mine}\n  duck  {only_theirs}"


def main():
    import __spark_entry__ as entry
    from cashtrail.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark, con = local_session(), duck(sf_dir)
    wanted, sqls, bad = sys.argv[2:], entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, sf_dir, name, query, sqls[name])
            else:
                rows = query(spark, sf_dir).count()
                problem = "" if rows else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        kind = "sql" if name in sqls else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
