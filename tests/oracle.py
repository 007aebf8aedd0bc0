"""Comparison of a Spark result with its oracle SQL, also usable from the command line."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in records)


def compare(df, con, sql: str) -> list[str]:
    """Differences in columns, types and values; empty when both sides agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    types = dict(zip(names, [str(d[1]) for d in result.description]))
    for c, t in df.dtypes:
        if SPARK_TYPES.get(t) != types[c]:
            problems.append(f"type of {c}: {t} against {types[c]}")
    ours, theirs = rows_of(df.collect(), df.columns), rows_of(result.fetchall(), names)
    if len(ours) != len(theirs):
        problems.append(f"{len(ours)} rows against {len(theirs)}")
    if ours != theirs:
        extra, lacking = set(ours) - set(theirs), set(theirs) - set(ours)
        problems.append(f"values {sorted(df.columns)}: {len(extra)} only here {sorted(extra)[:2]}, "
                        f"{len(lacking)} only in SQL {sorted(lacking)[:2]}")
    return problems


def main(sf_dir: str, *wanted: str) -> int:
    from shelfcast.catalog import ORACLES, QUERIES
    from shelfcast.session import build_session

    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g",
                                         "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in wanted or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            problems = compare(df, con, ORACLES[name]) if name in ORACLES else []
        except Exception as e:  # report every query, then fail
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} {time.time() - start:.1f}s {'; '.join(problems)[:1200]}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]) and 1)
