"""Compare a query with its SQL on the same files; also runs as a script.

    python -m tests.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(path: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value.normalize() + 0))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def _kind(name: str) -> str:
    return {"hugeint": "HUGEINT"}.get(name.lower(), name.lower())


def difference(df, con, sql: str) -> str | None:
    """None when columns, rows and values agree exactly, else what does not."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]).lower() for d in result.description}
    want_cols, want = _sorted(names, result.fetchall())
    got_cols, got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} but SQL has {want_cols}"
    spark_names = {"int": "integer", "string": "varchar"}
    odd = [(c, t, types[c]) for c, t in df.dtypes if spark_names.get(t, t) != types[c].split(" ")[0] and not (
        t.startswith("decimal") and types[c].startswith("decimal") and t.split(",")[1] == types[c].replace(" ", "").split(",")[1])]
    if odd:
        return f"types {odd}"
    if len(got) != len(want):
        return f"{len(got)} rows but SQL has {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None


def main(argv):
    from tests.session import local_session
    from tillcast.catalog import CHECKS, QUERIES
    path = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con = local_session(), duck(path)
    failed = []
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, path)
            if name in CHECKS:
                problem, rows = difference(df, con, CHECKS[name]), "sql"
            else:
                rows = f"{len(df.collect())} rows"
                problem = None
        except Exception as error:  # noqa: BLE001  (report and go on with the next query)
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", "error"
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {rows:10s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
