"""Run registered queries next to their SQL twins: ``python tests/oracle_check.py [name | @section ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, int):
        return float(f"{float(v):.9g}")
    return str(v)


SPARK_KINDS = {"byte": "int", "short": "int", "integer": "int", "long": "int", "float": "float", "double": "float", "string": "text", "boolean": "bool"}
DUCK_KINDS = {"TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "FLOAT": "float", "DOUBLE": "float", "VARCHAR": "text", "BOOLEAN": "bool"}


def kinds(spark_df, con, sql):
    """Columns whose type class differs; columns that are null throughout may have any type in SQL."""
    mine = {f.name: SPARK_KINDS.get(f.dataType.typeName(), f.dataType.typeName()) for f in spark_df.schema}
    twin = {r[0]: DUCK_KINDS.get(r[1], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {c: (k, twin.get(c)) for c, k in mine.items() if twin.get(c) != k and twin.get(c) != '"NULL"'}


def compare(spark_df, con, sql):
    cols = sorted(spark_df.columns)
    differ = kinds(spark_df, con, sql)
    if differ:
        return -1, f"types {differ}"
    got = [tuple(norm(v) for v in r) for r in spark_df.select(*cols).collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    if sorted(names) != cols:
        return len(got), f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in at) for r in rows]
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    got.sort(key=key)
    want.sort(key=key)
    if len(got) != len(want):
        sg, sw = set(got), set(want)
        extra, miss = [r for r in got if r not in sw][:2], [r for r in want if r not in sg][:2]
        return len(got), f"rows {len(got)} vs {len(want)}; cols {cols}; extra {extra}; missing {miss}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return len(got), f"{len(bad)} differ; cols {cols}; first {bad[0]}" if bad else ""


def main(names, sf_dir):
    from __spark_entry__ import oracle_sql, queries
    from bindloom.session import local_session

    spark, con = local_session(), connect(sf_dir)
    qs, oracles = queries(), oracle_sql()
    failed = []
    for name, fn in qs.items():
        section = fn.__module__.rsplit(".", 1)[-1]
        if names and not any(n == name or n == f"@{section}" for n in names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                n, problem = compare(df, con, oracles[name])
            else:
                n, problem = len(df.collect()), ""
            kind = "sql" if name in oracles else "rows"
            status = "ok  " if not problem else "FAIL"
        except Exception as e:
            n, kind, status = -1, "err", "FAIL"
            problem = "".join(traceback.format_exception_only(e))[:1500]
        if status == "FAIL":
            failed.append(name)
        print(f"{status} {kind:4} {name:28} {n:7} rows {time.time() - t0:6.2f}s {problem[:1500]}", flush=True)
    print("FAILED:", failed)


if __name__ == "__main__":
    main(sys.argv[1:], os.environ.get("SF_DIR", "/root/testdata/sf0.01"))
