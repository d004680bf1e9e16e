"""Run bound queries next to their SQL in DuckDB and compare values: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((v is None, str(type(v).__name__), str(v)) for v in row)


def compare(spark, con, query, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = query.run(spark, sf_dir)
    floats = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    names = sorted(df.columns)
    got = [tuple(_cell(r[c]) for c in names) for r in df.collect()]
    if not got:
        return "no rows"
    if query.sql is None:
        return None
    cur = con.execute(query.oracle())
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    if sorted(cols) != names:
        return f"columns differ: {names} != {sorted(cols)}"
    want = [tuple(_cell(row[cols.index(c)]) for c in names) for row in cur.fetchall()]
    if len(got) != len(want):
        return f"rows differ: {len(got)} != {len(want)}"
    for c in names:
        if (c in floats) != (types[c] in ("DOUBLE", "FLOAT")) and types[c] not in ("NULL",):
            return f"type of {c}: spark {dict(df.dtypes)[c]} sql {types[c]}"
        if "DECIMAL" in types[c] or "HUGEINT" in types[c]:
            return f"type of {c}: {types[c]}"
    norm = lambda rows: sorted((tuple(int(v) if isinstance(v, bool) else v for v in r) for r in rows), key=_key)
    bad = [(g, w) for g, w in zip(norm(got), norm(want), strict=True) if g != w]
    if bad:
        g, w = bad[0]
        diff = [(c, x, y) for c, x, y in zip(names, g, w, strict=True) if x != y]
        return f"{len(bad)} of {len(got)} rows differ; first: {diff[:4]} in {g[:6]}"
    unrounded = [c for c in floats if c not in query.rounded]
    return f"(note) not rounded: {unrounded}" if unrounded else None


def main() -> int:
    from hourglass.plans.catalog import load_all
    from hourglass.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark = local_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), 0
    for name, query in load_all().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        started = time.time()
        try:
            problem = compare(spark, con, query, sf_dir)
        except Exception as exc:  # noqa: BLE001 - a report line per query
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += bool(problem) and not problem.startswith("(note)")
        print(f"{'ok ' if not problem else 'BAD' if not problem.startswith('(note)') else 'ok '} {name} {time.time() - started:.1f}s {'' if query.sql else '(rows only)'} {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
