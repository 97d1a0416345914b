"""Compare every named query with its SQL counterpart: ``python tests/check_queries.py SF_DIR [name …]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def key(row):
    return tuple((v is None, str(v)) for v in row)


def difference(spark, con, sf_dir: str, query, sql: str) -> tuple[str | None, int]:
    """What differs in columns, types, number or values of rows, and the number of rows."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    mine = sorted((tuple(r) for r in df.select(*names).collect()), key=key)
    res = con.execute(sql)
    theirs_names = [d[0] for d in res.description]
    if sorted(theirs_names) != names:
        return f"columns {names} and {sorted(theirs_names)}", len(mine)
    order = [theirs_names.index(n) for n in names]
    theirs = sorted((tuple(r[i] for i in order) for r in res.fetchall()), key=key)
    if len(mine) != len(theirs):
        only = set(map(str, mine)) ^ set(map(str, theirs))
        return f"{len(mine)} and {len(theirs)} rows, e.g. {sorted(only)[:2]}", len(mine)
    for a, b in zip(mine, theirs, strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} and {b}", len(mine)
    return None, len(mine)


def main(sf_dir: str, *only: str) -> int:
    from scangrove.plans.oracle import ORACLES
    from scangrove.plans.queries import QUERIES
    from scangrove.session import local_session

    spark, con, bad = local_session(8, 8, "8g"), connect(sf_dir), 0
    assert set(ORACLES) <= set(QUERIES)
    for name, query in QUERIES.items():
        if only and name not in only:
            continue
        start = time.time()
        if name in ORACLES:
            try:
                wrong, n = difference(spark, con, sf_dir, query, ORACLES[name])
            except Exception as error:  # noqa: BLE001 - reported, and counted as a failure
                wrong, n = f"error {str(error)[:500]}", 0
        else:
            wrong, n = None, query(spark, sf_dir).count()
        bad += wrong is not None
        print(f"{name:32s} {n:7d} {time.time() - start:6.2f} {'' if name in ORACLES else '(rows only)'} {wrong or ''}"[:900], flush=True)
    print(f"{bad} differences")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(*sys.argv[1:]))
