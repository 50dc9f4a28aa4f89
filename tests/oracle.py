"""Runs registered queries beside their SQL in DuckDB: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """A comparable form: NaN and NULL are one thing, other values keep their type."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def compare(df, con, query: str) -> str | None:
    """None when both sides hold the same columns and rows, else what differs."""
    result = con.execute(query)
    names = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    order = sorted(names)
    theirs = sorted(tuple(plain(row[names.index(c)]) for c in order) for row in result.fetchall())
    mine_rows = df.collect()
    mine = sorted(tuple(plain(r[c]) for c in order) for r in mine_rows)
    simple = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = [(n, t, kinds[n]) for n, t in df.dtypes if simple.get(t) != kinds[n]]
    if mine == theirs:
        return f"same rows ({len(mine)}), types differ {types}" if types else None
    only = [r for r in mine if r not in set(theirs)][:2], [r for r in theirs if r not in set(mine)][:2]
    return f"{len(mine)} vs {len(theirs)} rows, {order}, only spark {only[0]}, only sql {only[1]}"


def main(argv: list[str]) -> None:
    from __spark_entry__ import oracle_sql, queries
    from foldloom.session import local_session

    sf_dir = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    spark, con = local_session(), connect(sf_dir)
    wanted = argv[1:] or list(queries())
    sqls, bad = oracle_sql(), 0
    for name in wanted:
        start = time.time()
        try:
            df = queries()[name](spark, sf_dir)
            note = compare(df, con, sqls[name]) if name in sqls else f"no SQL, {len(df.collect())} rows"
        except Exception as error:  # report and go on with the next query
            note = f"{type(error).__name__}: {str(error)[:700]}"
        bad += note is not None and not note.startswith("no SQL")
        print(f"{name:28s} {time.time() - start:6.2f}s  {note or 'ok'}", flush=True)
    print(f"{len(wanted)} queries, {bad} differ")


if __name__ == "__main__":
    main(sys.argv[1:])
