"""Run registered queries next to their SQL and report differences.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def oracle_rows(folder: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr), [
        (names[i], str(found.description[i][1])) for i in order
    ]


def spark_rows(df):
    names = sorted(df.columns)
    rows = df.select(*[f"`{n}`" for n in names]).collect()
    return names, sorted((tuple(r) for r in rows), key=repr)


def difference(spark, run, sql: str, folder: str) -> str | None:
    want_names, want, _ = oracle_rows(folder, sql)
    names, rows = spark_rows(run(spark, folder))
    if names != want_names:
        return f"columns {names} != {want_names}"
    if rows == want:
        return None
    ours, theirs = set(map(repr, rows)), set(map(repr, want))
    return (
        f"{len(rows)} rows, want {len(want)}\n  only here: {[r[:300] for r in sorted(ours - theirs)[:2]]}"
        f"\n  only in SQL: {[r[:300] for r in sorted(theirs - ours)[:2]]}"
    )


def main() -> None:
    from pagesieve.session import build_session
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(8)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            problem = difference(spark, queries[name], sql[name], folder) if name in sql else "no SQL"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{name:28} {time.time() - start:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main()
