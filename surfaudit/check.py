"""Run registered queries next to their SQL twins and compare whole results.

usage: python -m surfaudit.check [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

from surfaudit.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def compare(spark, con, entry, sf: str) -> tuple[bool, str]:
    start = time.time()
    df = entry.run(spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    took = time.time() - start
    if entry.sql is None:
        return len(got) > 0, f"rows={len(got)} no twin, spark {took:.1f}s"
    start = time.time()
    result = con.execute(f"SELECT {', '.join(names)} FROM ({entry.sql}) AS t")
    want = sorted((tuple(r) for r in result.fetchall()), key=repr)
    note = f"rows={len(got)}/{len(want)} spark {took:.1f}s duckdb {time.time() - start:.1f}s"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w][:2]
        note += f"\n    columns {names}\n    " + "\n    ".join(f"{g} != {w}" for g, w in bad)
    return got == want and bool(got), note


def main(argv: list[str]) -> int:
    from surfaudit.plans import load_entries

    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                                "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf), []
    entries = load_entries()
    for name, entry in entries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            ok, note = compare(spark, con, entry, sf)
        except Exception as error:  # report and go on with the other queries
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {' '.join(failed)}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
