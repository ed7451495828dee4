"""Run registered queries and their SQL side by side.

    python tests/compare.py [--sf 0.01] [key ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return ("float", round(value, 6))
    return (type(value).__name__, value)


def bag(rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark, con, key, build, sql, sf_dir) -> list[str]:
    df = build(spark, sf_dir)
    mine = bag([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = bag(cur.fetchall(), names)
    out = []
    if sorted(df.columns) != sorted(names):
        out.append(f"columns {sorted(df.columns)} vs {sorted(names)}")
    elif mine != theirs:
        out.append(f"rows {sum(mine.values())} vs {sum(theirs.values())}")
        for label, rest in (("spark only", mine - theirs), ("sql only", theirs - mine)):
            for row in list(rest)[:3]:
                out.append(f"{label}: {[v for _, v in row]} {[t for t, _ in row]}")
    elif not mine:
        out.append("both empty")
    return out


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("keys", nargs="*")
    args = parser.parse_args()
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = connect(sf_dir)
    checks, bad = entry.oracle_sql(), []
    for key, build in entry.queries().items():
        if args.keys and key not in args.keys:
            continue
        start = time.time()
        try:
            if key in checks:
                found = differences(spark, con, key, build, checks[key], sf_dir)
            else:
                found = [] if build(spark, sf_dir).count() else ["no rows"]
        except Exception as error:  # noqa: BLE001
            found = [str(error)[:1500]]
        print(f"{'ok ' if not found else 'BAD'} {key} {time.time() - start:.1f}s", *found, sep="\n    " if found else " ", flush=True)
        if found:
            bad.append(key)
    print("bad:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
