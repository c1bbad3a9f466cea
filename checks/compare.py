"""Run registered queries against their SQL: python -m checks.compare [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb

from checks.oracles import ORACLES
from checks.queries import QUERIES
from tidelog.session import get_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def close(a, b):
    return a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and abs(a - b) <= 1e-6)


def main(sf: str, names: list[str]) -> int:
    spark = get_session(
        "tidelog-compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf)
            got = normal([tuple(r) for r in df.collect()], df.columns)
            took = round(time.time() - start, 1)
            if name not in ORACLES:
                print(f"{name}: {len(got)} rows, no SQL, {took}s", flush=True)
                continue
            cur = con.execute(ORACLES[name])
            columns = [d[0] for d in cur.description]
            want = normal(cur.fetchall(), columns)
            same = sorted(columns) == sorted(df.columns) and len(got) == len(want) and got == want
            if same:
                print(f"{name}: ok, {len(got)} rows, {took}s", flush=True)
                continue
            bad += 1
            diff = [(g, w) for g, w in zip(got, want) if not all(map(close, g, w))]
            print(f"{name}: DIFFERS {len(got)} / {len(want)} rows, columns {sorted(set(columns) ^ set(df.columns))}, {took}s")
            print("   ", diff[:2] or (got[:1], want[:1]), flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name}: FAILED {str(e)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    sys.exit(1 if main(sf_dir, args[1:]) else 0)
