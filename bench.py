"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

    python bench.py             headline queries, one warm-up pass of the session, then one timed run
    python bench.py --all       every registered query
    python bench.py --warm      adds a second run of each in the same session
    python bench.py --sql       adds the DuckDB time of the same question as a yardstick
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from stewardry.plans import QUERIES


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stewardry-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    wanted = [a for a in sys.argv[1:] if not a.startswith("--")]
    chosen = [
        q for q in QUERIES.values()
        if ("--all" in sys.argv or q.headline) and (not wanted or any(q.name.startswith(w) for w in wanted))
    ]
    spark = session(cpus)
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()

    def timed(q) -> float:
        started = time.perf_counter()
        q(spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    seconds: dict[str, float] = {}
    for q in chosen:
        seconds[q.name] = timed(q)
        print(q.name, seconds[q.name], file=sys.stderr, flush=True)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rsplit("sf", 1)[-1],
        "cpus": cpus,
    }
    if "--warm" in sys.argv:
        out["warm"] = {q.name: timed(q) for q in chosen}
    if "--sql" in sys.argv:
        import duckdb

        from tests.oracle import connect

        con = connect(folder)
        con.execute(f"SET threads = {cpus}")
        con.execute("SET memory_limit = '8GB'")
        out["duckdb"] = {}
        for q in chosen:
            if q.sql:
                started = time.perf_counter()
                try:
                    con.execute(f"CREATE OR REPLACE TEMP TABLE _bench AS {q.sql}")
                    out["duckdb"][q.name] = round(time.perf_counter() - started, 3)
                except duckdb.Error as error:
                    out["duckdb"][q.name] = str(error)[:60]
    print(json.dumps(out))


if __name__ == "__main__":
    main()
