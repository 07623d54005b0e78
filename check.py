"""Run registered queries beside their SQL in DuckDB and compare whole results.

    python check.py [--sf DIR] [--views] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

SPARK_TO_SQL = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP", "float": "FLOAT",
}


def spark_session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def compare(frame, con, sql: str) -> str:
    cols = sorted(frame.columns)
    ours = sorted(str([_plain(v) for v in r]) for r in frame.select(*cols).collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    if sorted(names) != cols:
        return f"COLUMNS ours={cols} sql={sorted(names)}"
    order = [names.index(c) for c in cols]
    theirs = sorted(str([_plain(r[i]) for i in order]) for r in rel.fetchall())
    notes = [
        f"{f.name}:{f.dataType.simpleString()}/{types[f.name]}"
        for f in frame.schema
        if SPARK_TO_SQL.get(f.dataType.simpleString()) not in (None, types[f.name])
    ]
    typed = f" TYPES {notes}" if notes else ""
    if ours == theirs:
        return f"OK {len(ours)} rows{typed}"
    only_ours = sorted(set(ours) - set(theirs))[:2]
    only_theirs = sorted(set(theirs) - set(ours))[:2]
    return f"DIFF rows {len(ours)}/{len(theirs)}{typed}\n   cols {cols}\n   ours {only_ours}\n   sql  {only_theirs}"


def main(args: list[str]) -> int:
    folder = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        folder = args[i + 1]
        args = args[:i] + args[i + 2:]
    spark, con = spark_session(), database(folder)
    from planloom.plans import queries as q
    from planloom.plans import registry

    if "--views" in args:
        from planloom.plans.adapters import ADAPTERS, SPARK_ONLY

        catalog = registry.Catalog(spark, folder)
        wanted = [a for a in args if not a.startswith("-")] or [*ADAPTERS, *SPARK_ONLY]
        jobs = {n: (lambda n=n: catalog.view(n), registry.with_views(f"SELECT * FROM {n}")) for n in wanted}
    else:
        wanted = [a for a in args if not a.startswith("-")]
        names = [n for n in q.QUERIES if not wanted or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
        sqls = registry.oracle_sql()
        jobs = {n: (lambda n=n: q.QUERIES[n](spark, folder), sqls.get(n)) for n in names}
    bad = 0
    for name, (build, sql) in jobs.items():
        start = time.time()
        try:
            frame = build()
            outcome = compare(frame, con, sql) if sql else f"OK {frame.count()} rows (no SQL)"
        except Exception as error:  # report and go on to the next query
            outcome = f"ERROR {str(error)[:700]}"
        bad += not outcome.startswith("OK") or "TYPES" in outcome
        print(f"{name}: {outcome} [{time.time() - start:.1f}s]", flush=True)
    print(f"{len(jobs)} checked, {bad} with findings")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
