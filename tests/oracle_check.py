"""Compare registered queries with their SQL: python tests/oracle_check.py <sf> [name-part ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "item"):
        return plain(value.item())
    if value.__class__.__name__ == "Decimal":
        return round(float(value), 6)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    got = con.execute(sql)
    cols = [c[0] for c in got.description]
    names = sorted(cols)
    at = [cols.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else a description of the difference."""
    names, ours = spark_rows(fn(spark, sf_dir))
    if sql is None:
        return None if ours else "no rows"
    expected_names, theirs = duck_rows(con, sql)
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{names}\n   spark {a!r:.600}\n   sql   {b!r:.600}"
    return None if ours else "no rows"


def session(threads=8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{threads}]")
        .config("spark.sql.shuffle.partitions", str(threads))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = f"/root/testdata/sf{sys.argv[1]}"
    parts = sys.argv[2:]
    spark, con = session(), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - start:6.2f}s {name}{'' if name in oracles else ' (no sql)'} {problem or ''}", flush=True)
    print(f"{bad} bad")
