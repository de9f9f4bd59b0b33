"""Run catalog queries beside their SQL and compare: `python -m tests.check_queries [sf_dir] [names]`."""

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    start = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "NestedLoop" in plan or "Cartesian" in plan:
        return False, f"{name}: joins all pairs"
    spent = time.time() - start
    start = time.time()
    result = con.execute(sql)
    expected = rows_of([d[0] for d in result.description], result.fetchall())
    line = f"{name}: {len(got[1])} rows, {spent:.1f} s, SQL {time.time() - start:.1f} s"
    if got == expected:
        return True, line
    detail = f"columns {got[0]} / {expected[0]}, rows {len(got[1])} / {len(expected[1])}"
    only = [set(map(repr, got[1])) - set(map(repr, expected[1])), set(map(repr, expected[1])) - set(map(repr, got[1]))]
    return False, f"{line} DIFFERS {detail}\n   spark only {sorted(only[0])[:2]}\n   sql only {sorted(only[1])[:2]}"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = connect(sf_dir), entry.oracle_sql()
    bad = []
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        if name not in oracle:
            print(f"{name}: {query(spark, sf_dir).count()} rows, no SQL", flush=True)
            continue
        try:
            fine, line = compare(spark, con, sf_dir, name, query, oracle[name])
        except Exception as error:  # noqa: BLE001
            fine, line = False, f"{name}: {type(error).__name__} {str(error)[:700]}"
        print(line, flush=True)
        bad += [] if fine else [name]
    print(f"{len(bad)} differ: {bad}")


if __name__ == "__main__":
    main()
