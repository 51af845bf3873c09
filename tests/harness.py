"""Runs registered queries beside their SQL and compares the results; ``python -m tests.harness [key …]``."""
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def make_spark(cores="8"):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def make_duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


SPENT: dict = {}


def compare(df, con, sql):
    """Empty string if equal, else a description of the difference."""
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    SPENT["spark"] = time.time()
    rel = con.sql(sql)
    want_types = dict(zip(rel.columns, map(str, rel.dtypes if not callable(rel.dtypes) else rel.dtypes())))
    want_cols, want = rows_of(list(rel.columns), rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    types = {f.name: SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    odd = {c: (types[c], want_types[c]) for c in types if types[c] != want_types[c]}
    note = f" TYPES {odd}" if odd else ""
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows; first {got[:2]} / {want[:2]}{note}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[:3]}{note}"
    return note


def main(keys, sf_dir="/root/testdata/sf0.01"):
    import __spark_entry__ as entry

    spark, con = make_spark(), make_duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for key in [k for k in queries if not keys or any(k.startswith(p) for p in keys)]:
        start = SPENT["spark"] = time.time()
        try:
            df = queries[key](spark, sf_dir)
            if key in oracles:
                diff = compare(df, con, oracles[key])
            else:
                diff = "" if df.collect() else "no rows"
                SPENT["spark"] = time.time()
                key += " (rows only)"
        except Exception as e:  # report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'FAIL' if diff else 'ok  '} {key} {SPENT['spark'] - start:.2f}s of {time.time() - start:.2f}s {diff}", flush=True)
        if diff:
            failed.append(key)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
