"""Column functions and the event stream."""

import datetime

from pyspark.sql import functions as F

from loomsql.functions import pg
from loomsql.streaming.windows import read_events, window_counts


def test_functions_agree_with_the_dialect(spark):
    t = "TIMESTAMP_NTZ '2024-12-30 23:59:58.25'"
    df = spark.sql(f"SELECT {t} AS t, 'hello' AS s, -7L AS a, 2L AS b, DATE '2024-02-28' AS d, 2.5D AS x")
    got = df.select(
        *(pg.extract(f, F.col("t")).cast("bigint").alias(f) for f in ("isodow", "isoyear", "dow", "doy", "microseconds", "milliseconds", "decade", "century", "millennium", "week", "year")),
        pg.substring(F.col("s"), F.lit(-1), F.lit(4)).alias("s1"), pg.substring(F.col("s"), F.lit(3)).alias("s2"), pg.substring(F.col("s"), F.lit(None).cast("int"), F.lit(1)).alias("s3"),
        pg.position(F.lit("l"), F.col("s")).alias("p"), pg.int_div(F.col("a"), F.col("b")).alias("q"), pg.bit_xor(F.col("a"), F.col("b")).alias("y"),
        pg.date_plus_interval(F.col("d"), F.expr("INTERVAL '1' DAY")).alias("e"), pg.round_cast(F.col("x"), "int").alias("r"),
    ).first().asDict()
    assert got == dict(
        isodow=1, isoyear=2025, dow=1, doy=365, microseconds=58_250_000, milliseconds=58_250, decade=202, century=21, millennium=3, week=1, year=2024,
        s1="he", s2="llo", s3=None, p=3, q=-3, y=-7 ^ 2, e=datetime.datetime(2024, 2, 29), r=2,
    )
    order = spark.createDataFrame([(1,), (None,), (2,)], "v int")
    assert [r[0] for r in order.orderBy(pg.default_nulls(F.col("v"))).collect()] == [1, 2, None]
    assert [r[0] for r in order.orderBy(pg.default_nulls(F.col("v"), False)).collect()] == [None, 2, 1]


def test_stream_gives_the_table_s_windows(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").orderBy("ts").limit(400)
    rows = events.repartitionByRange(3, "ts")
    rows.write.parquet(str(tmp_path / "in"))
    whole = {tuple(r)[:3] for r in window_counts(events).collect()}
    stream = window_counts(read_events(spark, str(tmp_path / "in"), events.schema), late="3650 days")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r)[:3] for r in spark.table("windows").collect()} == whole


def test_whole_numbers_beyond_doubles(spark):
    df = spark.sql("SELECT 9007199254740993L AS a, 1L AS b, -7L AS c, 2L AS d, CAST(2.5 AS DECIMAL(4, 1)) AS e, 2.5D AS f")
    row = df.select(pg.int_div(F.col("a"), F.col("b")).alias("x"), pg.int_div(F.col("c"), F.col("d")).alias("y"), pg.round_cast(F.col("e"), "int").alias("z"), pg.round_cast(F.col("f"), "int").alias("w")).first()
    assert tuple(row) == (9007199254740993, -3, 3, 2)
