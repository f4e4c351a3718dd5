"""Synthetic rows with the reference's constraints: the same seed gives the same rows.

Choices are hashes of (seed, row, purpose), so a row doesn't depend on how rows
are dealt to tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import day_class
from graphloom.operators.loyalty import assign_tier, fare_usage, flyer_frequency, preferred_routes, spending_segment

CHANNELS, STATUSES = ("APP", "WEB", "AGENT", "CALL_CENTRE"), ("CONFIRMED", "FLOWN", "CANCELLED")
# invented: eight fares, and fifteen places of which the last three are abroad
FARES = tuple(f"FARE_{i}" for i in range(1, 9))
AIRPORTS = tuple(f"P{i:02d}" for i in range(1, 16))
ABROAD = AIRPORTS[-3:]


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Adds ``rn``, 1, 2, ... by the key, from counts of ranges: no task sorts all rows."""
    dealt = df.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id())
    dealt = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.join(before.select("_part", "_before"), "_part").withColumn("rn", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def uniform(seed: int, purpose: str, *keys: str | Column) -> Column:
    """A number from 0 to 1 for the row and the purpose."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), *keys), F.lit(1 << 30)) / float(1 << 30)


def choice(u: Column, items: tuple, weights: tuple[float, ...] | None = None) -> Column:
    """One of the items by weight."""
    weights = weights or (1.0,) * len(items)
    total, upto, out = sum(weights), 0.0, None
    for item, w in zip(items[:-1], weights[:-1], strict=True):
        upto += w / total
        out = F.when(u < upto, F.lit(item)) if out is None else out.when(u < upto, F.lit(item))
    return F.lit(items[0]) if out is None else out.otherwise(F.lit(items[-1]))


def between(u: Column, low: int, high: int) -> Column:
    return (F.floor(u * (high - low + 1)) + low).cast("int")


def pick_without(u: Column, pool: tuple[str, ...], without: Column, n: int = 3) -> Column:
    """``n`` different items of the pool, not the one given, in an order that the number sets."""
    order = F.array_sort(F.transform(F.array_except(F.array(*map(F.lit, pool)), F.array(without)), lambda x: F.struct(F.xxhash64(x, u).alias("h"), x.alias("x"))))
    return F.transform(F.slice(order, 1, n), lambda s: s["x"])


def sample_rows(columns: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """(database, table_name, row, column_name, value): values by name and type for each catalogued column."""
    kind, name = F.lower("data_type"), F.lower("column_name")
    u = uniform(seed, "value", "table_name", "column_name", "row")
    value = (
        F.when(name.endswith("id"), F.concat(F.upper(F.substring("table_name", 1, 3)), F.lpad((F.col("row") + 1000).cast("string"), 6, "0")))
        .when(kind.contains("bool"), (u < 0.5).cast("string"))
        .when(kind.contains("timestamp") | kind.contains("date"), F.date_add(F.lit("2024-01-01").cast("date"), between(u, 0, 700)).cast("string"))
        .when(kind.contains("number") | kind.contains("int"), between(u, 1, 1000).cast("string"))
        .when(kind.contains("float"), F.round(u * 1000, 2).cast("string"))
        .otherwise(F.concat(F.initcap(F.regexp_replace("column_name", "_", " ")), F.lit(" "), F.col("row").cast("string")))
    )
    return columns.withColumn("row", F.explode(F.sequence(F.lit(1), F.lit(n)))).select("database", "table_name", "row", "column_name", value.alias("value"))


def loyalty_tables(spark: SparkSession, members: int | DataFrame = 20, seed: int = 42, today: str = "2026-01-01") -> dict[str, DataFrame]:
    """Members with 1 to 28 bookings of one or two segments, 0 to 2 add-ons a segment, and partner transactions.

    ``members`` is their number, or a table of their ids (``ffn_id``).
    """
    u = lambda purpose, *keys: uniform(seed, purpose, *keys)
    if isinstance(members, int):
        members = spark.range(1, members + 1).select(F.concat(F.lit("FF"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("ffn_id"))
    ids = members.select("ffn_id")
    active = choice(u("activity", "ffn_id"), (1, 4, 12, 28), (2, 4, 3, 1))
    booked = ids.withColumn("k", F.explode(F.sequence(F.lit(1), active)))
    booking = booked.select(
        F.concat_ws("-", "ffn_id", F.col("k").cast("string")).alias("booking_id"), "ffn_id",
        F.date_format(F.date_sub(F.lit(today).cast("date"), between(u("booked", "ffn_id", "k"), 10, 700)), "yyyy-MM-dd").alias("booking_date"),
        choice(u("channel", "ffn_id", "k"), CHANNELS, (5, 3, 1, 1)).alias("booking_channel"), choice(u("status", "ffn_id", "k"), STATUSES, (3, 6, 1)).alias("booking_status"),
        choice(u("fare", "ffn_id", "k"), FARES, (6, 3, 2, 1, 1, 1, 2, 1)).alias("fare_type"), choice(u("trip", "ffn_id", "k"), ("ONE_WAY", "ROUND_TRIP"), (6, 4)).alias("trip_type"),
        choice(u("orig", "ffn_id", "k"), AIRPORTS).alias("origin"), between(u("fareinr", "ffn_id", "k"), 2500, 45000).alias("total_fare"),
    )
    booking = booking.withColumn("destination", pick_without(u("dest", "booking_id"), AIRPORTS, F.col("origin"), 1)[0])
    booking = booking.withColumn("is_international", F.col("origin").isin(*ABROAD) | F.col("destination").isin(*ABROAD))
    legs = booking.withColumn("leg", F.explode(F.sequence(F.lit(1), F.when(F.col("trip_type") == "ROUND_TRIP", 2).otherwise(1))))
    out = F.col("leg") == 1
    day = F.date_add(F.col("booking_date").cast("date"), between(u("ahead", "booking_id", "leg"), 1, 60) + F.when(out, 0).otherwise(3))
    segment = legs.select(
        F.concat_ws("-", "booking_id", F.col("leg").cast("string")).alias("segment_id"), "booking_id", "ffn_id",
        F.when(out, F.col("origin")).otherwise(F.col("destination")).alias("origin"), F.when(out, F.col("destination")).otherwise(F.col("origin")).alias("destination"),
        F.date_format(day, "yyyy-MM-dd").alias("flight_date"), day_class(day).alias("travel_day"), "is_international",
    ).withColumn("route_id", F.concat_ws("_", "origin", "destination"))
    totals = booking.groupBy("ffn_id").agg(F.sum("total_fare").alias("spend"), F.count("*").alias("bookings"))
    member = totals.select("ffn_id", flyer_frequency(F.col("bookings")).alias("flyer_frequency"), spending_segment(F.col("bookings"), F.col("spend")).alias("spending_segment"))
    member_tier = totals.select("ffn_id", assign_tier(F.col("spend"), F.col("bookings")).alias("tier_name"), F.col("spend").alias("qualifying_spend"), F.col("bookings").alias("qualifying_flights"))
    addons = segment.withColumn("n", F.explode(F.sequence(F.lit(0), between(u("addons", "segment_id"), 0, 2)))).where("n > 0")
    segment_addon = addons.select("segment_id", F.concat(F.lit("ADD"), between(u("addon", "segment_id", "n"), 1, 12).cast("string")).alias("addon_id")).distinct()
    many = ids.withColumn("k", F.explode(F.sequence(F.lit(0), between(u("txns", "ffn_id"), 0, 30)))).where("k > 0")
    spend = between(u("spent", "ffn_id", "k"), 200, 20000)
    partner_txn = many.select(F.concat_ws("-", F.lit("T"), "ffn_id", F.col("k").cast("string")).alias("transaction_id"), "ffn_id", F.concat(F.lit("P"), between(u("partner", "ffn_id", "k"), 1, 19).cast("string")).alias("partner_id"), F.date_format(F.date_sub(F.lit(today).cast("date"), between(u("when", "ffn_id", "k"), 1, 700)), "yyyy-MM-dd").alias("activity_date"), spend.alias("spend_amount"), (spend / 100 * 2).cast("int").alias("points_earned"))
    route = segment.groupBy("route_id").agg(F.min("origin").alias("origin"), F.min("destination").alias("destination"), F.max("is_international").alias("is_international"))
    return {"member": member, "member_tier": member_tier, "booking": booking, "segment": segment, "segment_addon": segment_addon, "partner_txn": partner_txn, "route": route, "member_route": preferred_routes(segment), "member_fare": fare_usage(booking)}
