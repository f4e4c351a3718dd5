"""Queries on a loyalty graph, kept as fact and bridge tables.

Tables (a dict of DataFrames): member, tier, member_tier, booking, segment,
segment_addon, addon, fare_type, route, member_route, member_fare, partner,
partner_txn.  Counts on a branch are aggregated before they are joined, so no
branch multiplies another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: (spend, bookings) from which the upper tiers begin.
TIER_STEPS = ((200_000, 8), (100_000, 4))
TIER_NAMES = ("top", "middle", "entry")


def assign_tier(spend: Column, flights: Column, steps=TIER_STEPS, names=TIER_NAMES) -> Column:
    (s1, f1), (s2, f2) = steps
    return F.when((spend >= s1) & (flights >= f1), names[0]).when((spend >= s2) & (flights >= f2), names[1]).otherwise(names[2])


def spending_segment(bookings: Column, spend: Column, many: float = 6, much: float = 60_000) -> Column:
    return F.concat(F.when(bookings >= many, "HIGH").otherwise("LOW"), F.lit("_FREQ_"), F.when(spend >= much, "HIGH").otherwise("LOW"), F.lit("_SPEND"))


def flyer_frequency(bookings: Column) -> Column:
    return F.when(bookings <= 1, "ONE_TIME").when(bookings <= 4, "ANNUAL").otherwise("FREQUENT")


def points_earned(spend: Column, unit: Column, rate: Column) -> Column:
    return (spend / unit * rate).cast("long")


def balance(spend: Column, tier_bonus: Column, channel: Column, redeemed: Column) -> Column:
    """int(spend / 100 * (8 + tier + 0.7 * channel)), less the redeemed share."""
    return ((spend / 100 * (F.lit(8) + tier_bonus + F.lit(0.7) * channel)).cast("long") * (F.lit(1.0) - redeemed)).cast("long")


def preferred_routes(trips: DataFrame, top: int = 4) -> DataFrame:
    """(ffn_id, route_id, trip_count, last_flown): each member's most flown routes, ties by first flown, then by name."""
    counts = trips.groupBy("ffn_id", "route_id").agg(F.count("*").alias("trip_count"), F.max("flight_date").alias("last_flown"), F.min("flight_date").alias("first_flown"))
    rank = F.row_number().over(Window.partitionBy("ffn_id").orderBy(F.desc("trip_count"), "first_flown", "route_id"))
    return counts.withColumn("rn", rank).where(F.col("rn") <= top).drop("rn", "first_flown")


def fare_usage(bookings: DataFrame) -> DataFrame:
    """(ffn_id, fare_name, usage_count, pct_of_bookings)."""
    counts = bookings.groupBy("ffn_id", F.col("fare_type").alias("fare_name")).agg(F.count("*").alias("usage_count"))
    return counts.withColumn("pct_of_bookings", F.round(F.col("usage_count") / F.sum("usage_count").over(Window.partitionBy("ffn_id")), 2))


class Loyalty:
    def __init__(self, **tables: DataFrame):
        self.t = tables

    def _edges(self) -> dict[str, DataFrame]:
        t = self.t
        return {"BELONGS_TO_TIER": t["member_tier"], "MADE_BOOKING": t["booking"], "CONTAINS_SEGMENT": t["segment"], "FLIES_ON": t["segment"], "PURCHASED_ADDON": t["segment_addon"], "PREFERS_ROUTE": t["member_route"], "USES_FARE_TYPE": t["member_fare"], "EARNS_POINTS_FROM": t["partner_txn"], "WITH_PARTNER": t["partner_txn"]}

    def schema(self) -> DataFrame:
        """(kind, label, n) of vertices and edges."""
        labels = {"Member": "member", "Tier": "tier", "Booking": "booking", "Segment": "segment", "Route": "route", "AddOn": "addon", "FareType": "fare_type", "Partner": "partner", "PartnerTransaction": "partner_txn"}
        parts = [self.t[name].agg(F.lit("vertex").alias("kind"), F.lit(label).alias("label"), F.count("*").alias("n")) for label, name in labels.items()]
        parts += [df.agg(F.lit("edge").alias("kind"), F.lit(label).alias("label"), F.count("*").alias("n")) for label, df in self._edges().items()]
        return reduce(DataFrame.unionByName, parts)

    def tier_overview(self) -> DataFrame:
        n = self.t["member_tier"].groupBy("tier_name").agg(F.count("*").alias("member_count"))
        return self.t["tier"].join(n, "tier_name", "left").withColumn("member_count", F.coalesce("member_count", F.lit(0))).orderBy(F.desc("tier_rank"))

    def partner_overview(self) -> DataFrame:
        n = self.t["partner_txn"].groupBy("partner_id").agg(F.count("*").alias("transaction_count"))
        return self.t["partner"].join(n, "partner_id", "left").withColumn("transaction_count", F.coalesce("transaction_count", F.lit(0)))

    def addon_catalog(self) -> DataFrame:
        return self.t["addon"].orderBy("category", "addon_id")

    def tier_details(self, tier: str) -> DataFrame:
        return self.t["tier"].where(F.col("tier_name") == tier).limit(1)

    def member_bookings(self, ffn, limit: int = 10) -> DataFrame:
        own = self.t["booking"].where(F.col("ffn_id") == ffn)
        n = own.select("booking_id").join(self.t["segment"].select("booking_id"), "booking_id").groupBy("booking_id").agg(F.count("*").alias("segment_count"))
        return own.join(n, "booking_id", "left").withColumn("segment_count", F.coalesce("segment_count", F.lit(0))).orderBy(F.desc("booking_date"), F.desc("booking_id")).limit(limit)

    def booking_details(self, booking_id) -> DataFrame:
        """One row for each segment, with its add-on types (an empty list if none)."""
        own = self.t["segment"].where(F.col("booking_id") == booking_id)
        bought = own.select("segment_id").join(self.t["segment_addon"], "segment_id").join(self.t["addon"].select("addon_id", "addon_type"), "addon_id")
        lists = bought.groupBy("segment_id").agg(F.sort_array(F.collect_list("addon_type")).alias("addons"))
        out = self.t["booking"].where(F.col("booking_id") == booking_id).join(own, "booking_id").join(lists, "segment_id", "left")
        return out.withColumn("addons", F.coalesce("addons", F.array().cast("array<string>"))).orderBy("flight_date", "segment_id")

    def segment_history(self, ffn, limit: int = 20) -> DataFrame:
        own = self.t["booking"].where(F.col("ffn_id") == ffn).select("booking_id", "ffn_id", "fare_type")
        return own.join(self.t["segment"], "booking_id").orderBy(F.desc("flight_date"), "segment_id").limit(limit)

    def _addons_of(self, segments: DataFrame) -> DataFrame:
        return segments.join(self.t["segment_addon"], "segment_id").join(self.t["addon"].select("addon_id", "addon_type"), "addon_id")

    def member_addons(self, ffn) -> DataFrame:
        own = self.t["booking"].where(F.col("ffn_id") == ffn).select("booking_id").join(self.t["segment"].select("booking_id", "segment_id"), "booking_id")
        return self._addons_of(own).groupBy("addon_type").agg(F.count("*").alias("purchases"))

    def member_partner_transactions(self, ffn) -> DataFrame:
        return self.t["partner_txn"].where(F.col("ffn_id") == ffn).join(self.t["partner"], "partner_id").orderBy(F.desc("activity_date"), "transaction_id")

    def member_preferred_routes(self, ffn) -> DataFrame:
        return self.t["member_route"].where(F.col("ffn_id") == ffn).join(self.t["route"], "route_id").orderBy(F.desc("trip_count"), "route_id")

    def tier_members(self, tier: str) -> DataFrame:
        return self.t["member_tier"].where(F.col("tier_name") == tier).join(self.t["member"], "ffn_id")

    def route_travelers(self, origin: str, destination: str) -> DataFrame:
        route = f"{origin}_{destination}".upper()
        return self.t["member_route"].where(F.col("route_id") == route).join(self.t["member"], "ffn_id").orderBy(F.desc("trip_count"), "ffn_id")

    def popular_routes(self, top: int = 10) -> DataFrame:
        """Routes by travellers; the two counts are made apart and then joined."""
        travellers = self.t["member_route"].groupBy("route_id").agg(F.count("*").alias("traveller_count"))
        flown = self.t["segment"].groupBy("route_id").agg(F.count("*").alias("segment_count"))
        out = self.t["route"].join(travellers, "route_id", "left").join(flown, "route_id", "left").fillna(0, ["traveller_count", "segment_count"])
        return out.orderBy(F.desc("traveller_count"), F.desc("segment_count"), "route_id").limit(top)

    def partner_transactions(self, partner) -> DataFrame:
        own = self.t["partner"].where(F.col("partner_name") == partner)
        return own.join(self.t["partner_txn"], "partner_id").join(self.t["member"], "ffn_id")

    def members_by_fare(self, fare: str) -> DataFrame:
        return self.t["member_fare"].where(F.col("fare_name") == fare).join(self.t["member"], "ffn_id").orderBy(F.desc("usage_count"), "ffn_id")

    def members_by_addon(self, addon: str) -> DataFrame:
        ids = self.t["addon"].where(F.col("addon_type") == addon).select("addon_id")
        bought = self.t["segment_addon"].join(ids, "addon_id", "left_semi")
        owners = bought.join(self.t["segment"].select("segment_id", "ffn_id"), "segment_id")
        return owners.groupBy("ffn_id").agg(F.count("*").alias("purchases"))

    def high_value_members(self, segment: str = "HIGH_FREQ_HIGH_SPEND") -> DataFrame:
        return self.t["member"].where(F.col("spending_segment") == segment).join(self.t["member_tier"], "ffn_id")

    def segment_purchase_summary(self, origin: str, destination: str) -> DataFrame:
        """(kind, item, n): the route's segments, its add-ons by type, and its segments by fare."""
        own = self.t["segment"].where(F.col("route_id") == f"{origin}_{destination}".upper()).select("segment_id", "booking_id")
        total = own.agg(F.lit("segments").alias("kind"), F.lit("all").alias("item"), F.count("*").alias("n"))
        addons = self._addons_of(own).groupBy(F.col("addon_type").alias("item")).agg(F.count("*").alias("n")).select(F.lit("addon").alias("kind"), "item", "n")
        fares = own.join(self.t["booking"].select("booking_id", "fare_type"), "booking_id").groupBy(F.col("fare_type").alias("item")).agg(F.count("*").alias("n")).select(F.lit("fare").alias("kind"), "item", "n")
        return total.unionByName(addons).unionByName(fares)

    def member_profile(self, ffn) -> DataFrame:
        """One row: the member, the tier edge, routes and fares as sorted lists, and two counts."""
        of = lambda name: self.t[name].where(F.col("ffn_id") == ffn)
        listed = lambda df, alias, *cols: df.groupBy("ffn_id").agg(F.sort_array(F.collect_list(F.struct(*cols)), asc=False).alias(alias))
        count = lambda name, alias: of(name).groupBy("ffn_id").agg(F.count("*").alias(alias))
        out = of("member").join(of("member_tier"), "ffn_id", "left")
        out = out.join(listed(of("member_route"), "routes", "trip_count", "route_id"), "ffn_id", "left").join(listed(of("member_fare"), "fares", "usage_count", "fare_name"), "ffn_id", "left")
        out = out.join(count("booking", "booking_count"), "ffn_id", "left").join(count("partner_txn", "transaction_count"), "ffn_id", "left")
        return out.fillna(0, ["booking_count", "transaction_count"])

    def member_edges(self) -> DataFrame:
        """(src, dst, relationship) of the whole graph, with ids that carry their label."""
        t, tag = self.t, lambda label, col: F.concat(F.lit(label + ":"), F.col(col).cast("string"))
        make = lambda df, a, ac, b, bc, rel: df.select(tag(a, ac).alias("src"), tag(b, bc).alias("dst"), F.lit(rel).alias("relationship"))
        parts = [
            make(t["member_tier"], "Member", "ffn_id", "Tier", "tier_name", "BELONGS_TO_TIER"),
            make(t["booking"], "Member", "ffn_id", "Booking", "booking_id", "MADE_BOOKING"),
            make(t["segment"], "Booking", "booking_id", "Segment", "segment_id", "CONTAINS_SEGMENT"),
            make(t["segment"], "Segment", "segment_id", "Route", "route_id", "FLIES_ON"),
            make(t["segment_addon"], "Segment", "segment_id", "AddOn", "addon_id", "PURCHASED_ADDON"),
            make(t["member_route"], "Member", "ffn_id", "Route", "route_id", "PREFERS_ROUTE"),
            make(t["member_fare"], "Member", "ffn_id", "FareType", "fare_name", "USES_FARE_TYPE"),
        ]
        return reduce(DataFrame.unionByName, parts)

    def member_subgraph(self, ffn, depth: int = 2, mode: str = "exact", edges: DataFrame | None = None) -> DataFrame:
        """Simple paths (``path`` of vertices, ``rels``) of exactly ``depth`` hops, 3 at most, or with ``mode="within"`` of up to as many."""
        from graphloom.operators.graph import undirected

        depth = min(depth, 3)
        hop = undirected(edges if edges is not None else self.member_edges()).select(F.col("src").alias("_at"), F.col("dst").alias("_to"), F.col("relationship").alias("_rel"))
        path = hop.where(F.col("_at") == F.lit(f"Member:{ffn}")).where("_at <> _to").select(F.array("_at", "_to").alias("path"), F.array("_rel").alias("rels"))
        levels = [path]
        for _ in range(depth - 1):
            last = levels[-1].withColumn("_end", F.element_at("path", -1))
            step = last.join(hop, F.col("_end") == F.col("_at")).where(~F.array_contains("path", F.col("_to")))
            levels.append(step.select(F.concat("path", F.array("_to")).alias("path"), F.concat("rels", F.array("_rel")).alias("rels")))
        return levels[-1] if mode == "exact" else reduce(DataFrame.unionByName, levels)
