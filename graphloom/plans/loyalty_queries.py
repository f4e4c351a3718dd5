"""The loyalty graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.loyalty import Loyalty, assign_tier, fare_usage, flyer_frequency, points_earned, preferred_routes, spending_segment
from graphloom.plans.registry import Tables, query

ROUTE = ("NATION_1", "NATION_7")
_ROUTE_ID = "_".join(ROUTE)


class _Views(dict):
    """Views that are made when they are asked for."""

    def __init__(self, t: Tables):
        super().__init__()
        self.tables = t

    def __missing__(self, name: str) -> DataFrame:
        t = self.tables
        if name == "member_route":
            self[name] = preferred_routes(t.segment)
        elif name == "member_fare":
            self[name] = fare_usage(t.booking)
        elif name == "member_tier":
            s = t.spend
            self[name] = s.select("ffn_id", F.col("spend").alias("qualifying_spend"), F.col("bookings").alias("qualifying_flights"), assign_tier(F.col("spend"), F.col("bookings"), ((3_500_000, 12), (2_000_000, 8))).alias("tier_name"))
        elif name == "member":
            s = t.spend.select("ffn_id", spending_segment(F.col("bookings"), F.col("spend"), 10, 2_500_000).alias("spending_segment"), flyer_frequency(F.col("bookings")).alias("flyer_frequency"))
            self[name] = t.customer.select(F.col("c_custkey").alias("ffn_id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("customer_type")).join(s, "ffn_id")
        else:
            self[name] = getattr(t, name)
        return self[name]


def _g(t: Tables) -> Loyalty:
    g = Loyalty()
    g.t = _Views(t)
    return g


def _day(c: str):
    return F.col(c).cast("string").alias(c)


_MR = """mr AS (SELECT ffn_id, route_id, trip_count, last_flown FROM (
  SELECT *, row_number() OVER (PARTITION BY ffn_id ORDER BY trip_count DESC, first_flown, route_id) AS rn FROM (
    SELECT ffn_id, route_id, count(*) AS trip_count, max(flight_date) AS last_flown, min(flight_date) AS first_flown FROM {segment} GROUP BY ALL) a) b WHERE rn <= 4)"""
_MF = "mf AS (SELECT ffn_id, fare_type AS fare_name, count(*) AS usage_count, round(count(*) / sum(count(*)) OVER (PARTITION BY ffn_id), 2)::DOUBLE AS pct_of_bookings FROM {booking} GROUP BY ffn_id, fare_type)"


@query("q05_tier_overview", "SELECT t.tier_name, t.tier_rank::BIGINT AS tier_rank, count(m.ffn_id) AS member_count FROM {tier} t LEFT JOIN {member_tier} m ON t.tier_name = m.tier_name GROUP BY ALL")
def q05(t):
    return _g(t).tier_overview().select("tier_name", F.col("tier_rank").cast("long").alias("tier_rank"), "member_count")


@query("q06_partner_overview", "SELECT p.partner_id, p.partner_name, p.category, count(x.partner_id) AS transaction_count FROM {partner} p LEFT JOIN {partner_txn} x ON p.partner_id = x.partner_id GROUP BY ALL")
def q06(t):
    return _g(t).partner_overview().select("partner_id", "partner_name", "category", "transaction_count")


@query("q07_addon_catalog", "SELECT addon_id, addon_type, addon_name, category, approx_price FROM {addon}")
def q07(t):
    return _g(t).addon_catalog()


@query(
    "q08_member_profile",
    f"""WITH {_MR}, {_MF}
    SELECT m.ffn_id, m.full_name, m.spending_segment, m.flyer_frequency, mt.tier_name, mt.qualifying_spend,
      coalesce((SELECT string_agg(route_id || ':' || trip_count, ',' ORDER BY trip_count DESC, route_id DESC) FROM mr WHERE mr.ffn_id = m.ffn_id), '') AS routes,
      coalesce((SELECT string_agg(fare_name || ':' || usage_count, ',' ORDER BY usage_count DESC, fare_name DESC) FROM mf WHERE mf.ffn_id = m.ffn_id), '') AS fares,
      (SELECT count(*) FROM {{booking}} b WHERE b.ffn_id = m.ffn_id) AS booking_count, (SELECT count(*) FROM {{partner_txn}} x WHERE x.ffn_id = m.ffn_id) AS transaction_count
    FROM {{member}} m LEFT JOIN {{member_tier}} mt ON m.ffn_id = mt.ffn_id WHERE m.ffn_id = 5""",
)
def q08(t):
    text = lambda c, k, n: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s[k], s[n].cast("string")))).alias(c)
    return _g(t).member_profile(5).select("ffn_id", "full_name", "spending_segment", "flyer_frequency", "tier_name", "qualifying_spend", text("routes", "route_id", "trip_count"), text("fares", "fare_name", "usage_count"), "booking_count", "transaction_count")


@query("q09_member_bookings", "SELECT b.booking_id, b.booking_date::VARCHAR AS booking_date, b.fare_type, b.total_fare, count(s.segment_id) AS segment_count FROM {booking} b LEFT JOIN {segment} s ON b.booking_id = s.booking_id WHERE b.ffn_id = 5 GROUP BY ALL ORDER BY booking_date DESC, b.booking_id DESC LIMIT 10")
def q09(t):
    return _g(t).member_bookings(5).select("booking_id", _day("booking_date"), "fare_type", "total_fare", "segment_count")


@query("q10_booking_details", "SELECT s.segment_id, b.booking_id, b.fare_type, s.flight_date::VARCHAR AS flight_date, s.route_id, a.addon_type AS addons FROM {booking} b JOIN {segment} s ON b.booking_id = s.booking_id JOIN {addon} a ON s.addon_id = a.addon_id WHERE b.booking_id = 33")
def q10(t):
    return _g(t).booking_details(33).select("segment_id", "booking_id", "fare_type", _day("flight_date"), "route_id", F.array_join("addons", ",").alias("addons"))


@query("q11_segment_history", "SELECT s.segment_id, b.booking_id, b.fare_type, s.flight_date::VARCHAR AS flight_date, s.route_id FROM {booking} b JOIN {segment} s ON b.booking_id = s.booking_id WHERE b.ffn_id = 5 ORDER BY s.flight_date DESC, s.segment_id LIMIT 20")
def q11(t):
    return _g(t).segment_history(5).select("segment_id", "booking_id", "fare_type", _day("flight_date"), "route_id")


@query("q12_member_addons", "SELECT a.addon_type, count(*) AS purchases FROM {segment} s JOIN {addon} a ON s.addon_id = a.addon_id WHERE s.ffn_id = 5 GROUP BY ALL")
def q12(t):
    return _g(t).member_addons(5)


@query("q13_member_txns", "SELECT x.transaction_id, p.partner_name, x.activity_date::VARCHAR AS activity_date, x.spend_amount::DOUBLE AS spend_amount FROM {partner_txn} x JOIN {partner} p ON x.partner_id = p.partner_id WHERE x.ffn_id = 5")
def q13(t):
    return _g(t).member_partner_transactions(5).select("transaction_id", "partner_name", _day("activity_date"), F.col("spend_amount").cast("double").alias("spend_amount"))


@query("q14_preferred_routes", f"WITH {_MR} SELECT r.route_id, r.origin, r.destination, mr.trip_count, mr.last_flown::VARCHAR AS last_flown FROM mr JOIN {{route}} r ON mr.route_id = r.route_id WHERE mr.ffn_id = 5")
def q14(t):
    return _g(t).member_preferred_routes(5).select("route_id", "origin", "destination", "trip_count", _day("last_flown"))


@query("q15_tier_members", "SELECT m.ffn_id, m.full_name, t.qualifying_spend, t.qualifying_flights FROM {member_tier} t JOIN {member} m ON t.ffn_id = m.ffn_id WHERE t.tier_name = 'top'")
def q15(t):
    return _g(t).tier_members("top").select("ffn_id", "full_name", "qualifying_spend", "qualifying_flights")


@query("q16_route_travelers", f"WITH {_MR} SELECT m.ffn_id, m.full_name, mr.trip_count, mr.last_flown::VARCHAR AS last_flown FROM mr JOIN {{member}} m ON mr.ffn_id = m.ffn_id WHERE mr.route_id = '{_ROUTE_ID}'")
def q16(t):
    return _g(t).route_travelers(*[x.lower() for x in ROUTE]).select("ffn_id", "full_name", "trip_count", _day("last_flown"))


@query("q17_popular_routes", f"WITH {_MR}, a AS (SELECT route_id, count(*) AS n FROM mr GROUP BY route_id), b AS (SELECT route_id, count(*) AS n FROM {{segment}} GROUP BY route_id) SELECT r.route_id, coalesce(a.n, 0) AS traveller_count, coalesce(b.n, 0) AS segment_count FROM {{route}} r LEFT JOIN a ON r.route_id = a.route_id LEFT JOIN b ON r.route_id = b.route_id ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10")
def q17(t):
    return _g(t).popular_routes().select("route_id", "traveller_count", "segment_count")


@query("q18_partner_txns", "SELECT x.transaction_id, m.full_name, x.activity_date::VARCHAR AS activity_date, x.spend_amount::DOUBLE AS spend_amount FROM {partner} p JOIN {partner_txn} x ON p.partner_id = x.partner_id JOIN {member} m ON x.ffn_id = m.ffn_id WHERE p.partner_id = 3")
def q18(t):
    name = t.partner.where("partner_id = 3").first()["partner_name"]
    return _g(t).partner_transactions(name).select("transaction_id", "full_name", _day("activity_date"), F.col("spend_amount").cast("double").alias("spend_amount"))


@query("q19_members_by_fare", f"WITH {_MF} SELECT m.ffn_id, m.full_name, mf.usage_count, mf.pct_of_bookings FROM mf JOIN {{member}} m ON mf.ffn_id = m.ffn_id WHERE mf.fare_name = '1-URGENT'")
def q19(t):
    return _g(t).members_by_fare("1-URGENT").select("ffn_id", "full_name", "usage_count", "pct_of_bookings")


@query("q20_members_by_addon", "SELECT s.ffn_id, count(*) AS purchases FROM {segment} s JOIN {addon} a ON s.addon_id = a.addon_id WHERE a.addon_type = (SELECT min(addon_type) FROM {addon}) GROUP BY s.ffn_id")
def q20(t):
    return _g(t).members_by_addon(t.addon.agg({"addon_type": "min"}).first()[0])


@query("q21_high_value", "SELECT m.ffn_id, m.full_name, m.flyer_frequency, m.customer_type, t.tier_name FROM {member} m JOIN {member_tier} t ON m.ffn_id = t.ffn_id WHERE m.spending_segment = 'HIGH_FREQ_HIGH_SPEND'")
def q21(t):
    return _g(t).high_value_members().select("ffn_id", "full_name", "flyer_frequency", "customer_type", "tier_name")


@query(
    "q22_route_purchase_summary",
    f"""WITH own AS (SELECT * FROM {{segment}} WHERE route_id = '{_ROUTE_ID}')
    SELECT 'segments' AS kind, 'all' AS item, count(*) AS n FROM own UNION ALL SELECT 'addon', a.addon_type, count(*) FROM own JOIN {{addon}} a ON own.addon_id = a.addon_id GROUP BY a.addon_type
    UNION ALL SELECT 'fare', b.fare_type, count(*) FROM own JOIN {{booking}} b ON own.booking_id = b.booking_id GROUP BY b.fare_type""",
)
def q22(t):
    return _g(t).segment_purchase_summary(*ROUTE)


_PATHS = """WITH u AS (SELECT src, dst, relationship FROM {places} UNION ALL SELECT dst, src, relationship FROM {places}),
  one AS (SELECT src AS a, dst AS b, relationship AS r1 FROM u WHERE src = 'r1' AND dst <> src),
  two AS (SELECT one.*, u.dst AS c, u.relationship AS r2 FROM one JOIN u ON u.src = one.b WHERE u.dst <> one.a AND u.dst <> one.b)"""


@query("q23_member_subgraph_exact_depth", _PATHS + " SELECT a || '/' || b || '/' || c AS path, r1 || '/' || r2 AS rels FROM two")
def q23(t):
    places = t.places.withColumn("src", F.when(F.col("src") == "r1", "Member:r1").otherwise(F.col("src")))
    paths = Loyalty().member_subgraph("r1", 2, edges=places)
    return paths.select(F.regexp_replace(F.array_join("path", "/"), "Member:", "").alias("path"), F.array_join("rels", "/").alias("rels"))


@query("q60_loyalty_schema", "SELECT 'vertex' AS kind, 'Member' AS label, count(*) AS n FROM {member} UNION ALL SELECT 'vertex', 'Tier', count(*) FROM {tier} UNION ALL SELECT 'vertex', 'Booking', count(*) FROM {booking} UNION ALL SELECT 'vertex', 'Segment', count(*) FROM {segment} UNION ALL SELECT 'vertex', 'Route', count(*) FROM {route} UNION ALL SELECT 'vertex', 'AddOn', count(*) FROM {addon} UNION ALL SELECT 'vertex', 'FareType', count(*) FROM {fare_type} UNION ALL SELECT 'vertex', 'Partner', count(*) FROM {partner} UNION ALL SELECT 'vertex', 'PartnerTransaction', count(*) FROM {partner_txn} "
       "UNION ALL SELECT 'edge', 'BELONGS_TO_TIER', count(*) FROM {member_tier} UNION ALL SELECT 'edge', 'MADE_BOOKING', count(*) FROM {booking} UNION ALL SELECT 'edge', 'CONTAINS_SEGMENT', count(*) FROM {segment} UNION ALL SELECT 'edge', 'FLIES_ON', count(*) FROM {segment} UNION ALL SELECT 'edge', 'PURCHASED_ADDON', count(*) FROM {segment} UNION ALL SELECT 'edge', 'EARNS_POINTS_FROM', count(*) FROM {partner_txn} UNION ALL SELECT 'edge', 'WITH_PARTNER', count(*) FROM {partner_txn} "
       "UNION ALL SELECT 'edge', 'USES_FARE_TYPE', count(*) FROM (SELECT DISTINCT ffn_id, fare_type FROM {booking}) UNION ALL SELECT 'edge', 'PREFERS_ROUTE', sum(least(n, 4))::BIGINT FROM (SELECT ffn_id, count(DISTINCT route_id) AS n FROM {segment} GROUP BY ffn_id)")  # fmt: skip
def q60(t):
    return _g(t).schema()


@query("q61_tier_details", "SELECT tier_name, tier_rank::BIGINT AS tier_rank FROM {tier} WHERE tier_name = 'middle'")
def q61(t):
    return _g(t).tier_details("middle").select("tier_name", F.col("tier_rank").cast("long").alias("tier_rank"))


@query("q62_weekday_class", "SELECT CASE WHEN isodow(booking_date) >= 6 THEN 'WEEKEND' ELSE 'WEEKDAY' END AS day_class, count(*) AS n FROM {booking} GROUP BY 1")
def q62(t):
    from graphloom.functions import day_class

    return t.booking.groupBy(day_class(F.col("booking_date")).alias("day_class")).agg(F.count("*").alias("n"))


@query("q76_tier_assignment", "SELECT tier_name, count(*) AS n FROM {member_tier} GROUP BY tier_name")
def q76(t):
    return _g(t).t["member_tier"].groupBy("tier_name").agg(F.count("*").alias("n"))


@query("q77_fare_usage_all", f"WITH {_MF} SELECT ffn_id, fare_name, usage_count, pct_of_bookings FROM mf")
def q77(t):
    return fare_usage(t.booking).select("ffn_id", "fare_name", "usage_count", "pct_of_bookings")


@query("q78_preferred_routes_all", f"WITH {_MR} SELECT ffn_id, route_id, trip_count, last_flown::VARCHAR AS last_flown FROM mr")
def q78(t):
    return preferred_routes(t.segment).select("ffn_id", "route_id", "trip_count", _day("last_flown"))


@query("q79_points_earned", "SELECT ffn_id, sum(CAST(floor(spend_amount::DOUBLE / 100 * 2) AS BIGINT))::BIGINT AS points FROM {partner_txn} GROUP BY ffn_id")
def q79(t):
    each = points_earned(F.col("spend_amount").cast("double"), F.lit(100), F.lit(2))
    return t.partner_txn.groupBy("ffn_id").agg(F.sum(each).alias("points"))
