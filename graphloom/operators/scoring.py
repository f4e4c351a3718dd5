"""Policy-driven weighted scores over four joined tables, and their ranking.

All of it is column expressions over three left joins; nothing is collected.
"""

from __future__ import annotations

import json
from copy import deepcopy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import strict_int

# The default weights, thresholds and points.
DEFAULT_PARAMETERS = {
    "availability": {"weight": 0.40, "penalty_per_leave_day": 10},
    "appreciation": {"weight": 0.20, "points_per_letter": 10, "max_score": 100},
    "bmi": {
        "weight": 0.10, "ideal_min": 18.5, "ideal_max": 24.9, "ideal_score": 100.0, "near_min": 17.0, "near_max_low": 25.0,
        "near_max_high": 27.0, "near_score": 80.0, "moderate_min": 16.0, "moderate_max": 30.0, "moderate_score": 60.0, "far_score": 40.0,
    },
    "non_performance": {"weight": 0.10, "penalty_per_caution_letter": 20},
    "nps": {"weight": 0.10, "scale_factor": 10},
    "coaching": {"weight": 0.05, "points_per_session": 20, "max_score": 100},
    "recognition": {"weight": 0.05, "clap_score": 100, "other_score": 80},
}
#: In the order in which they are added up.
COMPONENTS = ("bmi", "appreciation", "non_performance", "coaching", "recognition", "availability", "nps")


def parameters(policy_json: str | None) -> dict:
    """The defaults, overlaid with a policy's JSON; JSON that can't be read gives the defaults."""
    out = deepcopy(DEFAULT_PARAMETERS)
    try:
        given = json.loads(policy_json) if policy_json else {}
    except ValueError:
        given = {}
    for part, values in given.items() if isinstance(given, dict) else ():
        if isinstance(values, dict):
            out.setdefault(part, {}).update(values)
    return out


def policy_parameters(vertices: DataFrame, name: str) -> dict:
    """The parameters of the policy vertex of that name."""
    row = vertices.where((F.col("label") == "Policy") & (F.col("name") == name)).select("parameters").limit(1).collect()
    return parameters(row[0]["parameters"] if row else None)


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key, the first by ``order``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def join_sources(hr: DataFrame, perf: DataFrame, leave: DataFrame, nps: DataFrame, key: str = "iga") -> DataFrame:
    """HR with performance, leave and survey rows, by left joins; right tables are joined as they are."""
    only = lambda df, *cols: df.select(key, *cols)
    return (
        hr.join(only(perf, "bmi", "appreciation_letters", "caution_letters", "coaching_sessions", "recognition"), key, "left")
        .join(only(leave, "status", "active", "lwd", "no_of_leaves"), key, "left")
        .join(only(nps, "nps_score"), key, "left")
    )


def _raw(p: dict, lenient: bool) -> dict[str, Column]:
    """Each component's score from 0 to 100, or null if it can't be had."""
    bmi, b = F.col("bmi"), p["bmi"]
    in_ = lambda lo, hi: (bmi >= F.lit(float(lo))) & (bmi <= F.lit(float(hi)))
    bands = (
        F.when(F.isnan(bmi), F.lit(float(b["far_score"])))
        .when(in_(b["ideal_min"], b["ideal_max"]), F.lit(float(b["ideal_score"])))
        .when(((bmi >= b["near_min"]) & (bmi < b["ideal_min"])) | in_(b["near_max_low"], b["near_max_high"]), F.lit(float(b["near_score"])))
        .when(((bmi >= b["moderate_min"]) & (bmi < b["near_min"])) | ((bmi > b["near_max_high"]) & (bmi <= b["moderate_max"])), F.lit(float(b["moderate_score"])))
        .otherwise(F.lit(float(b["far_score"])))
    )
    letters, cautions, sessions = F.col("appreciation_letters").cast("int"), strict_int(F.col("caution_letters"), lenient), strict_int(F.col("coaching_sessions"), lenient)
    said = F.lower(F.trim(F.coalesce(F.col("recognition"), F.lit(""))))
    off = F.coalesce(F.col("status") == "Released", F.lit(False)) | F.coalesce(F.col("active") == "N", F.lit(False)) | F.col("lwd").isNotNull()
    unknown = F.coalesce(F.trim("status"), F.lit("")).eqNullSafe("") & F.coalesce(F.trim("active"), F.lit("")).eqNullSafe("")
    score = lambda known, value: F.when(known, value.cast("double"))
    return {
        "bmi": score(bmi.isNotNull(), bands),
        "appreciation": score(letters.isNotNull(), F.least(letters * p["appreciation"]["points_per_letter"], F.lit(p["appreciation"]["max_score"]))),
        "non_performance": score(cautions.isNotNull(), F.greatest(F.lit(100) - cautions * p["non_performance"]["penalty_per_caution_letter"], F.lit(0))),
        "coaching": score(sessions.isNotNull(), F.least(sessions * p["coaching"]["points_per_session"], F.lit(p["coaching"]["max_score"]))),
        "recognition": score(~said.isin("", "none", "null"), F.when(said.contains("6e clap"), F.lit(p["recognition"]["clap_score"])).otherwise(F.lit(p["recognition"]["other_score"]))),
        "availability": score(~unknown, F.when(off, F.lit(0)).otherwise(F.greatest(F.lit(100) - F.coalesce(F.col("no_of_leaves").cast("int"), F.lit(0)) * p["availability"]["penalty_per_leave_day"], F.lit(0)))),
        "nps": score(F.col("nps_score").isNotNull(), F.least(F.greatest(F.col("nps_score") * p["nps"]["scale_factor"], F.lit(0)), F.lit(100))),
    }


def score(joined: DataFrame, params: dict | None = None, lenient: bool = False) -> DataFrame:
    """Adds ``<component>_score`` and ``<component>_weighted``, the total, how many components count and how many are missing."""
    p = params or DEFAULT_PARAMETERS
    raw = joined.withColumns({f"{k}_score": c for k, c in _raw(p, lenient).items()})
    out = raw.withColumns({f"{k}_weighted": F.col(f"{k}_score") * F.lit(float(p[k]["weight"])) for k in COMPONENTS})
    total = sum((F.coalesce(F.col(f"{k}_weighted"), F.lit(0.0)) for k in COMPONENTS[1:]), F.coalesce(F.col(f"{COMPONENTS[0]}_weighted"), F.lit(0.0)))
    count = lambda cond: sum((F.when(cond(k), 1).otherwise(0) for k in COMPONENTS[1:]), F.when(cond(COMPONENTS[0]), 1).otherwise(0))
    out = out.withColumns({
        "total_score": F.round(total, 2),
        "components_calculated": count(lambda k: F.col(f"{k}_weighted") > 0),
        "missing_data": count(lambda k: F.col(f"{k}_score").isNull()),
    })
    return out.withColumn("percentage", F.concat(F.col("total_score").cast("string"), F.lit("%")))


def components_long(scored: DataFrame, key: str = "iga") -> DataFrame:
    """One row for each employee and component: score, weighted score, and whether it is missing."""
    parts = F.array(*[F.struct(F.lit(k).alias("component"), F.col(f"{k}_score").alias("score"), F.coalesce(F.col(f"{k}_weighted"), F.lit(0.0)).alias("weighted"), F.col(f"{k}_score").isNull().alias("missing")) for k in COMPONENTS])
    return scored.select(key, F.explode(parts).alias("c")).select(key, "c.*")


def score_one(joined: DataFrame, identifier: str | int, by: str = "name", params: dict | None = None) -> DataFrame:
    """The score of the employee of that name (any case) or id; of several the least id."""
    hit = F.lower("name") == F.lit(str(identifier).lower()) if by == "name" else F.col("iga") == F.lit(identifier)
    return score(joined.where(hit), params).orderBy("iga").limit(1)


def rank(joined: DataFrame, limit: int = 5, base: str | None = None, designation: str | None = None, order: str = "best", params: dict | None = None) -> DataFrame:
    """The best or worst ``limit`` employees, with their rank; equal scores by id.

    The limit is taken by a top-k before the ranks are numbered, so numbering
    sees ``limit`` rows only.
    """
    if order not in ("best", "worst"):
        raise ValueError("order is best or worst")
    for col, value in (("base", base), ("designation", designation)):
        if value is not None:
            joined = joined.where(F.col(col) == value)
    by = (F.col("total_score").desc() if order == "best" else F.col("total_score").asc(), F.col("iga").asc())
    top = score(joined, params).orderBy(*by).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*by)).cast("long"))
