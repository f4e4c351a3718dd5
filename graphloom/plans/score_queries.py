"""Scoring and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.operators import scoring
from graphloom.plans.registry import Tables, query

_COMPONENTS = r"""
j AS (SELECT h.iga, h.name, h.base, h.designation, p.iga IS NOT NULL AS has_perf, p.bmi, p.appreciation_letters, p.caution_letters, p.coaching_sessions, p.recognition, l.status, l.active, l.lwd, l.no_of_leaves, n.nps_score
      FROM {hr} h LEFT JOIN {perf} p ON h.iga = p.iga LEFT JOIN {leave} l ON h.iga = l.iga LEFT JOIN {nps} n ON h.iga = n.iga),
c AS (SELECT iga, name, base, designation,
  CASE WHEN bmi IS NULL THEN NULL WHEN bmi >= 18.5 AND bmi <= CAST(24.9 AS DOUBLE) THEN 100.0 WHEN (bmi >= 17 AND bmi < 18.5) OR (bmi >= 25 AND bmi <= 27) THEN 80.0 WHEN (bmi >= 16 AND bmi < 17) OR (bmi > 27 AND bmi <= 30) THEN 60.0 ELSE 40.0 END::DOUBLE AS bmi_score,
  CASE WHEN appreciation_letters IS NOT NULL THEN least(appreciation_letters * 10, 100) END::DOUBLE AS appreciation_score,
  CASE WHEN regexp_full_match(caution_letters, '\s*[+-]?\d+\s*') THEN greatest(100 - CAST(caution_letters AS INT) * 20, 0) END::DOUBLE AS non_performance_score,
  CASE WHEN regexp_full_match(coaching_sessions, '\s*[+-]?\d+\s*') THEN least(CAST(coaching_sessions AS INT) * 20, 100) END::DOUBLE AS coaching_score,
  CASE WHEN lower(trim(coalesce(recognition, ''))) IN ('', 'none', 'null') THEN NULL WHEN contains(lower(recognition), '6e clap') THEN 100 ELSE 80 END::DOUBLE AS recognition_score,
  CASE WHEN status IS NULL AND active IS NULL THEN NULL WHEN coalesce(status = 'Released', false) OR coalesce(active = 'N', false) OR lwd IS NOT NULL THEN 0 ELSE greatest(100 - coalesce(no_of_leaves, 0) * 10, 0) END::DOUBLE AS availability_score,
  CASE WHEN nps_score IS NOT NULL THEN least(greatest(nps_score * 10, 0), 100) END::DOUBLE AS nps_score
  FROM j),
s AS (SELECT *, round(coalesce(bmi_score * 0.1::DOUBLE, 0) + coalesce(appreciation_score * 0.2::DOUBLE, 0) + coalesce(non_performance_score * 0.1::DOUBLE, 0) + coalesce(coaching_score * 0.05::DOUBLE, 0)
       + coalesce(recognition_score * 0.05::DOUBLE, 0) + coalesce(availability_score * 0.4::DOUBLE, 0) + coalesce(nps_score * 0.1::DOUBLE, 0), 2) AS total_score,
  (coalesce(bmi_score, 0) > 0)::BIGINT + (coalesce(appreciation_score, 0) > 0)::BIGINT + (coalesce(non_performance_score, 0) > 0)::BIGINT + (coalesce(coaching_score, 0) > 0)::BIGINT + (coalesce(recognition_score, 0) > 0)::BIGINT + (coalesce(availability_score, 0) > 0)::BIGINT + (coalesce(nps_score, 0) > 0)::BIGINT AS components_calculated,
  (bmi_score IS NULL)::BIGINT + (appreciation_score IS NULL)::BIGINT + (non_performance_score IS NULL)::BIGINT + (coaching_score IS NULL)::BIGINT + (recognition_score IS NULL)::BIGINT + (availability_score IS NULL)::BIGINT + (nps_score IS NULL)::BIGINT AS missing_data
  FROM c)
"""
_OUT = "iga, name, base, designation, total_score, components_calculated, missing_data"


def _joined(t: Tables) -> DataFrame:
    return scoring.join_sources(t.hr, t.perf, t.leave, t.nps)


def _ranked(df: DataFrame) -> DataFrame:
    return df.selectExpr("iga", "name", "base", "designation", "total_score", "bigint(components_calculated) AS components_calculated", "bigint(missing_data) AS missing_data", "rank")


@query("q01_score_rank_best", f"WITH {_COMPONENTS} SELECT {_OUT}, row_number() OVER (ORDER BY total_score DESC, iga) AS rank FROM s ORDER BY rank LIMIT 25")
def q01(t: Tables) -> DataFrame:
    return _ranked(scoring.rank(_joined(t), 25))


@query("q02_score_rank_worst_filtered", f"WITH {_COMPONENTS} SELECT {_OUT}, row_number() OVER (ORDER BY total_score, iga) AS rank FROM s WHERE base = (SELECT min(base) FROM s) AND designation = 'BUILDING' ORDER BY rank LIMIT 10")
def q02(t: Tables) -> DataFrame:
    base = t.hr.agg({"base": "min"}).first()[0]
    return _ranked(scoring.rank(_joined(t), 10, base=base, designation="BUILDING", order="worst"))


@query("q03_score_one", f"WITH {_COMPONENTS} SELECT {_OUT} FROM s WHERE iga = 7")
def q03(t: Tables) -> DataFrame:
    return scoring.score_one(_joined(t), 7, "iga").selectExpr("iga", "name", "base", "designation", "total_score", "bigint(components_calculated) AS components_calculated", "bigint(missing_data) AS missing_data")


_LONG = " UNION ALL ".join(f"SELECT iga, '{c}' AS component, {c}_score AS score, coalesce({c}_score * {w}::DOUBLE, 0) AS weighted, {c}_score IS NULL AS missing FROM c" for c, w in (("bmi", 0.1), ("appreciation", 0.2), ("non_performance", 0.1), ("coaching", 0.05), ("recognition", 0.05), ("availability", 0.4), ("nps", 0.1)))


@query("q04_score_components_long", f"WITH {_COMPONENTS} {_LONG}")
def q04(t: Tables) -> DataFrame:
    return scoring.components_long(scoring.score(_joined(t)))
