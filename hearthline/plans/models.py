"""Queries over both models where they have closed forms that SQL can say, and over their gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.operators import hedonic, survival
from hearthline.plans import market
from hearthline.plans.registry import query
from hearthline.sources.tables import table as t

#: One zone, one type, one month: the ridge model is a line in the logarithm of the area whose slope is shrunk; the zone's effect is 0, as the intercept isn't penalised. 14 columns, penalty 1.
_LINE_SQL = f"""WITH {market.OBJECTS_SQL}, r AS (SELECT id, current_price_minor AS p, area_sqm AS s, ln(area_sqm) AS x, ln(current_price_minor / area_sqm) AS y, (row_number() OVER (ORDER BY id) - 1) % 5 AS fold FROM objects WHERE current_price_minor > 0 AND area_sqm > 0),
    sums AS (SELECT fold, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM r GROUP BY fold),
    total AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS syy FROM sums),
    line AS (SELECT *, (n * sxy - sx * sy) / (n * (sxx + 1) - sx * sx) AS b FROM total), fitted AS (SELECT *, (sy - b * sx) / n AS a FROM line)"""


def _line_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = market.objects(spark, d).where("current_price_minor > 0 and area_sqm > 0")
    return rows.select(F.col("id").alias("object_id"), F.col("current_price_minor").alias("price_minor"), "area_sqm", F.lit(1).cast("long").alias("zone_id"), F.lit("flat").alias("property_type"), F.expr("cast(map() as map<string,string>)").alias("attrs"), F.lit(1).alias("month"), F.lit("street").alias("geo_level"))


def _no_parents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "zone_id long, parent_id long")


@query(_LINE_SQL + """, left_out AS (SELECT s.fold, t.n - s.n AS n, t.sx - s.sx AS sx, t.sy - s.sy AS sy, t.sxx - s.sxx AS sxx, t.sxy - s.sxy AS sxy FROM sums s, total t), folded AS (SELECT *, (n * sxy - sx * sy) / (n * (sxx + 1) - sx * sx) AS b FROM left_out),
    errors AS (SELECT sum((y - (f.sy - f.b * f.sx) / f.n - f.b * x) ** 2) AS e FROM r JOIN folded f USING (fold)), sse AS (SELECT sum((y - a - b * x) ** 2) AS e FROM r, fitted)
    SELECT n::BIGINT AS n, 14::BIGINT AS params, 1.0::DOUBLE AS penalty, round(a, 6) AS intercept, round(b, 6) AS log_area, 0.0::DOUBLE AS zone, round(errors.e / n, 6) AS cv_mse, round(1 - sse.e / (syy - sy * sy / n), 6) AS r_squared, round(sqrt(sse.e / (n - 14)), 6) AS sigma FROM fitted, errors, sse""")
def j02_line_fit(spark: SparkSession, d: str) -> DataFrame:
    """The model's figures: encoding, normal equations per fold, cross-validation, penalty, spread."""
    model, _ = hedonic.fit(_line_rows(spark, d), [], _no_parents(spark), hedonic.Settings(penalties=(1.0,)))
    at = dict(zip(model.names, (float(b) for b in model.beta)))
    row = (model.n, len(model.names), model.penalty, *(round(float(v), 6) + 0.0 for v in (at["intercept"], at["log_area"], at["zone:1"], model.cv_mse[0], model.r_squared, model.sigma)))
    return spark.createDataFrame([row], "n long, params long, penalty double, intercept double, log_area double, zone double, cv_mse double, r_squared double, sigma double")


@query(_LINE_SQL + """ SELECT id AS object_id, round(p / (exp(a + b * x) * s) - 1, 6) AS price_deviation, round(exp(a + b * x) * s)::BIGINT AS predicted_minor, false AS zone_fallback FROM r, fitted""")
def j06_line_values(spark: SparkSession, d: str) -> DataFrame:
    _, predicted = hedonic.fit(_line_rows(spark, d), [], _no_parents(spark), hedonic.Settings(penalties=(1.0,)))
    return predicted.select("object_id", F.round("price_deviation", 6).alias("price_deviation"), "predicted_minor", "zone_fallback")


@query(f"""WITH {market.OBJECTS_SQL}, z AS (SELECT zone_id, count(*) AS n FROM objects GROUP BY 1), big AS (SELECT *, n >= (SELECT median(n) FROM z) AS own FROM z)
    SELECT id, CASE WHEN own THEN zone_id ELSE 1000 + n_regionkey END::BIGINT AS zone_group, NOT own AS zone_fallback FROM objects JOIN big USING (zone_id) JOIN nation ON n_nationkey = zone_id""")
def j04_zone_groups(spark: SparkSession, d: str) -> DataFrame:
    """Zones with fewer rows than half of the zones take their parent's place."""
    rows = market.objects(spark, d).select("id", "zone_id")
    parents = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("zone_id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"))
    least = rows.groupBy("zone_id").count().agg(F.median("count")).first()[0]
    return hedonic.zone_groups(rows, parents, least).select("id", "zone_group", "zone_fallback")


@query(f"""WITH {market.OBJECTS_SQL}, r AS (SELECT id FROM objects WHERE current_price_minor > 0 AND area_sqm > 0)
    SELECT id AS object_id, 'insufficient_observations: n=' || (SELECT count(*) FROM r) || ', params=14, min_obs_per_param=1000000' AS null_reason, NULL::DOUBLE AS price_deviation FROM r""")
def j05_too_few_rows(spark: SparkSession, d: str) -> DataFrame:
    _, predicted = hedonic.fit(_line_rows(spark, d), [], _no_parents(spark), hedonic.Settings(per_param=1_000_000))
    return predicted.select("object_id", "null_reason", "price_deviation")


@query("""WITH r AS (SELECT l_returnflag = 'R' AS f, l_quantity > 20 AS y FROM lineitem), p AS (SELECT f, avg(y::INTEGER) AS p FROM r GROUP BY f), b AS (SELECT max(ln(p / (1 - p))) FILTER (WHERE NOT f) AS b0, max(ln(p / (1 - p))) FILTER (WHERE f) AS b1 FROM p)
    SELECT round(b0, 6) AS intercept, round(b1 - b0, 6) AS returned, true AS converged FROM b""")
def j10_two_rates(spark: SparkSession, d: str) -> DataFrame:
    """A logistic regression on one flag: its coefficients are the log odds of the two groups."""
    rows = t(spark, d, "lineitem").select(F.array(F.lit(1.0), (F.col("l_returnflag") == "R").cast("double")).alias("x"), (F.col("l_quantity") > 20).cast("double").alias("y"))
    beta, converged, _ = survival.fit_logistic(rows, 2, ridge=0.0)
    return spark.createDataFrame([(round(float(beta[0]), 6), round(float(beta[1]), 6), converged)], "intercept double, returned double, converged boolean")


def _weeks(spark: SparkSession, d: str) -> DataFrame:
    """Customers' lives between their first and last order; every other one has left."""
    lives = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("object_id")).agg(F.min("o_orderdate").cast("timestamp").alias("start_at"), F.max("o_orderdate").cast("timestamp").alias("end_at"))
    lives = lives.withColumns({"zone_id": F.lit(1).cast("long"), "status": F.when(F.col("object_id") % 2 == 0, "delisted").otherwise("active")})
    return survival.person_periods(lives).withColumns({"reductions": F.lit(0), "drop_pct": F.lit(0.0), "days_since": F.lit(0), "increased": F.lit(0), "price_deviation": F.lit(None).cast("double"), "attrs": F.expr("cast(map() as map<string,string>)")})


@query("""WITH spans AS (SELECT o_custkey AS k, min(o_orderdate)::TIMESTAMP AS a, max(o_orderdate)::TIMESTAMP AS b FROM orders GROUP BY 1), gone AS (SELECT count(*) AS n FROM spans WHERE k % 2 = 0 AND b > a)
    SELECT 'events' AS gate, 'insufficient_history' AS status, 'events=' || n || ', min_events=1000000' AS reason, n::BIGINT AS completed FROM gone UNION ALL SELECT 'early events', 'uncalibrated', 'no_events_in_train', n FROM gone UNION ALL SELECT 'later rows', 'uncalibrated', 'test_too_small', n FROM gone""")
def j12_gates(spark: SparkSession, d: str) -> DataFrame:
    """Why a hazard model isn't published: too few events, none before the split, too few rows after it."""
    weeks = _weeks(spark, d)
    tries = {"events": {"min_events": 1_000_000}, "early events": {"min_events": 1, "holdout": 0.0}, "later rows": {"min_events": 1, "holdout": 0.9999999, "min_test": 10**9}}
    reports = [(gate, survival.train_published(weeks, [], **options)[1]) for gate, options in tries.items()]
    return spark.createDataFrame([(gate, r.status, r.reason, r.completed) for gate, r in reports], "gate string, status string, reason string, completed long")


@query("""WITH spans AS (SELECT o_custkey AS k, min(o_orderdate)::TIMESTAMP AS a, max(o_orderdate)::TIMESTAMP AS b FROM orders GROUP BY 1), weeks AS (SELECT k, greatest(ceil((epoch_us(b) - epoch_us(a))::DOUBLE / 604800000000), 1)::BIGINT AS n FROM spans)
    SELECT k AS object_id, NULL::DOUBLE AS hazard_probability, CASE WHEN k % 2 = 0 THEN 'delisted' ELSE 'insufficient_history' END AS null_reason FROM weeks""")
def j13_unpublished_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Without a published model every object gets a reason in place of a probability."""
    weeks = _weeks(spark, d)
    model, report = survival.train_published(weeks, [], min_events=1_000_000)
    return survival.estimates(weeks.where("week = 0"), model, report)
