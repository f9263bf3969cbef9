"""Hedonic and survival models against numpy and closed forms."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import hedonic, metrics, survival

T0 = dt.datetime(2026, 1, 5, 12)
ROWS = "object_id long, price_minor long, area_sqm double, zone_id long, property_type string, attrs map<string,string>, month int, geo_level string"


def market(n=700, noise=0.01, seed=7, geo=False):
    """Prices from known effects of zone, rooms, state, area and month."""
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for i in range(n):
        zone, area, month, state = int(rng.integers(1, 4)), float(np.round(rng.uniform(30, 120), 1)), int(rng.integers(1, 13)), ["good", "poor"][int(rng.integers(2))]
        floor = int(rng.integers(1, 9))
        level = ["building", "street"][int(rng.integers(2))] if geo else "street"
        clean = 11 + 0.1 * zone + (0.2 if state == "good" else 0) + 0.01 * floor - 0.3 * math.log(area) + 0.01 * month + (0.15 if level == "building" and geo else 0)
        own = float(rng.normal(0, noise))
        truth[i] = math.exp(own) - 1
        rows.append((i, round(math.exp(clean + own) * area), area, zone, "flat", {"state": state, "floor": str(floor)}, month, level))
    return rows, truth


ATTRIBUTES = [hedonic.Attribute("state", ("good", "poor")), hedonic.Attribute("floor")]


def parents(spark, rows=()):
    return spark.createDataFrame(list(rows), "zone_id long, parent_id long")


def test_recovery(spark):
    rows, truth = market()
    model, out = hedonic.fit(spark.createDataFrame(rows, ROWS).repartition(5), ATTRIBUTES, parents(spark))
    assert model.rejected is None and model.r_squared >= 0.9 and len(model.names) == 1 + 3 + 3 + 2 + 1 + 11
    got = {r["object_id"]: r for r in out.collect()}
    off = [abs(got[i]["price_deviation"] - truth[i]) for i in truth]
    assert np.mean(off) <= 0.012 and max(off) <= 0.06
    assert all(r["interval_low_minor"] < r["predicted_minor"] < r["interval_high_minor"] and r["null_reason"] is None for r in got.values())
    # the same by plain numpy
    x = np.array([[1.0] + [float(z == k) for k in (1, 2, 3)] + [float(a["state"] == "good"), float(a["state"] == "poor"), 0.0, float(a["floor"]), 0.0, math.log(area)] + [float(m == k) for k in range(2, 13)] for _, _, area, z, _, a, m, _ in rows])
    y = np.array([math.log(p / area) for _, p, area, *_ in rows])
    shape = np.eye(x.shape[1])
    shape[0, 0] = 0
    errors = []
    for penalty in hedonic.Settings().penalties:
        sse = 0.0
        for f in range(5):
            held = np.arange(len(y)) % 5 == f
            b = np.linalg.solve(x[~held].T @ x[~held] + penalty * shape, x[~held].T @ y[~held])
            sse += float(((y[held] - x[held] @ b) ** 2).sum())
        errors.append(sse / len(y))
    assert model.cv_mse == pytest.approx(errors, rel=1e-6) and model.penalty == hedonic.Settings().penalties[int(np.argmin(errors))]
    regular = x.T @ x + model.penalty * shape
    beta = np.linalg.solve(regular, x.T @ y)
    assert model.beta == pytest.approx(beta, abs=1e-8)
    sigma = math.sqrt(float(((y - x @ beta) ** 2).sum()) / (len(y) - x.shape[1]))
    half = model.t_critical * sigma * math.sqrt(1 + x[0] @ np.linalg.inv(regular) @ x[0])
    assert got[0]["interval_high_minor"] == pytest.approx(math.exp(x[0] @ beta + half) * rows[0][2], rel=1e-6)
    again, _ = hedonic.fit(spark.createDataFrame(rows, ROWS).repartition(3), ATTRIBUTES, parents(spark))
    assert again.beta == pytest.approx(model.beta, abs=1e-10)


def test_rejections(spark):
    none, out = hedonic.fit(spark.createDataFrame([], ROWS), ATTRIBUTES, parents(spark))
    assert none.rejected == "no_observations" and out.count() == 0
    few, out = hedonic.fit(spark.createDataFrame(market(50)[0], ROWS), ATTRIBUTES, parents(spark))
    assert few.rejected.startswith("insufficient_observations: n=50, params=") and out.where("price_deviation is null and null_reason is not null").count() == 50
    flat = [r[:5] + ({"log": str(1e6 * math.log(r[2]))},) + r[6:] for r in market(300)[0]]
    bad, _ = hedonic.fit(spark.createDataFrame(flat, ROWS), [hedonic.Attribute("log")], parents(spark), hedonic.Settings(penalties=(0.01,)))
    assert bad.rejected.startswith("degenerate_matrix")
    with pytest.raises(ValueError):
        hedonic.fit(spark.createDataFrame([], ROWS), [], parents(spark), hedonic.Settings(missing="drop"))


def test_layout_and_fallback(spark):
    rows = market(220)[0]
    sparse = [r[:5] + ({} if i % 10 < 6 else {"state": "good"},) + r[6:] for i, r in enumerate(rows)]
    frame = spark.createDataFrame(sparse, ROWS)
    level, _ = hedonic.fit(frame, [hedonic.Attribute("state", ("good", "poor"))], parents(spark), hedonic.Settings(per_param=1))
    dropped, _ = hedonic.fit(frame, [hedonic.Attribute("state", ("good", "poor"))], parents(spark), hedonic.Settings(per_param=1, missing="exclude", exclude_rate=0.5))
    assert level.missing_rates["state"] == pytest.approx(0.6, abs=0.01) and dropped.excluded == ["state"] and len(level.names) - len(dropped.names) == 3
    mixed, _ = hedonic.fit(spark.createDataFrame(market(220, geo=True)[0], ROWS), [], parents(spark), hedonic.Settings(per_param=1))
    assert "geo:not_specified" in mixed.names and len(mixed.names) == len(dropped.names) + 6
    small = [r[:3] + ((1 if i < 2 else 2),) + r[4:] for i, r in enumerate(rows)]
    _, out = hedonic.fit(spark.createDataFrame(small, ROWS), [], parents(spark, [(1, 9), (2, None)]), hedonic.Settings(per_param=1))
    assert sorted(r["object_id"] for r in out.where("zone_fallback").collect()) == [0, 1]


def test_zone_penalty():
    p = hedonic.zone_penalty([1, 2, 3], {1: 9, 2: 9, 3: None})
    assert np.allclose(p, [[0.5, -0.5, 0], [-0.5, 0.5, 0], [0, 0, 1]])
    anchored = hedonic.zone_penalty([1, 2], {1: 9, 2: 9})
    assert np.allclose(anchored, [[1.5, -0.5], [-0.5, 0.5]])


# survival -----------------------------------------------------------------------------------------------------------


def test_person_periods(spark):
    objects = spark.createDataFrame([(i, T0, T0 + dt.timedelta(days=d), s) for i, d, s in [(1, 21, "active"), (2, 10, "delisted"), (3, 7, "delisted"), (4, 2, "delisted"), (5, 0, "delisted")]], "object_id long, start_at timestamp, end_at timestamp, status string")
    got = {}
    for r in survival.person_periods(objects).orderBy("object_id", "week").collect():
        got.setdefault(r["object_id"], []).append(r["target"])
        end = r["period_end"]
    assert got == {1: [0, 0, 0], 2: [0, 1], 3: [1], 4: [1], 5: [0]} and end == T0


def test_last_periods(spark):
    """Each object's latest week, also for lives of whole weeks and of none, without a sort or an exchange."""
    days = [0, 0.5, 6.999999, 7, 7.000001, 13, 14, 350, 351.25]
    objects = spark.createDataFrame([(i, T0 + dt.timedelta(hours=i), T0 + dt.timedelta(hours=i, days=d), "delisted") for i, d in enumerate(days)] + [(98, T0, T0 - dt.timedelta(days=1), "active"), (99, T0, None, "active")], "object_id long, start_at timestamp, end_at timestamp, status string")
    periods = survival.person_periods(objects)
    last = survival.last_periods(periods)
    assert sorted((r["object_id"], r["week"]) for r in last.collect()) == sorted(tuple(r) for r in periods.groupBy("object_id").agg(F.max("week")).collect()) and last.count() == len(objects.collect())
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan


def test_hazard_estimates_sort_no_weeks(spark):
    """The registered query groups weeks only for sums, not to find each customer's last."""
    from hearthline.plans.texts import j13_hazard_estimates

    plan = j13_hazard_estimates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "max_by" not in plan


def test_price_features_of_periods(spark):
    periods = spark.createDataFrame([(1, T0 + dt.timedelta(days=d)) for d in (0, 15, 45)], "object_id long, period_start timestamp")
    history = spark.createDataFrame([(1, 1, T0, 100), (1, 2, T0 + dt.timedelta(days=10), 80)], "object_id long, id long, change_at timestamp, price_minor long")
    values = spark.createDataFrame([(1, 1, T0 + dt.timedelta(days=1), -0.1), (1, 2, T0 + dt.timedelta(days=30), 0.2)], "object_id long, id long, computed_at timestamp, price_deviation double")
    got = [(r["reductions"], r["drop_pct"], r["price_deviation"]) for r in survival.with_price_features(periods, history, values).orderBy("period_start").collect()]
    assert got == [(0, 0.0, None), (1, 20.0, -0.1), (1, 20.0, 0.2)]


def test_logistic(spark):
    rng = np.random.default_rng(3)
    for mix in (0.0, 0.9):
        a, b, c = rng.normal(size=(3, 4000))
        x = np.column_stack([np.ones(4000), a, mix * a + math.sqrt(1 - mix * mix) * b, c])
        y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-(x @ np.array([-1.0, 0.7, -0.3, 0.5]))))).astype(float)
        frame = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y)], "x array<double>, y double")
        beta, converged, _ = survival.fit_logistic(frame, 4)
        own = np.zeros(4)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ own))
            ridge = np.diag([0, 1e-6, 1e-6, 1e-6])
            own += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ own)
        assert converged and beta == pytest.approx(own, abs=1e-6)


def test_horizon(spark):
    model = survival.Hazard([], [], [], None, True)
    model.names = [n for n, _ in survival._columns(F.lit(0), F.lit(1), [], [])]
    model.beta = np.array([math.log(3) if n == "week_12plus" else 0.0 for n in model.names])
    rows = spark.createDataFrame([(0, T0), (12, T0)], "week int, period_start timestamp").withColumns({"reductions": F.lit(0), "drop_pct": F.lit(0.0), "days_since": F.lit(0), "increased": F.lit(0), "price_deviation": F.lit(None).cast("double")})
    p = lambda days: [r[0] for r in rows.orderBy("week").select(survival.horizon_probability(model, days)).collect()]
    assert p(28)[0] == pytest.approx(0.9375) and p(14)[1] == pytest.approx(0.9375) and p(7)[0] == pytest.approx(0.5)


def scored(spark, p, y):
    return spark.createDataFrame([(i, float(a), b) for i, (a, b) in enumerate(zip(p, y))], "i int, p double, y int")


def test_metrics(spark):
    of = lambda p, y: metrics.c_index(scored(spark, p, y), "p", "y").first()
    assert tuple(of([.9, .8, .2, .1], [1, 1, 0, 0])) == (1.0, 4) and tuple(of([.1, .2, .8, .9], [1, 1, 0, 0])) == (0.0, 4)
    assert tuple(of([.5] * 4, [1, 1, 0, 0])) == (0.5, 4) and tuple(of([.9, .4, .6, .1], [1, 0, 0, 1])) == (0.5, 4) and tuple(of([.5, .6], [0, 0])) == (None, 0)
    frame = scored(spark, [.2] * 50 + [.8] * 50, [1] * 10 + [0] * 40 + [1] * 40 + [0] * 10)
    assert metrics.brier(frame, "p", "y").first()[0] == pytest.approx(0.16)
    rows = spark.createDataFrame([(0, 50, 0.2, 0.2), (1, 50, 0.8, 0.8)], "decile int, n long, predicted double, actual double")
    assert tuple(round(v, 9) for v in metrics.brier_parts(rows).first()) == (0.0, 0.09, 0.25)
    table = metrics.calibration(scored(spark, [i / 20 for i in range(20)], [1 - i % 2 for i in range(20)]), "p", "y", ["i"]).orderBy("decile").collect()
    assert [r["n"] for r in table] == [2] * 10 and [r["predicted"] for r in table] == sorted(r["predicted"] for r in table)


def test_publication(spark):
    lives = lambda n, gone: spark.createDataFrame([(i, T0 + dt.timedelta(days=7 * (i % 10)), T0 + dt.timedelta(days=7 * (i % 10) + 30 + i % 5), "delisted" if i < gone else "active") for i in range(n)], "object_id long, start_at timestamp, end_at timestamp, status string")
    ready = lambda df: survival.person_periods(df).withColumns({"reductions": F.lit(0), "drop_pct": F.lit(0.0), "days_since": F.lit(0), "increased": F.lit(0), "price_deviation": F.lit(None).cast("double"), "zone_id": F.lit(1).cast("long"), "attrs": F.expr("cast(map() as map<string,string>)")})
    model, report = survival.train_published(ready(lives(5, 3)), [], min_events=100)
    assert model is None and report.status == "insufficient_history" and report.completed == 3
    model, report = survival.train_published(ready(lives(60, 20)), [], min_events=2, holdout=0.5, max_deviation=1.0)
    assert report.status == "published" and model.converged and report.brier < 0.25 and len(report.calibration) == 10
    last = ready(lives(60, 20)).groupBy("object_id").agg(F.max_by(F.struct("week", "period_start", "status", "reductions", "drop_pct", "days_since", "increased", "price_deviation", "zone_id", "attrs"), "week").alias("r")).select("object_id", "r.*")
    out = survival.estimates(last, model, report)
    assert out.where("hazard_probability is not null and null_reason is null").count() == 40 and out.where("null_reason = 'delisted' and hazard_probability is null").count() == 20
    assert out.where("hazard_probability < 0 or hazard_probability > 1").count() == 0
