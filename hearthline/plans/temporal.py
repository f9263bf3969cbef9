"""Queries of as-of joins, ranks, metrics, periods and schedules (inventory D16-D18, D29, E21-E26, F, J08-J11, K)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions.money import apply_rate, convert, format_minor, parse_money, shown_price
from hearthline.functions.scheduling import backoff_minutes, effective_cap, slot_key, window_weight
from hearthline.operators import asof, delisting, metrics, queues, ranks, scheduling, survival
from hearthline.plans import market
from hearthline.plans.registry import query
from hearthline.sources.tables import table as t

_SCORED = """scored AS (SELECT doc_id, n_chars::DOUBLE / (n_chars + 2000)::DOUBLE AS p, quality AS y FROM documents JOIN labels USING (doc_id)),
    placed AS (SELECT *, least(9, ((row_number() OVER (ORDER BY p, doc_id) - 1) * 10) // count(*) OVER ())::INTEGER AS decile FROM scored),
    table_ AS (SELECT decile, count(*) AS n, avg(p) AS predicted, avg(y::DOUBLE) AS actual FROM placed GROUP BY 1)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select("doc_id", (F.col("n_chars").cast("double") / (F.col("n_chars") + 2000)).alias("p"), F.col("quality").alias("y"))


@query(f"WITH {_SCORED} SELECT decile, n, round(predicted, 6) AS predicted, round(actual, 6) AS actual FROM table_")
def e21_calibration(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration(_scored(spark, d), "p", "y", ["doc_id"]).select("decile", "n", F.round("predicted", 6).alias("predicted"), F.round("actual", 6).alias("actual"))


@query(f"WITH {_SCORED} SELECT round(max(abs(predicted - actual)), 6) AS max_deviation FROM table_")
def e22_worst_decile(spark: SparkSession, d: str) -> DataFrame:
    return metrics.worst_decile(metrics.calibration(_scored(spark, d), "p", "y", ["doc_id"])).select(F.round("max_deviation", 6).alias("max_deviation"))


@query(f"WITH {_SCORED} SELECT round(avg((p - y) ** 2), 6) AS brier FROM scored")
def e23_brier(spark: SparkSession, d: str) -> DataFrame:
    return metrics.brier(_scored(spark, d), "p", "y").select(F.round("brier", 6).alias("brier"))


@query(f"""WITH {_SCORED}, base AS (SELECT sum(n) AS total, sum(n * actual) / sum(n) AS b FROM table_)
    SELECT round(sum(n * (predicted - actual) ** 2) / max(total), 6) AS reliability, round(sum(n * (actual - b) ** 2) / max(total), 6) AS resolution, round(max(b * (1 - b)), 6) AS uncertainty FROM table_, base""")
def e24_brier_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = metrics.brier_parts(metrics.calibration(_scored(spark, d), "p", "y", ["doc_id"]))
    return parts.select(*[F.round(c, 6).alias(c) for c in parts.columns])


@query(f"WITH {_SCORED} SELECT round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS c_index, count(*) AS pairs FROM scored a JOIN scored b ON a.y = 1 AND b.y = 0")
def e25_c_index(spark: SparkSession, d: str) -> DataFrame:
    return metrics.c_index(_scored(spark, d), "p", "y").select(F.round("c_index", 6).alias("c_index"), F.col("pairs").cast("long").alias("pairs"))


@query("SELECT o_orderkey, least(9, ((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 10) // count(*) OVER ())::INTEGER AS decile FROM orders")
def f04_deciles(spark: SparkSession, d: str) -> DataFrame:
    return ranks.deciles(t(spark, d, "orders"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "decile")


@query("""WITH folded AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS y, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 5)::INTEGER AS fold FROM orders), sums AS (SELECT fold, count(*) AS n, sum(y)::BIGINT AS s FROM folded GROUP BY 1),
    means AS (SELECT fold, n, s, ((SELECT sum(s) FROM sums) - s)::DOUBLE / ((SELECT sum(n) FROM sums) - n) AS mean FROM sums)
    SELECT fold, n, round((s::DOUBLE / n - mean) / 100, 2) AS bias FROM means""")
def f05_fold_baseline(spark: SparkSession, d: str) -> DataFrame:
    """What the mean of the other folds is off for each fold."""
    folded = ranks.folds(t(spark, d, "orders"), "o_orderkey", 5).groupBy("fold").agg(F.count("*").alias("n"), F.sum(market.cents("o_totalprice")).alias("s"))
    mean = (folded.agg(F.sum("s")).scalar() - F.col("s")).cast("double") / (folded.agg(F.sum("n")).scalar() - F.col("n"))
    return folded.select("fold", "n", F.round((F.col("s").cast("double") / F.col("n") - mean) / 100, 2).alias("bias"))


@query("SELECT event_id, sum(round(value * 100)::BIGINT) OVER (ORDER BY ts, event_id)::BIGINT AS upto FROM events")
def f08_running_sum(spark: SparkSession, d: str) -> DataFrame:
    return ranks.prefix_sums(t(spark, d, "events"), ["ts", "event_id"], {"upto": market.cents("value")}).select("event_id", "upto")


@query("""WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), s AS (SELECT user_id, ts AS at, event_id AS rate_id, value FROM events WHERE event_type = 'signup')
    SELECT e.event_id, s.rate_id, round(s.value * 100)::BIGINT AS rate_minor, s.rate_id IS NOT NULL AND date_trunc('day', s.at) < date_trunc('day', e.ts) AS stale FROM e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.at""")
def d16_asof_rate(spark: SparkSession, d: str) -> DataFrame:
    events = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    asked = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    rates = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("rate_id"), market.cents("value").alias("rate_minor"))
    found = asof.asof_join(asked, rates, ["user_id"], "ts", "at", "rate_id", ["at", "rate_id", "rate_minor"])
    return found.select("event_id", "rate_id", "rate_minor", (F.col("rate_id").isNotNull() & (F.to_date("at") < F.to_date("ts"))).alias("stale"))


@query(f"""WITH {market.HISTORY_SQL}, marks AS (SELECT DISTINCT object_id, d.day AS mark FROM history, (VALUES (TIMESTAMP '2024-01-08'), (TIMESTAMP '2024-01-15'), (TIMESTAMP '2024-01-29')) d(day)),
    steps AS (SELECT *, price_minor - lag(price_minor) OVER w AS step, first_value(price_minor) OVER w AS start FROM history WINDOW w AS (PARTITION BY object_id ORDER BY change_at, id)),
    known AS (SELECT m.object_id, m.mark, count(*) FILTER (WHERE step < 0) AS down, count(*) FILTER (WHERE step > 0) AS up, last(price_minor ORDER BY change_at, id) AS price, max(change_at) AS known_at, any_value(start) AS start FROM marks m JOIN steps s ON s.object_id = m.object_id AND s.change_at <= m.mark GROUP BY ALL)
    SELECT m.object_id, strftime(m.mark, '%Y-%m-%d') AS mark, coalesce(down, 0)::INTEGER AS reductions, round(CASE WHEN start > 0 AND price < start THEN 100 * (start - price)::DOUBLE / start ELSE 0 END, 6) AS drop_pct,
        coalesce(floor(epoch(m.mark - known_at) / 86400), 0)::INTEGER AS days_since, CASE WHEN up > 0 THEN 1 ELSE 0 END::INTEGER AS increased FROM marks m LEFT JOIN known k ON k.object_id = m.object_id AND k.mark = m.mark""")
def d17_price_behaviour(spark: SparkSession, d: str) -> DataFrame:
    history = market.history(spark, d)
    days = F.array(*[F.lit(x).cast("timestamp") for x in ("2024-01-08", "2024-01-15", "2024-01-29")])
    marks = history.select("object_id").distinct().select("object_id", F.explode(days).alias("mark"))
    rows = asof.price_behaviour(marks, history, "object_id", "mark", "change_at", "id", "price_minor")
    return rows.select("object_id", F.date_format("mark", "yyyy-MM-dd").alias("mark"), "reductions", F.round("drop_pct", 6).alias("drop_pct"), "days_since", "increased")


@query("SELECT event_id, CASE WHEN d < 0 THEN 'down' WHEN d > 0 THEN 'up' END AS step FROM (SELECT event_id, round(value * 100)::BIGINT - lag(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)")
def f06_price_steps(spark: SparkSession, d: str) -> DataFrame:
    return asof.price_steps(market.history(spark, d), "object_id", "change_at", "id", "price_minor").select(F.col("id").alias("event_id"), "step")


@query("""WITH lives AS (SELECT o_custkey AS object_id, min(o_orderdate) AS a, max(o_orderdate) AS b, o_custkey % 2 = 0 AS gone FROM orders GROUP BY 1),
    weeks AS (SELECT *, unnest(range(greatest(ceil(epoch(b - a) / 604800), 1)::BIGINT))::INTEGER AS week FROM lives), cut AS (SELECT *, a + week * INTERVAL 7 DAY AS s, least(a + (week + 1) * INTERVAL 7 DAY, b) AS e FROM weeks)
    SELECT object_id, week, strftime(s, '%Y-%m-%d') AS starts, strftime(e, '%Y-%m-%d') AS ends, (gone AND b > s AND b <= e)::INTEGER AS target FROM cut""")
def j08_person_periods(spark: SparkSession, d: str) -> DataFrame:
    lives = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("object_id")).agg(F.min("o_orderdate").cast("timestamp").alias("start_at"), F.max("o_orderdate").cast("timestamp").alias("end_at"))
    rows = survival.person_periods(lives.withColumn("status", F.when(F.col("object_id") % 2 == 0, "delisted").otherwise("active")))
    day = lambda c, n: F.date_format(c, "yyyy-MM-dd").alias(n)
    return rows.select("object_id", "week", day("period_start", "starts"), day("period_end", "ends"), "target")


@query("""SELECT o_orderkey, round(1 - list_product(list_transform(range(5), lambda k: 1 - 1 / (1 + exp(-(-2 + 0.1::DOUBLE * least(o_orderkey % 15 + k, 12) + CASE WHEN month(o_orderdate + to_days((7 * k)::INTEGER)) >= 2 THEN 0.01::DOUBLE * month(o_orderdate + to_days((7 * k)::INTEGER)) ELSE 0 END + 0.05::DOUBLE * (o_orderkey % 3)))))), 6) AS p FROM orders""")
def j11_horizon_probability(spark: SparkSession, d: str) -> DataFrame:
    """The library's hazard with given coefficients over the five weeks of a 30-day horizon; weeks and months move on, prices stay."""
    import numpy as np

    beta = np.array([-2.0, *(0.1 * k for k in range(13)), *(0.01 * m for m in range(2, 13)), 0.05, 0, 0, 0, 0])
    rows = t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 15).alias("week"), F.col("o_orderdate").alias("period_start"), (F.col("o_orderkey") % 3).alias("reductions"), *[F.lit(0.0).alias(c) for c in ("drop_pct", "days_since", "increased", "price_deviation")], F.lit(1).alias("zone_id"))
    model = survival.Hazard([], [], [], beta, True)
    return rows.select("o_orderkey", F.round(survival.horizon_probability(model, 30), 6).alias("p"))


@query("""WITH runs AS (SELECT DISTINCT date_trunc('day', ts) AS day FROM events), last AS (SELECT user_id, max(date_trunc('day', ts)) AS seen FROM events WHERE event_type <> 'error' GROUP BY 1)
    SELECT user_id AS object_id, (SELECT count(*) FROM runs WHERE day > seen) AS misses FROM last""")
def d29_misses(spark: SparkSession, d: str) -> DataFrame:
    events = t(spark, d, "events").withColumn("day", F.to_date("ts"))
    runs = events.select("day").distinct().select(F.col("day").alias("run_id"), F.lit(1).alias("config_id"), F.col("day").cast("timestamp").alias("started_at"), F.lit("complete").alias("completeness"))
    sightings = events.where("event_type <> 'error'").select(F.col("user_id").alias("object_id"), F.col("day").alias("run_id"), F.col("ts").alias("fetched_at")).distinct()
    return delisting.misses(runs, sightings)


@query("""WITH slots AS (SELECT extract(dow FROM ts) || '-' || extract(hour FROM ts) AS slot_key, count(*) AS scans, sum(round(value)::BIGINT)::BIGINT AS new_objects FROM events GROUP BY 1),
    averaged AS (SELECT *, new_objects::DOUBLE / scans AS a FROM slots) SELECT slot_key, scans, new_objects, round(0.1 + 0.9 * (a / max(a) OVER ()), 6) AS weight FROM averaged""")
def e14_slot_weights(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    key = slot_key(F.dayofweek("ts") - 1, F.hour("ts"))
    slots = t(spark, d, "events").groupBy(key.alias("slot_key")).agg(F.count("*").alias("scans"), F.sum(F.round("value").cast("long")).alias("new_objects")).withColumn("a", F.col("new_objects").cast("double") / F.col("scans"))
    most = F.max("a").over(Window.partitionBy(F.lit(0)))  # 168 slots at most
    return slots.select("slot_key", "scans", "new_objects", F.round(window_weight(F.col("a"), most), 6).alias("weight"))


@query("""WITH r AS (SELECT user_id % 5 AS pool, dayofweek(ts)::INTEGER AS day, hour(ts) >= 12 AS late, round(value)::BIGINT AS n FROM events WHERE ts::DATE >= DATE '2024-01-20' - 14), w AS (SELECT DISTINCT user_id % 5 AS pool, day::INTEGER AS day, late FROM events, range(7) a(day), (VALUES (false), (true)) b(late))
    SELECT pool, w.day AS day, late, count(r.n) AS scans, round(coalesce(sum(r.n), 0)::DOUBLE / greatest(count(r.n), 1), 6) AS average FROM w LEFT JOIN r USING (pool, day, late) GROUP BY ALL""")
def e26_pooled_average(spark: SparkSession, d: str) -> DataFrame:
    """Half-day windows of five sources: new objects per scan over a window's slots, not the mean of the slots' means."""
    rows = t(spark, d, "events").select((F.col("user_id") % 5).alias("source_id"), F.col("ts").cast("timestamp").alias("started_at"), F.lit("complete").alias("completeness"), F.round("value").cast("long").alias("new_objects"))
    half = F.explode(F.array(F.struct(F.lit(0).alias("hour_start"), F.lit(12).alias("hour_end")), F.struct(F.lit(12).alias("hour_start"), F.lit(24).alias("hour_end")))).alias("h")
    windows = rows.select("source_id").distinct().select("source_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day_of_week")).select("source_id", "day_of_week", half).select("source_id", "day_of_week", "h.*")
    windows = windows.withColumn("window_id", F.col("day_of_week") * 100 + F.col("hour_start"))
    got = scheduling.window_weights(windows, scheduling.slot_yields(rows), dt.date(2024, 1, 20))
    return got.select(F.col("source_id").alias("pool"), F.col("day_of_week").alias("day"), (F.col("hour_start") == 12).alias("late"), "scans", F.round("average", 6).alias("average"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(least(4320, 60 * 2 ** (greatest(l_quantity, 1) - 1)))::BIGINT AS minutes, greatest(floor(l_linenumber * (1 - l_discount * 10)), 0)::INTEGER AS cap FROM lineitem")
def i44_backoff(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(backoff_minutes(F.col("l_quantity"))).cast("long").alias("minutes"), effective_cap(F.col("l_linenumber"), 1 - F.col("l_discount") * 10).alias("cap"))


@query("""WITH RECURSIVE o AS (SELECT user_id AS source_id, ts AS "at", event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE event_type IN ('error', 'purchase')),
    s AS (SELECT source_id, 0::BIGINT AS k, 0 AS strikes, 1.0::DOUBLE AS factor, false AS ok, NULL::TIMESTAMP AS "at" FROM (SELECT DISTINCT source_id FROM o)
        UNION ALL SELECT o.source_id, o.k, CASE WHEN o.ok THEN 0 ELSE s.strikes + 1 END, CASE WHEN o.ok THEN least(1.0, s.factor * 1.5) ELSE greatest(0.25, s.factor / 2) END, o.ok, o."at" FROM s JOIN o ON o.source_id = s.source_id AND o.k = s.k + 1)
    SELECT source_id, strftime("at", '%Y-%m-%d %H:%M:%S.%f') AS "at", ok, strikes, factor AS rate_factor, CASE WHEN ok THEN 0 ELSE least(4320, 60 * 2::DOUBLE ** (strikes - 1)) END::DOUBLE AS cooldown_minutes FROM s WHERE k > 0""")
def k04_cooldown_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Errors as failures, purchases as successes of each user as a source."""
    rows = t(spark, d, "events").where("event_type in ('error', 'purchase')").select(F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "purchase").alias("ok"))
    return scheduling.cooldown_ladder(rows).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("""WITH e AS (SELECT user_id, ts, round(value)::BIGINT AS n FROM events), recent AS (SELECT * FROM e WHERE ts::DATE >= DATE '2024-01-20' - 14), days AS (SELECT user_id, dow FROM (SELECT DISTINCT user_id FROM e), range(7) r(dow)),
    pooled AS (SELECT d.user_id, d.dow, count(r.ts) AS scans, coalesce(sum(n), 0)::DOUBLE / greatest(count(r.ts), 1) AS average FROM days d LEFT JOIN recent r ON r.user_id = d.user_id AND dayofweek(r.ts) = d.dow AND hour(r.ts) BETWEEN 6 AND 21 GROUP BY 1, 2),
    total AS (SELECT user_id, count(*) AS all_scans FROM recent GROUP BY 1), most AS (SELECT user_id, max(average) AS most FROM pooled GROUP BY 1), used AS (SELECT user_id, count(*) AS used FROM e WHERE date_trunc('hour', ts) = TIMESTAMP '2024-01-20 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:30:00' GROUP BY 1)
    SELECT user_id::VARCHAR AS source_id, user_id AS config_id, '6-12' AS slot_key, round(CASE WHEN coalesce(all_scans, 0) < 14 THEN 1.0 WHEN most > 0 THEN 0.1 + 0.9 * (average / most) ELSE 0.1 END, 9)::DOUBLE AS weight, (4 - coalesce(used, 0))::INTEGER AS remaining, coalesce(all_scans, 0) < 14 AS warming
    FROM pooled JOIN most USING (user_id) LEFT JOIN total USING (user_id) LEFT JOIN used USING (user_id) WHERE dow = 6 AND 4 - coalesce(used, 0) > 0""")
def k06_plan(spark: SparkSession, d: str) -> DataFrame:
    """What to crawl at a moment: users as sources in one window a day, their events as runs."""
    events = t(spark, d, "events").select(F.col("user_id").cast("string").alias("source_id"), F.col("user_id").alias("config_id"), F.col("ts").cast("timestamp").alias("started_at"), F.lit("complete").alias("completeness"), F.round("value").cast("long").alias("new_objects"))
    sources = events.select("source_id").distinct().select("source_id", F.lit("active").alias("state"), F.lit(1.0).alias("rate_factor"), F.lit(None).cast("timestamp").alias("cooldown_until"))
    windows = sources.select("source_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day_of_week")).select("source_id", F.col("day_of_week").alias("window_id"), "day_of_week", F.lit(6).alias("hour_start"), F.lit(22).alias("hour_end"), F.lit(4).alias("max_requests_per_hour"))
    weighted = scheduling.window_weights(windows, scheduling.slot_yields(events), dt.date(2024, 1, 20))
    configs = events.select("source_id", "config_id").distinct().withColumn("active", F.lit(True))
    return scheduling.plan(sources, weighted, configs, events, dt.datetime(2024, 1, 20, 12, 30)).withColumn("weight", F.round("weight", 9))


@query("""WITH q AS (SELECT ts AS created_at, CASE WHEN event_type = 'error' THEN 'pending' ELSE 'sent' END AS status FROM events WHERE ts < TIMESTAMP '2024-01-15') SELECT count(*) FILTER (WHERE status = 'pending') AS pending_total,
    count(*) FILTER (WHERE status = 'pending' AND created_at < TIMESTAMP '2024-01-15' - INTERVAL 5 MINUTE) AS pending_older, coalesce(max(floor(epoch(TIMESTAMP '2024-01-15' - created_at) / 60)) FILTER (WHERE status = 'pending'), 0)::BIGINT AS oldest_minutes FROM q""")
def k10_queue_depth(spark: SparkSession, d: str) -> DataFrame:
    as_of = dt.datetime(2024, 1, 15)
    rows = t(spark, d, "events").select(F.col("ts").cast("timestamp").alias("created_at"), F.when(F.col("event_type") == "error", "pending").otherwise("sent").alias("status"), F.lit("prod").alias("queue_ns")).where(F.col("created_at") < F.lit(as_of))
    return queues.queue_depth(rows, as_of)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error'),
    s AS (SELECT user_id, event_id, k, ts AS last, true AS sent FROM e WHERE k = 1
        UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.ts - s.last >= INTERVAL 1 DAY THEN e.ts ELSE s.last END, e.ts - s.last >= INTERVAL 1 DAY FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
    SELECT user_id, event_id FROM s WHERE sent""")
def k10_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "events").where("event_type = 'error'").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return queues.without_repeats(rows, ["user_id"], "ts", "event_id", 86400.0).select("user_id", "event_id")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, sum(round(o_totalprice)::BIGINT) OVER (ORDER BY o_orderkey) - round(o_totalprice)::BIGINT AS before FROM orders) WHERE before < 100000000")
def k12_within_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("cost"))
    return queues.within_budget(rows, ["o_orderkey"], "cost", 100_000_000).select("o_orderkey")


@query("""WITH r(code, scaled) AS (VALUES ('CZK', 241000000000::HUGEINT), ('PLN', 42731000000::HUGEINT), ('HUF', 3912500000000::HUGEINT)),
    a AS (SELECT o_orderkey, round(o_totalprice * 100)::HUGEINT AS m, ['CZK', 'PLN', 'HUF'][o_orderkey % 3 + 1] AS code FROM orders)
    SELECT o_orderkey, code, ((2 * m * 10000000000::HUGEINT + scaled) // (2 * scaled))::BIGINT AS euro_minor, ((2 * m * scaled + 10000000000::HUGEINT) // (2 * 10000000000::HUGEINT))::BIGINT AS from_euro_minor FROM a JOIN r USING (code)""")
def i10_money_rates(spark: SparkSession, d: str) -> DataFrame:
    code = F.element_at(F.array(F.lit("CZK"), F.lit("PLN"), F.lit("HUF")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rate = F.when(code == "CZK", F.lit("24.1")).when(code == "PLN", F.lit("4.2731")).otherwise("391.25").cast("decimal(20,10)")
    return t(spark, d, "orders").select("o_orderkey", code.alias("code"), apply_rate(market.cents("o_totalprice"), rate, inverse=True).alias("euro_minor"), apply_rate(market.cents("o_totalprice"), rate).alias("from_euro_minor"))


@query("""WITH a AS (SELECT o_orderkey, round(o_totalprice * 100)::HUGEINT AS m FROM orders), e AS (SELECT *, (2 * m * 10000000000::HUGEINT + 241000000000::HUGEINT) // (2 * 241000000000::HUGEINT) AS euro FROM a)
    SELECT o_orderkey, ((2 * euro * 42731000000::HUGEINT + 10000000000::HUGEINT) // (2 * 10000000000::HUGEINT))::BIGINT AS zloty_minor FROM e""")
def i11_convert_through_euro(spark: SparkSession, d: str) -> DataFrame:
    rate = lambda x: F.lit(x).cast("decimal(20,10)")
    return t(spark, d, "orders").select("o_orderkey", convert(market.cents("o_totalprice"), F.lit("CZK"), "PLN", rate("24.1"), rate("4.2731")).alias("zloty_minor"))


@query("SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS minor, CASE WHEN round(o_totalprice * 100)::BIGINT < 0 THEN '-' ELSE '' END || (abs(round(o_totalprice * 100)::BIGINT) // 100)::VARCHAR || '.' || lpad((abs(round(o_totalprice * 100)::BIGINT) % 100)::VARCHAR, 2, '0') AS shown FROM orders")
def i08_money_text(spark: SparkSession, d: str) -> DataFrame:
    shown = format_minor(market.cents("o_totalprice"))
    return t(spark, d, "orders").select("o_orderkey", parse_money(F.replace(shown, F.lit("."), F.lit(",")))["minor"].alias("minor"), shown.alias("shown"))


@query("""WITH m AS (SELECT o_orderkey, (round(o_totalprice * 100)::BIGINT * CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END) // CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 1 END * CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 1 END AS minor FROM orders)
    SELECT o_orderkey, CASE WHEN minor < 0 THEN '-' ELSE '' END || replace(format('{:,}', abs(minor) // 100), ',', ' ') || CASE WHEN abs(minor) % 100 > 0 THEN '.' || lpad((abs(minor) % 100)::VARCHAR, 2, '0') ELSE '' END || ' CZK' AS shown FROM m""")
def i09_shown_prices(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    minor = market.cents("o_totalprice") * F.when(k % 5 == 0, -1).otherwise(1)
    minor = F.when(k % 3 == 0, (F.floor(F.abs(minor) / 100) * 100 * F.signum(minor)).cast("long")).otherwise(minor)
    return t(spark, d, "orders").select("o_orderkey", shown_price(minor, F.lit("CZK")).alias("shown"))
