"""Streams over folders of small files, run to their end."""

import datetime as dt
import random

import pytest

from hearthline.operators.merging import upsert, upsert_adding
from hearthline.operators.queues import without_repeats
from hearthline.operators.scheduling import cooldown_ladder
from hearthline.streaming import states, timed
from hearthline.streaming.sinks import KeyedTable, upserting_into

T0 = dt.datetime(2026, 8, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def stream(spark, folder, schema, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def run(df, name, folder, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_price_changes(spark, tmp_path):
    schema = "object_id long, source_id string, price_minor long, currency string, change_at timestamp"
    batches = [[(1, "s", 100, "EUR", at(0)), (1, "s", 100, "EUR", at(1)), (2, "s", 7, "EUR", at(0)), (2, "s", None, None, at(1))], [(1, "s", 90, "EUR", at(2)), (1, "t", 90, "EUR", at(2)), (1, "s", 500, "EUR", at(0.5))], [(1, "s", 90, "EUR", at(3)), (2, "s", 7, "CZK", at(4))]]
    got = run(states.price_changes(stream(spark, tmp_path / "in", schema, batches)), "prices", tmp_path)
    assert sorted((r["object_id"], r["source_id"], r["price_minor"], r["currency"]) for r in got.collect()) == [(1, "s", 90, "EUR"), (1, "s", 100, "EUR"), (1, "t", 90, "EUR"), (2, "s", 7, "CZK"), (2, "s", 7, "EUR")]


def test_lifecycle(spark, tmp_path):
    batches = [[(1, at(0), True), (2, at(0), True)], [(1, at(1), False), (2, at(1), False)], [(1, at(2), False), (2, at(2), True)], [(1, at(3), False), (1, at(4), True)]]
    got = run(states.lifecycle(stream(spark, tmp_path / "in", "object_id long, run_at timestamp, found boolean", batches)), "lives", tmp_path)
    assert sorted((r["object_id"], r["run_at"], r["status"]) for r in got.collect()) == [(1, at(2), "delisted"), (1, at(4), "active")]


def test_slot_yields(spark, tmp_path):
    schema = "source_id string, started_at timestamp, completeness string, new_objects long"
    batches = [[("s", at(0.1), "complete", 3), ("s", at(0.2), "partial", 9), ("s", at(0.5), "complete", 2)], [("s", at(1.5), "complete", 1)], [("s", at(9), "complete", 4)], [("s", at(20), "complete", 1)]]
    got = run(states.slot_yield_stream(stream(spark, tmp_path / "in", schema, batches)), "yields", tmp_path)
    assert sorted((r["slot_key"], r["scans"], r["new_objects"]) for r in got.collect())[:3] == [("6-0", 2, 5), ("6-1", 1, 1), ("6-9", 1, 4)]


def test_first_alerts(spark, tmp_path):
    schema = "kind string, created_at timestamp, id int"
    batches = [[("a", at(0), 1)], [("a", at(0.5), 2), ("b", at(0.5), 3)], [("c", at(5), 4)], [("d", at(5.05), 6)], [("a", at(5.1), 5)]]
    got = run(states.first_alerts(stream(spark, tmp_path / "in", schema, batches), ["kind"]), "alerts", tmp_path)
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 4, 5, 6]


def test_upserting(spark, tmp_path):
    place = str(tmp_path / "table")
    schema = "k int, v string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(place)
    source = stream(spark, tmp_path / "in", schema, [[(2, "c")], [(3, "d"), (1, "e")]])
    writer = states.upserting(source, lambda: spark.read.schema(schema).parquet(place), lambda df: df.write.mode("overwrite").parquet(place), lambda base, new: upsert(base, new, ["k"]))
    writer.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.schema(schema).parquet(place).collect()) == [(1, "e"), (2, "c"), (3, "d")]


def files(folder):
    return sorted(str(p) for p in folder.rglob("part-*.parquet"))


def test_keyed_table(spark, tmp_path):
    """A batch rewrites the partitions of its keys only, and once; also where a crash left it half done, and where values are added."""
    schema = spark.createDataFrame([], "k long, v long").schema
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ("k",), buckets=8)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    adding = lambda base, new: upsert_adding(base, new, ["k"], ["v"])
    assert table.read().collect() == [] and table.apply(frame([]), adding, 0) == []
    assert table.apply(frame([(k, 1) for k in range(40)]), adding, 1) == list(range(8))
    before = files(tmp_path / "t")
    touched = table.apply(frame([(3, 10), (3, 5)]), adding, 2)
    after = files(tmp_path / "t")
    assert len(touched) == 1 and {f for f in before if f"bucket_={touched[0]}/" not in f} == {f for f in after if f"bucket_={touched[0]}/" not in f} and before != after
    assert table.apply(frame([(3, 10), (3, 5)]), adding, 2) == [] and files(tmp_path / "t") == after
    # the first partition of batch 3 was written before a crash: only the others are when it is run again
    one, other = [(k, 7) for k in range(40)], [(3, 7)]
    assert table.apply(frame(other), adding, 3) == touched and len(table.apply(frame(one), adding, 3)) == 7
    got = dict(map(tuple, table.read().collect()))
    mine = {k for k in range(40) if spark.createDataFrame([(k, 0)], schema).select(table.bucket()).first()[0] == touched[0]}
    assert got == {k: (1 + (22 if k == 3 else 0)) if k in mine else 8 for k in range(40)}


def test_upserting_into(spark, tmp_path):
    schema = "k long, v long"
    source = stream(spark, tmp_path / "in", schema, [[(1, 1), (2, 2)], [(2, 20), (3, 30)], [(None, 4)]])
    table = KeyedTable(spark, str(tmp_path / "t"), source.schema, ("k",), buckets=4)
    for _ in range(2):
        upserting_into(source, table, lambda base, new: upsert(base, new, ["k"])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, table.read().collect()), key=str) == [(1, 1), (2, 20), (3, 30), (None, 4)]


@pytest.fixture
def rocks(spark):
    old = {k: spark.conf.get(k, None) for k in timed.STORE}
    for k, v in timed.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffled(rows, seed, parts):
    """Micro-batches whose rows are out of order within two hours."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.uniform(0, 110)))
    return [order[i * len(order) // parts:(i + 1) * len(order) // parts] for i in range(parts)]


def test_cooldowns(spark, tmp_path, rocks):
    rng = random.Random(1)
    rows = [(f"s{rng.randrange(3)}", at(i / 3), rng.random() < 0.4) for i in range(60)]
    schema = "source_id string, at timestamp, ok boolean"
    far = [[("end", at(10_000 + i), True)] for i in range(2)]
    source = stream(spark, tmp_path / "in", schema, shuffled(rows, 2, 5) + far)
    got = run(timed.cooldowns(source, late="2 hours"), "cooldowns", tmp_path).where("source_id <> 'end'").collect()
    want = cooldown_ladder(spark.createDataFrame(rows, schema)).collect()
    short = lambda r: (r["source_id"], r["at"], r["strikes"], r["rate_factor"], r["cooldown_minutes"])
    assert sorted(short(r) for r in got if r["event"] != "active") == sorted(map(short, want))
    ends = set()  # a cooldown runs out unless another outcome of the source comes before
    for s in {r[0] for r in rows}:
        mine = sorted((r for r in want if r["source_id"] == s), key=lambda r: r["at"])
        for r, following in zip(mine, mine[1:] + [None]):
            end = r["at"] + dt.timedelta(minutes=r["cooldown_minutes"])
            if not r["ok"] and (following is None or end <= following["at"]):
                ends.add((s, end))
    assert {(r["source_id"], r["at"]) for r in got if r["event"] == "active"} == ends and ends


def test_alerts_apart(spark, tmp_path, rocks):
    rng = random.Random(4)
    rows = [(rng.choice(["disk", "queue"]), at(i / 4), i) for i in range(80)] + [("disk", at(3), 900), ("disk", at(3), 901)]
    schema = "kind string, created_at timestamp, id long"
    source = stream(spark, tmp_path / "in", schema, shuffled(rows, 5, 6) + [[("end", at(10_000 + i), i)] for i in range(2)])
    got = run(timed.alerts_apart(source, "kind", "created_at", "id", 5400, late="2 hours"), "apart", tmp_path)
    want = without_repeats(spark.createDataFrame(rows, schema), ["kind"], "created_at", "id", 5400)
    assert sorted(r["id"] for r in got.where("key <> 'end'").collect()) == sorted(r["id"] for r in want.collect())
