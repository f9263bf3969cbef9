"""Fill-in-middle, source mixing and the filter audit against SQL and brute force."""

import hashlib
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from hearthline.llm import queries as Q
from hearthline.llm.filter_audit import audited, cells, filter_audit, masks, parity_sums
from hearthline.llm.fim_transform import LANE, Scan, draws, fim_digests, fim_transform, restored
from hearthline.llm.source_mixing import blocks_of, mix_counts, mix_sources, permuted, shard_counts, shares, slots_of

SMALL = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", ["op11_fim_transform", "op13_filter_audit"])
def test_against_sql(spark, name):
    assert compare(Q.QUERIES[name](spark, SMALL), duck(SMALL), Q.ORACLE[name]) is None


# 11 -----------------------------------------------------------------------------------------------------------------

TEXTS = ["", None, " ", " \t\n", "a", " a", "a ", "a  b ", "é ü x ß\n", "日本語 テ　キスト。", "🙂 🙂🙂\r\n🙂", "<P>", "x <S> y", "a<M", "<<P", "< P>", "<P <S <M>", "w " * 300, "日" * 700, "x" * 255, "x" * 256 + " y", "y" * 254 + "<M>",
         "ab " * 85 + "<S>" + " tail" * 90, "z" * 253 + " <P" + "q" * 300, "\u0085 nel \x1c fs", "word " * 60000]


def brute_fim(doc, text):
    text = text or ""
    units = re.findall(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+", text)
    h = [int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc, len(units), "plain", None, None, text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc, len(units), form, len(p), len(m), out)


def test_fim(spark):
    """Each odd text under many ids, so under all forms and cuts; repeated rows, null ids, clashing columns."""
    rows = [(100 * k + i, t, "o", 1) for i, t in enumerate(TEXTS) for k in range(14)] + [(None, "some words without an id", "o", 1), (3, "tie a b", "o", 1), (3, "tie a b", "o", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    got = fim_transform(docs, pool_bytes=5000)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_fim(d, t) for d, t, _, _ in rows), key=str)
    back = got.select("doc_id", restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((d, t or "") for d, t, _, _ in rows), key=str)
    digests = {r["doc_id"]: r for r in fim_digests(docs).collect()}
    assert digests[5]["output_sha256"] == hashlib.sha256(brute_fim(5, TEXTS[5])[5].encode()).hexdigest() and digests[5]["restored_sha256"] == hashlib.sha256(TEXTS[5].encode()).hexdigest()
    assert {r["form"] for r in digests.values()} == {"plain", "spm", "psm"}
    assert fim_transform(docs.limit(0)).collect() == []


def test_fim_scan():
    """Counts and cuts of every unit, over borders of lanes."""
    marks = (b"<P>", b"<S>", b"<M>")
    texts = [t.encode() for t in ["ab  cé　d " * 200, "", "<P><S>x<M>", "\n" * 600 + "q", "<" * 400 + "M>"]]
    scan = Scan(texts, marks, together=3)
    for k, t in enumerate(texts):
        starts = [m.start() for m in re.finditer(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", t)]
        assert scan.totals()[:, k].tolist() == [len(starts), len(t.decode()), sum(t.count(m) for m in marks)]
        if starts:
            byte, point = scan.cuts(np.full(len(starts), k), np.arange(len(starts)))
            assert byte.tolist() == starts and point.tolist() == [len(t[:s].decode()) for s in starts]
    assert LANE == 256 and draws(7, 42)[0] == int(hashlib.sha256(b"42:7").hexdigest()[:8], 16)


def test_fim_sentinels(spark):
    """Sentinels of other lengths, one of them with a head of another."""
    marks = ("<|pre|>", "<|pr", "⟨m⟩")
    with pytest.raises(ValueError):
        fim_transform(spark.createDataFrame([(1, "a")], "doc_id long, text string"), sentinels=marks)
    marks = ("<|pre|>", "<|suf|>", "⟨m⟩")
    rows = [(i, t) for i, t in enumerate(["a b <|pre| c", "a ⟨m⟨m⟩ b", "x y z " * 100, "<|<|suf|>"] * 5)]
    out = fim_transform(spark.createDataFrame(rows, "doc_id long, text string"), percent=100, sentinels=marks)
    got = {r["doc_id"]: r for r in out.withColumn("back", restored(F.col("output"), F.col("form"), marks)).collect()}
    assert all(got[i]["back"] == t and (got[i]["form"] == "plain") == any(m in t for m in marks) for i, t in rows)


# 12 -----------------------------------------------------------------------------------------------------------------


def brute_mix(rows, block, shard_slots, seed=42, weights=(1, 2, 3)):
    """Words taken by (source, id): every slot read word by word from its source's words laid end to end; the order of documents is the operator's."""
    sources = sorted({s for _, _, s, _, _ in rows}, key=lambda s: (s is None, s or ""))
    stream = {s: [w for d, n, src, start, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (r[3], r[4])) for w in [d] * n] for s in sources}
    sizes = [len(stream[s]) for s in sources]
    target = shares(sizes, [weights[k % len(weights)] for k in range(len(sizes))])
    slots = [slots_of(n, t, block) for n, t in zip(sizes, target)]
    taken, shards = Counter(), -(-sum(slots) // shard_slots)
    seen = [0] * len(sources)
    for shard in range(shards):
        before, counts = shard_counts(slots, shards, shard_slots, shard, seed)
        assert before.tolist() == seen and counts.sum() == min(shard_slots, sum(slots) - shard * shard_slots)
        for k, count in enumerate(counts.tolist()):
            for i in range(seen[k], seen[k] + count):
                _, at = blocks_of(np.array([k]), np.array([i]), np.array(sizes), block, seed)
                taken.update((sources[k], w) for w in stream[sources[k]][at[0] * block:(at[0] + 1) * block])
            seen[k] += count
    assert seen == slots
    return taken, dict(zip(sources, target)), dict(zip(sources, sizes))


def test_mixing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    mix, documents = mix_sources(docs, shard_slots=100)
    rows = [tuple(r) for r in documents.select("doc_id", "size", "source", "start", "place").collect()]
    texts = {r["doc_id"]: (r["text"] or "").encode().split() for r in docs.collect()}
    assert {r[0]: r[1] for r in rows} == {d: len(t) for d, t in texts.items()}
    taken, target, sizes = brute_mix(rows, 64, 100)
    pieces = mix.collect()
    got = Counter()
    for r in pieces:
        got[r["source"], r["doc_id"]] += r["words"]
        assert r["text"].encode().split() == texts[r["doc_id"]][r["first"]:r["first"] + r["words"]]
    assert got == taken
    assert len({(r["shard"], r["slot"]) for r in pieces}) == sum(slots_of(sizes[s], t, 64) for s, t in target.items())
    by_source = Counter()
    for (s, _), n in taken.items():
        by_source[s] += n
    assert all(abs(by_source[s] - t) <= 32 for s, t in target.items()) and sum(target.values()) == pytest.approx(sum(sizes.values()))
    first, again = (sorted(map(tuple, mix_counts(docs.repartition(n)).collect())) for n in (1, 7))
    assert first == again and {r[0]: r[4] for r in first} == {d: taken.get((s, d), 0) for d, _, s, _, _ in rows}


def test_mixing_odd(spark):
    """Nulls, no words, rows that share an id, a source at its cap, a long text, clashing columns, an empty table."""
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "d", "y"), (None, "n n", "x"), (2, None, "x"), (2, "", "x"), (2, " \t", None), (3, "z " * 50000, "y"), (4, "q " * 700, None), (5, "", "w"), (6, "r " * 20, "")]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, source string, place int, block string")
    got = [tuple(r) for r in mix_counts(docs).collect()]
    assert len(got) == len(rows) and Counter(r[0] for r in got) == Counter(r[0] for r in rows)
    assert sorted(r[1] for r in got) == sorted(len((t or "").split()) for _, t, _ in rows)
    assert all(r[4] <= 3 * r[1] for r in got)
    assert {(r[2], round(r[3], 6)) for r in got} == {(20, 60.0), (0, 0.0), (8, 24.0), (50001, 48545.0), (700, 2100.0)}
    assert sum(r[4] for r in got if r[2] in (8, 20, 700)) == 24 + 60 + 2100
    assert mix_counts(docs.limit(0)).collect() == []
    assert [tuple(r) for r in mix_counts(docs.where("doc_id = 5")).collect()] == [(5, 0, 0, 0.0, 0)]
    with pytest.raises(ValueError):
        mix_sources(docs, max_sources=3)


def test_mixing_parts():
    assert shares([100, 100, 100], [1, 2, 3]) == [50, 100, 150] and shares([10, 90, 0], [1, 1, 5]) == [30, 70, 0] and shares([], []) == [] and shares([0], [1]) == [0]
    capped = shares([1, 10, 1000], [1, 1, 1])
    assert capped == [3, 30, 978]
    for size in (1, 2, 3, 63, 64, 65, 1000):
        keys = np.arange(3, dtype=np.uint64)
        for key in keys:
            out = permuted(np.arange(size), np.full(size, size), np.full(size, key))
            assert sorted(out.tolist()) == list(range(size))
    counts = np.array([shard_counts([1000, 300, 7, 0], 14, 100, k, 1)[1] for k in range(14)])
    assert counts.sum(axis=0).tolist() == [1000, 300, 7, 0] and counts.sum(axis=1).tolist() == [100] * 13 + [7]
    assert 70 < counts[:13, 0].mean() < 83 and counts[:13, 0].std() > 1  # drawn, not dealt evenly
    for size, target in ((100, 0.0), (100, 149.0), (100, 300.0), (130, 120.0), (64, 33.0), (10, 4.0), (1000, 998.0)):
        blocks, slots = -(-size // 64), slots_of(size, target, 64)
        words = slots // blocks * size + slots % blocks * 64
        assert abs(words - target) <= 32 and slots <= 3 * blocks


# 13 -----------------------------------------------------------------------------------------------------------------


def brute_audit(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    judged = []
    for d, t, s in docs:
        t = t or ""
        words = [w for w in re.split(rf"[{WHITE}]+", t) if w]
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        judged.append((s or "", f, d is not None and d in good, d is not None and d in toxic))
    out = {}
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, c in enumerate(order, 1):
                gone = [j for j in left if j[1][c]]
                left = [j for j in left if not j[1][c]]
                shapley[c] += len(gone)
                failing = [j for j in mine if j[1][c]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(j[1].values()) == 1 for j in failing), sum(j[2] for j in gone), sum(j[3] for j in gone)]
        for (p, o, step), v in out.items():
            if p == part:
                v.append(shapley[o[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def test_audit(spark):
    """Copies over parts, ties of the smallest id, null ids, texts and parts, repeated labels, clashing columns."""
    long = " ".join(f"w{i}" for i in range(230))
    rows = [(1, long, "a"), (2, long, "a"), (3, long, "b"), (1, long, "b"), (1, long, "a"), (None, long, "a"), (None, None, None), (4, None, ""), (5, "", "b"), (6, "ABC # x", "a"), (7, "same " * 400, "a"), (8, long + " |", "b"), (9, long.upper(), "b"),
            (10, "same " * 400, "b"), (11, "Ab " * 5000, None), (12, " \t", "a"), (13, "x y É", "a")] + [(100 + i, "hot $", "a" if i % 3 else "b") for i in range(60)]
    labels = [(1, 1, 0), (1, 0, 0), (2, 1, None), (3, None, 1), (9, 1, 1), (6, 0, 1), (None, 1, 1), (999, 1, 1), (101, 1, 0)]
    docs = spark.createDataFrame([(*r, 5, "m") for r in rows], "doc_id long, text string, source string, n int, mask string")
    known = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, part string")
    assert sorted(map(tuple, filter_audit(docs, known).collect())) == brute_audit(rows, labels)
    assert filter_audit(docs.limit(0), known).collect() == []
    assert sorted(map(tuple, filter_audit(docs, known.limit(0)).collect())) == brute_audit(rows, [])


def test_audit_inverts(spark):
    """Parity sums give the counts of masks back, and refuse what no counts give."""
    counts = np.random.default_rng(3).integers(0, 10**12, size=(4, 32))
    signs = np.array([[1 - 2 * ((m & t).bit_count() % 2) for m in range(32)] for t in range(32)])
    assert (cells(counts @ signs) == counts).all()
    with pytest.raises(ArithmeticError):
        cells(np.arange(32))
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    counted = masks(docs, labels)
    sums = parity_sums(counted).collect()
    by_mask = Counter()
    for r in counted.collect():
        by_mask[r["part"], r["mask"]] += r["n"]
    assert all(cells(np.array(r["documents"])).tolist() == [by_mask[r["part"], m] for m in range(32)] for r in sums)
    assert audited(parity_sums(counted)).count() == 600 * len(sums)
