"""The pipeline's stages against the operators' own brute-force results."""

import re

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hearthline.llm.queries import BYTE_BPE
from hearthline.llm.simhash_dedup import fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    clean = steps["toxicity"](spark, docs, SF)
    assert clean.columns == columns and 0.8 * docs.count() < clean.count() <= docs.count()
    single = steps["exact_dedup"](spark, docs, SF)
    first = {}
    for i, t in sorted((r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"])) for r in docs.collect()):
        first.setdefault(t, i)
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(first.values())
    near = steps["simhash_dedup"](spark, single, SF)
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in single.collect()}
    left = {r["doc_id"] for r in near.collect()}
    assert near.columns == columns
    assert all(any((prints[i] ^ prints[j]).bit_count() <= 4 for j in prints if j != i) for i in prints if i not in left)
    assert not any((prints[i] ^ prints[j]).bit_count() <= 4 for i in left for j in left if i < j)
    cut = steps["substring_dedup"](spark, near, SF)
    assert cut.columns == columns and cut.count() == near.count()
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    packed = steps["packing"](spark, cut, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == left


def test_run(spark):
    """The whole pipeline's pieces hold the tokens of what the first four stages leave."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    whole = Tokenizer.from_file(BYTE_BPE[0])
    want = {r["doc_id"]: len(whole.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == want == {r["doc_id"]: r["all"] for r in got}


def test_rows_of_equal_id_and_text(spark):
    """One of them stays, and one of near copies that share an id; stages take other columns along, and tables without n_chars or without rows."""
    words = [f"w{i}" for i in range(400)]
    text, near, other = " ".join(words), " ".join(words[:399] + ["end"]), " ".join(words[::-1])
    docs = spark.createDataFrame([(3, text, 1, "a"), (3, text, 1, "b"), (5, text, 1, "c"), (4, near, 2, "d"), (7, other, 0, "e"), (7, other, 0, "e"), (8, None, 0, "f"), (9, "", 0, "g"), (9, "", 0, "g")], "doc_id long, text string, h int, fp string")
    steps = dict(corpus_pipeline.STAGES)
    single = steps["exact_dedup"](spark, docs, SF)
    assert sorted((r["doc_id"], r["text"]) for r in single.collect()) == sorted([(3, text), (4, near), (7, other), (8, None)], key=lambda r: r[0])
    left = steps["simhash_dedup"](spark, docs, SF)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 7, 8] and left.columns == docs.columns
    same_id = spark.createDataFrame([(3, text), (3, near), (3, other)], "doc_id long, text string")
    assert steps["simhash_dedup"](spark, same_id, SF).count() == 2
    assert sorted(r["doc_id"] for r in steps["substring_dedup"](spark, docs, SF).collect()) == sorted(r["doc_id"] for r in docs.collect())
    for name in ("toxicity", "exact_dedup", "simhash_dedup", "substring_dedup", "packing"):
        assert steps[name](spark, docs.limit(0), SF).count() == 0


def test_rows_are_dropped_by_their_own_decision(spark):
    """A copy goes, also without an id, and a unique text that shares its id with a copy stays."""
    words = [f"w{i}" for i in range(40)]
    same, other, third = " ".join(words), " ".join(words[::-1]), " ".join(words[20:] + words[:20] + ["end"] * 30)
    docs = spark.createDataFrame([(1, same), (2, same), (2, other), (None, same), (None, third)], "doc_id long, text string")
    steps = dict(corpus_pipeline.STAGES)
    for name in ("exact_dedup", "simhash_dedup"):
        left = steps[name](spark, docs, SF)
        assert left.columns == docs.columns
        assert sorted(map(tuple, left.collect()), key=str) == sorted([(1, same), (2, other), (None, third)], key=str)


def test_columns_of_any_name(spark):
    """Columns that are called as the stages' own come through every stage with their values, rows that share an id included."""
    words = [f"w{i}" for i in range(200)]
    text, near, other = " ".join(words), " ".join(words[:199] + ["end"]), " ".join(words[::-1])
    names = ["__key", "key", "row", "id", "named", "of", "decided", "kept", "n", "spans", "text_key", "__passages", "component", "digest", "fp", "score"]
    texts = [(1, text), (2, text), (2, other), (None, text), (None, near), (3, other + " " + text), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, *[f"{i}/{n}" for n in names]) for i, t in texts], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, SF)
        assert left.columns == docs.columns and left.schema["text"].dataType == docs.schema["text"].dataType
        rows = left.collect()
        assert rows and all(r[n] == f"{r['doc_id']}/{n}" for r in rows for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(texts)
