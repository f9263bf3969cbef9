"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells.

Equal vectors of a label become one class first, so that copies cost one row. Centroids are fitted on a bounded sample; there are as many cells as 1/16 of the classes' square root, so that cells and their number grow together.
Each class goes to its nearest cell, and as a guest to each lower-numbered cell whose border is near enough: a pair is compared in
the lower of its two home cells. With slack 1 the border test is exact (no pair at the threshold is missed); less is cheaper and
trades recall for it. Cells are cut into blocks of bounded size, and each pair of blocks is one product of
two matrices, made in strips; it returns counts and a spanning forest of the links, not the pairs.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label or null id, link with nothing;
vectors of different length neither. Rows that share an id are vectors of their own, with links and components of their own. Of equally near cells the first is home. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.shared import components, written


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k unit centroids of unit rows; started from evenly spaced rows, an empty cell keeps its centroid."""
    centres = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        size = np.linalg.norm(sums, axis=1)
        full = size > 1e-12
        centres[full] = sums[full] / size[full, None]
    return centres


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very large components overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links (id, id) that connect what the Boolean matrix connects: one for each row and column with a link at most."""
    low = np.iinfo(np.int64).max
    of_left, of_right = left.copy(), right.copy()
    while True:
        new_left = np.minimum(of_left, np.where(linked, of_right[None, :], low).min(axis=1))
        new_right = np.minimum(of_right, np.where(linked, new_left[:, None], low).min(axis=0))
        if (new_left == of_left).all() and (new_right == of_right).all():
            break
        of_left, of_right = new_left, new_right
    pairs = [*zip(left.tolist(), of_left.tolist()), *zip(right.tolist(), of_right.tolist())]
    return [(a, b) for a, b in dict.fromkeys(pairs) if a != b]


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93,
                    cells: int | None = None, sample_rows: int = 16_384, block_rows: int = 2048, slack: float = 1.0) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors."""
    few = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    sound = F.expr("vec_id is not null and label is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    table = few.withColumn("vec", F.when(sound, F.transform("vec", lambda x: x.cast("double") + F.lit(0.0))))
    classes = table.where("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    numbered = F.monotonically_increasing_id().alias("cid")  # ids may repeat, so classes are named by numbers, which are written with them
    classes = written(classes.select(numbered, "rep", "copies", F.col("label").cast("string").alias("label"), F.size("vec").alias("dim"), "vec"))
    sample = classes.orderBy(F.xxhash64("vec"), "rep", "label").limit(sample_rows).select("dim", "vec").toArrow()
    k = cells or math.ceil(math.sqrt(classes.count()) / 16)
    by_dim: dict[int, list] = {}
    for dim, vec in zip(sample.column("dim").to_pylist(), sample.column("vec").to_pylist()):
        by_dim.setdefault(dim, []).append(vec)
    centres = {}
    for dim, rows in by_dim.items():
        centres[dim] = spherical_kmeans(_unit(np.array(rows)), max(1, min(k, len(rows))))
    near = slack * math.sqrt(1 - threshold * threshold)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = _unit(part.column(4).flatten().to_numpy().reshape(-1, dim))
                middle = centres.get(dim, np.ones((1, dim)))
                alike = x @ middle.T
                home = alike.argmax(axis=1)
                apart = np.sqrt(np.maximum(0, 2 - 2 * middle @ middle.T))[home] if len(middle) > 1 else np.zeros_like(alike)
                lead = alike[np.arange(len(x)), home][:, None] - alike
                guest = (lead <= near * apart + 1e-9) & (np.arange(len(middle)) < home[:, None])
                rows, cell = np.nonzero(guest)
                rows, cell = np.concatenate([np.arange(len(x)), rows]), np.concatenate([home, cell])
                raw = [v.tobytes() for v in x]
                for at in range(0, len(rows), 4096):
                    i = rows[at:at + 4096]
                    taken = part.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays(
                        [taken.column(2), taken.column(3), pa.array(cell[at:at + 4096], pa.int32()), pa.array(np.arange(at, at + len(i)) >= len(x)), taken.column(0), taken.column(1), pa.array([raw[j] for j in i], pa.binary())],
                        ["label", "dim", "cell", "guest", "cid", "copies", "x"])

    placed = written(classes.select("cid", "copies", "label", "dim", "vec").mapInArrow(assign, "label string, dim int, cell int, guest boolean, cid long, copies long, x binary"))
    key = ["label", "dim", "cell"]
    sizes = placed.groupBy(*key).agg(F.count_if(~F.col("guest")).alias("homes"), F.count_if("guest").alias("guests"))
    sizes = sizes.select(*key, F.ceil(F.col("homes") / block_rows).cast("int").alias("hb"), F.ceil(F.col("guests") / block_rows).cast("int").alias("gb")).where("hb > 0")
    block = placed.join(sizes, key).withColumn("b", F.pmod(F.xxhash64("cid"), F.when(F.col("guest"), F.col("gb")).otherwise(F.col("hb"))).cast("int"))
    homes = block.where("not guest")
    own = homes.select("*", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)).alias("other")).select(
        *key, F.lit(False).alias("mixed"), F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), (F.col("b") <= F.col("other")).alias("first"), "cid", "copies", "x")
    towards = homes.where("gb > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("gb") - 1)).alias("other")).select(
        *key, F.lit(True).alias("mixed"), F.col("b").alias("i"), F.col("other").alias("j"), F.lit(True).alias("first"), "cid", "copies", "x")
    guests = block.where("guest").select("*", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)).alias("other")).select(
        *key, F.lit(True).alias("mixed"), F.col("other").alias("i"), F.col("b").alias("j"), F.lit(False).alias("first"), "cid", "copies", "x")
    tasks = own.unionByName(towards).unionByName(guests)

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        names, copies = group.column("cid").to_numpy(), group.column("copies").to_numpy()
        x, first = _matrix(group.column("x").combine_chunks()), group.column("first").to_numpy(zero_copy_only=False)
        same = not group.column("mixed")[0].as_py() and group.column("i")[0].as_py() == group.column("j")[0].as_py()
        left, right = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
        linked = np.zeros((len(left), len(right)), bool)
        for at in range(0, len(left), 512):
            linked[at:at + 512] = x[left[at:at + 512]] @ x[right].T >= threshold
        if same:
            np.fill_diagonal(linked, False)
        some, other = linked.any(axis=1), linked.any(axis=0)
        left, right, linked = left[some], right[other], linked[np.ix_(some, other)]
        rows = list(zip(names[left].tolist(), [None] * len(left), (linked @ copies[right]).tolist()))
        if not same:
            rows += list(zip(names[right].tolist(), [None] * len(right), (copies[left] @ linked).tolist()))
        if rows:
            rows += [(a, b, 0) for a, b in _forest(linked, names[left], names[right])]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], names=["a", "b", "n"])

    compared = written(tasks.groupBy(*key, "mixed", "i", "j").applyInArrow(compare, "a long, b long, n long"))
    counted = compared.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    groups = components(compared.where("b is not null").select("a", "b"))
    named = classes.join(counted, "cid", "left").join(groups, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    back = table.select("vec_id", F.col("label").cast("string").alias("label"), "vec").join(named, ["label", "vec"], "left")
    return back.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
