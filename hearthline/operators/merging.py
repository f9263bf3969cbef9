"""Write semantics as pure functions: the table after a batch of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators.latest import top_per_key


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """delta replaces base rows of the same keys."""
    return delta.unionByName(base.join(delta.select(*keys).distinct(), keys, "left_anti"))


def upsert_adding(base: DataFrame, delta: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Counters of delta are added to those of base."""
    return base.select(*keys, *sums).unionByName(delta.select(*keys, *sums)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def insert_absent(base: DataFrame, delta: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """base and those rows of delta whose keys it lacks; of delta rows that share keys the first in order."""
    fresh = delta.join(base.select(*keys).distinct(), keys, "left_anti")
    return base.unionByName(top_per_key(fresh, keys, order))


def replace_children(base: DataFrame, changed: DataFrame, parent: str, values: str, child: str, ord_col: str = "ord") -> DataFrame:
    """base (parent, ord, child) where parents in changed (parent, values array) get their new list, numbered from 1."""
    new = changed.select(parent, F.posexplode(values).alias("__i", child)).select(parent, (F.col("__i") + 1).alias(ord_col), child)
    return base.select(parent, ord_col, child).join(changed.select(parent), parent, "left_anti").unionByName(new)


def update_known(base: DataFrame, delta: DataFrame, key: str, known: list[str], frozen: list[str] = (), frozen_when: str | None = None, maps: list[str] = (), sticky: list[str] = ()) -> DataFrame:
    """base updated by delta (one row per key): a null never overwrites a known value.

    Columns in frozen keep base's value where the column frozen_when isn't null; maps merge with delta's values first; flags in
    sticky stay true once set.
    """
    d = delta.select(key, *[F.col(c).alias(f"__{c}") for c in (*known, *frozen, *maps, *sticky)])
    joined = base.join(d, key, "left")
    new = {c: F.coalesce(f"__{c}", c) for c in known}
    new |= {c: F.when(F.col(frozen_when).isNotNull(), F.col(c)).otherwise(F.coalesce(f"__{c}", c)) for c in frozen}
    new |= {c: F.when(F.col(f"__{c}").isNull(), F.col(c)).otherwise(merge_maps(F.coalesce(F.col(c), F.expr(f"cast(map() as {dict(base.dtypes)[c]})")), F.col(f"__{c}"))) for c in maps}
    new |= {c: F.coalesce(F.col(c), F.lit(False)) | F.coalesce(F.col(f"__{c}"), F.lit(False)) for c in sticky}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in base.columns])


def merge_maps(left: Column, right: Column) -> Column:
    """The entries of both; right wins. Doesn't depend on the session's policy for equal keys."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def split_map(values: Column, known: Column) -> tuple[Column, Column]:
    """The entries whose keys are in the array known, and the rest."""
    return F.map_filter(values, lambda k, _: F.array_contains(known, k)), F.map_filter(values, lambda k, _: ~F.array_contains(known, k))


def append_distinct(held: Column, new: Column, most: int | None = None) -> Column:
    """Both arrays without repeats, sorted; the first `most` of them."""
    both = F.array_sort(F.array_union(held, new))
    return F.slice(both, 1, most) if most else both


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reconcile(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """name, n_before, n_after, same of two sets of tables."""
    a, b = table_counts(before).withColumnRenamed("n", "n_before"), table_counts(after).withColumnRenamed("n", "n_after")
    return a.join(b, "name", "full").withColumn("same", F.col("n_before").eqNullSafe(F.col("n_after")))
