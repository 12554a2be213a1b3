"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import discard, staging_path


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write `df` as Parquet into the shared folder; the written table and its path."""
    path = staging_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str) -> DataFrame:
    return stage(df, name)[0]


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that `df` does not use, however it spells its own."""
    used = {c.lower() for c in df.columns}
    free = []
    for name in names:
        while name in used:
            name = f"_{name}"
        used.add(name)
        free.append(name)
    return free


def order_bucket(hashed: Column, bits: int) -> Column:
    """The leading bits of a 64-bit hash, so that buckets keep the order of the hashes."""
    return F.shiftrightunsigned(hashed.bitwiseXOR(F.lit(-(1 << 63))), 64 - bits).cast("int")


def section_bits(rows: int, section_rows: int = 1 << 20) -> int:
    """Leading bits for `order_bucket` with which a key of all `rows` has sections of about `section_rows`."""
    return max(8, (max(rows, 1) // section_rows).bit_length())


def with_running_total(
    df: DataFrame, keys: list[str], bucket: str, order: list[str], amount: Column, name: str
) -> DataFrame:
    """Adds the sum of `amount` over all rows before this one within its key.

    A key's rows are summed bucket by bucket (`bucket` must not decrease along `order`), and the
    totals of the earlier buckets are joined on, so no task has to hold a whole key. `df` is
    read twice and must therefore be a written table or a deterministic plan.
    """
    groups = [*keys, bucket]
    totals = df.groupBy(*groups).agg(F.sum(amount).alias("_total"))
    before = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(groups)],
        F.coalesce(
            F.sum("_total").over(before.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
    )
    within = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.lit(True)
    for i, k in enumerate(groups):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        df.withColumn("_within", F.sum(amount).over(within) - amount)
        .join(offsets, same)
        .withColumn(name, (F.col("_within") + F.col("_offset")).cast("long"))
        .drop("_within", "_offset", *[f"_k{i}" for i in range(len(groups))])
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b of type long); root is the smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each only needs the
    smallest neighbour of a node, which is a combinable minimum, so a node with very many
    neighbours is never gathered. Every round is written to the shared folder.
    """
    pairs = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    current, path = stage(pairs, "components")
    for _ in range(max_rounds):
        if _is_forest_of_stars(current):
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        following, new_path = stage(_small_star(_large_star(current)), "components")
        discard(edges.sparkSession, path)
        current, path = following, new_path
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    moved = pairs.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _is_forest_of_stars(pairs: DataFrame) -> bool:
    roles = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(
        pairs.select(F.col("b").alias("node"), F.lit(0).alias("up"))
    )
    seen = roles.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("lowest"))
    return seen.where("ups > 1 OR (ups = 1 AND lowest = 0)").isEmpty()
