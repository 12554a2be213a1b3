"""Mixing sources to target weights by temperature.

Source token shares s are raised to an exponent and normalised: w = s^a / sum(s^a). The exponent is
found by repeated bisection: either the mixture reaches a target entropy, or it is as flat as a
limit on repetitions allows. The weights and a token budget give each source a quota. A source
whose quota exceeds its tokens is repeated; every epoch is a permutation of its own, and the stream
is cut into blocks in which each source has its weight's share of the tokens.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import floor, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, order_bucket, section_bits, staged, with_running_total

#: Exponents tried in one pass over the source totals: four bisections at once.
TRIED = 15
WHITE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Target:
    """Either an entropy in nats, or the most epochs that a source may be repeated.

    Without a budget, it is the least one with which every source is used whole at least once.
    """

    entropy: float | None = None
    repetitions: float | None = None
    budget_tokens: int | None = None

    def __post_init__(self) -> None:
        if (self.entropy is None) == (self.repetitions is None):
            raise ValueError("give either an entropy or a repetition limit")


def token_count(text: Column) -> Column:
    """Words of a text and one end token, so that an empty text still has a weight."""
    trimmed = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(1)).otherwise(F.size(F.split(trimmed, WHITE)) + 1).cast("long")


def source_totals(rows: DataFrame) -> DataFrame:
    """(source, tokens, share) per source."""
    totals = staged(rows.groupBy("source").agg(F.sum("tokens").cast("double").alias("tokens")), "mixing_totals")
    everything = totals.agg(F.sum("tokens")).first()[0] or 1.0
    return totals.withColumn("share", F.col("tokens") / everything)


def _measure(totals: DataFrame, exponents: list[float]) -> list[tuple[float, float, float, float]]:
    """Per exponent: sum of s^a, entropy, and the greatest and least of w/s."""
    share, columns = F.col("share"), []
    for k, a in enumerate(exponents):
        power = F.pow(share, F.lit(a))
        columns += [
            F.sum(power).alias(f"z{k}"), F.sum(power * F.log(share)).alias(f"l{k}"),
            F.max(power / share).alias(f"g{k}"), F.min(power / share).alias(f"s{k}"),
        ]
    found = totals.agg(*columns).first()
    out = []
    for k, a in enumerate(exponents):
        z = found[f"z{k}"]
        out.append((z, log(z) - a * found[f"l{k}"] / z, found[f"g{k}"] / z, found[f"s{k}"] / z))
    return out


def bisect_exponent(totals: DataFrame, target: Target, tolerance: float = 1e-9) -> float:
    """The exponent for the target. Entropy falls, and the flattest allowed exponent is sought, from 0 up.

    A target that no exponent reaches gives the nearer end of the range.
    """
    size = totals.agg(F.sum("tokens")).first()[0] or 1.0

    def too_flat(measured) -> bool:
        _, entropy, greatest, least = measured
        if target.entropy is not None:
            return entropy > target.entropy
        scale = target.budget_tokens / size if target.budget_tokens else 1 / least
        return greatest * scale > target.repetitions

    low, high = 0.0, 16.0 if target.entropy is not None else 1.0
    if not too_flat(_measure(totals, [low])[0]):
        return low
    while high - low > tolerance:
        tried = [low + (high - low) * k / (TRIED + 1) for k in range(1, TRIED + 1)]
        flat = [too_flat(m) for m in _measure(totals, tried)]
        passed = flat.index(False) if False in flat else TRIED  # monotone: too flat up to some exponent
        edges = [low, *tried, high]
        low, high = edges[passed], edges[passed + 1]
    return high


def draw_of(epoch: Column, seed: int) -> Column:
    """Where a document stands in the permutation of an epoch."""
    return F.xxhash64(F.lit(seed), epoch.cast("int"), F.col("doc_id"), F.col("mark"))


def measured_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, mark); mark tells texts of one doc_id apart."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        token_count(F.col("text")).alias("tokens"), F.xxhash64(F.col("text").cast("string")).alias("mark"),
    )


@dataclass
class Mixture:
    """Per source: weight, quota of tokens, whole epochs, and the last place used in the epoch after."""

    exponent: float
    sources: DataFrame


def plan_mixture(rows: DataFrame, target: Target, seed: int = 3) -> Mixture:
    """The weights and what they take of every source; `rows` is a written table of `measured_rows`."""
    totals = source_totals(rows)
    if totals.isEmpty():
        return Mixture(1.0, totals.selectExpr("source", "share AS weight", "tokens AS quota", "1 AS whole", "CAST(NULL AS bigint) AS last"))
    exponent = bisect_exponent(totals, target)
    z, _, _, least = _measure(totals, [exponent])[0]
    size = totals.agg(F.sum("tokens")).first()[0]
    budget = float(target.budget_tokens or size / least)
    weight = F.pow("share", F.lit(exponent)) / z
    # A quota within a billionth of whole epochs is whole: the bisection is no finer.
    epochs = F.round(weight * budget / F.col("tokens"), 8)
    quotas = totals.select(
        F.col("source").alias("of"), weight.alias("weight"), (epochs * F.col("tokens")).alias("quota"),
        F.floor(epochs).cast("int").alias("whole"), ((epochs - F.floor(epochs)) * F.col("tokens")).alias("rest"),
    )
    same = F.col("source").eqNullSafe(F.col("of"))
    bits = section_bits(rows.count())
    partly = rows.join(quotas.where("rest > 0"), same).withColumn("draw", draw_of(F.col("whole"), seed))
    partly = with_running_total(
        partly.withColumn("section", order_bucket(F.col("draw"), bits)), ["source"], "section", ["draw"], F.col("tokens"), "before"
    )
    last = partly.where("before < rest").groupBy("source").agg(F.max("draw").alias("last")).withColumnRenamed("source", "o")
    sources = quotas.join(last, F.col("of").eqNullSafe(F.col("o")), "left").select(
        F.col("of").alias("source"), "weight", "quota", "whole", "last"
    )
    return Mixture(exponent, staged(sources, "mixture"))


def epochs_of(seed: int) -> Column:
    """How often a row joined with its source is used; equal places in the permutation share their fate."""
    return F.col("whole") + F.when(draw_of(F.col("whole"), seed) <= F.col("last"), 1).otherwise(0)


def _with_source(rows: DataFrame, mixture: Mixture) -> DataFrame:
    sources = mixture.sources.withColumnRenamed("source", "of")
    return rows.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def mixed_stream(docs: DataFrame, target: Target, block_tokens: int = 1 << 20, seed: int = 3) -> DataFrame:
    """(doc_id, source, epoch, block, slot, tokens): the mixed stream, one row per use of a document.

    Block by block and slot by slot it is the order to read in; a block holds about `block_tokens`
    tokens, each source its weight's share. Null sources are one source, null texts are empty, and
    an empty table gives an empty stream.
    """
    rows = staged(measured_rows(docs), "mixing_rows")
    mixture = plan_mixture(rows, target, seed)
    used = _with_source(rows, mixture).withColumn("uses", epochs_of(seed)).where("uses > 0")
    uses = used.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    uses = uses.withColumn("draw", draw_of(F.col("epoch"), seed)).withColumn("section", order_bucket(F.col("draw"), section_bits(rows.count())))
    placed = with_running_total(staged(uses, "mixing_uses"), ["source", "epoch"], "section", ["draw"], F.col("tokens"), "before")
    budget = mixture.sources.agg(F.sum("quota")).first()[0] or 1.0
    blocks = max(1, -(-floor(budget) // block_tokens))
    totals = rows.groupBy("source").agg(F.sum("tokens").alias("whole_tokens")).withColumnRenamed("source", "of")
    at = (F.col("epoch") * F.col("whole_tokens") + F.col("before")) / F.col("quota")
    cut = placed.join(totals, F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "block", F.least(F.floor(at * blocks), F.lit(blocks - 1)).cast("long")
    )
    order = Window.partitionBy("block").orderBy("draw", "doc_id", "epoch")  # a block is bounded by its tokens
    return cut.withColumn("slot", F.row_number().over(order) - 1).select(
        "doc_id", "source", "epoch", "block", F.col("slot").cast("long").alias("slot"), "tokens"
    )


def mixed_documents(docs: DataFrame, target: Target, seed: int = 3) -> DataFrame:
    """`docs`, all its columns, with every row as often as the mixture uses it.

    Null sources are one source and null texts are empty; rows that share a doc_id and a text are
    used equally often, and an empty table gives an empty one. Only the sources' quotas are joined on.
    """
    rows = staged(measured_rows(docs), "mixing_rows")
    mixture = plan_mixture(rows, target, seed)
    columns = docs.columns
    mark, of, whole, last, uses, use = free_names(docs, "mark", "of", "whole", "last", "uses", "use")
    sources = mixture.sources.select(F.col("source").alias(of), F.col("whole").alias(whole), F.col("last").alias(last))
    marked = docs.withColumn(mark, F.xxhash64(F.col("text").cast("string")))
    draw = F.xxhash64(F.lit(seed), F.col(whole).cast("int"), F.col("doc_id").cast("long"), F.col(mark))
    often = F.col(whole) + F.when(draw <= F.col(last), 1).otherwise(0)
    joined = marked.join(sources, F.col("source").cast("string").eqNullSafe(F.col(of))).withColumn(uses, often).where(F.col(uses) > 0)
    return joined.select(*columns, F.explode(F.sequence(F.lit(1), F.col(uses))).alias(use)).select(*columns)
