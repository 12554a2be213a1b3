"""Secret scans in DataFrame functions only.

Three fixed patterns give the base spans. Two character Markov models add more: one of random
strings, one of ordinary identifiers, both first-order and trained from labelled samples. A long
token whose log-likelihood ratio per character is above a threshold is a span of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

# The base patterns and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Runs of these characters are scored by the models.
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "markov")
SPAN = "struct<start:int,kind:int,stop:int>"
#: Characters the models tell apart; any other counts as one more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
STATES = len(ALPHABET) + 1


@dataclass(frozen=True)
class MarkovRatio:
    """log P(next | previous) of random strings less that of ordinary identifiers, row by row."""

    ratios: tuple[float, ...]
    threshold: float


#: Lists are walked in blocks of so many entries: a list grown entry by entry is copied every time.
BLOCK = 256


def _no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _walk(values: Column, state: Column, nothing: Column, step: Callable, finish: Callable) -> Column:
    """Walks a list from left to right, block by block.

    `step(state, value)` gives the state after a value and a list of outputs, whose empty form is
    `nothing`; `finish(state, outputs)` ends the walk, the outputs being one list per block.
    """
    def one(done: Column, value: Column) -> Column:
        after, out = step(done["state"], value)
        return F.struct(after.alias("state"), F.concat(done["out"], out).alias("out"))

    def block(done: Column, held: Column) -> Column:
        return F.aggregate(
            held, F.struct(done["state"].alias("state"), nothing.alias("out")), one,
            lambda x: F.struct(x["state"].alias("state"), F.concat(done["out"], F.array(x["out"])).alias("out")),
        )

    start = F.struct(state.alias("state"), F.slice(F.array(nothing), 1, 0).alias("out"))
    return F.aggregate(_blocks(values), start, block, lambda x: finish(x["state"], x["out"]))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once: what a lambda takes from outside is worked out at every call."""
    return F.transform(F.array(value), use)[0]


def _blocks(values: Column) -> Column:
    def cut(held: Column) -> Column:
        last = F.floor(F.greatest(F.size(held) - 1, F.lit(0)) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(held, i * BLOCK + 1, F.lit(BLOCK)))

    return _once(values, cut)


def _span(start: Column, kind: Column, stop: Column) -> Column:
    return F.struct(start.alias("start"), kind.alias("kind"), stop.alias("stop"))


def _matches(pattern: str, kind: str, group: int, wanted: Callable[[Column], Column]) -> Column:
    """Spans (start, kind, end) of the matches in `text` whose group is wanted, in code points.

    The text between the matches is what a split leaves, so a match starts where all earlier pieces
    and matches end. Only wanted matches are put together; the others just move the place on.
    """
    source = F.col("text")
    whole = F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(source, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(source, pattern, -1)
    lengths = F.transform(
        F.arrays_zip(whole.alias("m"), held.alias("g"), F.slice(gaps, F.lit(1), F.size(whole)).alias("gap")),
        lambda x: F.struct(
            F.char_length(x["gap"]).alias("gap"), F.char_length(x["m"]).alias("m"), wanted(x["g"]).alias("wanted")
        ),
    )
    order, empty = F.lit(KINDS.index(kind)), _no_spans()

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        found = F.array(_span(start, order, start + x["m"]))
        return start + x["m"], F.when(x["wanted"], found).otherwise(empty)

    walked = _walk(lengths, F.lit(0), empty, step, lambda _, out: F.flatten(out))
    # Most texts have no match: spare them the split.
    return F.when(F.rlike(source, F.lit(pattern)), walked).otherwise(empty)


def _of_length(least: int) -> Callable[[Column], Column]:
    return lambda held: F.char_length(held) >= least


def base_spans() -> Column:
    """Spans of the three base patterns in the column `text`, by start and then kind."""
    return F.array_sort(F.concat(
        _matches(ASSIGN, "assign", 2, _of_length(LEAST_ASSIGN)),
        # A greedy run is found whole or not at all, so its least length can be part of the pattern.
        _matches(rf"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}", "access", 0, _of_length(LEAST_ACCESS)),
        _matches(rf"[0-9a-f]{{{LEAST_HEX},}}", "hex", 0, _of_length(LEAST_HEX)),
    ))


def _state(character: Column) -> Column:
    """0 to STATES - 1; characters outside the alphabet share the last one."""
    place = F.instr(F.lit(ALPHABET), character)
    return F.when(place > 0, place - 1).otherwise(STATES - 1)


def labelled_strings(docs: DataFrame, random_docs: int = 2000, plain_docs: int = 300, words_each: int = 120) -> DataFrame:
    """(is_random, value): a labelled sample from a bounded number of documents, those of lowest hash.

    Random: what the base patterns found (the assigned value, not its name). Ordinary: names made of
    neighbouring words, joined the way identifiers are, in lower, title and upper case. Documents
    without a base span give the ordinary ones.
    """
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64("doc_id").alias("draw"))
    secret = F.rlike(F.col("text"), F.lit(rf"{ASSIGN}|AKIA[A-Z0-9]{{16,}}|[0-9a-f]{{24,}}"))
    # Only what is needed of a text takes part in the ordering.
    strings = F.array_distinct(F.concat(
        F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: (F.char_length(v) >= 16) & v.rlike("[0-9]")),
        F.regexp_extract_all("text", F.lit(r"AKIA[A-Z0-9]{16,}"), F.lit(0)),
        F.regexp_extract_all("text", F.lit(r"[0-9a-f]{24,}"), F.lit(0)),
    ))
    found = texts.where(secret).select("draw", F.slice(strings, 1, words_each).alias("strings"))
    found = found.orderBy("draw", F.xxhash64("strings")).limit(random_docs).select(F.explode("strings").alias("value"))
    lowest = texts.select("draw").orderBy("draw").limit(plain_docs).agg(F.max("draw")).first()[0]
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{2,}"), F.lit(0)), 1, words_each)
    plain = texts.where(F.col("draw") <= F.lit(lowest).cast("long")).where(~secret).select("draw", words.alias("words"))
    plain = plain.orderBy("draw", F.xxhash64("words")).limit(plain_docs)
    three = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - 2), F.lit(3)), lambda i: F.slice(F.col("words"), i, 3)
    )
    names = plain.where(F.size("words") >= 3).select(F.explode(three).alias("w"))
    lower = F.lower(F.concat_ws("_", "w"))
    ordinary = names.select(F.explode(F.array(
        lower, F.regexp_replace(lower, "_", "-"), F.upper(lower), F.concat_ws("/", "w"),
        F.concat_ws("", F.transform("w", lambda x: F.initcap(x))), F.concat_ws("", "w"),
    )).alias("value"))
    return found.select(F.lit(True).alias("is_random"), "value").union(ordinary.select(F.lit(False), "value"))


def train(samples: DataFrame, threshold: float = 0.9, smoothing: float = 0.5) -> MarkovRatio:
    """Both models from (is_random, value). Without any sample of a class its model is uniform."""
    value = F.col("value")
    steps = samples.where(F.char_length("value") >= 2).select(
        "is_random",
        F.explode(F.transform(
            F.sequence(F.lit(1), F.char_length("value") - 1),
            lambda i: F.struct(_state(F.substring(value, i, F.lit(1))).alias("a"), _state(F.substring(value, i + 1, F.lit(1))).alias("b")),
        )).alias("step"),
    )
    counts = steps.groupBy("is_random", "step.a", "step.b").count().collect()  # at most 2 x STATES x STATES rows
    tables = {k: [[smoothing] * STATES for _ in range(STATES)] for k in (True, False)}
    for r in counts:
        tables[r.is_random][r.a][r.b] += r["count"]
    ratios = []
    for random, plain in zip(tables[True], tables[False]):
        in_random, in_plain = sum(random), sum(plain)
        ratios += [log(x / in_random) - log(y / in_plain) for x, y in zip(random, plain)]
    return MarkovRatio(tuple(ratios), threshold)


def _mean_ratio(token: Column, model: MarkovRatio) -> Column:
    """Mean log-likelihood ratio of the transitions of a token of two or more characters.

    The token is split into its characters once, so a token of any length is read in one pass.
    """
    table = F.lit(list(model.ratios))
    total = F.aggregate(
        F.split(token, ""),
        F.struct(F.lit(-1).alias("a"), F.lit(0.0).alias("sum")),
        lambda done, character: F.struct(
            _state(character).alias("a"),
            (done["sum"] + F.when(done["a"] < 0, 0.0).otherwise(F.get(table, done["a"] * STATES + _state(character)))).alias("sum"),
        ),
    )
    return total["sum"] / (F.char_length(token) - 1)


def _looks_random(model: MarkovRatio) -> Callable[[Column], Column]:
    """A token without a letter is a number, not an identifier."""
    return lambda token: token.rlike("[A-Za-z]") & (_mean_ratio(token, model) > model.threshold)


def _free_of(base: Column, tokens: Column) -> Column:
    """The base spans and the tokens that overlap none of them, by start and then kind.

    Tokens do not overlap each other, so a base span can only meet the last token before it.
    """
    state = F.struct(F.lit(0).alias("reach"), F.lit(None).cast(SPAN).alias("token"))

    def step(held: Column, s: Column) -> tuple[Column, Column]:
        is_base = s["kind"] < len(KINDS) - 1
        token, reach = held["token"], held["reach"]
        spared = F.when(token.isNull() | (is_base & (s["start"] < token["stop"])), _no_spans()).otherwise(F.array(token))
        after = F.struct(
            F.when(is_base, F.greatest(reach, s["stop"])).otherwise(reach).alias("reach"),
            F.when(~is_base & (s["start"] >= reach), s).alias("token"),
        )
        return after, F.when(is_base, F.concat(spared, F.array(s))).otherwise(spared)

    def finish(held: Column, out: Column) -> Column:
        return F.concat(F.flatten(out), F.when(held["token"].isNull(), _no_spans()).otherwise(F.array(held["token"])))

    merged = _walk(F.array_sort(F.concat(base, tokens)), state, _no_spans(), step, finish)
    return F.when(F.size(tokens) == 0, base).otherwise(merged)


def scan(docs: DataFrame, model: MarkovRatio, kept: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `kept`, text and spans for every row of `docs`; spans are structs (start, kind, stop) in order.

    Positions count code points, `stop` is exclusive, kind indexes KINDS. A null text counts as
    empty, and an empty table gives an empty one; equal rows are scanned one by one. A token that
    overlaps a base span is left to it. Columns named text or spans are replaced. Nothing is shuffled.
    """
    others = [c for c in kept if c not in ("text", "spans")]
    rows = docs.select(*others, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base, tokens = free_names(rows, "base", "tokens")
    rows = rows.withColumn(base, base_spans()).withColumn(tokens, _matches(TOKEN, "markov", 0, _looks_random(model)))
    return rows.select(*others, "text", _free_of(F.col(base), F.col(tokens)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.lit(list(KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")
    )))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base spans, their digest, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] < 3)


    def of(kind: int) -> Callable[[Column], Column]:
        return lambda s: s["kind"] == kind

    counts = [F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return scanned.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(scanned: DataFrame, mask: str = "<SECRET>") -> DataFrame:
    """The texts with every span replaced; overlapping spans are replaced together."""
    range_ = "struct<start:int,stop:int>"
    nothing = F.array().cast(f"array<{range_}>")

    def join(open_: Column, s: Column) -> tuple[Column, Column]:
        meets = open_.isNotNull() & (open_["stop"] >= s["start"])
        after = F.struct(
            F.when(meets, open_["start"]).otherwise(s["start"]).alias("start"),
            F.when(meets, F.greatest(open_["stop"], s["stop"])).otherwise(s["stop"]).alias("stop"),
        )
        return after, F.when(open_.isNull() | meets, nothing).otherwise(F.array(open_))

    merged = _walk(F.col("spans"), F.lit(None).cast(range_), nothing, join, lambda open_, out: F.concat(F.flatten(out), F.array(open_)))

    def replaced(part: Column, first: Column, held: Column) -> Column:
        """A part of the text that starts at `first` and ends with the last range of `held`."""
        return F.aggregate(
            held, F.struct(first.alias("at"), F.array().cast("array<string>").alias("parts")),
            lambda done, s: F.struct(
                s["stop"].alias("at"),
                F.concat(done["parts"], F.array(F.substring(part, done["at"] - first + 1, s["start"] - done["at"]), F.lit(mask))).alias("parts"),
            ),
            lambda done: F.array_join(done["parts"], ""),
        )

    def block(done: Column, held: Column) -> Column:
        stop = F.element_at(held, -1)["stop"]
        part = F.substring(F.col("text"), done["at"] + 1, stop - done["at"])
        replacement = _once(part, lambda p: replaced(p, done["at"], held))
        return F.struct(stop.alias("at"), F.concat(done["parts"], F.array(replacement)).alias("parts"))

    whole = F.aggregate(
        _blocks(merged), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")), block,
        lambda done: F.concat(F.array_join(done["parts"], ""), F.substring(F.col("text"), done["at"] + 1, F.char_length("text"))),
    )
    return scanned.withColumn("text", F.when(F.size("spans") > 0, whole).otherwise(F.col("text")))
