"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations alone.

The documents of a source, in a seeded random order, form blocks of `block` documents. A source whose weight is w (its
parts of all parts) releases block i at floor(i / w), and its deadline is ceil((i + 1) / w). One block is placed in each
slot: the released one of the earliest deadline, ties to the source named first. Weights sum to one, so every block lies
between its release and its deadline, and after any t slots a source has had t * w blocks, give or take less than one.
The order repeats itself after as many slots as there are parts, so one such period, found by a fold, places all blocks.

A source that runs out leaves its later slots empty; the others keep theirs, and position counts documents without gaps.
Each row is placed once. Every source of the table is a part of its own: those without a weight, null being one of them,
have equal shares of `others`. Parts are made whole numbers without a common divisor; their sum, the period, must not be
over MAX_PERIOD. A null doc_id counts as the empty text in the order; repeated rows are placed one by one. An empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the mixture by source, and what all other sources have together.
WEIGHTS = {"src0": 20, "src1": 10, "src2": 10, "src3": 5, "src4": 5}
OTHERS = 50
BLOCK = 16
SEED = "mix"
MIX = "struct<part: string, block: bigint, release: bigint, deadline: bigint, slot: bigint, position: bigint>"
MAX_PERIOD = 5000
RANGE_ROWS = 100_000  # about so many documents are put in order in one range of the random key, 4,096 ranges at least


def _ints(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def period_slots(spark, parts: list[int]) -> DataFrame:
    """slot, part (index in parts), nth (of the part's blocks in the period), before (blocks of each part in earlier slots)."""
    period = sum(parts)
    if not 0 < period <= MAX_PERIOD or min(parts) < 1:
        raise ValueError(f"parts must be positive and sum to {MAX_PERIOD} at most")
    share = _ints(parts)

    def place(state: Column, t: Column) -> Column:
        given = state["given"][F.size(state["given"]) - 1]  # blocks that each part has had before slot t
        ready = F.transform(given, lambda n, s: F.when(F.floor(n * period / share[s]) <= t, F.struct(F.ceil((n + 1) * period / share[s]).alias("deadline"), s.alias("part"))))
        chosen = F.array_min(ready)["part"]
        after = F.transform(given, lambda n, s: n + F.when(s == chosen, 1).otherwise(0))
        return F.struct(F.concat(state["chosen"], F.array(chosen)).alias("chosen"), F.concat(state["given"], F.array(after)).alias("given"))

    none = F.struct(F.expr("cast(array() as array<int>)").alias("chosen"), F.array(_ints([0] * len(parts))).alias("given"))
    placed = spark.range(1).select(F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)), none, place).alias("x"))
    slots = placed.select("x.given", F.posexplode("x.chosen").alias("slot", "part"))
    return slots.select("slot", "part", F.col("given")[F.col("slot")][F.col("part")].alias("nth"), F.col("given")[F.col("slot")].alias("before"))


def whole_parts(sources: list[str | None], weights: dict[str, int], others: int) -> list[tuple[str | None, int]]:
    """Each source with its part: weighted ones in their order, then the others by name, null last."""
    rest = sorted((s for s in sources if s is not None and s not in weights)) + [None] * (None in sources)
    parts = [(s, w * max(1, len(rest))) for s, w in weights.items()] + [(s, others) for s in rest]
    divisor = math.gcd(*(w for _, w in parts)) or 1
    return [(s, w // divisor) for s, w in parts]


def mix(documents: DataFrame, weights: dict[str, int] | None = None, others: int = OTHERS, block: int = BLOCK, seed: str = SEED, name: str = "mix") -> DataFrame:
    """All columns of the documents (with doc_id and source, and text if there is one) and `name`: a struct of part (the
    source), block, release, deadline, slot and position."""
    spark = documents.sparkSession
    weights = WEIGHTS if weights is None else weights
    counted = documents.groupBy("source").agg(F.count("*").alias("n")).limit(MAX_PERIOD + 1).collect()  # a row for each source
    found = whole_parts([r["source"] for r in counted], weights, others)
    names, parts = [s for s, _ in found], [w for _, w in found]
    if not parts:
        return documents.withColumn(name, F.lit(None).cast(MIX))
    period = sum(parts)
    part = F.when(F.col("source").isNull(), len(names) - 1).otherwise(F.array_position(F.array(*[F.lit(s) for s in names if s is not None]), F.col("source")).cast("int") - 1)
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    digits = 3 + next(i for i in range(8) if 16 ** (3 + i) * RANGE_ROWS >= sum(r["n"] for r in counted))
    kept = documents.drop(name)
    docs = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), part.alias("part"), key.alias("key"), F.conv(F.substring(key, 1, digits), 16, 10).cast("long").alias("range"))

    ranges = docs.groupBy("part", "range").agg(F.count("*").alias("docs"))  # a row for each part and range
    earlier = Window.partitionBy("part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", "range", F.coalesce(F.sum("docs").over(earlier), F.lit(0)).alias("first"))
    per_source = {r["source"]: r["n"] for r in counted}
    have = F.array(*[F.lit(int(per_source.get(s, 0))).cast("bigint") for s in names])

    tie = [F.xxhash64("row.text")] if "text" in documents.columns else []
    inside = Window.partitionBy("part", "range").orderBy("key", "row.doc_id", *tie)
    ranked = docs.withColumn("n", F.row_number().over(inside)).join(ranges, ["part", "range"])
    at = F.col("first") + F.col("n") - 1
    share = _ints(parts)[F.col("part")]
    blocks = ranked.select("row", "part", F.floor(at / block).alias("block"), (at % block).alias("place"), share.alias("share"))
    blocks = blocks.withColumn("nth", (F.col("block") % F.col("share")).cast("int"))
    # a row for each slot, MAX_PERIOD at most
    placed = blocks.join(F.broadcast(period_slots(spark, parts).withColumnRenamed("slot", "period_slot")), ["part", "nth"])
    rounds = F.floor(F.col("block") / F.col("share"))
    ahead = F.transform(have, lambda n, s: F.least(n, block * (rounds * _ints(parts)[s] + F.col("before")[s])))
    position = F.aggregate(ahead, F.lit(0).cast("bigint"), lambda a, b: a + b) + F.col("place")
    source = F.array(*[F.lit(n).cast("string") for n in names])[F.col("part")]
    return placed.select(
        "row.*",
        F.struct(
            source.alias("part"), F.col("block"), F.floor(F.col("block") * period / F.col("share")).alias("release"),
            F.ceil((F.col("block") + 1) * period / F.col("share")).alias("deadline"),
            (rounds * period + F.col("period_slot")).alias("slot"), position.alias("position"),
        ).alias(name),
    )


def in_mixed_order(documents: DataFrame, rows_per_file: int = 5000, **options) -> DataFrame:
    """The same rows and columns, in the order of the mixture: files written from it hold it in their order."""
    from .storage import free_name, tasks

    name = free_name(documents, "mix")
    position = F.col(f"{name}.position")
    files = tasks(documents.sparkSession, documents.count(), rows_per_file)
    mixed = mix(documents, name=name, **options).repartitionByRange(files, position).sortWithinPartitions(position)
    return mixed.drop(name)
