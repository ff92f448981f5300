"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.operators.joins import null_safe_join
from trialgrid.operators.ordinal import ordinal
from trialgrid.session import broadcast_if_small, cut_lineage

WEIGHTS = (5, 2, 1)
#: A source is repeated at most so many times.
MOST = 3
#: Offsets are multiples of this fraction, so that sums with them stay exact in doubles.
STEPS = 1 << 16
#: Equal rows are numbered in lists of so many.
TURNS = 10_000


def count_words(text: Column) -> Column:
    """Runs of anything but the six ASCII white-space characters; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): the words each source gives to a mix as large as all sources together.

    Sources by code point, null last, weigh `weights` in turn. No target is above `most` times its source; what that leaves
    over goes to the other sources by weight, until none is above. Sources without words have target 0.
    """
    totals = cut_lineage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = ordinal(totals.withColumn("missing", F.col("source").isNull()), ["missing", "source"], name="rank")
    listed = F.array(*[F.lit(w) for w in weights])
    ranked = cut_lineage(
        ranked.select("source", "source_size", F.get(listed, F.col("rank") % len(weights)).cast("bigint").alias("weight"))
    )
    everything = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    rate, full = 0.0, None
    while True:  # one small aggregate per round; a source once full stays full, and mostly few rounds are needed
        above = F.lit(most) * F.col("source_size") <= F.col("weight") * F.lit(rate)
        kept, weight, count = ranked.agg(
            F.coalesce(F.sum(F.when(above, most * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
            F.count(F.when(above, 1)),
        ).first()
        if count == full or not weight:
            break
        rate, full = (everything - kept) / weight, count
    target = F.least((F.lit(most) * F.col("source_size")).cast("double"), F.col("weight") * F.lit(rate))
    return ranked.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: str) -> Column:
    """One random number in [0, 1) per source, the same in every run."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("")))), 1, 4), 16, 10)
    return drawn.cast("double") / STEPS


def systematic_mix(
    docs: DataFrame, keys: Sequence[str], weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = "mix"
) -> DataFrame:
    """(*keys, source, size, source_size, target, copies) for (*keys, source, size): how often each document is taken.

    Every document of a source expects target / source_size copies. Expected copies are summed along the source in order of
    size, then of a hash of the keys; a random offset of the source is added, and a document is taken once per whole number
    that its step crosses. In order of size, the words taken differ from the target by little more than the largest
    document. No document is taken more than `most` times. Equal rows take equal places in turn; null keys and sources are
    values like others. The running sums are cut into ranges, so that no source is in one task.
    """
    placed = docs.select(*keys, "source", F.col("size").cast("bigint").alias("size"), F.xxhash64(*keys).alias("__tie"))
    placed = cut_lineage(placed)
    targets = source_targets(placed.select("source", "size"), weights, most)
    placed = ordinal(placed, ["size", "__tie", *keys], by=["source"], name="__at")
    joined = null_safe_join(placed, broadcast_if_small(cut_lineage(targets)), ["source"], "left")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = offset(F.col("source"), seed)
    crossed = F.floor((F.col("__at") + 1) * share + start) - F.floor(F.col("__at") * share + start)
    return joined.select(*keys, "source", "size", "source_size", "target", crossed.cast("bigint").alias("copies"))


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", name: str = "copy", **options) -> DataFrame:
    """The rows of the mix: each document once per copy taken, numbered from 1 in column `name`, all columns kept.

    If there is such a column already, the new one gets underscores in front. Rows are told apart by
    96 bits of hashes of all their columns; each of several equal ones is taken for itself.
    """
    taken_names = {column.lower() for column in docs.columns}
    while name.lower() in taken_names:
        name = "_" + name
    whole = docs.select(F.struct("*").alias("row"))
    row_hash = F.xxhash64("row").alias("hash"), F.hash("row").alias("check")
    sizes = whole.select(*row_hash, F.col("row")[source].alias("source"), count_words(F.col("row")[text]).alias("size"))
    # Equal rows are counted, not gathered; their turns are made again from the count, in short lists.
    counted = cut_lineage(sizes.groupBy("hash", "check", "source", "size").agg(F.count("*").alias("n")))
    begins = counted.select("*", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(TURNS))).alias("begin"))
    turn = F.explode(F.sequence(F.col("begin"), F.least(F.col("n"), F.col("begin") + (TURNS - 1))).cast("array<int>"))
    narrow = begins.select("hash", "check", "source", "size", turn.alias("turn"))
    taken = systematic_mix(narrow, ["hash", "check", "turn"], **options).select("hash", "check", "copies").filter("copies > 0")
    keyed = whole.select("row", *row_hash)
    if counted.filter("n > 1").limit(1).count():  # otherwise this shuffle of whole rows would change nothing
        keyed = keyed.dropDuplicates(["hash", "check"])
    copies = keyed.join(taken, ["hash", "check"])
    number = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(name)
    return copies.select("row", number).select("row.*", name)
