"""Sample jobs: a circle count and generated text, both functions of an index column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.functions.params import literal_array

# Steps of the two-dimensional low-discrepancy sequence (powers of the plastic number's inverse).
STEP_X = 0.7548776662466927
STEP_Y = 0.5698402909980532
# Multiplier and modulus of the minimal standard generator.
MULTIPLIER = 48271
MODULUS = 2147483647


def pi_points(rows: DataFrame, index: str) -> DataFrame:
    """A repeatable point in the unit square for every index, exact for all 64-bit indices."""
    return rows.select(_fraction(F.col(index), STEP_X).alias("x"), _fraction(F.col(index), STEP_Y).alias("y"))


def _fraction(index: Column, step: float) -> Column:
    """Fractional part of index * step, by whole numbers modulo 2^53, in which a step is a whole number.

    Both factors are split at 27 bits, so that no product leaves 64 bits.
    """
    whole, low = int(step * (1 << 53)), (1 << 27) - 1
    at = index.cast("bigint").bitwiseAND((1 << 53) - 1)
    a0, a1, s0, s1 = at.bitwiseAND(low), F.shiftrightunsigned(at, 27), whole & low, whole >> 27
    high = (a0 * s1 + a1 * s0).bitwiseAND((1 << 26) - 1)
    return (a0 * s0 + F.shiftleft(high, 27)).bitwiseAND((1 << 53) - 1) / float(1 << 53)


def pi_estimate(rows: DataFrame, index: str) -> DataFrame:
    """Points in the quarter circle, all points, and 4 * inside / points."""
    x, y = F.col("x"), F.col("y")
    inside = F.count_if(x * x + y * y <= 1)
    counted = pi_points(rows, index).agg(inside.alias("inside"), F.count("*").alias("points"))
    return counted.select("inside", "points", (F.col("inside") * 4.0 / F.col("points")).alias("pi"))


def _drawn(seed: Column, below: int) -> Column:
    """A number from 0 to `below` - 1."""
    return seed * MULTIPLIER % MODULUS % below


def generate_text(rows: DataFrame, index: str, words: Sequence[str], max_words: int, seed: int = 0) -> DataFrame:
    """(index, line): between 1 and `max_words` words per row, a function of index and seed only."""
    base = F.pmod(F.col(index) + seed, F.lit(MODULUS).cast("bigint"))
    length = 1 + _drawn(base, max_words)
    vocabulary = literal_array(words)
    word = lambda k: F.get(vocabulary, _drawn((base * 31 + k) % MODULUS, len(words)).cast("int"))
    line = F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), length), word), " ")
    return rows.select(index, line.alias("line"))


def generate_sized_text(
    spark, size: int, words: Sequence[str], max_words: int = 20, seed: int = 0, line_bytes: int | None = None
) -> DataFrame:
    """Generated lines of about `size` bytes; the number of lines follows from the mean line length."""
    mean_word = sum(len(word.encode()) for word in words) / len(words) + 1
    lines = max(1, round(size / (line_bytes or mean_word * (max_words + 1) / 2)))
    return generate_text(spark.range(lines), "id", words, max_words, seed)
