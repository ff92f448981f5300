"""Exact substring deduplication: bytes covered by a string of a given length that also starts elsewhere.

The suffix sort works on a sample of positions, as a difference cover does: any two equal strings have a common offset at
which both are sampled. A cover by residues needs two thirds of all positions and shuffles them once per level, which
is many times the input. Here the sample is chosen by content: of each window of `length` bytes, the position of its least
gram hash, the rightmost if tied. Equal strings choose equal offsets, and about 2 of `length` positions are sampled.

1. Sampled positions are named by all bytes of the strings that chose them. 2. Equal names repeat as a whole; a gram that has
one member repeats nowhere. 3. Names that are alone among several of their gram are compared on both sides of the sampled position, in steps: where
no other member of the gram agrees any further, no string that reaches beyond can repeat. 4. What is left is resolved by
recursion: its strings are cut into blocks by their distance to the sampled position, and named again with those of one
member of every other name; after two such levels single strings are named, and equal neighbours in the order of names are
the repeated ones.

Passages of many short words may stay below that length. Texts that lose no byte are therefore looked at by words as well: windows of
a given number of words are sampled in the same way, by the least hash of several words in a row, and where a sampled place repeats,
each window that chose it is named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.session import broadcast_if_small, cut_lineage, scratch_path

LENGTH = 400
#: Words of a passage that counts although its bytes are fewer.
WORDS = 51
#: Bytes whose hash chooses the sample.
GRAM = 32
#: Words whose hash chooses the sample of a text's windows of words; a power of two.
WORD_GRAM = 16
#: Strings handled at once; bounds the memory for a long text.
PIECE = 1 << 18
#: Rows that a task holds before it hands them on.
ROWS = 1 << 16
#: Bytes in which the sides of a sampled position are compared.
RUNG = 64
#: Strings in a block, level by level.
BLOCKS = (64, 8, 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    wide = data.astype(np.uint64)
    for half in (1, 2, 4):
        wide = wide[:-half] | wide[half:] << np.uint64(8 * half)
    count = len(data) - GRAM + 1
    hashed = np.zeros(count, dtype=np.uint64)
    for offset in range(0, GRAM, 8):
        hashed = (hashed ^ wide[offset : offset + count]) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(32)
    hashed *= np.uint64(0xD6E8FEB86659FD93)
    return hashed ^ hashed >> np.uint64(29)


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def _choices(hashed: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, at) arrays: of the `width` hashes from each of first to last on, the one at `at` is the least, the rightmost if tied."""
    low_bits = np.uint64((2 * PIECE).bit_length())
    top = np.uint64((1 << int(low_bits)) - 1)
    keys = hashed >> low_bits << low_bits | (top - np.arange(len(hashed), dtype=np.uint64))
    chosen = (top - (_window_minimum(keys, width) & top)).astype(np.int64)
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    return first, np.append(first[1:], len(chosen)) - 1, chosen[first]


def _name(data: bytes | memoryview, first: int, last: int, at: int, length: int) -> int:
    """Names all bytes of the strings starting from first to last, and where the sampled position is in them."""
    return xxhash.xxh3_64_intdigest(data[first : last + length], seed=at - first)


def sampled_runs(data: bytes | memoryview, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(gram, name, first, last, at) arrays: the strings starting from first to last chose the sampled position at."""
    width = length - GRAM + 1
    for begin in range(0, max(len(data) - length + 1, 0), PIECE):
        part = data[begin : begin + PIECE + length - 1]
        hashed = _gram_hashes(np.frombuffer(part, dtype=np.uint8))
        first, last, at = _choices(hashed, width)
        places = zip(first.tolist(), last.tolist(), at.tolist())
        names = np.fromiter((_name(part, a, b, c, length) for a, b, c in places), dtype=np.uint64, count=len(first))
        yield hashed[at].view(np.int64), names.view(np.int64), first + begin, last + begin, at + begin


#: `gram` is the hash of the gram at the sampled position; `block` the distance to it in blocks; `alone` whether a row's
#: outcome is still open.
RUNS = "gram bigint, block int, name bigint, ident bigint, hash bigint, first int, last int, at int, alone boolean"


def _sample(length: int):
    """The sampled runs of all texts; texts are read where they lie in the batch, and only columns of numbers are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0

        def joined() -> pa.RecordBatch:
            gram, name, first, last, at = (np.concatenate([part[i] for part in held]) for i in range(5))
            sizes = [len(part[0]) for part in held]
            of_text = np.repeat(np.arange(len(held)), sizes)
            ident = pa.array([part[5] for part in held], pa.int64()).take(pa.array(of_text))
            key = np.repeat(np.asarray([part[6] for part in held], dtype=np.int64), sizes)
            columns = [
                pa.array(gram), pa.array(np.zeros(len(gram), dtype=np.int32)), pa.array(name), ident, pa.array(key),
                *[pa.array(each.astype(np.int32)) for each in (first, last, at)], pa.array(np.ones(len(gram), dtype=bool)),
            ]
            return pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in RUNS.split(", ")])

        for batch in batches:
            for ident, key, body in zip(batch["ident"], batch["hash"], batch["body"]):
                for found in sampled_runs(memoryview(body.as_buffer()), length):
                    held.append((*found, ident.as_py(), key.as_py()))
                    rows += len(found[0])
                    if rows >= ROWS:
                        yield joined()
                        held.clear()
                        rows = 0
        if held:
            yield joined()

    return run


#: A piece of a listed run beside its sampled position: `rung` is its length in steps, negative to the left.
RUNGS = "gram bigint, rung int, name bigint, ident bigint, hash bigint, at int"


def _climb(length: int):
    """Names the bytes beside the sampled position of each listed run, in steps, as far as its strings reach."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for ident, key, body, runs in zip(batch["ident"], batch["hash"], batch["body"], batch["runs"]):
                for each in runs:
                    gram, at = each["gram"], each["at"]
                    for rung in range(1, (at - each["first"]) // RUNG + 1):
                        out.append((gram, -rung, digest(body[at - rung * RUNG : at]), ident, key, at))
                    for rung in range(1, (each["last"] + length - at) // RUNG + 1):
                        out.append((gram, rung, digest(body[at : at + rung * RUNG]), ident, key, at))
                    if len(out) >= ROWS:
                        yield _named(out, RUNGS)
                        out = []
            yield _named(out, RUNGS)

    return run


def _named(rows: list[tuple], schema: str) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[field.split()[0] for field in schema.split(", ")])
    frame["name"] = frame["name"].astype(np.uint64).to_numpy().view(np.int64)
    return frame


def _narrowed(members: DataFrame, beside, length: int) -> DataFrame:
    """`members` without the strings that reach beyond what any other member of the gram agrees with."""
    rungs = beside(_climb(length), RUNGS).groupBy("gram", "rung", "name")
    single = rungs.agg(F.count("*").alias("n"), *[F.min(c).alias(f"b_{c}") for c in ("ident", "hash", "at")]).filter("n = 1")
    ends = single.groupBy(F.col("gram").alias("b_gram"), "b_ident", "b_hash", "b_at").agg(
        F.min(F.when(F.col("rung") < 0, -F.col("rung"))).alias("left"), F.min(F.when(F.col("rung") > 0, F.col("rung"))).alias("right")
    )
    same = (F.col("gram") == F.col("b_gram")) & (F.col("member.hash") == F.col("b_hash")) & (F.col("member.at") == F.col("b_at"))
    joined = members.join(ends, same & F.col("member.ident").eqNullSafe(F.col("b_ident")), "left")
    at = F.col("member.at")
    first = F.greatest("member.first", at - (F.col("left") * RUNG - 1))  # null bounds do not count
    last = F.least("member.last", at - length + F.col("right") * RUNG - 1)
    kept = joined.select(*members.columns, first.alias("first"), last.alias("last")).filter("first <= last")
    return kept.withColumn("member", F.struct("member.ident", "member.hash", "first", "last", "member.at")).select(*members.columns)


def _split(width: int, length: int):
    """Cuts the listed runs of each text into blocks of `width` strings and names them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ident, key, body, runs in zip(batch["ident"], batch["hash"], batch["body"], batch["runs"]):
                for each in runs:
                    at, low, high = each["at"], each["at"] - each["last"], each["at"] - each["first"]
                    for block in range(low // width, high // width + 1):
                        first, last = at - min(high, block * width + width - 1), at - max(low, block * width)
                        name = _name(body, first, last, at, length)
                        out.append((each["gram"], block, name, ident, key, first, last, at, each["alone"]))
                    if len(out) >= ROWS:
                        yield _named(out, RUNS)
                        out = []
            yield _named(out, RUNS)

    return run


_MASK = (1 << 64) - 1
_BASE, _JOIN = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: A value of each byte, and the powers of the base and of its inverse.
_SIGNS = np.random.default_rng(8).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS, _INVERSES = (
    np.cumprod(np.append(np.uint64(1), np.full(PIECE, x, dtype=np.uint64)), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64))
)


def _word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word between white space: its bytes as digits, from running sums at the ends of words."""
    sums, shifts = [], []
    total, scale, unscale, outside = 0, 1, 1, True
    for begin in range(0, len(data), PIECE):
        part = data[begin : begin + PIECE]
        space = (part == 32) | (part - np.uint8(9) < 5)
        ends = np.flatnonzero(space != np.concatenate(([outside], space[:-1])))  # of spaces and of words, in turn
        running = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_SIGNS[part] * _POWERS[: len(part)], out=running[1:])
        sums.append(running[ends] * np.uint64(scale) + np.uint64(total))
        shifts.append(_INVERSES[ends] * np.uint64(unscale))
        total = (total + int(running[-1]) * scale) & _MASK
        scale = scale * int(_POWERS[len(part)]) & _MASK
        unscale = unscale * int(_INVERSES[len(part)]) & _MASK
        outside = bool(space[-1])
    if not outside:
        sums.append(np.array([total], dtype=np.uint64))
    if not sums:
        return np.zeros(0, dtype=np.uint64)
    bounds = np.concatenate(sums)
    hashed = (bounds[1::2] - bounds[::2]) * np.concatenate(shifts)[::2]
    return hashed ^ hashed >> np.uint64(32)


def word_runs(data: bytes | memoryview, words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(gram, first, last) arrays: the windows of `words` words that start from word first to word last chose that gram."""
    hashes = _word_hashes(np.frombuffer(data, dtype=np.uint8))
    for begin in range(0, max(len(hashes) - words + 1, 0), PIECE):
        wide, factor, half = hashes[begin : begin + PIECE + words - 1], _JOIN, 1
        while half < WORD_GRAM:
            wide = wide[:-half] * np.uint64(factor) + wide[half:]
            factor, half = factor * factor & _MASK, 2 * half
        wide = (wide ^ wide >> np.uint64(32)) * np.uint64(_BASE)
        wide ^= wide >> np.uint64(29)
        first, last, at = _choices(wide, words - WORD_GRAM + 1)
        yield wide[at].view(np.int64), first + begin, last + begin


#: `whole` is whether the text loses no byte.
PLACES = "gram bigint, ident bigint, hash bigint, first int, last int, whole boolean"
WINDOWS = "gram bigint, name bigint, ident bigint, hash bigint, first int, whole boolean"


def _sample_words(words: int):
    """The sampled places of all texts, by words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0

        def joined() -> pa.RecordBatch:
            gram, first, last = (np.concatenate([part[i] for part in held]) for i in range(3))
            of_text = pa.array(np.repeat(np.arange(len(held)), [len(part[0]) for part in held]))
            ident, key, whole = (pa.array([part[i] for part in held], kind).take(of_text) for i, kind in ((3, pa.int64()), (4, pa.int64()), (5, pa.bool_())))
            columns = [pa.array(gram), ident, key, pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), whole]
            return pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in PLACES.split(", ")])

        for batch in batches:
            for ident, key, body, whole in zip(batch["ident"], batch["hash"], batch["body"], batch["whole"]):
                for found in word_runs(memoryview(body.as_buffer()), words):
                    held.append((*found, ident.as_py(), key.as_py(), whole.as_py()))
                    rows += len(found[0])
                    if rows >= ROWS:
                        yield joined()
                        held.clear()
                        rows = 0
        if held:
            yield joined()

    return run


def _windows(words: int):
    """Names each window of words of the listed places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ident, key, body, whole, places in zip(batch["ident"], batch["hash"], batch["body"], batch["whole"], batch["places"]):
                found = body.split()
                for each in places:
                    for first in range(each["first"], each["last"] + 1):
                        name = xxhash.xxh3_64_intdigest(b" ".join(found[first : first + words]))
                        out.append((each["gram"], name, ident, key, first, whole))
                    if len(out) >= ROWS:
                        yield _named(out, WINDOWS)
                        out = []
            yield _named(out, WINDOWS)

    return run


def _repeated_words(texts: DataFrame, words: int) -> DataFrame:
    """(w_ident, w_hash, starts): the windows of `words` words that also start anywhere else, of the texts that are `whole`.

    First only hashes of places are counted; the places themselves are kept where one that repeats lies in a text that is `whole`.
    """
    places = texts.filter(F.octet_length("body") >= 2 * words - 1).mapInArrow(_sample_words(words), PLACES)
    shared = places.groupBy("gram").agg(F.count("*").alias("n"), F.bool_or("whole").alias("whole")).filter("n > 1 and whole")
    shared = broadcast_if_small(cut_lineage(shared.select("gram")))
    listed = places.join(shared, "gram", "left_semi").groupBy(F.col("ident").alias("p_ident"), F.col("hash").alias("p_hash"))
    listed = broadcast_if_small(cut_lineage(listed.agg(F.collect_set(F.struct("gram", "first", "last")).alias("places"))))
    here = F.col("ident").eqNullSafe(F.col("p_ident")) & (F.col("hash") == F.col("p_hash"))
    beside = texts.join(listed, here).select("ident", "hash", "body", "whole", "places")
    named = cut_lineage(beside.mapInPandas(_windows(words), WINDOWS))
    several = cut_lineage(named.groupBy("gram", "name").agg(F.count("*").alias("n")).filter("n > 1").select("gram", "name"))
    found = named.filter("whole").join(broadcast_if_small(several), ["gram", "name"], "left_semi")
    starts = found.groupBy(F.col("ident").alias("w_ident"), F.col("hash").alias("w_hash")).agg(F.collect_set("first").alias("starts"))
    return cut_lineage(starts)


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """The maximal runs of overlapping or touching spans."""
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return merged


def _cut(words: int):
    """What is left of each text without its repeated spans, and the repeated passages of a text that loses nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for body, spans, starts in zip(batch["body"], batch["spans"], batch["starts"]):
                merged = _merged([(s["first"], s["end"]) for s in spans] if spans is not None else [])
                kept, at = hashlib.sha256(), 0
                for start, end in merged:
                    kept.update(body[at:start])
                    at = end
                kept.update(body[at:])
                removed = sum(end - start for start, end in merged)
                passages = _merged([(int(s), int(s) + words) for s in starts] if starts is not None else [])
                out.append((len(body), removed, len(merged), kept.hexdigest(), len(merged) + len(passages), merged, passages))
            frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "removed", "passages"])
            frame.insert(0, "ident", batch["ident"])
            yield frame

    return run


def _beside(base: DataFrame, members: DataFrame, run, schema: str) -> DataFrame:
    """`run` over the texts that have members, with the list of them; a text has no more of them than positions."""
    each = F.struct("gram", "member.first", "member.last", "member.at", "alone")
    listed = members.groupBy(F.col("member.ident").alias("r_ident"), F.col("member.hash").alias("r_hash"))
    listed = broadcast_if_small(cut_lineage(listed.agg(F.collect_list(each).alias("runs"))))
    here = F.col("ident").eqNullSafe(F.col("r_ident")) & (F.col("hash") == F.col("r_hash"))
    return base.join(listed, here).select("ident", "hash", "body", "runs").mapInPandas(run, schema)


def repeated_substrings(docs: DataFrame, ident: str = "doc_id", text: str = "text", length: int = LENGTH, words: int = WORDS) -> DataFrame:
    """(ident, n_bytes, n_removed, n_spans, kept_sha256, n_passages, removed, passages), one row per row of `docs`.

    Removed is every byte covered by a string of `length` bytes of the UTF-8 text that also starts anywhere else, in the same
    document or another one; overlaps count, and no string crosses documents. `removed` holds the maximal runs (start, end).
    Of a document that loses no byte, `passages` holds the maximal runs (first word, end) covered by a string of `words` words that also
    starts anywhere else, whatever the white space between; such passages are reported, not removed. `n_passages` counts both kinds.
    Null texts are empty and lose nothing; equal rows repeat each other; null ids are kept. A name of 64 bits with the
    64-bit hash of its gram decides whether strings are equal. Copies count by name before any pair is formed, and hot names meet in plain equality joins.
    """
    if length < 2 * GRAM:
        raise ValueError(f"the length must be at least {2 * GRAM}, not {length}")
    if words < WORD_GRAM:
        raise ValueError(f"a passage must have at least {WORD_GRAM} words, not {words}")
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(F.col(ident).cast("bigint").alias("ident"), F.xxhash64(body).alias("hash"), body.alias("body"))

    def written(rows: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        rows.write.parquet(path)
        return spark.read.schema(RUNS).parquet(path)

    runs = written(base.filter(F.octet_length("body") >= length).mapInArrow(_sample(length), RUNS), "sampled")
    spans = []
    group, member = ["gram", "block"], F.struct("ident", "hash", "first", "last", "at")
    for width in (*BLOCKS, None):
        # One row per name, of the groups that have more than one row, with a member.
        several = runs.groupBy(*group).agg(F.count("*").alias("n")).filter("n > 1").select(*group)
        # By name first, where copies count before the shuffle; a gram with many names is split by the join.
        names = runs.groupBy(*group, "name").agg(F.count("*").alias("n"), F.bool_and("alone").alias("alone"), F.min(member).alias("member"))
        names = cut_lineage(names.join(several, group, "left_semi"))
        repeated = cut_lineage(names.filter("n > 1").select(*group, "name"))
        found = runs.filter("alone").join(broadcast_if_small(repeated), [*group, "name"], "left_semi")
        spans.append(found.select("ident", "hash", "first", (F.col("last") + length).alias("end")))
        if width is None:
            break
        # Groups of several names, one of them open: their members go one level deeper.
        still = (F.col("n") == 1) & F.col("alone")
        mixed = names.groupBy(*group).agg(F.count("*").alias("names"), F.bool_or(still).alias("open")).filter("names > 1 and open")
        members = names.join(mixed.select(*group), group, "left_semi").select("gram", "member", still.alias("alone"))
        if width == BLOCKS[0]:
            members = _narrowed(members, partial(_beside, base, members), length)
        # Equal rows of the input are one member each time, whose name is not alone.
        runs = written(_beside(base, members, _split(width, length), RUNS), "blocks")

    gathered = reduce(DataFrame.union, spans).groupBy("ident", "hash").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    gathered = cut_lineage(gathered).withColumnsRenamed({"ident": "s_ident", "hash": "s_hash"})
    here = F.col("ident").eqNullSafe(F.col("s_ident")) & (F.col("hash") == F.col("s_hash"))
    marked = base.join(broadcast_if_small(gathered), here, "left")
    lost = broadcast_if_small(gathered.select("s_ident", "s_hash"))
    starts = _repeated_words(base.join(lost, here, "left").select("ident", "hash", "body", F.col("s_hash").isNull().alias("whole")), words)
    by_words = F.col("ident").eqNullSafe(F.col("w_ident")) & (F.col("hash") == F.col("w_hash"))
    marked = marked.join(broadcast_if_small(starts), by_words, "left").select("ident", "body", "spans", "starts")
    schema = (
        "ident bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, "
        "removed array<array<int>>, passages array<array<int>>"
    )
    return marked.mapInPandas(_cut(words), schema).withColumnRenamed("ident", ident)
