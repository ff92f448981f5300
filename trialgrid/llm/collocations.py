"""Phrases that occur together, found by dynamic itemset counting over cyclic scans of corpus shards.

The corpus is written once, cut into SHARDS. Step t scans shard t mod SHARDS. All single words are counted in the first cycle.
A longer phrase becomes active in the step after both its parts, without the last and without the first word, have reached
the threshold, and is counted until it has seen every shard once, so lengths are interleaved: frequent phrases of two and
three words are counted while the first cycle still runs. Counting ends when no active phrase lacks a shard.

What has reached the threshold, and in which step, goes to the tasks as a bit-sliced Bloom filter of bounded size, with
one bit per step in every slot. A false positive can only count a phrase under a starting step that is not its own;
counts are kept by phrase and starting step, and the step that follows from the exact tables decides which one holds.

Counts move in packs: the phrases of a chunk that fall into one bucket, spelled out line by line and compressed. Sums of
phrases that lack a shard are packed the same way and join the next step's counts.

Most pairs never reach the threshold. Before the first step the pairs are counted by their hashes, packed by buckets of
them, and pairs whose hash stays below the threshold are never spelled out. A hash counts at least as often as each of its
pairs, so no pair is lost.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.llm.wordbytes import word_pieces
from trialgrid.session import broadcast_if_small, cut_lineage, scratch_path

THRESHOLD, LONGEST = 10, 3
CONTAINED = 50
TOP = 2000
UNDETERMINED = "und"
#: Shards of a cycle. Steps have one bit each in a slot of 16, which is enough for three cycles.
SHARDS = 2
#: Files at most in which a step keeps what reached the threshold in it.
FILES = 32
#: Buckets of phrases at most; packs get too small to compress well when there are many.
MOST_BUCKETS = 512
#: Rows that a task holds before it sums them up, and that one pack holds at most when sums are packed.
HELD, MOST_PACKED = 1 << 20, 1 << 18
#: Words counted at once in a task.
CHUNK = 1 << 20
#: Slots per phrase that reached the threshold; at most MOST_SLOTS slots are sent, beyond which more phrases are counted in vain.
ROOM, MOST_SLOTS, HASHES = 12, 1 << 24, 4
#: Leading bits of a pair's hash that are its bucket, and those that are kept after them.
BUCKET_BITS, KEPT_BITS = 12, 32

#: Piece ends become a word of their own, which no text can hold, and tabs spaces; A-Z become lower case.
_END = b"."
_BYTES = bytes(
    0x2E if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)
_TURNS = tuple(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) for i in range(HASHES))
_NEXT = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ values >> np.uint64(29)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its beginning and its last word."""
    return _mixed(left * _NEXT + right)


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, seed=xxhash.xxh3_64_intdigest(lang))


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(hash function, phrase): the slots of phrases."""
    return np.stack([hashes * np.uint64(turn) >> np.uint64(64 - bits) for turn in _TURNS]).astype(np.int64)


class _Reached:
    """Bit r of a phrase's mask tells that it may have reached the threshold in step r."""

    def __init__(self, slots: np.ndarray):
        self.slots, self.bits = slots, int(len(slots)).bit_length() - 1

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        return np.bitwise_and.reduce(self.slots[_slots(hashes, self.bits)], axis=0)


class _Numbers(defaultdict):
    """Numbers words as they come; the piece end is 0."""

    def __init__(self):
        super().__init__(None, {_END: 0})
        self.words = [_END]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


def _chunks(bodies: Iterator[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, int]]:
    """(words, numbers, context): the texts one after another as numbered words, in chunks of about CHUNK words.

    The first `context` numbers were counted before and only lead to those that follow.
    """
    numbers, parts, size, context = _Numbers(), [], 0, 0
    for body in bodies:
        for words in word_pieces(body.translate(_BYTES).replace(_END, b" . ") + b" ."):
            parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
            size += len(words)
            if size >= CHUNK:
                joined = np.concatenate(parts)
                yield numbers.words, joined, context
                kept = [numbers.words[i] for i in joined[1 - LONGEST :]]
                numbers = _Numbers()
                parts = [np.asarray([numbers[word] for word in kept], dtype=np.int64)]
                size, context = 0, len(kept)
    if size:
        yield numbers.words, np.concatenate(parts), context


def _active(first: np.ndarray, second: np.ndarray, start: int) -> np.ndarray:
    """Whether phrases whose parts have these masks start in step `start`: the later part reached the threshold just before."""
    upto = np.uint16((1 << start) - 1)
    just = np.uint16(1 << start - 1)
    return ((first & upto) != 0) & ((second & upto) != 0) & (((first | second) & just) != 0)


def _pair_keys(hashes: np.ndarray) -> np.ndarray:
    """The bits of pairs' hashes by which pairs are counted before they are spelled out."""
    return hashes >> np.uint64(64 - BUCKET_BITS - KEPT_BITS)


def _pack(threshold: int):
    """(bucket, packed): the keys of all pairs of words, a key at most `threshold` times a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, numbers, context in _numbered(batch):
                hashes = np.fromiter((word_hash(lang, word) for word in words), dtype=np.uint64, count=len(words))
                at = np.flatnonzero((numbers[:-1] != 0) & (numbers[1:] != 0))
                at = at[at + 1 >= context]
                keys, n = np.unique(_pair_keys(_joined(hashes[numbers[at]], hashes[numbers[at + 1]])), return_counts=True)
                keys = np.repeat(keys, np.minimum(n, threshold))
                of_key = (keys >> np.uint64(KEPT_BITS)).astype(np.int32)
                edges = np.flatnonzero(np.diff(of_key, prepend=-1))
                offsets = (np.append(edges, len(keys)) * 4).astype(np.int32)
                buffers = [None, pa.py_buffer(offsets), pa.py_buffer(keys.astype(np.uint32))]
                packed = pa.Array.from_buffers(pa.binary(), len(edges), buffers)
                yield pa.RecordBatch.from_arrays([pa.array(of_key[edges]), packed], ["bucket", "packed"])

    return run


def _often(threshold: int):
    """(key): the keys that come at least `threshold` times, from batches sorted by bucket."""

    def found(bucket: int, parts: list[np.ndarray]) -> np.ndarray:
        kept = np.sort(np.concatenate(parts))
        last = len(kept) - threshold + 1
        often = np.unique(kept[:last][kept[:last] == kept[threshold - 1 :]]) if last > 0 else kept[:0]
        return often.astype(np.int64) | np.int64(bucket << KEPT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []
        for batch in batches:
            keys = []
            for each, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed")):
                if each != bucket and parts:
                    keys.append(found(bucket, parts))
                    parts = []
                bucket = each
                parts.append(np.frombuffer(packed.as_buffer(), dtype=np.uint32).copy())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], ["key"])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(found(bucket, parts))], ["key"])

    return run


def _place_keys(bits: int):
    """(slot, mask): the slots of each key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slots = _slots(_mixed(batch["key"].to_numpy().view(np.uint64)), bits)
            yield pd.DataFrame({"slot": slots.ravel(), "mask": 1})

    return run


def _likely_pairs(rows: DataFrame, threshold: int) -> np.ndarray:
    """The slots of the pairs whose hash occurs at least `threshold` times in the rows (lang, body)."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.mapInArrow(_pack(threshold), "bucket int, packed binary")
    packed = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    keys = cut_lineage(packed.mapInArrow(_often(threshold), "key bigint"))
    size = _size(keys.count())
    return _gathered(keys.mapInPandas(_place_keys(size.bit_length() - 1), "slot bigint, mask bigint"), size).astype(np.uint8)


#: Some phrases of one bucket; `summed` if they were counted in earlier steps, `size` in bytes before compression.
PACKED = "bucket int, lang string, length int, start int, summed boolean, phrases int, size int, packed binary"


def _fold(lines: pa.Array, n: np.ndarray) -> tuple[int, int, bytes]:
    """(phrases, size, packed) of phrases that end with a newline each, and their counts."""
    ends = np.frombuffer(lines.buffers()[1], dtype=np.int32)[lines.offset : lines.offset + len(lines) + 1]
    text = memoryview(lines.buffers()[2])[ends[0] : ends[-1]]
    data = n.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() + text.tobytes()  # counts by byte: mostly zeros
    return len(n), len(data), pa.compress(data, codec="zstd", asbytes=True)


def _unfold(phrases: int, size: int, packed: pa.Buffer) -> tuple[pa.Array, np.ndarray]:
    """The lines and counts that `_fold` packed."""
    data = pa.decompress(packed, decompressed_size=size, codec="zstd")
    raw = np.frombuffer(data, dtype=np.uint8)
    n = np.ascontiguousarray(raw[: 8 * phrases].reshape(8, -1).T).view(np.int64).ravel()
    ends = np.append(0, np.flatnonzero(raw[8 * phrases :] == ord("\n")) + 1).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), phrases, [None, pa.py_buffer(ends), data.slice(8 * phrases)]), n


def _packs(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields])


def _tables(
    words: list[bytes], numbers: np.ndarray, context: int, lang: str, step: int, reached: _Reached | None, likely: _Reached | None, buckets: int
) -> Iterator[pa.RecordBatch]:
    """PACKED rows of the phrases of a chunk that are active in this step."""
    count = len(words)
    vocabulary, ending = pa.array(words, pa.binary()), pa.array([word + b"\n" for word in words], pa.binary())
    hashes = np.fromiter((word_hash(lang, word) for word in words), dtype=np.uint64, count=count)

    def rows(length: int, start: int, at: np.ndarray) -> pa.RecordBatch:
        code = numbers[at]
        for place in range(1, length):  # exact: a chunk has far fewer than 2^21 distinct words
            code = code * count + numbers[at + place]
        distinct, n = np.unique(code, return_counts=True)
        places = []
        for _ in range(length):
            places.insert(0, distinct % count)
            distinct = distinct // count
        of = (_mixed(reduce(_joined, [hashes[place] for place in places])) % np.uint64(buckets)).astype(np.uint16)
        order = np.argsort(of, kind="stable")  # phrases with the same beginning stay together
        spelled = [(ending if place is places[-1] else vocabulary).take(pa.array(place[order])) for place in places]
        lines, n, of = pc.binary_join_element_wise(*spelled, b" "), n[order], of[order].astype(np.int32)
        edges = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
        spans = zip(edges, [*edges[1:], len(n)])
        return _packs([(int(of[i]), lang, length, start, False, *_fold(lines[i:j], n[i:j])) for i, j in spans], PACKED)

    inside = numbers != 0
    if step < SHARDS:
        at = np.flatnonzero(inside[context:]) + context
        if len(at):
            yield rows(1, 0, at)
    if reached is None:
        return
    masks = reached.masks(hashes)
    masks[0] = 0
    starts = range(max(1, step - SHARDS + 1), step + 1)
    first, second = masks[numbers[:-1]], masks[numbers[1:]]
    both = np.flatnonzero((first != 0) & (second != 0))
    joined = _joined(hashes[numbers[both]], hashes[numbers[both + 1]])
    often = likely.masks(_mixed(_pair_keys(joined))) != 0
    both, joined = both[often], joined[often]
    for start in starts:
        at = both[_active(first[both], second[both], start)]
        at = at[at + 1 >= context]
        if len(at):
            yield rows(2, start, at)
    masks = reached.masks(joined)
    row = np.flatnonzero(np.diff(both) == 1)  # words that begin two pairs in a row
    both, pair, other = both[row], masks[row], masks[row + 1]
    for start in starts:
        at = both[_active(pair, other, start)]
        at = at[at + 2 >= context]
        if len(at):
            yield rows(3, start, at)


#: A phrase that was counted often enough so far, `before` this step or with it; or a pack of sums; or, with length 0, the
#: words of a language in a bucket.
SUMS = "bucket int, lang string, phrase string, length int, start int, f bigint, before bigint, phrases int, size int, packed binary"


class _Sums:
    """Sums of counts by bucket, language, length and starting step."""

    def __init__(self):
        self.parts, self.rows, self.room = defaultdict(list), 0, HELD

    def add(self, key: tuple, lines: pa.Array, n: np.ndarray, summed: bool) -> None:
        before = n if summed else np.zeros(len(n), dtype=np.int64)
        self.parts[key].append(pa.table({"line": lines, "f": n, "before": before}))
        self.rows += len(n)
        if self.rows > self.room:
            self.settle()
            self.room = max(HELD, 2 * self.rows)

    def settle(self) -> None:
        for key, tables in self.parts.items():
            summed = pa.concat_tables(tables).group_by("line", use_threads=False).aggregate([("f", "sum"), ("before", "sum")])
            self.parts[key] = [summed.select(["line", "f_sum", "before_sum"]).rename_columns(["line", "f", "before"])]
        self.rows = sum(table.num_rows for (table,) in self.parts.values())


def _sum(step: int, threshold: int):
    """SUMS from packs: phrases counted often enough so far, and sums of those that lack a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        names = ["bucket", "lang", "length", "start", "summed", "phrases", "size"]
        for batch in batches:
            packs = batch.column("packed")
            for i, row in enumerate(zip(*[batch.column(name).to_pylist() for name in names])):
                sums.add(row[:4], *_unfold(*row[5:], packs[i].as_buffer()), row[4])
        sums.settle()
        for (bucket, lang, length, start), (table,) in sums.parts.items():
            if start == 0 and step == SHARDS - 1:
                yield _packs([(bucket, lang, None, 0, 0, pc.sum(table["f"]).as_py(), None, None, None, None)], SUMS)
            often = table.filter(pc.greater_equal(table["f"], threshold)).combine_chunks()
            if often.num_rows:
                phrases = pc.utf8_rtrim(often["line"].cast(pa.string()), "\n")
                same = [pa.repeat(value, often.num_rows) for value in (pa.scalar(lang), pa.scalar(length, pa.int32()), pa.scalar(start, pa.int32()))]
                found = pa.table({"lang": same[0], "phrase": phrases, "length": same[1], "start": same[2], "f": often["f"], "before": often["before"]})
                for part in found.combine_chunks().to_batches():
                    none = {name: pa.nulls(part.num_rows, kind) for name, kind in _NONE.items()}
                    columns = dict(zip(part.schema.names, part.columns)) | none
                    yield pa.RecordBatch.from_arrays([columns[name] for name in _SUMS], _SUMS)
            if start > step + 1 - SHARDS:
                table = table.take(pc.sort_indices(table["line"])).combine_chunks()
                for i in range(0, table.num_rows, MOST_PACKED):
                    part = table.slice(i, MOST_PACKED).combine_chunks()
                    packed = _fold(part["line"].chunk(0), part["f"].to_numpy())
                    yield _packs([(bucket, lang, None, length, start, None, None, *packed)], SUMS)

    return run


_SUMS = [field.split()[0] for field in SUMS.split(", ")]
_NONE = {"bucket": pa.int32(), "phrases": pa.int32(), "size": pa.int32(), "packed": pa.binary()}


def _numbered(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes], np.ndarray, int]]:
    """(lang, words, numbers, context): the chunks of each language in a batch."""
    langs = batch.column("lang")
    for lang in pc.unique(langs).to_pylist():
        bodies = (body.as_py() for body in batch.column("body").filter(pc.equal(langs, lang)))
        for chunk in _chunks(bodies):
            yield lang, *chunk


def _count(step: int, shared, pairs, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = _Reached(shared.value) if shared is not None else None
        likely = _Reached(pairs.value) if shared is not None else None
        for batch in batches:
            for lang, words, numbers, context in _numbered(batch):
                yield from _tables(words, numbers, context, lang, step, reached, likely, buckets)

    return run


def _place(bits: int):
    """(slot, mask): the slots and step bit of each phrase that reached the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, words = list(batch["lang"]), [phrase.encode().split(b" ") for phrase in batch["phrase"]]
            hashes = np.fromiter((word_hash(lang, each[0]) for lang, each in zip(langs, words)), dtype=np.uint64, count=len(words))
            for place in range(1, max(map(len, words), default=1)):
                at = [i for i, each in enumerate(words) if len(each) > place]
                hashes[at] = _joined(hashes[at], np.asarray([word_hash(langs[i], words[i][place]) for i in at], dtype=np.uint64))
            slots = _slots(hashes, bits)
            masks = np.broadcast_to(1 << batch["step"].to_numpy(dtype=np.int64), slots.shape)
            yield pd.DataFrame({"slot": slots.ravel(), "mask": masks.ravel()})

    return run


def _marked(reached: DataFrame, size: int) -> np.ndarray:
    """Slots of which those of the given phrases are marked; the driver gets at most MOST_SLOTS small rows."""
    return _gathered(reached.mapInPandas(_place(size.bit_length() - 1), "slot bigint, mask bigint"), size)


def _gathered(placed: DataFrame, size: int) -> np.ndarray:
    """An array of so many slots from (slot, mask)."""
    found = placed.groupBy("slot").agg(F.bit_or("mask").alias("mask")).select(F.col("slot").cast("int"), F.col("mask").cast("int")).toArrow()
    slots = np.zeros(size, dtype=np.uint16)
    slots[found["slot"].to_numpy()] = found["mask"].to_numpy().astype(np.uint16)
    return slots


def _size(phrases: int) -> int:
    return min(MOST_SLOTS, 1 << max(12, (ROOM * phrases - 1).bit_length()))


def _filter(reached: DataFrame, phrases: int, step: int, before: np.ndarray | None) -> np.ndarray:
    """The slots of so many phrases that reached the threshold; those of earlier steps are taken over while they suffice."""
    size = _size(phrases)
    if before is None or len(before) < size:
        return _marked(reached, size)
    return before | _marked(reached.filter(F.col("step") == step), len(before))


def _parts(phrases: DataFrame, head: str, tail: str) -> DataFrame:
    """`phrases` with their first `head` and last `tail` words, given as SQL."""
    first, last = f"substring_index(phrase, ' ', {head})", f"substring_index(phrase, ' ', -({tail}))"
    return phrases.withColumn("head", F.expr(first)).withColumn("tail", F.expr(last))


def _with(phrases: DataFrame, part: str, table: DataFrame, value: str, name: str) -> DataFrame:
    """`phrases` with `value` of the phrase in column `part`, as `name`."""
    # A hint on `table` goes with its columns.
    side = table.select(F.col("lang").alias("t_lang"), F.col("phrase").alias("t_phrase"), F.col(value).alias(name))
    return phrases.join(side, (F.col("lang") == F.col("t_lang")) & (F.col(part) == F.col("t_phrase"))).drop("t_lang", "t_phrase")


def count_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, f) of all phrases of 1 to 3 words that occur at least `threshold` times, and (lang, n).

    n is the number of word occurrences of a language. Null texts are empty; a null language is `und`.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNDETERMINED)).alias("lang"), body.alias("body"))
    corpus = scratch_path(spark, "shards")
    shard = F.pmod(F.xxhash64("body", F.rand(7)), F.lit(SHARDS)).cast("int")  # copies are dealt like other texts
    rows.filter(F.length("body") > 0).withColumn("shard", shard).write.partitionBy("shard").option("compression", "zstd").parquet(corpus)
    shards = spark.read.schema("lang string, body binary, shard int").parquet(corpus)

    pairs = spark.sparkContext.broadcast(_likely_pairs(shards.select("lang", "body"), threshold))
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    ready, carried, reached, slots, totals = scratch_path(spark, "reached"), None, None, None, None
    step, last = 0, SHARDS - 1
    while step <= last:
        scan = shards.filter(F.col("shard") == step % SHARDS).select("lang", "body")
        shared = spark.sparkContext.broadcast(slots) if slots is not None else None
        counted = scan.mapInArrow(_count(step, shared, pairs, buckets), PACKED)
        counted = counted if carried is None else counted.union(carried)
        where = scratch_path(spark, "counts")
        counted.repartitionById(buckets, "bucket").mapInArrow(_sum(step, threshold), SUMS).write.option("compression", "zstd").parquet(where)
        sums = spark.read.schema(SUMS).parquet(where)
        carried = sums.filter("packed is not null").withColumn("summed", F.lit(True)).select(*[field.split()[0] for field in PACKED.split(", ")])
        if step == SHARDS - 1:
            totals = cut_lineage(sums.filter("length = 0").groupBy("lang").agg(F.sum("f").alias("n")))
        found = _frequent(sums.filter("length > 0 and packed is null"), reached)
        found.coalesce(FILES).write.option("compression", "zstd").parquet(f"{ready}/step={step}")
        every = spark.read.schema(f"{FOUND}, step int").parquet(ready)
        reached = every.filter(F.col("before") < threshold).select("lang", "phrase", "length", "step")
        parts = reached.filter(F.col("length") < LONGEST)
        size, just = parts.agg(F.count("*"), F.count(F.when(F.col("step") == step, 1))).first()
        if just:
            last = max(last, step + SHARDS)  # a phrase that starts next sees every shard once
        slots = _filter(parts, size, step, slots) if size and step < last else None
        step += 1
    closed = every.filter(F.col("start") == F.col("step") - SHARDS + 1)  # those have seen all shards
    return closed.select("lang", "phrase", "length", "f"), totals


#: Phrases that have reached the threshold, with their counts so far and before the step.
FOUND = "lang string, phrase string, length int, start int, f bigint, before bigint"


def _frequent(counts: DataFrame, reached: DataFrame | None) -> DataFrame:
    """FOUND rows of the phrases among `counts`, those counted often enough so far, that are counted under their own start."""
    columns = [field.split()[0] for field in FOUND.split(", ")]
    found = [counts.filter("start = 0").select(columns)]
    for length in range(2, LONGEST + 1) if reached is not None else ():
        longer = _parts(counts.filter((F.col("start") > 0) & (F.col("length") == length)), "length - 1", "length - 1")
        shorter = broadcast_if_small(reached.filter(F.col("length") == length - 1))
        longer = _with(_with(longer, "head", shorter, "step", "h_step"), "tail", shorter, "step", "t_step")
        found.append(longer.filter(F.col("start") == F.greatest("h_step", "t_step") + 1).select(columns))
    return reduce(DataFrame.union, found)


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, contained: int = CONTAINED, top: int = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of 2 to 3 words of each language.

    a is the count of a phrase, l and r those of the parts of its lowest-scoring cut, n the language's words; the score
    floor(10^6 a^2 / (l r)) is computed in decimals. A phrase goes if a longer one around it has `contained` percent
    of its count. Null or empty texts hold no words, a null language is `und`, repeated rows count each, and no document id
    is used.
    """
    frequent, totals = count_phrases(docs, text, lang, threshold)
    phrases = frequent.filter("length > 1").withColumnRenamed("f", "a")
    score = F.expr(
        "cast(1000000 as decimal(7,0)) * cast(a as decimal(14,0)) * cast(a as decimal(14,0)) "
        "div (cast(l as decimal(14,0)) * cast(r as decimal(14,0)))"
    )
    counts = {k: frequent.filter(F.col("length") == k) for k in range(1, LONGEST)}
    counts[1] = broadcast_if_small(counts[1])
    lowest, scored = F.struct(score.alias("score"), "k", "l", "r"), {}
    for length in range(2, LONGEST + 1):
        cuts = []
        for k in range(1, length):
            cut = _parts(phrases.filter(F.col("length") == length), str(k), str(length - k)).withColumn("k", F.lit(k))
            cut = _with(_with(cut, "head", counts[k], "f", "l"), "tail", counts[length - k], "f", "r")
            cuts.append(cut.select("lang", "phrase", "a", lowest.alias("cut")))
        every = reduce(DataFrame.union, cuts)
        scored[length] = every if len(cuts) == 1 else every.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))

    longer = _parts(phrases.filter(F.col("length") > 2), "length - 1", "length - 1")
    inner = longer.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), F.col("a").alias("f"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    shorter = reduce(DataFrame.union, [scored[length] for length in range(2, LONGEST)])
    kept = shorter.join(inner, ["lang", "phrase"], "left").filter(F.col("f").isNull() | (100 * F.col("f") < contained * F.col("a")))
    kept = kept.drop("f").union(scored[LONGEST])  # nothing is around the longest

    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)  # first within parts of a language
    best = kept.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))
