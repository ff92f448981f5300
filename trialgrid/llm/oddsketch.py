"""MinHash near-duplicates: banded candidates, odd sketches that estimate their similarity, and a check on the full sets.

Equal sets are one class from the start. Each class has a MinHash sample of BANDS x ROWS values; the values of a band are
a bucket. The sample is also folded into a parity bitmap: every (row, value) flips one bit, so that the XOR of two bitmaps
is the bitmap of what the samples do not share, and its population count tells high similarities precisely.

No bucket is expanded into all its pairs. First every class is compared by its sketch with a few representatives of each of
its buckets, the same ones in all buckets they share, and checked in full against the nearest in each component. Buckets
whose members are connected by then are done. Of the others, members outside the largest component are compared with the rest if they are few
or the bucket fits one block; otherwise the bucket is cut by a second and third band that its members also share, and each part
is treated alike. What is left at the third band is compared in full.

These comparisons run in blocks of bounded size, first on the sketches alone; only members that may be alike another one
bring their text, once per block, and a block gives links, never pairs that are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.components import connected_components
from trialgrid.llm.wordbytes import map_words
from trialgrid.session import broadcast_if_small, cut_lineage, scratch_path

SHINGLE, SIMILARITY = 5, 0.85
BANDS, ROWS = 32, 6
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch, as 64-bit words.
WORDS = 8
BITS = 64 * WORDS
#: Standard deviations by which the sketches of a link may differ in more bits than expected; see `most_flipped`.
LEEWAY = 5.0
#: Members outside a bucket's largest component up to which they are compared with all its members.
SMALL = 256
#: Representatives of a bucket.
STARS = 6
#: Shingles and members of either side of a block, about; larger buckets are cut into several blocks.
BLOCK_SHINGLES, BLOCK_MEMBERS = 1 << 19, 1 << 12
#: Hashes of sets kept for further pairs in a task.
KEPT = 1 << 22
#: Shingles times samples hashed at once.
CELLS = 1 << 20

#: One odd multiplier per sample, fixed by the seed: a sample's value is the least of all shingles' multiples.
MULTIPLIERS = np.random.default_rng(20).integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_PLACES = np.asarray([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ values >> np.uint64(32)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a UTF-8 text's shingles, A-Z lower-cased; one for a text with fewer words."""
    hashed = map_words(text.lower(), xxhash.xxh3_64_intdigest)
    if not len(hashed):
        return hashed
    size = min(shingle, len(hashed))
    count = len(hashed) - size + 1
    total = np.full(count, size, dtype=np.uint64)  # shorter sequences are sets of their own
    for place in range(size):
        turn = _PLACES[place % len(_PLACES)] + np.uint64(2 * place)
        total = total * np.uint64(0x100000001B3) + _mixed(hashed[place : place + count] * turn)
    return np.unique(_mixed(total))


def min_hashes(values: np.ndarray) -> np.ndarray:
    """The MinHash sample of a set of 64-bit hashes that is not empty."""
    high = (values >> np.uint64(32)).astype(np.uint32)
    step = max(1, CELLS // SAMPLES)
    least = np.full(SAMPLES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for start in range(0, len(high), step):
        np.minimum(least, (MULTIPLIERS[:, None] * high[None, start : start + step]).min(axis=1), out=least)
    return least


def fold(samples: np.ndarray) -> np.ndarray:
    """The odd sketch of a MinHash sample, as signed 64-bit words."""
    numbered = samples.astype(np.uint64) | np.arange(1, SAMPLES + 1, dtype=np.uint64) << np.uint64(32)
    places = (_mixed(_mixed(numbered * _PLACES[0])) % np.uint64(BITS)).astype(np.int64)
    odd = np.bincount(places, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def most_flipped(similarity: float) -> int:
    """The most bits in which the odd sketches of two sets differ that are at least this similar, up to LEEWAY deviations.

    Samples differ in d of SAMPLES places, a binomial number; 2d values fall on BITS bits, of which
    BITS / 2 * (1 - (1 - 2 / BITS)^2d) are expected to be odd, and each two that meet take two bits away.
    """
    d = SAMPLES * (1 - similarity)
    odd = BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * d))
    by_sample = 2 * (1 - 2 / BITS) ** (2 * d) * np.sqrt(d * similarity)
    by_place = 2 * np.sqrt((2 * d) ** 2 / (2 * BITS))
    return int(np.ceil(odd + LEEWAY * np.hypot(by_sample, by_place)))


def estimated_similarity(flipped: int) -> float:
    """The similarity that an odd-sketch difference of so many bits stands for."""
    share = min(2 * flipped / BITS, 1 - 1 / BITS)
    return max(0.0, 1 + BITS / (4 * SAMPLES) * np.log(1 - share))


SIGNED = "ident bigint, hash bigint, n_shingles bigint, digest string, bands array<bigint>, sketch array<bigint>"


def _sign(shingle: int):
    """One row per document: its set's size and name, a hash per band, and the odd sketch; no bands without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, digests, bands, sketches = [], [], [], []
            for body in batch["body"]:
                values = shingle_set(body, shingle)
                sizes.append(len(values))
                if not len(values):
                    digests.append(None), bands.append(None), sketches.append(None)
                    continue
                samples = min_hashes(values)
                rows = samples.reshape(BANDS, ROWS)
                digests.append(xxhash.xxh3_128_hexdigest(values.tobytes()))
                bands.append([xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) - (1 << 63) for i, row in enumerate(rows)])
                sketches.append(fold(samples))
            frame = pd.DataFrame({"ident": batch["ident"].astype("Int64"), "hash": batch["hash"], "n_shingles": sizes})
            yield frame.assign(digest=digests, bands=bands, sketch=sketches)

    return run


def _shared(pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(x, y) of the pairs (x, y, x_body, y_body) whose full sets are similar enough, in exact integers."""
    share = round(similarity * 100)

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        sets: dict[bytes, np.ndarray] = {}
        held = 0
        out = []
        for x, y in zip(left, right):
            for body in (x, y):
                if body not in sets:
                    if held > KEPT:
                        sets, held = {each: sets[each] for each in (x, y) if each in sets}, 0
                    sets[body] = shingle_set(body, shingle)
                    held += len(sets[body])
            a, b = sets[x], sets[y]
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= share * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    return pairs.filter(similar("x_body", "y_body")).select("x", "y")


BLOCK = "block bigint, node bigint, component bigint, n_shingles bigint, sketch array<bigint>, outer boolean, chosen boolean"
BLOCK_COLUMNS = [column.split()[0] for column in BLOCK.split(", ")]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of one block after another, from batches sorted by block."""

    def columns(batch: pd.DataFrame) -> dict[str, np.ndarray]:
        found = {name: batch[name].to_numpy() for name in batch.columns}
        return found | {"sketch": np.stack(batch["sketch"].to_numpy()).view(np.uint64)}

    parts: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        rows = columns(batch)
        if parts and parts[-1]["block"][-1] != rows["block"][0]:
            yield {name: np.concatenate([part[name] for part in parts]) for name in rows}
            parts = []
        edges = np.flatnonzero(np.diff(rows["block"])) + 1
        for start, end in zip([0, *edges], [*edges, len(batch)]):
            parts.append({name: values[start:end] for name, values in rows.items()})
            if end < len(batch):
                yield {name: np.concatenate([part[name] for part in parts]) for name in rows} if len(parts) > 1 else parts[0]
                parts = []
    if parts:
        yield {name: np.concatenate([part[name] for part in parts]) for name in parts[0]}


def _beside(rows: dict[str, np.ndarray], share: int, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, places): each chosen row of a block beside those of other components that sizes and sketches allow, no pair twice."""
    node, component, sizes, sketch = (rows[name] for name in ("node", "component", "n_shingles", "sketch"))
    right = np.flatnonzero(~rows["chosen"])
    for i in np.flatnonzero(rows["chosen"]):
        small, large = np.minimum(sizes[right], sizes[i]), np.maximum(sizes[right], sizes[i])
        once = ~rows["outer"][right] | (node[right] > node[i])
        at = right[once & (component[right] != component[i]) & (small * 100 >= large * share)]
        at = at[np.bitwise_count(sketch[at] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= limit]
        if len(at):
            yield i, at


def _candidates(similarity: float):
    """Those rows of a block that may be alike another one."""
    share, limit = round(similarity * 100), most_flipped(similarity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _blocks(batches):
            wanted = np.zeros(len(rows["node"]), dtype=bool)
            for i, at in _beside(rows, share, limit):
                wanted[i] = wanted[at] = True
            if wanted.any():
                found = {name: rows[name][wanted] for name in BLOCK_COLUMNS}
                yield pd.DataFrame(found | {"sketch": list(found["sketch"].view(np.int64))})

    return run


def _links(similarity: float, shingle: int):
    """(x, y): links by the full sets, in exact integers, one for each two components that a block links."""
    share, limit = round(similarity * 100), most_flipped(similarity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _blocks(batches):
            node, component = rows["node"], rows["component"]
            sets = [shingle_set(body, shingle) for body in rows["body"]]
            sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            values, codes = np.unique(np.concatenate(sets), return_inverse=True)
            held = np.split(codes, np.cumsum(sizes)[:-1])
            marked = np.zeros(len(values), dtype=np.int64)
            known: set[tuple[int, int]] = set()
            found = []
            for i, at in _beside(rows, share, limit):
                marked[held[i]] = 1
                starts = np.concatenate([[0], np.cumsum(sizes[at])[:-1]])
                both = np.add.reduceat(marked[np.concatenate([held[j] for j in at])], starts)
                marked[held[i]] = 0
                for j in at[100 * both >= share * (sizes[i] + sizes[at] - both)]:
                    pair = (min(component[i], component[j]), max(component[i], component[j]))
                    if pair not in known:
                        known.add(pair)
                        found.append((node[i], node[j]))
            if found:
                yield pd.DataFrame(found, columns=["x", "y"])

    return run


class _Linker:
    """Grows the links between classes and keeps the components they form."""

    def __init__(self, bodies: DataFrame, classes: DataFrame, similarity: float, shingle: int):
        self.bodies, self.classes, self.similarity, self.shingle = bodies, classes, similarity, shingle
        self.links: list[DataFrame] = []
        self.checked: list[DataFrame] = []
        self.components: DataFrame | None = None

    def placed(self, members: DataFrame) -> DataFrame:
        """`members` with the component of their node."""
        if self.components is None:
            return members.withColumn("component", F.col("node"))
        joined = members.drop("component").join(self.components.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left")
        return joined.withColumn("component", F.coalesce("component", "node")).drop("c_node")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """(x, y, bits) of those of the distinct pairs (x, y) that sizes and sketches allow to be links."""
        about = self.classes.select("node", "n_shingles", "sketch")
        x, y = (about.select(*[F.col(c).alias(f"{side}_{c}") for c in about.columns]) for side in "xy")
        joined = pairs.join(x, F.col("x") == F.col("x_node")).join(y, F.col("y") == F.col("y_node"))
        return joined.filter(alike("x_", "y_", self.similarity)).select("x", "y", flipped("x_sketch", "y_sketch").alias("bits"))

    def compare(self, members: DataFrame, buckets: DataFrame) -> None:
        """Keeps the links between members of the buckets outside the largest component and those of other components."""
        about = self.classes.select(F.col("node").alias("c_node"), "sketch")
        here = members.join(buckets, F.col("key") == F.col("b_key")).join(about, F.col("node") == F.col("c_node"))
        outer = (F.col("component") != F.col("most")).alias("outer")
        here = cut_lineage(here.select("key", "node", "component", "n_shingles", "sketch", outer, "parts", "outer_parts"))
        if here.isEmpty():
            return
        turn, each = (lambda n: F.pmod(F.xxhash64("node"), n)), (lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)))
        kept = [F.col(name) for name in here.columns]
        left = here.filter("outer").select(*kept, F.lit(True).alias("chosen"), each("parts").alias("part")).withColumn("o_part", turn(F.col("outer_parts")))
        right = here.select(*kept, F.lit(False).alias("chosen"), each("outer_parts").alias("o_part")).withColumn("part", turn(F.col("parts")))
        rows = left.unionByName(right).withColumn("block", F.xxhash64("key", "part", "o_part")).select(*BLOCK_COLUMNS)
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much to compare
        rows = rows.repartition(tasks, "block").sortWithinPartitions("block")
        rows = cut_lineage(rows.mapInPandas(_candidates(self.similarity), BLOCK))
        texts = broadcast_if_small(rows).join(self.bodies.withColumnRenamed("node", "t_node"), F.col("node") == F.col("t_node"))
        texts = texts.select(*BLOCK_COLUMNS, "body").repartition(tasks, "block").sortWithinPartitions("block")
        self.keep(texts.mapInPandas(_links(self.similarity, self.shingle), "x bigint, y bigint"))

    def check(self, pairs: DataFrame) -> None:
        """Keeps those of the pairs (x, y) whose full sets are links."""
        pairs = pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        for before in self.checked:
            pairs = pairs.join(before, ["x", "y"], "left_anti")
        pairs = cut_lineage(pairs)
        self.checked.append(pairs)
        if pairs.isEmpty():
            return
        # The pairs meet the texts in equality joins, one side after the other; a hot side is split there.
        texts = broadcast_if_small(pairs).join(self.bodies.select("node", F.col("body").alias("x_body")), F.col("x") == F.col("node"))
        texts = texts.drop("node").join(self.bodies.select("node", F.col("body").alias("y_body")), F.col("y") == F.col("node"))
        self.keep(_shared(texts, self.similarity, self.shingle))

    def keep(self, found: DataFrame) -> None:
        """Takes up links (x, y)."""
        found = cut_lineage(found.distinct())
        if not found.isEmpty():
            self.links.append(found)
            self.components = cut_lineage(connected_components(reduce(DataFrame.union, self.links), "x", "y"))


def _parts(members: Column, shingles: Column) -> Column:
    """How many parts so many members with so many shingles in all are cut into."""
    return F.greatest(F.ceil(shingles / BLOCK_SHINGLES), F.ceil(members / BLOCK_MEMBERS), F.lit(1)).cast("bigint")


def flipped(left: str, right: str) -> Column:
    """In how many bits two odd sketches differ."""
    words = [F.bit_count(F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i)))) for i in range(WORDS)]
    return reduce(Column.__add__, words)


def alike(left: str, right: str, similarity: float) -> Column:
    """Whether sizes and sketches of two sets, in columns of these prefixes, allow them to be similar enough."""
    small, large = (f(f"{left}n_shingles", f"{right}n_shingles") for f in (F.least, F.greatest))
    sizes = small * 100 >= large * round(similarity * 100)
    return sizes & (flipped(f"{left}sketch", f"{right}sketch") <= most_flipped(similarity))


def _mixed_buckets(members: DataFrame) -> DataFrame:
    """(b_key, most, outside, parts, outer_parts) of the buckets of several components.

    That is the largest component, how many members are not of it, and into how many parts all of them and those are cut.
    """
    parts = members.groupBy(F.col("key").alias("b_key"), "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    size = F.struct("n", "component", "shingles")
    whole = parts.groupBy("b_key").agg(F.max(size).alias("top"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"))
    outside = F.col("n") - F.col("top.n")
    outer_parts = _parts(outside, F.col("shingles") - F.col("top.shingles")).alias("outer_parts")
    mixed = whole.select("b_key", F.col("top.component").alias("most"), outside.alias("outside"), _parts(F.col("n"), F.col("shingles")).alias("parts"), outer_parts)
    return mixed.filter("outside > 0")


def _stars(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """(x, y): members of the buckets beside representatives y of other components.

    A representative is the member whose hash is least, by one of STARS hashes; it represents all buckets where that holds.
    """
    here = members.join(buckets.select("b_key"), F.col("key") == F.col("b_key"))
    firsts = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node", "component")) for i in range(STARS)]
    stars = F.array_distinct(F.array(*[F.struct(f["node"].alias("y"), f["component"].alias("part")) for f in firsts]))
    chosen = here.groupBy(F.col("key").alias("s_key")).agg(stars.alias("stars")).select("s_key", F.explode("stars").alias("star"))
    pairs = here.join(chosen, F.col("key") == F.col("s_key")).filter(F.col("component") != F.col("star.part"))
    return pairs.select(F.col("node").alias("x"), "star.y").distinct()


def similar_components(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE
) -> DataFrame:
    """(ident, n_shingles, component_id, kept), one row per row of `docs`.

    A document's set is that of its distinct word shingles, or the whole sequence if it has fewer words. Documents are linked if
    the sets' Jaccard similarity is at least `similarity` (whole percents), and a component is named by its least id.
    Null and empty texts have no set and are linked with nothing, not even each other. Repeated rows and equal sets are
    linked; null ids are kept and count for no component's name unless there is no other, and their rows are kept = false.
    Sets are compared by 64-bit hashes of their shingles. A link of exactly the similarity asked for shares no band with a
    probability of 3e-7 (0.85: (1 - 0.85^6)^32), more similar ones with far less; links are also found step by step.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(F.col(ident).cast("bigint").alias("ident"), F.xxhash64(body).alias("hash"), body.alias("body"))
    path = scratch_path(spark, "signed")
    base.mapInPandas(_sign(shingle), SIGNED).write.parquet(path)
    signed = spark.read.parquet(path)
    at = F.min(F.struct("ident", "hash")).alias("at")
    classes = signed.filter("n_shingles > 0").groupBy("digest").agg(
        at, F.min("ident").alias("least_id"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")]
    )
    path = scratch_path(spark, "classes")
    classes.withColumn("node", F.monotonically_increasing_id()).write.parquet(path)  # written once, so numbers stay
    classes = spark.read.parquet(path)

    listed = classes.select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = listed.groupBy(F.col("key").alias("b_key")).agg(F.count("*").alias("n")).filter("n > 1")
    path = scratch_path(spark, "buckets")
    listed.join(shared, F.col("key") == F.col("b_key")).select("node", "band", "key", "n_shingles").write.parquet(path)
    first = members = spark.read.parquet(path)
    bucketed = classes.join(first.select("node").distinct(), "node", "left_semi").select("node", "at.*")
    bucketed = broadcast_if_small(cut_lineage(bucketed.withColumnsRenamed({"ident": "a_ident", "hash": "a_hash"})))
    path = scratch_path(spark, "bodies")
    here = F.col("ident").eqNullSafe(F.col("a_ident")) & (F.col("hash") == F.col("a_hash"))
    base.join(bucketed, here).select("node", "body").write.parquet(path)
    linker = _Linker(spark.read.parquet(path), classes, similarity, shingle)
    for deepest in (False, False, True):
        here = linker.placed(members)
        stars = cut_lineage(linker.likely(_stars(here, _mixed_buckets(here))))
        nearest = stars.groupBy("x").agg(F.min_by("y", F.struct("bits", "y")).alias("y"))
        between = stars.join(stars.select(F.col("y").alias("star")).distinct(), F.col("x") == F.col("star"), "left_semi")
        linker.check(nearest.unionByName(between.select("x", "y")))
        here = cut_lineage(linker.placed(members))
        mixed = cut_lineage(_mixed_buckets(here))
        at_once = (F.col("outside") <= SMALL) | (F.col("parts") == 1)
        linker.compare(here, mixed if deepest else mixed.filter(at_once))
        wide = mixed.filter(~at_once).select("b_key")
        if deepest or wide.isEmpty():
            break
        wide_members = here.join(wide, F.col("key") == F.col("b_key"), "left_semi").select("node", "band", "key", "n_shingles")
        again = first.select(F.col("node").alias("n_node"), F.col("band").alias("n_band"), F.col("key").alias("n_key"))
        both = wide_members.join(again, (F.col("node") == F.col("n_node")) & (F.col("n_band") > F.col("band")))
        members = cut_lineage(both.select("node", F.col("n_band").alias("band"), F.xxhash64("key", "n_key").alias("key"), "n_shingles"))
    return _named(signed, linker.placed(classes), ident)


def _named(signed: DataFrame, placed: DataFrame, ident: str) -> DataFrame:
    """The result rows, from each class's component."""
    groups = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = placed.select("digest", "component").join(groups, "component").select(F.col("digest").alias("c_digest"), "component_id")
    rows = signed.join(broadcast_if_small(cut_lineage(named)), F.col("digest") == F.col("c_digest"), "left")
    component = F.when(F.col("digest").isNull(), F.col("ident")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("ident") == component, F.lit(False)).alias("kept")
    return rows.select(F.col("ident").alias(ident), "n_shingles", component.alias("component_id"), kept)
