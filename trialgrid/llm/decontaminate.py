"""Benchmark decontamination: short test items found inside long documents by containment of word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.expressions import let
from trialgrid.session import broadcast_if_small, cut_lineage

SHINGLE = 5
CONTAINED = 0.8


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashes(found: Column, size: int) -> Column:
    """One hash per run of `size` words."""

    def runs(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0)))
        return F.transform(starts, lambda word, i: F.xxhash64(word, *[F.get(w, i + j) for j in range(1, size)]))

    return let(found, runs)


def _shingles(found: Column, size: Column) -> Column:
    """The distinct runs of `size` words, as text."""

    def runs(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - size + 1, F.lit(0)))
        return F.array_distinct(F.transform(starts, lambda _, i: F.array_join(F.slice(w, i + 1, size), " ")))

    return let(found, runs)


def _sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(key, item): the bottom-k MinHash sketch of each item's shingle set, k by size partition.

    Partition p holds the sets of up to 2^p shingles. At containment t, at most 2^p - ceil(t * 2^p) shingles of an item
    are missing in a document, so that of one more than that at least one is there: no item is lost, and an item
    shows a few hashes only instead of all.
    """
    top = F.pow(F.lit(2), F.ceil(F.log2(F.size("hashes"))))
    k = (top - F.ceil(F.round(top * threshold, 9)) + 1).cast("int")
    sketch = F.slice(F.array_sort("hashes"), 1, k)
    return items.select("item", F.explode_outer(sketch).alias("key"))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    doc_ident: str = "doc_id",
    item_ident: str = "item_id",
    doc_text: str = "text",
    item_text: str = "text",
    threshold: float = CONTAINED,
    shingle: int = SHINGLE,
) -> DataFrame:
    """(doc_ident, item_ident, n_shared, n_item, containment) of all documents that hold an item.

    Containment is the share of an item's distinct shingles that occur in the document, at least `threshold`. An item with
    fewer words than a shingle is one shingle of its own length; an item without words is in no document. Rows with the
    same ids are judged one by one and reported once, with the largest share; null ids are kept. Other columns are ignored.
    """
    tests = items.select(F.col(item_ident).alias("item"), words(F.col(item_text)).alias("w")).filter(F.size("w") > 0)
    tests = cut_lineage(tests.withColumn("k", F.least(F.size("w"), F.lit(shingle))))
    lengths = sorted(row[0] for row in tests.select("k").distinct().collect())  # at most `shingle` values
    parts = []
    for length in lengths:
        here = tests.filter(F.col("k") == length)
        parts.append(_sketches(here.select("item", F.array_distinct(_hashes(F.col("w"), length)).alias("hashes")), threshold))
    if not parts:
        parts = [_sketches(tests.select("item", F.array_distinct(_hashes(F.col("w"), shingle)).alias("hashes")), threshold)]
        lengths = [shingle]
    sketches = parts[0]
    for part in parts[1:]:
        sketches = sketches.union(part)
    found = words(F.col(doc_text))
    grams = let(found, lambda w: F.concat(*[_hashes(w, length) for length in lengths]))
    # The outer form keeps Spark from testing for empty arrays first, which would split every text twice.
    grams = docs.select(F.col(doc_ident).alias("doc"), F.explode_outer(grams).alias("gram"))
    grams = grams.join(broadcast_if_small(cut_lineage(sketches)), F.col("gram") == F.col("key"))
    candidates = cut_lineage(grams.select("doc", "item").distinct())

    # The exact check, on the shingles themselves, of candidate pairs only.
    wanted = candidates.select(F.col("doc").alias("c_doc"), F.col("item").alias("c_item"))
    pairs = docs.select(F.col(doc_ident).alias("doc"), F.col(doc_text).alias("body")).join(
        broadcast_if_small(wanted), F.col("doc").eqNullSafe(F.col("c_doc"))
    )
    sets = tests.select("item", "k", _shingles(F.col("w"), F.col("k")).alias("item_set"))
    pairs = pairs.join(broadcast_if_small(sets), F.col("item").eqNullSafe(F.col("c_item")))
    both = F.array_intersect("item_set", _shingles(words(F.col("body")), F.col("k")))
    shared = pairs.select("doc", "item", F.size("item_set").alias("n_item"), F.size(both).alias("n_shared"))
    enough = F.col("n_shared") >= F.ceil(F.round(F.col("n_item") * threshold, 9))
    best = shared.filter(enough).groupBy("doc", "item").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_shared", "n_item")).alias("b"))
    return best.select(
        F.col("doc").alias(doc_ident),
        F.col("item").alias(item_ident),
        F.col("b.n_shared").cast("bigint").alias("n_shared"),
        F.col("b.n_item").cast("bigint").alias("n_item"),
        (F.col("b.n_shared") / F.col("b.n_item")).alias("containment"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item, all columns; rows are told apart by id and text."""
    whole = docs.select(F.struct("*").alias("row"))
    keyed = whole.select("row", F.struct(F.col("row")[ident].alias("id"), F.xxhash64(F.col("row")[text]).alias("hash")).alias("key"))
    found = contained_items(keyed.select("key", F.col("row")[text].alias("text")), items, "key")
    found = cut_lineage(found.select(F.col("key").alias("bad")).distinct())
    return keyed.join(broadcast_if_small(found), F.col("key").eqNullSafe(F.col("bad")), "left_anti").select("row.*")
