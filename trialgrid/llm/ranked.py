"""Ranked lexical search in the manner of LEMP: norm buckets, Cauchy-Schwarz pruning, coordinate bounds, exact rescoring.

A document is the vector of its terms' integer impacts, an item the vector of its terms' integer weights; a score is their
inner product. Document vectors hold only the terms of the items, are ordered by length over the whole corpus and
written. A task reads a run of that order and cuts it into buckets of similar length. With the item's 50th best score so far, from a
first search among the longest vectors and from the task's earlier buckets, a bucket is passed over for an item if the product of
both lengths stays below it. Otherwise the item's heaviest terms, as many as leave the rest too short to reach the
score alone, name the candidates by their lists; known coordinates and the length of the unknown rest bound each of
them. Survivors are scored exactly in 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from trialgrid.llm.wordbytes import word_pieces
from trialgrid.session import scratch_path

TOP = 50
#: Bytes of item texts searched in one pass over the documents; more items take more passes.
ITEM_BYTES = 16 << 20
#: Vectors, and coordinates, of a bucket at most; a bucket also ends where the length falls below this share of its first.
BUCKET, BUCKET_COORDINATES, SIMILAR = 2048, 1 << 20, 0.9
#: The share of the longest vectors that gives the first bound of each item. It only decides how much is pruned.
SEED_SHARE = 0.02
#: Room for rounding in bounds; scores themselves are integers.
ROUNDING = 1 + 1e-9

#: Letters, digits and all bytes beyond ASCII are of terms, in lower case for A-Z; all else divides them.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def count_terms(body: bytes) -> Counter:
    """How often each term occurs in a UTF-8 text."""
    counts: Counter = Counter()
    for words in word_pieces(body.translate(_TERM_BYTES)):
        counts.update(words)
    return counts


def _lists(offsets: list[int], values: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _project(shared):
    """(ident, n, terms, tfs): length of each document and its terms that occur in items, numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            lengths, offsets, terms, tfs = [], [0], [], []
            for body in batch["body"]:
                counts = count_terms(body.as_py())
                lengths.append(counts.total())
                for term in counts.keys() & vocabulary.keys():
                    terms.append(vocabulary[term])
                    tfs.append(counts[term])
                offsets.append(len(terms))
            columns = [batch["ident"], pa.array(lengths, pa.int64()), _lists(offsets, terms), _lists(offsets, tfs)]
            yield pa.RecordBatch.from_arrays(columns, ["ident", "n", "terms", "tfs"])

    return run


@dataclass(frozen=True)
class Item:
    """An item's terms, the heaviest first, their weights, and the length of what is left behind each of them."""

    terms: np.ndarray
    weights: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(weights: dict[int, int]) -> Item:
        pairs = sorted(((w, t) for t, w in weights.items() if w > 0), reverse=True)
        w = np.asarray([w for w, _ in pairs], dtype=np.int64)
        squares = np.concatenate([np.cumsum((w.astype(float) ** 2)[::-1])[::-1], [0.0]])
        return Item(np.asarray([t for _, t in pairs], dtype=np.int64), w, np.sqrt(squares))


class Search:
    """The best `top` documents of each item among the buckets seen so far."""

    def __init__(self, items: list[Item], terms: int, floors: np.ndarray, top: int):
        self.items, self.top = items, top
        self.floors = np.maximum(floors, 1)  # the least score that still counts; nothing below 1 ever does
        self.lengths = np.asarray([item.rest[0] for item in items])
        self.terms, self.dense = terms, np.zeros(terms, dtype=np.int64)
        none = np.zeros(0, dtype=np.int64)
        self.scores, self.idents = [none] * len(items), [none] * len(items)
        self.rescored = 0

    def add_bucket(self, idents: np.ndarray, norm2: np.ndarray, offsets: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> None:
        """Searches one bucket, given as rows of (term, impact) lists."""
        longest = math.sqrt(norm2.max())
        wanted = np.flatnonzero(self.lengths * longest * ROUNDING >= self.floors)
        if not len(wanted):
            return
        owner = np.repeat(np.arange(len(idents)), np.diff(offsets))
        order = np.argsort(terms, kind="stable")
        starts = np.searchsorted(terms[order], np.arange(self.terms + 1))
        by_term, by_term_impact = owner[order], impacts[order]
        for number in wanted:
            item, floor = self.items[number], self.floors[number]
            # Focus terms: without any of them a vector of this bucket cannot reach the floor.
            focus = int(np.argmax(item.rest * longest * ROUNDING < floor)) or len(item.terms)
            known = np.zeros(len(idents), dtype=np.int64)
            known2 = np.zeros(len(idents), dtype=np.int64)
            for term, weight in zip(item.terms[:focus], item.weights[:focus]):
                here = slice(starts[term], starts[term + 1])
                known[by_term[here]] += weight * by_term_impact[here]
                known2[by_term[here]] += by_term_impact[here] ** 2
            candidates = np.flatnonzero(known)
            unknown = np.sqrt(np.maximum(norm2[candidates] - known2[candidates], 0).astype(float))
            bound = known[candidates] + item.rest[focus] * unknown
            rows = candidates[bound * ROUNDING >= floor]
            if len(rows):
                self._rescore(number, rows, idents, offsets, terms, impacts)

    def _rescore(self, number, rows, idents, offsets, terms, impacts) -> None:
        item = self.items[number]
        self.rescored += len(rows)
        lengths = offsets[rows + 1] - offsets[rows]  # candidates hold a term, so none is empty
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(offsets[rows] - (ends - lengths), lengths)
        self.dense[item.terms] = item.weights
        scores = np.add.reduceat(self.dense[terms[at]] * impacts[at], ends - lengths)
        self.dense[item.terms] = 0
        good = scores >= self.floors[number]
        if not good.any():
            return
        scores = np.concatenate([self.scores[number], scores[good]])
        found = np.concatenate([self.idents[number], idents[rows[good]]])
        best = np.lexsort((found, -scores))[: self.top]
        self.scores[number], self.idents[number] = scores[best], found[best]
        if len(best) == self.top:
            self.floors[number] = max(self.floors[number], int(scores[best[-1]]))


_NO_IDENT = np.iinfo(np.int64).max  # sorts behind every other id


def _buckets(norm2: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(norm2):
        short = np.flatnonzero(norm2[start : start + BUCKET] < norm2[start] * SIMILAR**2)
        end = start + int(short[0]) if len(short) else min(start + BUCKET, len(norm2))
        room = int(np.searchsorted(offsets, offsets[start] + BUCKET_COORDINATES, side="right")) - 1
        end = max(start + 1, min(end, room))
        yield start, end
        start = end


def _search(shared):
    """(item, ident, score): the best documents of each item among the vectors of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, terms, floors, top = shared.value
        search = Search(items, terms, floors, top)
        for batch in batches:
            idents = batch["ident"].fill_null(_NO_IDENT).to_numpy()
            norm2 = batch["norm2"].to_numpy()
            offsets = batch["terms"].offsets.to_numpy().astype(np.int64)
            base = offsets[0]
            listed = batch["terms"].values.to_numpy()
            impacts = batch["impacts"].values.to_numpy()
            shift = batch["impacts"].offsets.to_numpy()[0] - base
            for start, end in _buckets(norm2, offsets):
                a, b = offsets[start], offsets[end]
                search.add_bucket(
                    idents[start:end], norm2[start:end], offsets[start : end + 1] - a,
                    listed[a:b].astype(np.int64), impacts[a + shift : b + shift].astype(np.int64),
                )
        number = np.repeat(np.arange(len(items)), np.asarray([len(s) for s in search.scores], dtype=np.int64))
        idents = np.concatenate([np.zeros(0, dtype=np.int64), *search.idents])
        scores = np.concatenate([np.zeros(0, dtype=np.int64), *search.scores])
        columns = [pa.array(number, pa.int32()), pa.array(idents, pa.int64(), mask=idents == _NO_IDENT), pa.array(scores, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["item", "ident", "score"])

    return run


def _item_blocks(items: DataFrame) -> Iterator[list[Row]]:
    """The items in blocks of bounded size, cut by hash; each is searched in a pass of its own."""
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = -(-size // ITEM_BYTES) or 1
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == block)
        yield part.collect()


def _impact_vectors(docs: DataFrame, vocabulary: dict[bytes, int], label: str) -> tuple[DataFrame, int, dict[int, int]]:
    """The documents' impact vectors ordered by length, the count of documents with terms, and each term's documents."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    path = scratch_path(spark, f"{label}-terms")
    docs.mapInArrow(_project(shared), "ident bigint, n bigint, terms array<int>, tfs array<int>").filter("n > 0").write.parquet(path)
    counted = spark.read.parquet(path)
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = {row[0]: row[1] for row in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    m = f"(50 + (50 * n * {n_docs}L) div {n_terms or 1}L)"
    impact = F.expr(f"transform(tfs, tf -> cast((1000000000L * tf) div (1000L * tf + 20 * {m}) as int))")
    vectors = counted.filter("size(terms) > 0").select("ident", "terms", impact.alias("impacts"))
    norm2 = F.aggregate("impacts", F.lit(0).cast("bigint"), lambda sum_, x: sum_ + x.cast("bigint") * x)
    path = scratch_path(spark, f"{label}-vectors")
    ordered = vectors.withColumn("norm2", norm2).repartitionByRange(F.desc("norm2"), "ident").sortWithinPartitions(F.desc("norm2"), "ident")
    ordered.write.parquet(path)
    return spark.read.parquet(path), n_docs, holding


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    ident: str = "doc_id",
    item_ident: str = "item_id",
    text: str = "text",
    item_text: str = "text",
    top: int = TOP,
) -> DataFrame:
    """(item_ident, rank, ident, score): the `top` documents of highest score above 0 for each item.

    Equal scores go by ascending id, null ids last. A null or empty text has no terms and is never found; an item without terms
    finds nothing. Every row of `items` is searched for, repeated ones again, and every row of `docs` is a document,
    so that a repeated row takes as many ranks. Ids of documents are integers. Other columns are ignored. Items are the
    query set: they are taken to the tasks in blocks of at most ITEM_BYTES, one pass over the documents each.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(ident).cast("bigint").alias("ident"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    asked = items.select(F.col(item_ident).alias("item"), F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("body"))
    found = None
    for rows in _item_blocks(asked):
        terms = [sorted(count_terms(bytes(row["body"]))) for row in rows]
        vocabulary = {term: i for i, term in enumerate(sorted(set().union(*terms)))}
        vectors, n_docs, holding = _impact_vectors(base, vocabulary, "ranked")
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in holding.items()}
        queries = [Item.of({vocabulary[t]: weight.get(vocabulary[t], 0) for t in own}) for own in terms]

        def best(part: DataFrame, floors: np.ndarray) -> DataFrame:
            shared = spark.sparkContext.broadcast((queries, len(vocabulary), floors, top))
            each = part.select("ident", "norm2", "terms", "impacts").mapInArrow(_search(shared), "item int, ident bigint, score bigint")
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("ident"))
            return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

        floors = np.zeros(len(queries), dtype=np.int64)
        long = vectors.agg(F.percentile_approx("norm2", 1 - SEED_SHARE)).first()[0]
        if long is not None:
            for row in best(vectors.filter(F.col("norm2") >= long), floors).filter(F.col("rank") == top).collect():
                floors[row["item"]] = row["score"]
        names = spark.createDataFrame(
            [(i, row["item"]) for i, row in enumerate(rows)], f"item int, name {asked.schema['item'].dataType.simpleString()}"
        )
        ranked = best(vectors, floors).join(names, "item").select(
            F.col("name").alias(item_ident), "rank", F.col("ident").alias(ident), "score"
        )
        found = ranked if found is None else found.union(ranked)
    return found
