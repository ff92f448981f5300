"""Document fingerprints by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.llm.expressions import let
from trialgrid.operators.ordinal import ordinal
from trialgrid.session import cut_lineage

#: Words per gram, and grams per window: any run of GRAM + WINDOW - 1 shared words leaves a shared mark.
GRAM, WINDOW = 5, 8
#: A mark holds a 32-bit gram hash above, and below it the position counted down from here: the least mark of a window is
#: then the rightmost of those with the least hash.
POSITIONS = (1 << 31) - 1


def text_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The marks of a text, in text order: of each window of `window` grams the one with the least hash, the rightmost if tied.

    A gram is `gram` consecutive words, whose hashes are chained. A text with fewer words is one gram; a text with fewer
    grams than a window is one window. A null or empty text, or one of white space, has no marks.
    """

    def grams(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - (gram - 1), F.least(F.size(w), F.lit(1))))
        rolled = lambda word, i: F.xxhash64(word, *[F.get(w, i + j) for j in range(1, gram)])
        return F.transform(
            starts, lambda word, i: F.shiftleft(rolled(word, i).bitwiseAND(0xFFFFFFFF), 31).bitwiseOR(F.lit(POSITIONS) - i)
        )

    def least(g: Column) -> Column:
        windows = F.slice(g, 1, F.greatest(F.size(g) - (window - 1), F.lit(1)))
        return F.array_distinct(F.transform(windows, lambda _, i: F.array_min(F.slice(g, i + 1, window))))

    return let(let(text_words(text), grams), least)


def mark_hash(mark: Column) -> Column:
    return F.shiftrightunsigned(mark, 31)


def mark_position(mark: Column) -> Column:
    """Number of the gram's first word, from 0."""
    return F.lit(POSITIONS) - mark.bitwiseAND(POSITIONS)


def mark_hashes(marks: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(marks, mark_hash))


def likeness(left: Column, right: Column) -> Column:
    """Share of the distinct hashes of both that both have; 1 if neither has any."""

    def share(common: Column) -> Column:
        union = F.size(left) + F.size(right) - common
        return F.when(union == 0, F.lit(1.0)).otherwise(common / union)

    return let(F.size(F.array_intersect(left, right)), share)


def fingerprint_text(marks: Column) -> Column:
    """hash:position of each mark, in text order."""
    return F.array_join(
        F.transform(marks, lambda m: F.concat_ws(":", F.lower(F.hex(mark_hash(m))), mark_position(m))), " "
    )


def next_documents(docs: DataFrame) -> DataFrame:
    """(ident, before, part) for (ident, part): the ident whose next one in descending order `ident` is, and its part.

    After the last comes the first again. Idents count once, with their largest part; a null ident is the last.
    """
    idents = cut_lineage(docs.groupBy("ident").agg(F.max("part").alias("part")))
    count = idents.count()
    placed = cut_lineage(ordinal(idents, ["ident"], name="at"))
    before = placed.select(F.pmod(F.col("at") - 1, F.lit(max(count, 1))).alias("at"), F.col("ident").alias("before"), "part")
    return placed.select("at", "ident").join(before, "at").select("ident", "before", "part")


def compare_with_edit(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, body, edited, marks, edited_marks, next_hashes), one row per row of `docs`.

    The edited text has its last third, floor(n / 3) code points, replaced by the first as many (or all) of the next
    document in descending order of ids. Rows that share an id are each edited; as the next document, the one with the
    least text hash stands for them. A null text is empty; a null id comes last. Texts are shuffled once, by id, and the
    part of a next document that is needed goes to its user in a second, smaller shuffle.
    """
    base = docs.select(F.struct(F.col(ident).alias("ident")).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    third = F.floor(F.length("body") / 3).cast("int")
    links = next_documents(base.select("key.ident", third.alias("part")))
    links = links.select(F.struct("ident").alias("key"), F.struct(F.col("before").alias("ident")).alias("before"), "part")
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("body"), "body"))
    # Arrays enter the shuffle as they are; nothing after it asks for the whole next text.
    heads = base.join(cut_lineage(links), "key").withColumn("turn", turn).filter("turn = 1")
    heads = heads.select(
        F.col("before").alias("key"),
        F.left("body", F.col("part")).alias("head"),
        mark_hashes(winnow(F.col("body"))).alias("next_hashes"),
    )
    edited = F.concat(F.left("body", F.length("body") - third), F.left("head", third))
    both = base.join(heads, "key").select(F.col("key.ident").alias(ident), "body", edited.alias("edited"), "next_hashes")
    return both.select(
        ident, "body", "edited", winnow(F.col("body")).alias("marks"), winnow(F.col("edited")).alias("edited_marks"), "next_hashes"
    )
