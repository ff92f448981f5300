"""Language identification: bit-sliced Bloom filters of character trigrams, with two bits per language in every slot."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.session import cut_lineage

UNDETERMINED = "und"
#: A trigram is common in a language from this share of the language's trigrams on. Filters hold the others as well.
COMMON_SHARE = 1e-5
HASHES = 4
#: Slots per trigram of the largest language.
ROOM = 12
#: Slots at most, so that the filters can be sent to every executor. Beyond them no trigram is left out: there are more
#: false positives, whose share is measured and taken off.
MOST_SLOTS = 1 << 23
#: Code points handled at once; bounds the memory for one long text.
PIECE = 1 << 17
#: Odd multipliers, one per hash function.
MULTIPLIERS = tuple(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) for i in range(HASHES))

#: Standard errors by which the share of few distinct trigrams may lie below a bound.
LEEWAY = 3.0
#: A word with a digit, such as a key or a number, says nothing about the language.
TOKEN = re.compile(r"(?=[^0-9]*[0-9])[\x21-\x7e]+")

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter; made once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str], list[tuple[int, int]]]]:
    """Texts in lower case in groups of about PIECE characters; long ones are cut, with one character of context.

    Yields owners, pieces, and how many characters at each end are only context.
    """
    owners, pieces, context, size = [], [], [], 0
    for i, text in enumerate(texts):
        low = text.lower()
        for start in range(0, len(low), PIECE):
            a, b = max(0, start - 1), min(len(low), start + PIECE + 1)
            owners.append(i)
            pieces.append(low[a:b])
            context.append((start - a, max(0, b - start - PIECE)))
            size += b - a
            if size >= PIECE:
                yield owners, pieces, context
                owners, pieces, context, size = [], [], [], 0
    if owners:
        yield owners, pieces, context


def trigrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, code) of every trigram around a letter; other characters count as a space."""
    for owners, pieces, context in _pieces(texts):
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        joined = " " + " ".join(pieces) + " "
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        is_letter = letters()[chars]
        chars = np.where(is_letter, chars, 32).astype(np.uint64)
        starts = np.concatenate(([1], 1 + np.cumsum(lengths + 1)[:-1]))
        for at, length, (left, right) in zip(starts, lengths, context):
            if left:
                is_letter[at] = False
            if right:
                is_letter[at + length - 1] = False
        centre = np.flatnonzero(is_letter)
        codes = chars[centre - 1] | chars[centre] << np.uint64(21) | chars[centre + 1] << np.uint64(42)
        yield np.asarray(owners)[np.searchsorted(starts, centre, side="right") - 1], codes


def _count(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        return np.unique(codes, return_counts=True)
    distinct, at = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(at, weights=weights).astype(np.int64)


def _counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, code, n): one row per distinct trigram and language; rows without a text or language teach nothing."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    return rows.mapInPandas(_count_batches, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, code, n) of the texts of a partition, pre-aggregated."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts):
        return _count(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))

    for batch in batches:
        for lang, group in batch.groupby("lang"):
            for _, codes in trigrams(group["text"].tolist()):
                parts = held.setdefault(lang, [])
                parts.append(_count(codes))
                if len(parts) > 16:
                    held[lang] = [merged(parts)]
    for lang, parts in held.items():
        codes, n = merged(parts)
        yield pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": n})


@dataclass(frozen=True)
class Filters:
    """Bloom filters side by side: slot -> bits, 64 per word.

    With L languages, bit i tells that language i contains the trigram, and bit L + i that it is common there.
    """

    languages: tuple[str, ...]
    slots: np.ndarray
    false_positive: np.ndarray
    letters: np.ndarray

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """(trigram, word): the bits of all languages that contain the trigram, or in which it is common."""
        found = None
        for slot in _slots_of(codes, len(self.slots)):
            found = self.slots[slot] if found is None else found & self.slots[slot]
        return found


def _mix(codes: np.ndarray) -> np.ndarray:
    codes = codes ^ codes >> np.uint64(31)
    codes = codes * np.uint64(0xBF58476D1CE4E5B9)
    return codes ^ codes >> np.uint64(29)


def _slots_of(codes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The slots of trigrams, one array per hash function."""
    mixed, shift = _mix(codes), np.uint64(64 - (size - 1).bit_length())
    for multiplier in MULTIPLIERS:
        yield (mixed * np.uint64(multiplier) >> shift).astype(np.int64)


def _place(size: int):
    """(slot, bit) of every trigram of a language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, bit = batch["code"].to_numpy().astype(np.uint64), batch["bit"].to_numpy()
            for slot in _slots_of(codes, size):
                yield pd.DataFrame({"slot": slot, "bit": bit})

    return run


def learn_languages(docs: DataFrame, text: str = "text", lang: str = "lang", common_share: float = COMMON_SHARE) -> Filters:
    """Filters of all trigrams of each language's texts; rows without a text or language teach nothing.

    Counts cover all rows of `docs`, and no trigram is left out. The filters are sized by the distinct trigrams of the
    largest language, and their slots are put together in Spark: the driver gets at most MOST_SLOTS words per 64 bits.
    """
    counted = cut_lineage(_counts(docs, text, lang))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("codes"))
    found = sorted(totals.collect())  # one row per language
    names = tuple(row["lang"] for row in found)
    largest = max([row["codes"] for row in found], default=1)
    size = min(MOST_SLOTS, 1 << max(10, (ROOM * largest - 1).bit_length()))
    slots = np.zeros((size, (2 * len(names) + 63) // 64), dtype=np.uint64)
    if not names:
        return Filters(names, slots, np.zeros(0), np.zeros(0, dtype=np.uint64))
    spark = docs.sparkSession
    places = spark.createDataFrame([(row["lang"], i, row["total"]) for i, row in enumerate(found)], "lang string, at int, total bigint")
    marked = counted.join(F.broadcast(places), "lang")
    common = marked.filter(F.col("n") >= F.col("total") * common_share)
    bits = marked.select("code", F.col("at").alias("bit")).union(common.select("code", (F.col("at") + len(names)).alias("bit")))
    placed = bits.mapInPandas(_place(size), "slot bigint, bit int")
    word = F.expr("bit_or(shiftleft(1L, bit % 64))")
    for row in _batches(placed.groupBy("slot", F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(word.alias("mask"))):
        slots[row["slot"].to_numpy(), row["word"].to_numpy()] = row["mask"].to_numpy().view(np.uint64)
    filled = [np.count_nonzero(slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / size for i in range(2 * len(names))]
    centre = F.expr(f"shiftrightunsigned(code, 21) & {(1 << 21) - 1}L").alias("letter")
    letters = common.select(centre).distinct().toArrow()["letter"].to_numpy().astype(np.uint64)
    return Filters(names, slots, np.asarray(filled) ** HASHES, np.sort(letters))


def _batches(df: DataFrame) -> Iterator:
    """The rows of a bounded table, in column batches."""
    return iter(df.toArrow().to_batches())


def _centre(codes: np.ndarray) -> np.ndarray:
    return codes >> np.uint64(21) & np.uint64((1 << 21) - 1)


def belongs(model: Filters, text: str, least: float) -> bool:
    """Whether a text can be of a learned language, by all trigrams of its words without digits.

    Most letters must be of the languages. The share of contained trigrams must reach `least`, or lie below it by no more
    than so few distinct trigrams can show (Wilson's bound): repeats of a line are no further evidence.
    """
    count = len(model.languages)
    plain = " ".join(word for word in text.split() if not TOKEN.fullmatch(word))
    for body in (plain, text):  # a text of nothing but tokens is judged by them
        total, own, hits = 0, 0, np.zeros(count)
        distinct = np.zeros(0, dtype=np.uint64)
        for _, codes in trigrams([body]):
            total += len(codes)
            own += np.count_nonzero(np.isin(_centre(codes), model.letters))
            hits += _hits(model, codes)[:count]
            distinct = np.union1d(distinct, codes)
        if total:
            break
    if not total or own < least * total:
        return False
    wrong = model.false_positive[:count]
    if _corrected(hits, total, wrong).max() >= least:
        return True
    n, share = len(distinct), _corrected(_hits(model, distinct)[:count], len(distinct), wrong).max()
    spread = LEEWAY * np.sqrt(share * (1 - share) / n + LEEWAY**2 / (4 * n * n))
    return bool((share + LEEWAY**2 / (2 * n) + spread) / (1 + LEEWAY**2 / n) >= least)


def _hits(model: Filters, codes: np.ndarray) -> np.ndarray:
    """How many of the trigrams each bit is set for."""
    masks = model.masks(codes)
    bits = [masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1) for i in range(len(model.false_positive))]
    return np.asarray([np.count_nonzero(b) for b in bits], dtype=float)


def _corrected(hits: np.ndarray, total: np.ndarray | int, wrong: np.ndarray) -> np.ndarray:
    return np.clip((hits - total * wrong) / np.maximum(1 - wrong, 1e-9) / np.maximum(total, 1), 0, 1)


def in_learned_language(model: Filters, text: Column, least: float) -> Column:
    """Whether a text has letters and is of a learned language: by its common trigrams or, if they are too few, by `belongs`."""
    shared = _broadcast(model)

    @F.pandas_udf("boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            total, _, common = _shares(shared.value, texts.tolist())
            best = common.max(axis=1, initial=0)
            yield pd.Series([n > 0 and bool(s >= least or belongs(shared.value, t, least)) for t, n, s in zip(texts, total, best)], dtype=bool)

    return judge(text)


def _shares(model: Filters, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of each text, and per language the shares it contains and that are common in it, corrected."""
    count = len(model.languages)
    hits, total = np.zeros((len(texts), 2 * count)), np.zeros(len(texts))
    for owner, codes in trigrams([t or "" for t in texts]):
        total += np.bincount(owner, minlength=len(texts))
        masks = model.masks(codes)
        for i in range(2 * count):
            inside = masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1) != 0
            hits[:, i] += np.bincount(owner[inside], minlength=len(texts))
    share = _corrected(hits, total[:, None], model.false_positive)
    return total, share[:, :count], share[:, count:]


def predict_texts(model: Filters, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    total, contained, common = _shares(model, texts)
    best = (contained + common).argmax(axis=1)
    names = [model.languages[b] if n else UNDETERMINED for b, n in zip(best, total)]
    return names, np.where(total > 0, contained[np.arange(len(texts)), best], 0.0)


def identify_language(model: Filters, text: Column) -> Column:
    """struct(lang_pred, score) of a text.

    The score is the share of the text's trigrams that the language contains, corrected for the false positives its
    filter is known to give. The language wins whose contained and common trigrams together have the largest share, the
    first by name among equal ones: a trigram that a language's texts hold by chance counts half of a common one. A null text,
    or one without letters, is `und` with score 0. Whole texts are used, in pieces of bounded size.
    """
    shared = _broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = predict_texts(shared.value, texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predict(text)


def _broadcast(model: Filters):
    """The filters have at most MOST_SLOTS slots, so that they can be sent to every executor."""
    from pyspark import SparkContext

    return SparkContext.getOrCreate().broadcast(model)


def held_out(ident: Column, folds: int = 5) -> Column:
    """Whether a row is kept out of learning: crc32 of its id as text is divisible by `folds`; rows without id are."""
    return F.coalesce(F.crc32(ident.cast("string")) % folds == 0, F.lit(True))
