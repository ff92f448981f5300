"""Toxicity: cumulative-link ordinal regression on the words of a text, with one weight vector for all thresholds."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.expressions import let
from trialgrid.session import cut_lineage

#: Labelled rows the model is fitted on, at most; a hash of their ids chooses. Everything else covers all rows.
SAMPLE_ROWS = 6_000
#: A word is a feature if it is in at least so many sampled texts. One in more than this share of them is none if it is
#: less than COMMON_RATIO times as frequent in toxic texts as in others, and the reverse: it tells nothing.
LEAST_TEXTS, MOST_SHARE, COMMON_RATIO = 5, 0.2, 2
#: A toxic text's grade is 1 to GRADES.
GRADES = 3
#: A word marks toxic texts if it is so many times as frequent in them.
MARKED_RATIO = 20
STEPS, RATE, SPARSITY = 400, 0.1, 5e-4

WORD = re.compile(r"[^\W\d_]+")
#: Letters of a longer word's beginning, a feature of its own: it knows forms of a word that the sample does not have.
STEM = 5


def text_features(text: str) -> set[str]:
    """The words of a text and the beginnings of its longer words."""
    words = set(WORD.findall(text.lower()))
    return words | {word[:STEM] + "*" for word in words if len(word) > STEM}


def _with_stems(words: Column) -> Column:
    """The same as `text_features`, as an array with repeats."""
    longer = F.filter(words, lambda word: F.length(word) > STEM)
    return F.concat(words, F.transform(longer, lambda word: F.concat(F.substring(word, 1, STEM), F.lit("*"))))


@dataclass(frozen=True)
class SeverityModel:
    """P(grade >= k) = sigmoid(sum of the weights of the words in a text - thresholds[k - 1])."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def at_least(self, texts: list[str | None]) -> np.ndarray:
        """(text, k): the probability of each grade or a higher one."""
        known = self.weights.keys()
        score = [sum(self.weights[w] for w in sorted(known & text_features(t or ""))) for t in texts]
        return _sigmoid(np.asarray(score, dtype=float).reshape(-1, 1) - np.asarray(self.thresholds))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(
    rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, width: int, levels: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds of a cumulative-link model on 0/1 features given by (row, column) pairs.

    Maximum likelihood with an L1 penalty on the weights: adaptive gradient steps, each followed by shrinking. A threshold
    is where P(grade >= k) is one half; all thresholds share the weights.
    """
    n = len(grades)
    weights = np.zeros(width)
    share = np.clip([(grades >= k).mean() for k in range(1, levels + 1)], 1e-4, 1 - 1e-4)
    thresholds = np.log((1 - share) / share)
    thresholds = np.maximum.accumulate(thresholds + 1e-3 * np.arange(levels))
    first = second = np.zeros(width + levels)
    index = np.arange(n)
    for step in range(1, STEPS + 1):
        score = np.bincount(rows, weights=weights[columns], minlength=n)
        above = np.hstack([np.ones((n, 1)), _sigmoid(score[:, None] - thresholds), np.zeros((n, 1))])
        low, high = above[index, grades], above[index, grades + 1]
        mass = np.maximum(low - high, 1e-12)
        slope = (low + high - 1) / n
        gradient = np.zeros(width + levels)
        gradient[:width] = np.bincount(columns, weights=slope[rows], minlength=width)
        cut = np.zeros(levels + 2)
        np.add.at(cut, grades, low * (1 - low) / mass / n)
        np.subtract.at(cut, grades + 1, high * (1 - high) / mass / n)
        gradient[width:] = cut[1:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        scale = RATE / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        move = scale * first / (1 - 0.9**step)
        weights = weights - move[:width]
        weights = np.sign(weights) * np.maximum(np.abs(weights) - np.minimum(scale[:width], 50) * SPARSITY, 0)
        thresholds = np.maximum.accumulate(thresholds - np.clip(move[width:], -RATE, RATE) + 0.0)
        thresholds = thresholds + 1e-3 * np.arange(levels) * (np.diff(thresholds, prepend=thresholds[0] - 1) <= 0)
    return weights, thresholds


def distinct_rows(rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which texts to fit on: of n copies of a text with one label the first sqrt(n), so that no text drowns the others.

    Copies have the same words equally often; texts without any feature are no copies of each other.
    """
    edges = np.searchsorted(rows, np.arange(len(toxic) + 1))
    words = [(toxic[i], columns[a:b].tobytes(), counts[a:b].tobytes()) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    copies, seen = Counter(words), Counter()
    kept = np.ones(len(toxic), dtype=bool)
    for i, key in enumerate(words):
        seen[key] += 1
        kept[i] = not key[1] or seen[key] ** 2 <= copies[key]
    return kept


def severity_grades(rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, toxic: np.ndarray, width: int) -> np.ndarray:
    """Ordered grades from 0/1 labels: 0 if not toxic, else 1 to GRADES by how many marked words a text has.

    Marked words are those at least MARKED_RATIO times as frequent in toxic texts. The cuts are quantiles over the toxic texts.
    """
    bad = toxic[rows]
    inside = np.bincount(columns[bad], minlength=width) + 0.5
    outside = np.bincount(columns[~bad], minlength=width) + 0.5
    ratio = inside / (toxic.sum() + 1) / (outside / ((~toxic).sum() + 1))
    marked = ratio[columns] >= MARKED_RATIO
    amount = np.bincount(rows[marked], weights=counts[marked], minlength=len(toxic))
    if not toxic.any():
        return np.zeros(len(toxic), dtype=int)
    cuts = np.quantile(amount[toxic], [g / GRADES for g in range(1, GRADES)])
    return np.where(toxic, 1 + np.searchsorted(cuts, amount, side="left"), 0)


def learn_severity(
    docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", toxic: str = "toxic", sample_rows: int = SAMPLE_ROWS
) -> SeverityModel:
    """A model of the labelled texts; rows without id, text or label teach nothing.

    At most about `sample_rows` labelled rows are used, those with low hashes of their ids, and only words in
    LEAST_TEXTS of them or more: this bounds what the driver gets. Without labelled texts nothing is toxic.
    """
    known = labels.select(F.col(ident).alias("id"), F.col(toxic).cast("int").alias("toxic")).dropna()
    known = cut_lineage(known.groupBy("id").agg(F.max("toxic").alias("toxic")))
    share = sample_rows / max(known.count(), 1)
    drawn = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(min(share, 1.0) * 1_000_000)
    known = known.filter(drawn)
    texts = docs.select(F.col(ident).alias("id"), F.lower(F.col(text)).alias("text")).dropna()
    # The sample is bounded, so that the labels can go to the texts and only sampled texts are shuffled.
    texts = texts.join(F.broadcast(known), "id")
    found = let(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), _with_stems)
    words = texts.select("id", "toxic", F.explode(found).alias("word")).groupBy("id", "toxic", "word").count()
    words = cut_lineage(words)
    frame = known.toArrow().to_pandas()
    frequent = words.groupBy("word").agg(F.count("*").alias("texts"), F.count_if(F.col("toxic") > 0).alias("bad"))
    limit, n_bad = max(LEAST_TEXTS, int(MOST_SHARE * len(frame))), int((frame["toxic"] > 0).sum())
    ratio = (F.col("bad") + 0.5) / (n_bad + 1) / ((F.col("texts") - F.col("bad") + 0.5) / (len(frame) - n_bad + 1))
    telling = (F.col("texts") <= limit) | (ratio >= COMMON_RATIO) | (ratio <= 1 / COMMON_RATIO)
    vocabulary = frequent.filter((F.col("texts") >= LEAST_TEXTS) & telling).select("word").toArrow()["word"]
    vocabulary = sorted(vocabulary.to_pylist())
    if not vocabulary or frame["toxic"].nunique() < 2:
        return SeverityModel({}, (40.0,) * GRADES)
    coded = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"word": vocabulary, "column": range(len(vocabulary))})))
    cells = words.join(coded, "word").select("id", F.col("column").cast("int"), F.col("count").cast("int")).toArrow().to_pandas()
    frame = frame.sort_values("id", ignore_index=True)
    rows = np.searchsorted(frame["id"].to_numpy(), cells["id"].to_numpy())
    columns, counts, bad = cells["column"].to_numpy(), cells["count"].to_numpy(), frame["toxic"].to_numpy() > 0
    order = np.lexsort((columns, rows))  # the same sums in every run
    rows, columns, counts = rows[order], columns[order], counts[order]
    kept = distinct_rows(rows, columns, counts, bad)
    inside = kept[rows]
    rows, columns, counts, bad = (np.cumsum(kept) - 1)[rows[inside]], columns[inside], counts[inside], bad[kept]
    grades = severity_grades(rows, columns, counts, bad, len(vocabulary))
    weights, thresholds = fit_ordinal(rows, columns, grades, len(vocabulary), GRADES)
    return SeverityModel({vocabulary[i]: float(weights[i]) for i in np.flatnonzero(weights)}, tuple(map(float, thresholds)))


def predict_severity(model: SeverityModel, text: Column) -> Column:
    """struct(severity, grade, p_toxic) of a whole text: the expected grade, the likeliest one, and P(grade >= 1).

    A null or empty text is judged by the thresholds alone.
    """

    @F.pandas_udf("severity double, grade int, p_toxic double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            above = model.at_least(texts.tolist())
            n = len(above)
            edges = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
            grade = (edges[:, :-1] - edges[:, 1:]).argmax(axis=1)
            yield pd.DataFrame({"severity": above.sum(axis=1), "grade": grade.astype(np.int32), "p_toxic": above[:, 0]})

    return predict(text)
