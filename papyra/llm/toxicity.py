"""Toxic passages by maximum-scoring segment search.

Every word has a log-odds score: how much likelier a document that holds it is
marked toxic, with Dirichlet priors that shrink a word's rate to that of its
first letters, those to that of fewer letters, and those to the overall rate.
A linear-time scan finds all maximal segments of positive total score; an
extreme-value (Gumbel) law fitted to the best segments of clean documents says
how surprising each is, and their joint surprise is turned into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import MEMO_KEY, SLICE, Memo, _slices
from .common import drop_kept, id_text, stored

WORD = re.compile(r"\w+")
# Lengths of the beginnings of a word that back its own rate off, short first.
STEMS = (4, 5, 6)


@dataclass(frozen=True)
class ToxicityModel:
    """``scores``: log-odds less ``drift`` of the words and beginnings
    ("beginning*") of the vocabulary; words unknown by any of them score
    ``-drift``. ``location`` and ``scale`` are the
    Gumbel law of the best segment's score less scale * ln(words); ``weights``
    turn (1, best surprise, log of joint surprise) into the logit."""
    scores: dict[str, float]
    drift: float
    location: float
    scale: float
    significance: float
    weights: tuple[float, float, float]


def features(word: str) -> list[str]:
    """A word's beginnings, short first, then the word."""
    return [word[:k] + "*" for k in STEMS if k < len(word)] + [word]


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, total) of a text whose words
    score ``-drift`` except the given (place, score) ones, ascending by place."""
    rises, total, seen = [], 0.0, 0
    for place, score in scores:
        total -= drift * (place - seen)
        seen = place + 1
        before, total = total, total + score
        if score > 0:
            rises.append((place, before, total))
    return maximal(rises)


def maximal(rises: Iterable[tuple[int, float, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, total) from the running total
    before and after every positive score, ascending by place.

    A positive score opens a segment; while an earlier one starts lower and
    ends lower, the two and all between join. Each segment points to the
    nearest earlier one that starts lower, so the search back is linear in all."""
    first, last, low, high, back = [], [], [], [], []
    for place, before, total in rises:
        a, z, lo, hi = place, place, before, total
        j = len(first) - 1
        while True:
            while j >= 0 and low[j] >= lo:
                j = back[j]
            if j < 0 or high[j] >= hi:
                break
            a, lo = first[j], low[j]
            del first[j:], last[j:], low[j:], high[j:], back[j + 1:]
            j = back.pop()
        first.append(a), last.append(z), low.append(lo), high.append(hi), back.append(j)
    return [(a, z, hi - lo) for a, z, lo, hi in zip(first, last, low, high, strict=True)]


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model = model
        self.of = Memo(self._of, longest=MEMO_KEY)

    def _of(self, word: str) -> float:
        """Score of the word or of its longest known beginning."""
        return next((self.model.scores[f] for f in reversed(features(word)) if f in self.model.scores),
                    -self.model.drift)

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float, bool]]]:
        """Number of words and the maximal segments, every word scored wherever
        it occurs; the mark tells a passage from a copy of an earlier one."""
        words = WORD.findall(text.lower())
        own = np.fromiter(map(self.of.__getitem__, words), float, len(words))
        total = np.concatenate([[0.0], np.cumsum(own)])
        hot = np.flatnonzero(own > 0)
        found = maximal(zip(hot.tolist(), total[hot].tolist(), total[hot + 1].tolist(), strict=True))
        met, out = set(), []
        for first, last, score in found:
            passage = tuple(words[first:last + 1])
            out.append((first, last, score, passage not in met))
            met.add(passage)
        return len(words), out

    def surprise(self, n_words: int, score: float) -> float:
        """-ln of the chance that a clean text of this length has so good a segment."""
        m = self.model
        x = (score - m.scale * math.log(max(n_words, 1)) - m.location) / m.scale
        e = math.exp(-min(max(x, -30.0), 600.0))
        p = -math.expm1(-e)
        return -math.log(max(p, 1e-300))

    def weigh(self, n_words: int, found: list[tuple[float, bool]]) -> tuple[float, float, list[float]]:
        """Log of the best surprise, log of the joint surprise of the
        significant passages, each distinct one once (copies are no further
        evidence), and the surprise of every (score, distinct) passage."""
        judged = [self.surprise(n_words, s) for s, _ in found]
        joint = sum(x for x, (_, distinct) in zip(judged, found, strict=True) if distinct and self.significant(x))
        return math.log1p(max(judged, default=0.0)), math.log1p(joint), judged

    def significant(self, surprise: float) -> bool:
        return surprise >= -math.log(self.model.significance)

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Probability, and all significant passages (first, last word, surprise)."""
        n, found = self.passages(text)
        best, joint, judged = self.weigh(n, [(s, distinct) for _, _, s, distinct in found])
        good = [(a, z, x) for (a, z, _, _), x in zip(found, judged, strict=True) if self.significant(x)]
        b, w1, w2 = self.model.weights
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, b + w1 * best + w2 * joint)))), good


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def word_scores(counts: dict[str, tuple[int, int]], toxic: int, clean: int, prior: float, drift: float) -> dict[str, float]:
    """Log-odds less the drift of every counted feature, positive or not."""
    base = (toxic + 0.5) / (toxic + clean + 1)
    rate: dict[str, float] = {}

    def theta(f: str) -> float:
        if f not in rate:
            word = f.rstrip("*")
            parents = [p for p in features(word) if p.endswith("*") and len(p) - 1 < len(word)]
            above = theta(parents[-1]) if parents else base
            n1, n0 = counts.get(f, (0, 0))
            rate[f] = (n1 + prior * above) / (n1 + n0 + prior)
        return rate[f]

    return {f: _logit(theta(f)) - _logit(base) - drift for f in counts}


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 40_000, min_docs: int = 3, prior: float = 16.0,
          drift: float = 1.0, significance: float = 0.01, seed: int = 7) -> ToxicityModel:
    """Fit on labelled rows that are not held out.

    A bounded sample: where there are more than ``sample_rows`` such labels,
    about that many are taken by a seeded hash of the id. Their labels are
    broadcast (16 bytes a row, so 640 kB at most), the texts stay in place.
    Two thirds of the sample give word counts (documents that hold a word, so
    one long text counts once; features of fewer than ``min_docs`` are left
    out), the rest fits the extreme-value law and the final weights on texts
    whose words were not counted; the model then takes the counts of all. What reaches the driver is bounded by the
    sample. Labels other than 0 and 1 and null ids are not used; labels that
    repeat an id count as 1 if one is 1. With no labels, or of one kind only,
    every text scores the neutral 0.5.
    """
    spark = docs.sparkSession
    known = (labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y"))
             .filter("_id IS NOT NULL AND _y IN (0, 1)").filter(~held_out(F.col("_id")))
             .groupBy("_id").agg(F.max("_y").alias("_y")))
    n = known.count()
    pick = F.xxhash64(F.lit(seed), "_id")
    if n > sample_rows:
        known = known.filter(F.pmod(pick, F.lit(n)) < sample_rows)
    known = known.withColumn("_fold", F.pmod(pick.bitwiseXOR(F.shiftright(pick, 17)), F.lit(3)).cast("int"))
    base = id_text(docs)
    sample = base.join(F.broadcast(known), base["doc_id"] == F.col("_id")).select("text", "_y", "_fold")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in batches:
            held: dict[tuple[int, bool], Counter] = {}
            for part in _slices(batch):
                for text, y, fold in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    c = held.setdefault((y, fold > 0), Counter())
                    c.update({f for w in set(WORD.findall((text or "").lower())) for f in features(w)})
                    c[""] += 1
            for (y, counted), c in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.string()), pa.array([y] * len(c), pa.int32()),
                     pa.array([counted] * len(c), pa.bool_()), pa.array(list(c.values()), pa.int64())],
                    ["feature", "y", "counted", "n"])

    def total(y: int, counted: bool) -> Column:
        return F.sum(F.when((F.col("y") == y) & (F.col("counted") | F.lit(not counted)), F.col("n")).otherwise(0))

    table = stored(sample.select("text", "_y", "_fold").mapInArrow(count, "feature string, y int, counted boolean, n long")
                   .groupBy("feature").agg(total(1, True).alias("c1"), total(0, True).alias("c0"),
                                           total(1, False).alias("a1"), total(0, False).alias("a0"))
                   .filter((F.col("a1") + F.col("a0") >= min_docs) | (F.col("feature") == "")), "features")

    def scored(rows: pd.DataFrame, n1: str, n0: str) -> dict[str, float] | None:
        counts = dict(zip(rows["feature"], zip(rows[n1].tolist(), rows[n0].tolist(), strict=True), strict=True))
        toxic, clean = counts.pop("", (0, 0))
        counts = {f: c for f, c in counts.items() if sum(c) >= min_docs}
        return word_scores(counts, toxic, clean, prior, drift) if toxic and clean else None

    known_features = table.toPandas()
    neutral = ToxicityModel({}, drift, 0.0, 1.0, significance, (0.0, 0.0, 0.0))
    scores = scored(known_features, "c1", "c0")
    if scores is None:
        return neutral
    draft = ToxicityModel(scores, drift, 0.0, 1.0, significance, (0.0, 0.0, 0.0))
    sent = spark.sparkContext.broadcast(draft)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        scorer = Scorer(sent.value)
        for batch in batches:
            for part in _slices(batch):
                found = [scorer.passages(t or "") for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array([k for k, _ in found], pa.int64()),
                     pa.array([[s for _, _, s, _ in x] for _, x in found], pa.list_(pa.float64())),
                     pa.array([[d for *_, d in x] for _, x in found], pa.list_(pa.bool_()))], ["y", "n", "found", "distinct"])

    rest = sample.filter("_fold = 0").select("text", "_y").mapInArrow(
        best, "y int, n long, found array<double>, distinct array<boolean>").toPandas()
    sent.unpersist()
    y = rest["y"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        return neutral
    sizes = np.maximum(rest["n"].to_numpy(), 1)
    top = np.array([max(x, default=0.0) for x in rest["found"]])
    location, scale = gumbel(top[y == 0], np.log(sizes[y == 0]))
    fitted = ToxicityModel(scores, drift, location, scale, significance, (0.0, 0.0, 0.0))
    judge = Scorer(fitted)
    x = [(1.0, *judge.weigh(size, list(zip(found, distinct, strict=True)))[:2])
         for size, found, distinct in zip(sizes.tolist(), rest["found"], rest["distinct"], strict=True)]
    return ToxicityModel(scored(known_features, "a1", "a0") or scores, drift, location, scale, significance, logistic(np.array(x), y))


def gumbel(best: np.ndarray, log_words: np.ndarray) -> tuple[float, float]:
    """Location and scale, by moments, of best scores less scale * ln(words)."""
    scale = max(float(np.std(best)) * math.sqrt(6) / math.pi, 0.25)
    return float(np.mean(best - scale * log_words)) - 0.5772156649 * scale, scale


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; slopes below 0 are refitted
    as 0, so more surprise never lowers a score."""
    use = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x[:, use] * (p * (1 - p))[:, None]).T @ x[:, use] + (ridge * len(y) + 1e-9) * np.eye(int(use.sum()))
            step = np.linalg.solve(h, x[:, use].T @ (y - p) - ridge * len(y) * w[use])
            w[use] += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if (w[1:] >= 0).all():
            return tuple(float(v) for v in w)
        use[1:] &= w[1:] >= 0


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, passages`` of every whole text;
    ``passages`` are the significant ones (first and last word, surprise).

    Only the text is scored. One narrow ``mapInArrow``; the model is broadcast
    (its size is bounded by the training sample). Null or empty text: no
    passage, the lowest score. Null and repeated ids pass through (null: not
    held out); an empty table gives no rows; extra columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        scorer = Scorer(sent.value)
        for batch in batches:
            for part in _slices(batch):
                got = [scorer.score(t or "") for t in part.column(1).to_pylist()]
                spans = [[{"first_word": a, "last_word": z, "surprise": s} for a, z, s in g] for _, g in got]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([s for s, _ in got], pa.float64()), part.column(2), pa.array(spans, kind)],
                    ["doc_id", "score", "text_hash", "passages"])

    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("surprise", pa.float64())]))
    base = id_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    got = base.mapInArrow(rows, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double, text_hash long, "
                                "passages array<struct<first_word:long,last_word:long,surprise:double>>")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"), "passages", "text_hash")


def reject_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """Pipeline form: rows of toxic texts go, the others keep all columns. One
    scorer a task; few texts of an Arrow batch are Python objects at a time."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        drop_kept()
        scorer = Scorer(sent.value)
        for texts in batches:
            slices = (texts.slice(at, SLICE).to_pylist() for at in range(0, len(texts), SLICE))
            yield pa.array([scorer.score(t or "")[0] >= threshold for some in slices for t in some], pa.bool_())

    return docs.filter(~toxic(docs["text"]))
