"""Toxic passages by maximum-scoring segments.

Words get log-odds between toxic and clean documents, shrunk by an informative Dirichlet prior whose counts
come from the whole corpus. A scan in linear time finds all maximal segments of each text, and extreme-value
theory says which of them are more than chance in a text of that length. A document's score sums its
significant segments and is calibrated on labelled documents.

Features are words and their stems (first ``_STEM`` characters). A word scores like its stem where the stem says more:
inflected words are too rare to be learned one by one. Labels enter through a sample of at most ``most_labels``
training rows, the ones with the smallest hashes of their ids: that is the only bounded part. The features of those
texts are the ones that can be told from chance; they are gathered, counted over all documents for the prior, and the
ones that are sure get a score. All others say nothing. Prior, scan and scores cover all documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.sources.scratch import materialise

# Mass of the prior in words, cost of a word that says nothing, largest gain or loss of one word.
_PRIOR, _DRIFT, _CAP = 5000.0, 0.5, 6.0
# A word counts as far as its log-odds exceed this many standard errors.
_SURE = 2.0
_STEM = 5
_WORD = re.compile(r"\w+")
_KEPT_WORDS = 300_000
_EULER = 0.5772156649


@dataclass(frozen=True)
class Model:
    """Scores of features that say something, the extreme-value constants and the calibration ``1 / (1 + exp(-(slope * g + shift)))``."""

    scores: dict[str, float]
    decay: float
    constant: float
    slope: float = 1.0
    shift: float = 0.0

    def scorer(self) -> Callable[[str], float]:
        scores = self.scores

        class Known(dict):
            def __missing__(self, word: str) -> float:
                value = max((scores.get(f, -_DRIFT) for f in features(word)), key=lambda x: abs(x + _DRIFT))
                if len(self) < _KEPT_WORDS:
                    self[word] = value
                return value

        return Known().__getitem__


def features(word: str) -> tuple[str, ...]:
    """A word itself, and its stem, marked by a star, if it is longer than one."""
    return (word, f"{word[:_STEM]}*") if len(word) > _STEM else (word,)


def segments(gains: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments ``(score, start, end)``, end exclusive, in order; linear time.

    Every positive gain opens a candidate; it joins earlier ones as long as the sum before an earlier
    candidate is lower and its end no higher.
    """
    total = np.concatenate(([0.0], np.cumsum(gains)))
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, start, end, earlier with a lower sum before
    for i in np.flatnonzero(gains > 0).tolist():
        low, high, start = float(total[i]), float(total[i + 1]), i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= low:
                j = found[j][4]
            if j < 0 or found[j][1] >= high:
                found.append((low, high, start, i + 1, j))
                break
            low, start = found[j][0], found[j][2]
            del found[j:]
    return [(high - low, start, end) for low, high, start, end, _ in found]


def passages(text: str | None, model: Model, score_of: Callable[[str], float]) -> tuple[float, list[tuple[int, int, float]]]:
    """``(g, [(start, end, score)])``: the calibration variable of a text and its significant passages.

    Offsets are code points. Significant: fewer than 0.05 such segments expected by chance in a text of this
    length. ``g`` is the sum of ``decay * score - ln(constant * words)`` over them, or else the value of the
    best segment; a text without gains has the least, -10.
    """
    lowered = (text or "").lower()
    same = len(lowered) == len(text or "")
    words = list(_WORD.finditer(lowered)) if same else list(_WORD.finditer(text or ""))
    gains = np.fromiter((score_of(m[0] if same else m[0].lower()) for m in words), dtype=np.float64, count=len(words))
    found = segments(gains)
    if not found:
        return -10.0, []
    level = math.log(model.constant * len(words))
    bits = [model.decay * s - level for s, _, _ in found]
    sure = [(words[a].start(), words[b - 1].end(), x) for x, (_, a, b) in zip(bits, found, strict=True) if x > 3.0]
    return max(-10.0, sum(x for *_, x in sure) if sure else max(bits)), sure


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _features_of(text: str | None) -> set[str]:
    return {f for word in set(_WORD.findall((text or "").lower())) for f in features(word)}


def _tally_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled documents per feature: toxic, clean."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for feature in _features_of(text):
                counts.setdefault(feature, [0, 0])[1 - toxic] += 1
    toxic, clean = ([c[i] for c in counts.values()] for i in (0, 1))
    made = {"feature": pa.array(list(counts), pa.string()), "toxic": pa.array(toxic, pa.int64()), "clean": pa.array(clean, pa.int64())}
    yield pa.RecordBatch.from_pydict(made)


def _tally_all(known: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents per known feature by its place; at -1 the sum over all features, known or not."""
        place = {feature: i for i, feature in enumerate(known)}
        counts = np.zeros(len(known) + 1, dtype=np.int64)

        class Places(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                found = tuple(place.get(f, -1) for f in features(word))
                if len(self) < _KEPT_WORDS:
                    self[word] = found
                return found

        places = Places()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                at: set[int] = set()
                unknown: set[str] = set()
                for word in set(_WORD.findall((text or "").lower())):
                    found = places[word]
                    at.update(found)
                    if -1 in found:
                        unknown.update(f for f, i in zip(features(word), found, strict=True) if i < 0)
                at.discard(-1)
                counts[list(at)] += 1
                counts[-1] += len(at) + len(unknown)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"place": np.where(some == len(known), -1, some), "n": counts[some]})

    return run


def _measured(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = model.scorer()
        for batch in batches:
            g, found = [], []
            for text in batch.column("text").to_pylist():
                value, sure = passages(text, model, score_of)
                g.append(value)
                found.append([{"start": a, "end": b, "bits": x} for a, b, x in sure])
            made = {name: batch.column(name) for name in batch.schema.names if name != "text"}
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))
            yield pa.RecordBatch.from_pydict(made | {"g": pa.array(g, pa.float64()), "passages": pa.array(found, kind)})

    return run


def _log_odds(n: np.ndarray, toxic: np.ndarray, clean: np.ndarray, everything: float) -> np.ndarray:
    """Log-odds of toxic against clean with prior counts in proportion to the corpus, shrunk by their error."""
    prior = _PRIOR * n / max(1.0, everything) + 1e-9
    a, b = toxic + prior, clean + prior
    # What is not among these features has a prior only.
    rest = _PRIOR - prior.sum()
    ratio = np.log(a / np.maximum(a.sum() + rest - a, 1e-9)) - np.log(b / np.maximum(b.sum() + rest - b, 1e-9))
    return ratio * np.maximum(0.0, 1.0 - _SURE**2 * (1 / a + 1 / b) / np.maximum(ratio**2, 1e-12))


def _decay(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of ``sum(share * exp(x * score)) = 1``: how fast chance segments thin out."""
    if not (scores[share > 0] > 0).any():
        return 1.0
    low, high = 1e-4, 20.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if (share * np.exp(middle * scores)).sum() > 1 else (middle, high)
    return low


def _calibrate(g: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by damped Newton steps, with a weak prior on both."""
    design = np.column_stack([g, np.ones_like(g)])
    beta, prior = np.array([0.5, -2.0]), np.diag([1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (p - toxic) + prior @ (beta - [0.5, -2.0])
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + prior, gradient)
        beta = beta - step / max(1.0, np.abs(step).max())
    return max(0.01, float(beta[0])), float(beta[1])


def train(df: DataFrame, labels: DataFrame, doc_id: str, text: str, most_labels: int = 50_000) -> Model:
    """A model from all texts and the labelled training rows (see the module); held-out labels are not read.

    Labels other than 0 and 1 are ignored. Without labels of both kinds every word scores the same and every
    document gets the calibration's prior.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    once = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = materialise(once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels), "labels")
    texts = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # At most ``most_labels`` rows of two numbers.
    labelled = materialise(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic"), "labelled")
    tallied = labelled.select("text", "toxic").mapInArrow(_tally_labelled, "feature string, toxic bigint, clean bigint")
    # The features of the sample's texts: as many as those hold, whatever the size of the corpus.
    summed = tallied.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).orderBy("feature").toArrow()
    known = summed.column("feature").to_pylist()
    toxic, clean = (summed.column(name).to_numpy().astype(np.float64) for name in ("toxic", "clean"))
    everywhere = texts.select("text").mapInArrow(_tally_all(known), "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    n, everything = np.zeros(len(known)), 0.0
    for place, count in zip(*(c.to_pylist() for c in everywhere.toArrow().columns), strict=True):
        if place < 0:
            everything = float(count)
        else:
            n[place] = count
    scores = np.clip(_log_odds(n, toxic, clean, everything), -_CAP, _CAP) - _DRIFT
    if not toxic.sum() or not clean.sum():
        scores = np.full(len(known), -_DRIFT)
    sure = {known[i]: float(scores[i]) for i in np.flatnonzero(scores != -_DRIFT)}
    model = Model(sure, _decay(scores, clean / max(1.0, clean.sum())), 1.0)
    kind = labelled.schema["doc_id"].dataType.simpleString()
    seen = labelled.mapInArrow(
        _measured(model), f"doc_id {kind}, toxic int, g double, passages array<struct<start: bigint, end: bigint, bits: double>>"
    )
    # One row per labelled id, also where documents share one.
    seen = seen.groupBy("doc_id").agg(F.max("g").alias("g"), F.max("toxic").alias("toxic")).orderBy("doc_id").toArrow()
    g, toxic = seen.column("g").to_numpy(), seen.column("toxic").to_numpy()
    clean = g[(toxic == 0) & (g > -10)]
    if len(clean):  # the mean of a Gumbel variate is its location plus Euler's constant
        shift = float(np.mean(np.minimum(clean, np.quantile(clean, 0.9)))) - _EULER
        model = Model(model.scores, model.decay, math.exp(max(-8.0, min(8.0, shift))))
        g = np.where(g > -10, g - math.log(model.constant), g)
    slope, shift = _calibrate(g, toxic.astype(np.float64))
    return Model(model.scores, model.decay, model.constant, slope, shift)


def toxicity(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted, passages)``, one row per row of ``df``.

    A null or empty text has no passages and the lowest score. Only the text makes the score. Repeated rows
    stay; a null id is not held out; other columns are not read. A repeated label counts once, toxic first.
    """
    model = train(df, labels, doc_id, text, **options)
    narrow = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    measured = narrow.mapInArrow(
        _measured(model), f"doc_id {kind}, g double, passages array<struct<start: bigint, end: bigint, bits: double>>"
    )
    score = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("g") + F.lit(model.shift))))
    scored = measured.withColumn("score", score)
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages"
    )
