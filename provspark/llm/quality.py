"""Quality by Bradley-Terry: scores whose differences explain which of two documents is preferred.

Documents labelled 1 are preferred to those labelled 0. The strength of a document is linear in figures of its whole
text; weights minimise the logistic loss of the pairs' feature differences. A document is kept if its strength reaches
a quantile of the training strengths: near the share of labels 0, the level with the fewest errors. The score is 0.3
there and grows with the strength.

The model is fitted on all labelled documents and all of their pairs, which are never listed: a pair's loss depends on the
difference of two strengths, so counts of strengths in ``BINS`` bins tell a document its pairs' mean loss, slope and
curvature. A Newton round is two passes over the figures. Null and empty texts have the figures of no words. With no label
of one kind all scores are 0.5.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provspark.llm.common import LOWER, Scratch, in_chunks, remainder

ROUNDS, DECAY = 16, 1e-3
#: Strengths of training rows count within -SPAN and SPAN; bins of them, those of the curvature's mixed part, and of the cut.
SPAN, BINS, COARSE, FINE = 32.0, 4096, 256, 65_536
#: Sums are exact in whole numbers of this size, so they do not depend on the order of tasks. Rows worked on at once.
UNIT, ROWS = 1 << 20, 512
#: Score of the least strength that is kept.
AT_CUT = 0.3
FOLDS = 5

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_USUAL = b".,;:'-?\"()"
_ODD = bytes(b for b in range(33, 127) if b not in _UPPER + _LOWER + _DIGITS + _USUAL)


def figures(text: str | None) -> list[float]:
    """Shares and logarithms that describe a text, whatever its language."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(LOWER).split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return [0.0] * WIDTH
    upper, lower, digits, odd = (size - len(raw.translate(None, k)) for k in (_UPPER, _LOWER, _DIGITS, _ODD))
    counts = Counter(words)
    top = max(counts.values())
    pairs = Counter(zip(words, words[1:], strict=False))
    again = sum(c - 1 for c in pairs.values())
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    odd_ends = sum(w[-1] in _ODD for w in words)
    odd_words = sum(not w.translate(None, _ODD) for w in words)
    stops = raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")
    base = [
        upper / max(1, upper + lower), digits / size, odd / size, odd_ends / n, odd_words / n, top / n, again / n, same / n,
        1 - len(counts) / n, 1 - len(set(lines)) / max(1, len(lines)), raw.count(b"|") / n, raw.count(b"!") / n, stops / n,
    ]
    return [*base, *[math.sqrt(x) for x in base], math.log1p(n), math.log1p(n) ** 2 / 10, float(lengths.mean()) / 10, float(lengths.std()) / 10, float((lengths == 1).mean()), math.log1p(len(lines))]


WIDTH = 2 * 13 + 6


@dataclass(frozen=True)
class BradleyTerry:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.strength(x) - self.cut) / self.spread + math.log(AT_CUT / (1 - AT_CUT))
        return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))


def _sums(rows: DataFrame, size: int, parts) -> np.ndarray:
    """Sums over ``rows(quality, x)`` of whole numbers: ``parts(x, y)`` gives (places, numbers) for some of the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                x, y = some.column(1).flatten().to_numpy().reshape(-1, WIDTH), some.column(0).to_numpy()
                for place, number in parts(x, y):
                    np.add.at(total, place, number)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["place", "total"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "place int, total long").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r["place"]] = float(r["total"])
    return out


def _whole(v: np.ndarray) -> np.ndarray:
    return np.rint(v * UNIT).astype(np.int64)


def _moments(x: np.ndarray, y: np.ndarray):
    """Rows by label, then sums of the figures and of their squares, each as whole millions and the rest."""
    yield y, 1
    for k, v in enumerate((x, x * x)):
        high = np.floor(v / UNIT)
        yield 2 + 2 * k * WIDTH + np.arange(WIDTH), high.astype(np.int64).sum(0)
        yield 2 + (2 * k + 1) * WIDTH + np.arange(WIDTH), _whole(v - high * UNIT).sum(0)


def _strengths(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Figures on a common scale, and strengths within the span; a row's numbers do not depend on the rows beside it."""
    z = (x - mean) / scale
    return z, np.clip((z * w).sum(1), -SPAN, SPAN)


def _bin(s: np.ndarray, low: float, high: float, bins: int) -> np.ndarray:
    return np.clip(np.floor((s - low) * (bins / (high - low))), 0, bins - 1).astype(np.int64)


def _logistic(t: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(t / 2))


def _over(counts: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """For each bin a the mean over the bins b of ``counts`` of ``kernel`` at a - b (from 1 - BINS to BINS - 1)."""
    return np.convolve(counts / counts.sum(), kernel)[BINS - 1:2 * BINS - 1]


def fit(rows: DataFrame) -> BradleyTerry:
    """Newton rounds over all pairs (preferred, other) of ``rows(quality, x)``, each step halved until the loss falls."""
    got = _sums(rows, 2 + 4 * WIDTH, _moments)
    bad, good = got[:2]
    n = max(1.0, bad + good)
    high, low, high2, low2 = got[2:].reshape(4, WIDTH)
    mean = (high * UNIT + low / UNIT) / n
    scale = np.sqrt(np.maximum(0, (high2 * UNIT + low2 / UNIT) / n - mean * mean)) + 1e-3
    if not good or not bad:
        return BradleyTerry(mean, scale, np.zeros(WIDTH), math.log(AT_CUT / (1 - AT_CUT)), 1.0)

    # All that depends on a difference of strengths, by the number of bins between them.
    gap = np.arange(1 - BINS, BINS) * (2 * SPAN / BINS)
    losses, slopes = np.logaddexp(0, -gap), _logistic(-gap)
    bends = slopes * (1 - slopes)
    centres = (np.arange(BINS) + 0.5) * (2 * SPAN / BINS) - SPAN
    wide = (np.arange(COARSE) + 0.5) * (2 * SPAN / COARSE) - SPAN
    mixed = _logistic(wide[:, None] - wide[None, :])
    mixed = mixed * (1 - mixed)

    def counted(w: np.ndarray) -> np.ndarray:
        def parts(x: np.ndarray, y: np.ndarray):
            yield y * BINS + _bin(_strengths(x, mean, scale, w)[1], -SPAN, SPAN, BINS), 1

        return _sums(rows, 2 * BINS, parts).reshape(2, BINS)

    def curved(w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slope = np.stack([_over(counts[1], slopes[::-1]), -_over(counts[0], slopes)])
        bend = np.stack([_over(counts[1], bends), _over(counts[0], bends)])
        places = np.arange(WIDTH + WIDTH * WIDTH)

        def parts(x: np.ndarray, y: np.ndarray):
            z, s = _strengths(x, mean, scale, w)
            for label in (0, 1):
                a, t = z[y == label], s[y == label]
                by = np.interp(t, centres, slope[label])[:, None] * a
                twice = (np.interp(t, centres, bend[label])[:, None, None] * a[:, :, None] * a[:, None, :]).reshape(len(a), WIDTH * WIDTH)
                yield label * len(places) + places, np.concatenate([_whole(by).sum(0), _whole(twice).sum(0)])
                at = 2 * len(places) + (label * COARSE + _bin(t, -SPAN, SPAN, COARSE)) * WIDTH
                yield at[:, None] + np.arange(WIDTH), _whole(a)

        sums = _sums(rows, 2 * len(places) + 2 * COARSE * WIDTH, parts) / UNIT
        each = sums[:2 * len(places)].reshape(2, -1) / np.array([[bad], [good]])
        held = sums[2 * len(places):].reshape(2, COARSE, WIDTH) / np.array([bad, good])[:, None, None]
        both = held[1].T @ mixed @ held[0]
        return each[:, :WIDTH].sum(0) + DECAY * w, each[:, WIDTH:].sum(0).reshape(WIDTH, WIDTH) - both - both.T

    w = step = np.zeros(WIDTH)
    counts, least = counted(w), math.inf
    for _ in range(ROUNDS):
        loss = float(counts[1] @ _over(counts[0], losses)) / good + DECAY / 2 * float(w @ w)
        if loss > least:
            step = step / 2
            w = w - step
        else:
            if least - loss < 1e-6:
                break
            least = loss
            gradient, curve = curved(w, counts)
            size, axes = np.linalg.eigh(curve)
            step = -axes @ ((axes.T @ gradient) / (np.maximum(size, 0) + DECAY))
            w = w + step
        counts = counted(w)
    return _with_cut(rows, BradleyTerry(mean, scale, w, 0.0, 1.0), counts)


def _with_cut(rows: DataFrame, model: BradleyTerry, counts: np.ndarray) -> BradleyTerry:
    """The model with the level of fewest errors; ``counts`` are those of its strengths by label and bin."""
    n = counts.sum()
    share = counts[0].sum() / n
    levels = sorted(np.clip(share * np.linspace(0.7, 1.3, 121), 0, 1), key=lambda q: abs(q - share))

    def bins_of(sums: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The bin of the row at each place, in order of strengths."""
        return np.searchsorted(np.cumsum(sums), places, side="right")

    first, last = bins_of(counts.sum(0), np.array([math.floor(min(levels) * (n - 1)), math.ceil(max(levels) * (n - 1))])) * (2 * SPAN / BINS) - SPAN
    last += 2 * SPAN / BINS
    mean, scale, w = model.mean, model.scale, model.weights

    def parts(x: np.ndarray, y: np.ndarray):
        s = _strengths(x, mean, scale, w)[1]
        yield np.array([0, 1]), np.array([_whole(s).sum(), _whole(s * s).sum()])
        yield 2 + y * FINE + _bin(s, first, last, FINE), 1

    sums = _sums(rows, 2 + 2 * FINE, parts)
    total, square = sums[:2] / UNIT / n
    fine = sums[2:].reshape(2, FINE)
    places = np.array(levels) * (n - 1)
    low, high = bins_of(fine.sum(0), np.floor(places)), bins_of(fine.sum(0), np.ceil(places))
    # Between the two rows' bins, as a quantile is, on the edge below: what lies on either side of an edge is known.
    edges = np.floor(low + 0.5 + (places - np.floor(places)) * (high - low)).astype(np.int64)
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(fine, axis=1)], axis=1)
    wrong = below[1][edges] + below[0][-1] - below[0][edges]
    cut = first + edges[int(np.argmin(wrong))] * ((last - first) / FINE)
    return BradleyTerry(mean, scale, w, float(cut), math.sqrt(max(0.0, square - total * total)) + 1e-6)


def _figure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, texts in in_chunks(batch, "text"):
            x = [figures(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])


def train(docs: DataFrame, labels: DataFrame) -> BradleyTerry:
    """Learn from all labelled documents outside the held-out fold."""
    kept = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and _id is not null") \
        .where(remainder(F.col("_id"), FOLDS) != 0).groupBy("_id").agg(F.min("quality").alias("quality"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != 0))
    # Figures come before the join, so no text is shuffled; the join is the same whatever the number of labels.
    figured = rows.mapInArrow(_figure_rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")
    seen = figured.join(kept.hint("merge"), F.col("doc_id") == F.col("_id")).select("_id", "quality", "x")
    # One text for each labelled id, so repeated ids do not crowd others out.
    scratch = Scratch(docs.sparkSession, "quality")
    model = fit(scratch.put(seen.groupBy("_id").agg(F.min(F.struct("quality", "x")).alias("r")).select("r.quality", "r.x"), "figures"))
    scratch.drop()
    return model


def scored(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` and ``predicted``; columns of these names are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("score", "predicted")
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, texts in in_chunks(batch, batch.schema.names[at]):
                s = held.value.score(np.array([figures(t) for t in texts]))
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= AT_CUT).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    out = scored(docs.withColumnsRenamed({"score": "_score", "predicted": "_predicted"}), train(docs, labels)).where("predicted = 1").drop("score", "predicted")
    return out.withColumnsRenamed({"_score": "score", "_predicted": "predicted"})
