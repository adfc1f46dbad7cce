"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.common import bounded_sample, written

#: Lines of one round of forward-backward, padding included.
ROUND = 1 << 16
#: Lines whose features are held at once when a text is scored.
CHUNK = 1 << 12
#: Texts of more lines go through forward-backward in blocks.
LONG = 1 << 12
BASE = 16
#: A line's features, those of the line before and after, and whether there are any.
FEATURES = 3 * BASE + 2

_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SYMBOL = re.compile(r"[^\w\s.,;:'\"?()\-]")
_MARKED = re.compile(r"\w[^\w\s.,;:'\"?()\-]{2,}")


def line_features(line: str, seen: bool) -> list[float]:
    """What is said of a line alone; ``seen``: the same line came before in the document."""
    words = line.split()
    n = len(words)
    if not n:
        return [0.0] * (BASE - 1) + [1.0]
    size = len(line)
    upper = len(_UPPER.findall(line)) / size
    marks = len(_MARKED.findall(line)) / n
    symbols = len(_SYMBOL.findall(line)) / size
    twice = sum(map(str.__eq__, words, words[1:])) / n
    distinct = len(set(words)) / n
    return [
        min(n, 50) / 50,
        float(n < 4),
        upper,
        float(upper > 0.4),
        symbols,
        float(symbols > 0.05),
        marks,
        float(marks > 0.3),
        twice,
        float(twice > 0.2),
        1 - distinct,
        min(size / n, 20) / 20,
        float(line[0].isupper()),
        float(line.rstrip()[-1:] in ".!?"),
        float(seen),
        0.0,
    ]


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line of a text, its neighbours' included, and the lines' lengths."""
    lines = (text or "").split("\n")
    seen: set[str] = set()
    own = np.zeros((len(lines), BASE))
    for i, line in enumerate(lines):
        own[i] = line_features(line, line in seen)
        seen.add(line)
    out = np.zeros((len(lines), FEATURES))
    out[:, :BASE] = own
    out[1:, BASE : 2 * BASE] = own[:-1]
    out[:-1, 2 * BASE : 3 * BASE] = own[1:]
    out[0, -2] = out[-1, -1] = 1.0
    return out, np.array([len(x) + 1.0 for x in lines])


def line_scores(text: str | None, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``document_features`` times ``weights``, and the lines' lengths, with the features of ``CHUNK`` lines at a time.

    A line adds to its own score and to those of both neighbours, so three numbers a line are enough.
    """
    lines = (text or "").split("\n")
    parts = weights[: 3 * BASE].reshape(3, BASE).T
    seen: set[str] = set()
    said = np.empty((len(lines), 3))
    for at in range(0, len(lines), CHUNK):
        own = []
        for line in lines[at : at + CHUNK]:
            own.append(line_features(line, line in seen))
            seen.add(line)
        said[at : at + CHUNK] = np.array(own) @ parts
    out = said[:, 0].copy()
    out[1:] += said[:-1, 1]
    out[:-1] += said[1:, 2]
    out[0] += weights[-2]
    out[-1] += weights[-1]
    return out, np.fromiter((len(x) + 1.0 for x in lines), float, len(lines))


def long_marginals(score: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability that each line of one long sequence is good, in about three times the root of its length steps.

    Steps of the chain are 2 x 2 matrices: their products over blocks, all blocks at once, give the messages
    that enter each block from both sides; then all blocks run side by side.
    """
    n = len(score)
    width = math.isqrt(n - 1) + 1
    blocks = -(-n // width)
    local = np.ones((blocks * width, 2))
    peak = np.maximum(score, 0.0)
    local[:n, 0], local[:n, 1] = np.exp(-peak), np.exp(score - peak)
    local = local.reshape(blocks, width, 2)
    places = np.arange(blocks) * width
    step, still = np.exp(trans - trans.max()), np.eye(2)

    def move(t: int) -> np.ndarray:
        """The chain's matrix at place ``t`` of each block: no change of label before the first line or past the last."""
        inner = ((places + t > 0) & (places + t < n))[:, None, None]
        return np.where(inner, step, still) * local[:, t, None, :]

    whole = np.broadcast_to(still, (blocks, 2, 2))
    for t in range(width):
        whole = whole @ move(t)
        whole = whole / whole.max(axis=(1, 2), keepdims=True)
    first, last = np.ones((blocks, 1, 2)), np.ones((blocks, 2, 1))
    for b in range(1, blocks):
        first[b] = first[b - 1] @ whole[b - 1]
        first[b] /= first[b].sum()
    for b in range(blocks - 2, -1, -1):
        last[b] = whole[b + 1] @ last[b + 1]
        last[b] /= last[b].sum()
    ahead = np.empty((blocks, width, 2))
    state = first
    for t in range(width):
        state = state @ move(t)
        state = state / state.sum(axis=2, keepdims=True)
        ahead[:, t] = state[:, 0]
    state = last
    good = np.empty((blocks, width))
    for t in range(width - 1, -1, -1):
        both = ahead[:, t] * state[:, :, 0]
        good[:, t] = both[:, 1] / both.sum(axis=1)
        state = move(t) @ state
        state = state / state.sum(axis=1, keepdims=True)
    return good.ravel()[:n]


def marginals(emit: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over sequences, padded to the same length.

    ``emit`` (sequences x lines x labels) and ``trans`` (labels x labels) are log potentials. Returns
    the labels' marginals, the expected number of each transition in each sequence, and log partition functions.
    """
    n, longest, _ = emit.shape
    live = np.arange(longest)[None, :] < sizes[:, None]
    peak = emit.max(axis=2, keepdims=True)
    local, step = np.exp(emit - peak), np.exp(trans)
    ahead, scale = np.zeros_like(emit), np.ones((n, longest))
    state = local[:, 0]
    for t in range(longest):
        if t:
            state = np.where(live[:, t, None], (ahead[:, t - 1] @ step) * local[:, t], ahead[:, t - 1])
        total = state.sum(axis=1)
        scale[:, t] = np.where(live[:, t], total, 1.0)
        ahead[:, t] = state / total[:, None]
    back = np.ones_like(emit)
    pairs = np.zeros((n, 2, 2))
    for t in range(longest - 2, -1, -1):
        both = live[:, t + 1, None]
        coming = local[:, t + 1] * back[:, t + 1]
        back[:, t] = np.where(both, (coming @ step.T) / scale[:, t + 1, None], 1.0)
        joint = ahead[:, t, :, None] * step[None] * coming[:, None, :] / scale[:, t + 1, None, None]
        pairs += np.where(both[:, :, None], joint, 0.0)
    shares = ahead * back
    shares /= shares.sum(axis=2, keepdims=True)
    partition = (np.log(scale) + np.where(live, peak[:, :, 0], 0.0)).sum(axis=1)
    return shares, pairs, partition


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), sizes.max(), *rows[0].shape[1:]))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, sizes


@dataclass
class QualityModel:
    weights: np.ndarray  # of "good" against "bad"
    trans: np.ndarray
    slope: float = 1.0  # from good share to score
    shift: float = 0.0

    def line_marginals(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Probability that each line is good, from the lines' scores."""
        out: list[np.ndarray] = [np.zeros(0)] * len(scores)
        order = np.argsort([len(s) for s in scores], kind="stable")
        at = 0
        while at < len(order):
            if len(scores[order[at]]) > LONG:
                out[order[at]] = long_marginals(scores[order[at]], self.trans)
                at += 1
                continue
            end = at + 1  # sequences of about the same length, a bounded number of lines at a time
            while end < len(order) and len(scores[order[end]]) <= LONG and (end + 1 - at) * len(scores[order[end]]) <= ROUND:
                end += 1
            part = order[at:end]
            rows, sizes = _padded([scores[i] for i in part])
            emit = np.stack([np.zeros_like(rows), rows], axis=2)
            good = marginals(emit, sizes, self.trans)[0][:, :, 1]
            for place, i in enumerate(part):
                out[i] = good[place, : sizes[place]]
            at = end
        return out

    def good_shares(self, scores: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals."""
        found = self.line_marginals(scores)
        return np.array([float(p @ n / n.sum()) for p, n in zip(found, lengths)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        scores, lengths = zip(*(line_scores(t, self.weights) for t in texts))
        return self.calibrated(self.good_shares(list(scores), list(lengths)))

    def calibrated(self, shares: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _log_odds(shares) + self.shift)))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _adam(start: np.ndarray, gradient, rounds: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, rounds + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def fit_field(docs: list[np.ndarray], labels: list[np.ndarray], ridge: float = 1e-3, rounds: int = 60) -> QualityModel:
    """Maximum likelihood of the lines' labels, with a penalty, over all sequences at once."""
    rows, sizes = _padded(docs)
    wanted, _ = _padded(labels)
    live = np.arange(rows.shape[1])[None, :] < sizes[:, None]
    total = live.sum()
    seen = np.zeros((2, 2))
    for y in labels:
        np.add.at(seen, (y[:-1].astype(int), y[1:].astype(int)), 1)

    def gradient(x: np.ndarray) -> np.ndarray:
        weights, trans = x[:FEATURES], x[FEATURES:].reshape(2, 2)
        score = rows @ weights
        shares, pairs, _ = marginals(np.stack([np.zeros_like(score), score], axis=2), sizes, trans)
        off = np.where(live, shares[:, :, 1] - wanted, 0.0)
        of_weights = np.tensordot(off, rows, axes=([0, 1], [0, 1])) / total
        of_trans = (pairs.sum(axis=0) - seen) / total
        return np.concatenate([of_weights, of_trans.ravel()]) + ridge * x

    x = _adam(np.zeros(FEATURES + 4), gradient, rounds, 0.1)
    return QualityModel(x[:FEATURES], x[FEATURES:].reshape(2, 2))


def fit_quality(docs: list[np.ndarray], lengths: list[np.ndarray], good: np.ndarray) -> QualityModel:
    """Learn from documents' labels: lines start with their document's label; then, in documents
    labelled bad, those that look good become good, all but the worst line; the field is
    fitted again. At last the score is set against the labels by a logistic curve of the good share."""
    if not len(docs) or good.min() == good.max():
        # nothing to tell apart: the share of good documents, or one half
        level = _log_odds(np.array([good.mean() if len(docs) else 0.5]))[0]
        return QualityModel(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, float(level))
    labels = [np.full(len(d), float(g)) for d, g in zip(docs, good)]
    model = fit_field(docs, labels)
    for _ in range(2):
        found = model.line_marginals([d @ model.weights for d in docs])
        for i in np.flatnonzero(good == 0):
            labels[i] = (found[i] > 0.5).astype(float)
            labels[i][found[i].argmin()] = 0.0
        model = fit_field(docs, labels)
    x = _log_odds(model.good_shares([d @ model.weights for d in docs], lengths))

    def gradient(p: np.ndarray) -> np.ndarray:
        off = 1 / (1 + np.exp(-(p[0] * x + p[1]))) - good
        return np.array([(off * x).mean() + 1e-3 * p[0], off.mean()])

    model.slope, model.shift = map(float, _adam(np.array([1.0, 0.0]), gradient, 400, 0.05))
    model.slope = max(model.slope, 0.0)
    return model


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [document_features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("good"),
                pa.array([f[0].astype("<f4").tobytes() for f in found], pa.binary()),
                pa.array([f[1].astype("<f8").tobytes() for f in found], pa.binary()),
            ],
            names=["good", "features", "lengths"],
        )


def learn_quality(
    docs: DataFrame,
    labels: DataFrame,
    allowed: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    per_label: int = 300,
    most_lines: int = 100,
) -> QualityModel:
    """Fit on rows that are ``allowed`` and have a label of 0 or 1.

    The sample is bounded: at most ``per_label`` documents of each label, chosen by a hash of the key, those of
    over ``most_lines`` lines left out of it. Only the lines' features come to the driver. Of
    conflicting labels the smaller holds; a key that repeats counts once, by the text of least hash. Without labels, or
    with one only, all texts get one score.
    """
    marked = (
        labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
        .select(F.col(key).alias("id"), F.col(label).cast("int").alias("good"))
        .groupBy("id")
        .agg(F.min("good").alias("good"))
    )
    lines = F.size(F.split(F.col(text), "\n"))
    known = docs.where(allowed & F.col(key).isNotNull() & F.col(text).isNotNull()).where(lines <= most_lines)
    known = known.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    ids = known.groupBy("id").agg(F.min("hash").alias("hash"))
    both = written(marked.join(ids, "id"), "labelled")
    chosen = bounded_sample(both, "id", "good", per_label, 2)
    # at most two times per_label rows, so they may be broadcast
    rows = (
        known.join(F.broadcast(chosen), ["id", "hash"])
        .dropDuplicates(["id"])
        .select("good", "text")
        .mapInArrow(_profiled, "good int, features binary, lengths binary")
        .collect()
    )
    rows.sort(key=lambda r: (r["good"], bytes(r["lengths"]), bytes(r["features"])))
    features = [np.frombuffer(r["features"], "<f4").reshape(-1, FEATURES).astype(float) for r in rows]
    lengths = [np.frombuffer(r["lengths"], "<f8") for r in rows]
    return fit_quality(features, lengths, np.array([r["good"] for r in rows], float))


def quality_score(model: QualityModel, text: Column) -> Column:
    """Score of a whole text, 0 to 1, from all its lines; a missing text is one empty line. Equal texts get
    equal scores; no other column is looked at."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        parts = [
            model.scores(texts.iloc[at : at + 512].tolist()) for at in range(0, len(texts), 512)
        ]
        return pd.Series(np.concatenate([np.zeros(0), *parts]))

    return score(text)
