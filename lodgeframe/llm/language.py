"""Language identification by error-correcting output codes over hashed n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.common import bounded_sample

#: Hashed n-grams of 1 to 3 bytes; a power of two.
BUCKETS = 4096
#: Bytes of text whose n-grams are counted at once.
CHUNK = 1 << 20
UNKNOWN = "und"
MOST_LANGUAGES = 256

#: Letters and bytes of other scripts as they are, all else as a blank.
_FOLD = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def ngram_profile(text: str) -> np.ndarray:
    """Square roots of the shares of hashed n-grams, over the whole text: a vector of length 1 or 0."""
    counts = np.zeros(BUCKETS)
    raw = np.frombuffer(f" {text.lower()} ".encode(errors="replace"), np.uint8)
    shift = np.uint32(32 - int(math.log2(BUCKETS)))
    for at in range(0, len(raw), CHUNK):
        part = _FOLD[raw[max(0, at - 2) : at + CHUNK]]
        grams = part + np.uint32(1)
        for n in range(1, 4):
            if n > 1:
                grams = grams[:-1] * np.uint32(0x01000193) + part[n - 1 :] + np.uint32(n)
            hashed = (grams * np.uint32(2654435769)) >> shift
            counts += np.bincount(hashed, minlength=BUCKETS)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


def codewords(classes: int) -> np.ndarray:
    """A row of -1 and 1 for each class. Up to 7 classes: all ways to part them; beyond, random rows far apart."""
    if classes <= 7:
        bits = max(1, 2 ** (classes - 1) - 1)
        # class 0 is always 1, so no column is another one's complement
        rest = np.arange(bits)[:, None] >> np.arange(classes - 1)[None, :] & 1
        return np.concatenate([np.ones((bits, 1)), 2.0 * rest - 1], axis=1).T
    bits = math.ceil(10 * math.log2(classes))
    rng = np.random.default_rng(0)
    tries = (rng.choice([-1.0, 1.0], (classes, bits)) for _ in range(50))
    gap = lambda c: (bits - np.max(c @ c.T - 3 * bits * np.eye(classes))) / 2
    return max(tries, key=gap)


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits: how often a bit is right for a language; rows sum to 1
    sharpness: float

    def losses(self, profiles: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each row to each codeword."""
        said = np.clip(profiles @ self.weights + self.bias, -4, 4)
        agree = said[:, None, :] * self.codes[None, :, :]
        return (np.exp(-agree) * self.trust[None, :, :]).sum(axis=2)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its share of belief, and whether the runner-up is too near to tell."""
        names, scores, unclear = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        rows = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        if rows:
            loss = self.losses(np.stack([ngram_profile(texts[i]) for i in rows]))
            belief = np.exp(-self.sharpness * (loss - loss.min(axis=1, keepdims=True)))
            belief /= belief.sum(axis=1, keepdims=True)
            best = belief.argmax(axis=1)
            top = belief[np.arange(len(rows)), best]
            second = np.where(np.arange(belief.shape[1]) == best[:, None], 0, belief).max(axis=1, initial=0)
            for place, i in enumerate(rows):
                names[i] = self.languages[best[place]]
            scores[rows] = top
            unclear[rows] = top < 2 * second
        return names, scores, unclear


def fit_model(profiles: np.ndarray, names: list[str], ridge: float = 0.01) -> LanguageModel:
    """One least-squares classifier for each bit of the code, each example weighted by its language's size."""
    languages = sorted(set(names))
    codes = codewords(len(languages)) if languages else np.zeros((0, 1))
    if not languages:
        return LanguageModel([], codes, np.zeros((BUCKETS, 1)), np.zeros(1), codes, 1.0)
    of = np.array([languages.index(n) for n in names])
    weight = 1 / np.bincount(of)[of] / len(languages)
    middle = weight @ profiles
    wanted = codes[of]
    bias = weight @ wanted
    scale = np.sqrt(weight)[:, None]
    x, y = (profiles - middle) * scale, (wanted - bias) * scale
    penalty = ridge / len(names)
    if len(names) <= BUCKETS:
        weights = x.T @ np.linalg.solve(x @ x.T + penalty * np.eye(len(names)), y)
    else:  # the same weights from a system of fixed size
        weights = np.linalg.solve(x.T @ x + penalty * np.eye(BUCKETS), x.T @ y)
    bias = bias - middle @ weights
    said = np.sign(profiles @ weights + bias)
    right = np.stack([(said[of == k] == codes[k]).mean(axis=0) for k in range(len(languages))])
    trust = (right + 1e-3) / (right + 1e-3).sum(axis=1, keepdims=True)
    return LanguageModel(languages, codes, weights, bias, trust, 4.0)


def learn_languages(
    docs: DataFrame,
    allowed: Column,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = 300,
    fit_rows: int = 16384,
) -> LanguageModel:
    """Fit on rows that are ``allowed``, have a key, a language and a letter.

    The sample is bounded: at most ``per_language`` documents of a language, chosen by a hash of
    the key, ``fit_rows`` documents in all (dealt evenly to the languages), and at most ``MOST_LANGUAGES`` languages
    (more raise an error). A key that repeats within a language counts once, by the text of least hash. Only n-gram
    counts come to the driver. No such row: a model that knows no language.
    """
    lettered = docs.where(allowed & F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).rlike(r"\p{L}"))
    lettered = lettered.select(
        F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")
    )
    named = lettered.groupBy("id", "lang").agg(F.min("hash").alias("hash"))
    kinds = named.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    size = max(1, min(per_language, fit_rows // max(kinds, 1)))
    chosen = bounded_sample(named, "id", "lang", size, MOST_LANGUAGES)

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (name, ngram_profile(t).astype("<f4").tobytes())
                for name, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())
                if has_letter(t)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())],
                names=["lang", "profile"],
            )

    # the chosen ids are bounded by the parameters, so they may be broadcast
    rows = (
        lettered.join(F.broadcast(chosen), ["id", "lang", "hash"], "left_semi")
        .dropDuplicates(["id", "lang"])
        .select("lang", "text")
        .mapInArrow(profiled, "lang string, profile binary")
        .collect()
    )
    rows.sort(key=lambda r: (r["lang"], bytes(r["profile"])))
    profiles = np.stack([np.frombuffer(r["profile"], "<f4") for r in rows]) if rows else np.zeros((0, BUCKETS))
    return fit_model(profiles.astype(np.float64), [r["lang"] for r in rows])


def identify(model: LanguageModel, text: Column) -> Column:
    """Struct of ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` for a whole text.

    ``und`` with score 0, ambiguous, where the text is missing or has no letter, or the model knows no
    language. Equal texts get equal results; no other column is looked at.
    """

    @F.pandas_udf("struct<lang_pred: string, score: double, ambiguous: boolean>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found: list[tuple] = []
        for at in range(0, len(texts), 256):
            found.extend(zip(*model.predict(texts.iloc[at : at + 256].tolist())))
        return pd.DataFrame(found, columns=["lang_pred", "score", "ambiguous"])

    return predict(text)
