"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary text and one on the
telling passages of toxic text: those whose 5-byte strings are much likelier there.  Each
window of a document is compressed with the ordinary dictionary and with the toxic one
behind it; the bytes that the toxic one saves are that window's distance.  Thresholds on
the distances of all windows, and a logistic calibration fitted on labelled rows that
trained no dictionary, turn them into a score from 0 to 1.

The model is fitted on at most `max_rows` labelled rows of each class (the bound of the
sample, chosen by a hash of the id); scoring reads every window of every document.

Defined results: null or empty text has one empty window and so the score of a text
without toxic passages; without labels of both classes every score is 0; a null
doc_id is held out of nothing; repeated rows score alike; an empty table gives an
empty result; other columns pass through, and a score column whose name is taken ends in
an underscore.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import free, small_batches

WINDOW_WORDS = 16
MAX_ROWS = 1500
DICTIONARY_BYTES, TOXIC_BYTES = 65_536, 2048
LEVEL = 3
#: A byte string marks toxic text if it is in this share of the toxic rows and so much likelier there.
MIN_SHARE, MIN_LOG_ODDS = 0.01, 2.5


def windows(text: bytes | None, size: int = WINDOW_WORDS) -> list[bytes]:
    w = (text or b"").lower().split()
    return [b" " + b" ".join(w[i : i + size]) + b" " for i in range(0, len(w), size)] or [b""]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: tuple[float, ...] = ()

    def distances(self, text: bytes | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves, window by window."""
        plain, both = _compressor(self.ordinary), _compressor(self.ordinary + self.toxic)
        return _distances(plain, both, text)

    def scorer(self):
        if not self.weights:
            return lambda text: 0.0
        plain, both = _compressor(self.ordinary), _compressor(self.ordinary + self.toxic)
        weights = np.array(self.weights)
        return lambda text: float(1 / (1 + math.exp(-float(np.clip(features(_distances(plain, both, text)) @ weights, -30, 30)))))


def _distances(plain, both, text: bytes | None) -> np.ndarray:
    w = windows(text)
    a, b = plain.compress, both.compress
    return np.fromiter((len(a(x)) - len(b(x)) for x in w), np.int32, len(w))


def features(d: np.ndarray) -> np.ndarray:
    """Constant, then for each threshold the (damped) number and the share of windows beyond it."""
    beyond = np.array([(d >= t).sum() for t in (2, 3, 4, 5, 6, 8)])
    return np.concatenate([[1.0], np.log1p(beyond), np.sqrt(beyond / len(d)), [max(0, int(d.max())) / 8, math.log(len(d)) / 4]])


def _grams(text: bytes, n: int = 5) -> set[bytes]:
    return {x[i : i + n] for x in {b" " + w + b" " for w in text.lower().split()} for i in range(max(1, len(x) - n + 1))}


def _marked(word: bytes, marks: set[bytes], n: int = 5) -> list[bytes]:
    """The piece of a word from its first marked n bytes to its last ones."""
    at = [i for i in range(len(word) - n + 1) if word[i : i + n] in marks]
    return [word[at[0] : at[-1] + n]] if at else []


def _trained(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer
        return b"".join(samples)[-size:]


def fit(toxic: list[str], ordinary: list[str], share: float = 0.5) -> Model:
    """Half of each class trains the dictionaries, the other half calibrates; share: of toxic rows among all labels."""
    if len(toxic) < 4 or len(ordinary) < 4:
        return Model()
    texts = [[t.encode() for t in x] for x in (toxic, ordinary)]
    (a, calibrate_a), (b, calibrate_b) = ((x[::2], x[1::2]) for x in texts)
    rows_a, rows_b = (Counter(g for t in x for g in _grams(t)) for x in (a, b))
    least = max(2, MIN_SHARE * len(a))
    marks = {g for g, n in rows_a.items() if n >= least and math.log((n + 0.5) / (len(a) + 1)) - math.log((rows_b[g] + 0.5) / (len(b) + 1)) > MIN_LOG_ODDS}
    telling = [b" ".join(x for w in t.lower().split() for x in _marked(b" " + w + b" ", marks)) for t in a]
    model = Model(_trained([w for t in b for w in windows(t, 40)], DICTIONARY_BYTES), _trained([x for x in telling if x], TOXIC_BYTES))
    plain_c, both_c = _compressor(model.ordinary), _compressor(model.ordinary + model.toxic)
    x = np.array([features(_distances(plain_c, both_c, t)) for t in [*calibrate_a, *calibrate_b]])
    y = np.array([1.0] * len(calibrate_a) + [0.0] * len(calibrate_b))
    w = _logistic(x, y)
    w[0] += math.log(share / (1 - share)) - math.log(len(calibrate_a) / len(calibrate_b))
    model.weights = tuple(w)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; both classes weigh as they come."""
    w, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: str = "doc_id"):
    """Rows that never train: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most max_rows labelled, not held-out rows of each class."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and id is not null").filter(~held_out("id"))
    picked = None
    for y in (1, 0):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_rows)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * max_rows ids: small enough to broadcast at any input size
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked.dropDuplicates(["id"])), "id").orderBy(F.xxhash64("id"), "id", "text").limit(2 * max_rows).collect()
    toxic, total = known.agg(F.sum("y"), F.count("*")).first()
    by = {y: [r.text or "" for r in rows if r.y == y] for y in (0, 1)}
    return fit(by[1], by[0], min(0.99, max(0.01, (toxic or 0) / max(1, total))))


def score(docs: DataFrame, model: Model, *, text_col="text", out_col="score") -> DataFrame:
    """docs with the model's score of each whole text in out_col."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for texts in batches:
            yield pd.Series([one(t.encode() if t is not None else None) for t in texts], dtype=float)

    return docs.withColumn(free(docs, out_col)[0], run(F.col(text_col).cast("string")))


def digest(docs: DataFrame, model: Model) -> DataFrame:
    """The contract's columns."""
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
