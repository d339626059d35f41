"""Quality: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text is cut into tokens: runs of letters, of digits and of other marks. Its features
are hashed tokens, the tokens' letter-case shapes and pairs of neighbouring tokens,
where a pair of equal tokens is one feature whatever the token. A feature's value is its
share of the text's tokens, so a score is a sparse dot product that does not depend on
length. Per-coordinate FTRL-proximal steps with an L1 term keep the weights sparse.

Defined results: a null or empty text has no features and gets the score of the bias
alone; repeated rows get equal scores; an empty table gives an empty result; a column
named like the one added is replaced. Without labels of both values scores mean nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodeweave.llm import calibrate, text
from lodeweave.llm.shared import labelled_sample, release, tidy, widened

BUCKETS = 1 << 18
SAMPLE_PER_LABEL = 1500
CUT_AT = 0.7
#: What a feature's share of the tokens is multiplied by.
GAIN = 20.0
KINDS = 3

_KIND = np.zeros(256, np.uint8)  # 0 white space, 1 letters, 2 digits, 3 other marks
_KIND[~text.SPACE] = 3
_KIND[text.LETTER] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1


def token_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An n x 3 table of buckets (token, shape, pair with the next) and the rows' token offsets."""
    starts, ends, rows = text.runs(buf, offs, _KIND)
    out = np.zeros((len(starts), KINDS), np.int32)
    if len(starts):
        keep = np.uint64(BUCKETS - 1)
        token = text.hashes(buf, starts, ends)
        upper = np.concatenate([np.zeros(1, np.int32), np.cumsum(_UPPER[buf], dtype=np.int32)])
        capitals = upper[ends] - upper[starts]
        kind, first = _KIND[buf[starts]], _UPPER[buf[starts]]
        shape = kind.astype(np.uint64) * np.uint64(64) + (first + 2 * (capitals > first)).astype(np.uint64) * np.uint64(8) + np.minimum(ends - starts, 7).astype(np.uint64)
        pair = np.zeros_like(token)
        pair[:-1] = text.mix(token[:-1] * np.uint64(3) + token[1:] * np.uint64(0x9E3779B97F4A7C15))
        pair[:-1][(token[:-1] == token[1:]) & (kind[:-1] == 1)] = 11
        last = rows[1:][np.diff(rows) > 0] - 1
        pair[last] = 12
        for k, h in enumerate((token, text.mix(shape + np.uint64(1 << 20)), pair)):
            out[:, k] = h & keep
    return out, rows


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    cut: float = 0.0

    def raw(self, features: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows) - 1, self.bias, np.float64)
        n = np.diff(rows)
        full = np.flatnonzero(n)
        if len(full) and len(features):
            dots = self.weights[features].sum(axis=1, dtype=np.float64)
            out[full] += GAIN * np.add.reduceat(dots, rows[:-1][full]) / n[full]
        return out

    def scores(self, raw: np.ndarray) -> np.ndarray:
        return calibrate.squash(raw, self.slope, self.cut, CUT_AT)


def train(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, share: tuple[float, float] = (1, 1), epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, seed: int = 3) -> QualityModel:
    """FTRL-proximal over documents as (bucket, share) pairs."""
    rng = np.random.default_rng(seed)
    kept = rng.random(len(docs)) < 0.2
    if len(set(y[~kept])) < 2 or len(set(y[kept])) < 2:
        kept[:] = False
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        found = z[at]
        return np.where(np.abs(found) <= l1, 0, (np.sign(found) * l1 - found) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.flatnonzero(~kept)
    for _ in range(epochs):
        for i in rng.permutation(order):
            at, x = docs[i]
            at, x = np.append(at, BUCKETS), np.append(x * GAIN, 1.0)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y[i]) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    model = QualityModel(w[:-1].astype(np.float32), float(w[-1]))
    check = np.flatnonzero(kept) if kept.any() else np.arange(len(docs))
    raw = np.array([model.bias + GAIN * float(model.weights[docs[i][0]] @ docs[i][1]) for i in check])
    labels, weight = y[check], np.where(y[check] > 0, 1 / share[1], 1 / share[0])
    cut = calibrate.best_cut(raw, labels, weight)
    if cut is not None:
        model.slope, model.cut = calibrate.scale(raw - cut, labels, np.ones(len(raw))), cut
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_PER_LABEL) -> QualityModel:
    """Train on at most `most` rows of each value of labels.quality, none held out. Only bucket counts reach the driver."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for lo, hi, buf, offs in text.groups(batch.column("text")):
                features, rows = token_features(buf, offs)
                for i in range(hi - lo):
                    ids, counts = np.unique(features[rows[i] : rows[i + 1]], return_counts=True)
                    at.append(ids.astype(np.int32).tobytes())
                    n.append((counts / max(1, rows[i + 1] - rows[i])).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["doc_id", "y", "at", "share"])

    sample, total = labelled_sample(docs, labels, "quality", most)
    rows = sample.mapInArrow(tidy(hashed), "doc_id long, y int, at binary, share binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.at)))
    y = np.array([r.y for r in rows], np.int64)
    share = tuple(max(1e-6, min(1.0, float((y == v).sum()) / max(1, total.get(v, 1)))) for v in (0, 1))
    model = train([(np.frombuffer(bytes(r.at), np.int32), np.frombuffer(bytes(r.share), np.float32).astype(np.float64)) for r in rows], y, share)
    del rows
    release()  # the driver goes on
    return model


def score(docs: DataFrame, model: QualityModel, added: str = "quality_score") -> DataFrame:
    """`docs` with its score from 0 to 1, under the name `added`."""
    docs = docs.drop(added)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            raw = np.zeros(batch.num_rows)
            for lo, hi, buf, offs in text.groups(batch.column("text")):
                raw[lo:hi] = m.raw(*token_features(buf, offs))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.scores(raw))], [*batch.schema.names, added])

    return docs.mapInArrow(tidy(scored), widened(docs.schema, f"{added} double"))
