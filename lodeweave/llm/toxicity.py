"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is a run of letters, A-Z lower-cased. Its embedding is the sum of hashed rows for
the whole word and for its first 4, 5 and 6 bytes, so an inflected form that was never
seen still meets its stem. Filters one, two and three words wide run over the whole
text; each filter's largest value, if positive, goes into a logistic output. Everything
starts from random numbers. Raw outputs are calibrated on rows kept from training, and
every language gets its own threshold: its best cut, drawn to the common one as if that
had been seen on PRIOR toxic rows more.

Defined results: a null or empty text has the score of a text in which no filter fires;
a null language takes the threshold of all languages; repeated rows get equal scores;
an empty table gives an empty result; columns named like the ones added are replaced.
Without labels of both values the model is an untrained one, whose scores mean nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm import calibrate, text
from lodeweave.llm.shared import labelled_sample, release, tidy, widened

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
WIDTHS = (1, 2, 3)
DIM, FILTERS = 8, 8
#: Rows of each label that training takes at most.
SAMPLE_PER_LABEL = 1500
#: The score at which F1 is largest on the calibration rows.
CUT_AT = 0.3
#: Toxic calibration rows that the common cut counts as, when a language's own is found.
PRIOR = 10
#: Words whose filter outputs are held at a time.
PASS_WORDS = 1 << 16
_LETTER = text.LETTER.astype(np.uint8)


def word_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An n x 4 table of bucket numbers (0: no such prefix) and the rows' word offsets."""
    starts, ends, rows = text.runs(buf, offs, _LETTER)
    out = np.zeros((len(starts), 1 + len(PREFIXES)), np.int32)
    keep = np.uint64(BUCKETS - 1)
    if len(starts):
        out[:, 0] = np.maximum(text.hashes(buf, starts, ends, text.LOWER) & keep, np.uint64(1))
        for k, n in enumerate(PREFIXES, 1):
            ok = np.flatnonzero(ends - starts >= n)
            salted = text.hashes(buf, starts[ok], starts[ok] + n, text.LOWER) * np.uint64(2 * n + 1)
            out[ok, k] = np.maximum(text.mix(salted) & keep, np.uint64(1))
    return out, rows


@dataclass
class ToxicityModel:
    index: np.ndarray  # bucket -> row of table; 0 is the zero row
    table: np.ndarray
    filters: np.ndarray  # DIM x (FILTERS * sum(WIDTHS)), by width, then by place in the filter
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    cut: float = 0.0
    thresholds: dict[str | None, float] = field(default_factory=lambda: {None: CUT_AT})

    def raw(self, features: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Raw outputs of the rows whose words' buckets are features[rows[i]:rows[i + 1]]."""
        pooled = np.full((len(rows) - 1, FILTERS * len(WIDTHS)), -np.inf, np.float32)
        n = len(features)
        for lo in range(0, n, PASS_WORDS):
            hi = min(n, lo + PASS_WORDS)
            picked = self.index[features[lo : min(n, hi + max(WIDTHS) - 1)]]
            e = self.table[picked[:, 0]]
            for k in range(1, picked.shape[1]):
                e += self.table[picked[:, k]]
            parts = e @ self.filters
            owners = np.arange(np.searchsorted(rows, lo, "right") - 1, np.searchsorted(rows, hi))
            owners = owners[rows[owners] < rows[owners + 1]]  # the texts with words here
            starts = np.maximum(rows[owners] - lo, 0)
            at = 0
            for k, width in enumerate(WIDTHS):
                conv = parts[: hi - lo, at : at + FILTERS].copy()
                for j in range(1, width):
                    moved = parts[j : j + hi - lo, at + j * FILTERS : at + (j + 1) * FILTERS].copy()
                    for back in range(j):  # what lies beyond the text counts nothing
                        beyond = rows[1:] - 1 - back - lo
                        moved[beyond[(beyond >= 0) & (beyond < len(moved))]] = 0
                    conv[: len(moved)] += moved
                best = np.maximum.reduceat(conv, starts, axis=0)
                own = pooled[owners, k * FILTERS : (k + 1) * FILTERS]
                pooled[owners, k * FILTERS : (k + 1) * FILTERS] = np.maximum(own, best)
                at += width * FILTERS
        pooled[np.diff(rows) == 0] = 0
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias

    def scores(self, raw: np.ndarray) -> np.ndarray:
        return calibrate.squash(raw.astype(np.float64), self.slope, self.cut, CUT_AT)


def train(docs: list[np.ndarray], y: np.ndarray, langs: list[str | None], share: tuple[float, float] = (1, 1), epochs: int = 8, seed: int = 5) -> ToxicityModel:
    """Fit on word buckets by document. share: how much of each label's rows the sample holds, for weights."""
    rng = np.random.default_rng(seed)
    kept = rng.random(len(docs)) < 0.2  # for calibration
    if len(set(y[~kept])) < 2 or len(set(y[kept])) < 2:
        kept[:] = False
    fit = [i for i in range(len(docs)) if not kept[i]]
    seen = [np.unique(docs[i]) for i in fit]
    ids, where = np.unique(np.concatenate([*seen, np.zeros(1, np.int32)]), return_inverse=True)
    known = (np.bincount(where, minlength=len(ids)) >= 2) & (ids > 0)  # in two texts at least
    index = np.zeros(BUCKETS, np.int32)
    index[ids[known]] = np.arange(1, known.sum() + 1)
    table = rng.normal(0, 0.05, (known.sum() + 1, DIM)).astype(np.float32)
    table[0] = 0
    n_filters = FILTERS * len(WIDTHS)
    filters = rng.normal(0, 0.3, (DIM, FILTERS * sum(WIDTHS))).astype(np.float32)
    model = ToxicityModel(index, table, filters, np.zeros(n_filters, np.float32), np.abs(rng.normal(0.3, 0.1, n_filters)).astype(np.float32), -1.0)
    squares = {k: np.full_like(getattr(model, k), 1e-6) for k in ("table", "filters", "bias", "out")}
    bias_sq, rate = 1e-6, 0.05
    at = np.concatenate([[0], np.cumsum([w * FILTERS for w in WIDTHS])])

    def descend(name: str, where: object, g: np.ndarray) -> None:
        squares[name][where] += g * g
        getattr(model, name)[where] -= rate * g / np.sqrt(squares[name][where])

    for _ in range(epochs):
        for i in rng.permutation(fit):
            picked = index[docs[i]]
            if not len(picked):
                continue
            e = table[picked].sum(axis=1)
            parts = e @ filters
            top = np.zeros(n_filters, np.float32)
            places = []
            for k, width in enumerate(WIDTHS):
                conv = parts[:, at[k] : at[k] + FILTERS].copy()
                for j in range(1, min(width, len(conv))):
                    conv[:-j] += parts[j:, at[k] + j * FILTERS : at[k] + (j + 1) * FILTERS]
                best = conv.argmax(axis=0)
                places.append(best)
                top[k * FILTERS : (k + 1) * FILTERS] = conv[best, np.arange(FILTERS)]
            pooled = np.maximum(top + model.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.out_bias, -30, 30)))
            d = np.float32(p - y[i])
            if abs(d) < 1e-3:
                continue
            back = d * model.out * (pooled > 0)
            g_filters = np.zeros_like(filters)
            touched, g_rows = [], []
            for k, width in enumerate(WIDTHS):
                g = back[k * FILTERS : (k + 1) * FILTERS]
                for j in range(width):
                    place = places[k] + j
                    ok = place < len(picked)
                    cols = slice(at[k] + j * FILTERS, at[k] + (j + 1) * FILTERS)
                    g_filters[:, cols] = e[np.minimum(place, len(picked) - 1)].T * (g * ok)
                    touched.append(picked[place[ok]])
                    g_rows.append((filters[:, cols] * g).T[ok])
            descend("out", slice(None), d * pooled)
            bias_sq += float(d) ** 2
            model.out_bias -= rate * float(d) / np.sqrt(bias_sq)
            descend("bias", slice(None), back)
            descend("filters", slice(None), g_filters)
            rows, places_of = np.unique(np.concatenate(touched), return_inverse=True)
            g_sum = np.zeros((len(rows), DIM), np.float32)
            flat = np.concatenate(g_rows)
            for c in range(picked.shape[1]):
                np.add.at(g_sum, places_of[:, c], flat)
            descend("table", rows, g_sum)
            table[0] = 0

    check = np.flatnonzero(kept) if kept.any() else np.arange(len(docs))
    lengths = np.array([len(docs[i]) for i in check])
    z = model.raw(np.concatenate([docs[i] for i in check]), np.concatenate([[0], np.cumsum(lengths)])) if len(check) else np.zeros(0)
    labels, weight = y[check], np.where(y[check] > 0, 1 / share[1], 1 / share[0])
    cut = calibrate.best_cut(z, labels, weight)
    if cut is not None:
        model.slope, model.cut = calibrate.scale(z - cut, labels, np.ones(len(z))), cut
        for lang in sorted({langs[i] for i in check} - {None}):
            own = np.array([langs[i] == lang for i in check])
            found = calibrate.best_cut(z[own], labels[own], weight[own])
            if found is not None:
                n = int(labels[own].sum())
                model.thresholds[lang] = float(model.scores(np.array([(n * found + PRIOR * cut) / (n + PRIOR)]))[0])
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_PER_LABEL) -> ToxicityModel:
    """Train on at most `most` rows of each value of labels.toxic, none held out. Only word buckets reach the driver."""
    sample, total = labelled_sample(docs, labels, "toxic", most)
    # lang chooses a row's threshold; it is no input of the score.
    langs = docs.select("doc_id", "lang") if "lang" in docs.columns else docs.select("doc_id", F.lit(None).cast("string").alias("lang"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for lo, hi, buf, offs in text.groups(batch.column("text")):
                features, rows = word_features(buf, offs)
                got += [features[rows[i] : rows[i + 1]].tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(got, pa.binary())], ["doc_id", "y", "words"])

    rows = sample.mapInArrow(tidy(hashed), "doc_id long, y int, words binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.words)))
    wanted = [(r.doc_id,) for r in rows]
    by_id: dict[int, str | None] = {}
    if wanted:
        chosen = docs.sparkSession.createDataFrame(wanted, "doc_id long")
        own = langs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("lang").alias("lang"))
        by_id = {r.doc_id: r.lang for r in own.collect()}
    y = np.array([r.y for r in rows], np.int64)
    arrays = [np.frombuffer(bytes(r.words), np.int32).reshape(-1, 1 + len(PREFIXES)) for r in rows]
    share = tuple(max(1e-6, min(1.0, float((y == v).sum()) / max(1, total.get(v, 1)))) for v in (0, 1))
    model = train(arrays, y, [by_id.get(r.doc_id) for r in rows], share)
    del rows
    release()  # the driver goes on
    return model


def score(docs: DataFrame, model: ToxicityModel, added: tuple[str, str, str] = ("toxicity", "toxic_threshold", "toxic")) -> DataFrame:
    """`docs` with its score (0..1), the threshold of its language and a mark (1 from that threshold on), under the names `added`."""
    docs = docs.drop(*added)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    has_lang = "lang" in docs.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for lo, hi, buf, offs in text.groups(batch.column("text")):
                z[lo:hi] = m.raw(*word_features(buf, offs))
            s = m.scores(z)
            cut = np.array([m.thresholds.get(x, m.thresholds[None]) for x in batch.column("lang").to_pylist()]) if has_lang else np.full(len(s), m.thresholds[None])
            cols = [pa.array(s), pa.array(cut, pa.float64()), pa.array((s >= cut).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *added])

    return docs.mapInArrow(tidy(scored), widened(docs.schema, "{} double, {} double, {} int".format(*added)))
