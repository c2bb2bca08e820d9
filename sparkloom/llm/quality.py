"""Quality scores by a factorisation machine.

Features of a text are its hashed words, statistics of its structure and its
length. Every feature has a weight and a short vector; the score of a text adds
the products of all pairs of vectors, which the sum-of-squares identity gives in
time linear in the features: half of (sum of v x) squared less the sum of (v x) squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as T
from .common import session

BUCKET_BITS, RANK = 14, 8
#: At most so many labelled rows are learnt from, those with the least hashed doc_id.
SAMPLE_ROWS = 4000
THRESHOLD = 0.7
EPOCHS, BATCH, RATE, DECAY = 12, 32, 0.05, 1e-4

_KINDS = np.zeros((6, 256), bool)
_KINDS[0, 65:91] = True  # upper case
_KINDS[1, 97:123] = True  # lower case
_KINDS[2, 48:58] = True  # digits
_KINDS[3, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'"]] = True  # symbols
_KINDS[4, 10] = True  # line ends
_KINDS[5, 128:] = True  # bytes of other characters
STATS = 14


def _share_of_distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the share of its keys that are new, and the share of its most frequent key."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    total = np.maximum(np.bincount(o, minlength=n), 1)
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(k)))
    most = np.zeros(n)
    np.maximum.at(most, o[first], run)
    return np.bincount(o[first], minlength=n) / total, most / total


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse part as (text, bucket, value) and the dense statistics, a row a text."""
    n, size = len(off) - 1, np.maximum(np.diff(off), 1)
    starts, ends, first = T.words(data, off)
    hashes = T.span_hashes(data, starts, ends)
    counts = np.diff(first)
    owner, total = np.repeat(np.arange(n), counts), np.maximum(counts, 1)
    stats = np.zeros((n, STATS))
    for i, kind in enumerate(_KINDS):
        sums = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        stats[:, i] = (sums[off[1:]] - sums[off[:-1]]) / size
    stats[:, 0] /= np.maximum(stats[:, 0] + stats[:, 1], 1e-9)
    length = ends - starts
    stats[:, 6] = np.bincount(owner, length, n) / total / 20
    stats[:, 7] = np.bincount(owner, length <= 3, n) / total
    last = data[ends - 1] if len(ends) else data
    stats[:, 8] = np.bincount(owner, _KINDS[3][last], n) / total
    stats[:, 9], stats[:, 10] = _share_of_distinct(hashes, owner, n)
    if len(hashes) > 2:
        inside = owner[2:] == owner[:-2]
        three = T.mix(hashes[:-2] * T._STEP[0] + hashes[1:-1] * T._STEP[1] + hashes[2:] * T._STEP[2])
        stats[:, 11], _ = _share_of_distinct(three[inside], owner[2:][inside], n)
    stats[:, 12] = np.log1p(counts) / 12
    stats[:, 13] = np.log1p(np.diff(off)) / 14
    key, times = np.unique(owner.astype(np.int64) << BUCKET_BITS | (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), return_counts=True)
    text, bucket, value = key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1), np.log1p(times)
    norm = np.sqrt(np.bincount(text, value**2, n))
    return text, bucket, value / norm[text], stats


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    constant: float | None = None

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -4, 4) / 4

    def logits(self, text: np.ndarray, bucket: np.ndarray, value: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, words = len(dense), 1 << BUCKET_BITS
        v, w = self.vectors[words:], self.weight[words:]
        sums = dense @ v
        squares = (dense**2) @ (v**2).sum(1)
        linear = self.bias + dense @ w + np.bincount(text, self.weight[bucket] * value, n)
        for f in range(RANK):
            part = self.vectors[bucket, f] * value
            sums[:, f] += np.bincount(text, part, n)
            squares += np.bincount(text, part**2, n)
        return linear + 0.5 * ((sums**2).sum(1) - squares), sums

    def score(self, column: pa.Array) -> np.ndarray:
        data, off = T.flat(column)
        out = np.empty(len(off) - 1)
        for a, b in T.slices(off):
            text, bucket, value, stats = features(data[off[a] : off[b]], off[a : b + 1] - off[a])
            out[a:b] = self.constant if self.constant is not None else 1 / (1 + np.exp(-np.clip(self.logits(text, bucket, value, self.dense(stats))[0], -40, 40)))
        return out


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """rows: buckets, values, statistics and label of each text. Adaptive gradient steps on the logistic loss."""
    words = 1 << BUCKET_BITS
    labels = np.array([r[3] for r in rows], float)
    rng = np.random.default_rng(seed)
    empty = Model(0.0, np.zeros(words + STATS), rng.normal(0, 0.05, (words + STATS, RANK)), np.zeros(STATS), np.ones(STATS))
    if len(set(labels.tolist())) < 2:
        empty.constant = float(labels[0]) if len(labels) else 0.5
        return empty
    stats = np.stack([r[2] for r in rows])
    model = empty
    model.mean, model.spread = stats.mean(0), np.maximum(stats.std(0), 1e-3)
    dense = model.dense(stats)
    weigh = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    seen_w, seen_v, seen_b = np.full(words + STATS, 1e-6), np.full((words + STATS, RANK), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            text = np.repeat(np.arange(len(picked)), [len(rows[i][0]) for i in picked])
            bucket, value = np.concatenate([rows[i][0] for i in picked]), np.concatenate([rows[i][1] for i in picked])
            x = dense[picked]
            logits, sums = model.logits(text, bucket, value, x)
            error = (1 / (1 + np.exp(-np.clip(logits, -40, 40))) - labels[picked]) * weigh[picked] / len(picked)
            ids, back = np.unique(bucket, return_inverse=True)
            pull = error[text] * value
            grad_w = np.concatenate([np.bincount(back, pull, len(ids)), x.T @ error])
            grad_v = np.zeros((len(ids) + STATS, RANK))
            square = np.bincount(back, pull * value, len(ids))
            for f in range(RANK):
                grad_v[: len(ids), f] = np.bincount(back, pull * sums[text, f], len(ids)) - square * model.vectors[ids, f]
            own = model.vectors[words:]
            grad_v[len(ids) :] = (x * error[:, None]).T @ sums - (x**2 * error[:, None]).sum(0)[:, None] * own
            ids = np.concatenate([ids, np.arange(words, words + STATS)])
            grad_w += DECAY * model.weight[ids]
            grad_v += DECAY * model.vectors[ids]
            seen_w[ids] += grad_w**2
            seen_v[ids] += grad_v**2
            seen_b += error.sum() ** 2
            model.weight[ids] -= RATE * grad_w / np.sqrt(seen_w[ids])
            model.vectors[ids] -= RATE / 4 * grad_v / np.sqrt(seen_v[ids])
            model.bias -= RATE * error.sum() / np.sqrt(seen_b)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model of labels.quality from at most rows labelled documents, none of them held out.

    A doc_id labelled more than once counts as good only if all its labels are 1;
    null labels and ids are passed over. Of rows that share a doc_id one text is learnt
    from, so rows bounds what is collected. With one label only, every score is that
    label; without labels it is 0.5.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.filter(~held_out(F.col("doc_id"))).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.flat(batch.column(1))
            out = []
            for a, b in T.slices(off):
                text, bucket, value, stats = features(data[off[a] : off[b]], off[a : b + 1] - off[a])
                cuts = np.searchsorted(text, np.arange(b - a + 1))
                out += [(bucket[x:y].astype("<u2").tobytes(), value[x:y].astype("<f4").tobytes(), s.tobytes()) for x, y, s in zip(cuts[:-1], cuts[1:], stats)]
            names = ["bucket", "value", "stats"]
            arrays = [pa.array([r[i] for r in out], pa.binary()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, batch.column(2)], ["doc_id", *names, "quality"])

    session(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("quality").cast("int").alias("quality"))
    found = sample.mapInArrow(run, f"doc_id {kind}, bucket binary, value binary, stats binary, quality int").collect()
    found.sort(key=lambda r: (r.doc_id, r.stats))
    return train([(np.frombuffer(r.bucket, "<u2").astype(np.int64), np.frombuffer(r.value, "<f4").astype(float), np.frombuffer(r.stats), r.quality) for r in found])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    The score reads the whole text alone, however long; a null text is scored as the
    empty one. Rows that repeat get equal scores; a null doc_id is not held out. An
    empty table gives no rows; other columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1)))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with a score of THRESHOLD or more, all columns as they are; all rows if the model saw no label.

    Texts of any length are read whole, null as empty; rows that repeat stay or go
    together; an empty table stays empty.
    """
    if model.constant == 0.5:
        return docs

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(text))

    return docs.filter(score(F.col("text").cast("string")) >= THRESHOLD)
