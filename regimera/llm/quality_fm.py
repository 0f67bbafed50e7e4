"""Quality classifier: a factorisation machine over hashed words, binned structure statistics and text metadata.

score(x) = sigmoid(b + sum_j w_j x_j + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise part is computed in linear time
by the sum-of-squares identity: half of sum_f ((sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2).

Features of a text: its distinct lower-cased words hashed into 2**WORD_BITS slots (counts, scaled to length 1), and
one active bin of each structure statistic (length in words and characters, word length, shares of symbols, upper
case, digits, marks, non-ASCII bytes, distinct words, repeated neighbours, repeated lines). Labels, language, source
and id are no inputs. The model is fitted on at most TRAIN_ROWS labelled documents, the first by hashed id among
those whose crc32(id) mod 5 is not 0; that bound is a parameter and the fit runs on the driver over those rows alone.
Scoring is one pass over all texts in Arrow batches, without a shuffle; the model is broadcast (its size is fixed by
WORD_BITS and RANK, about 1.2 MB).

Cases: a null or empty text has no words and is scored from its bins; without labels every score is the prior 0.5;
repeated rows and ties are scored alike; null ids are never held out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .textkernel import Words, chunks

WORD_BITS = 15
RANK = 8
BINS = 12
TRAIN_ROWS = 6000
EPOCHS = 8
RATE = 0.1
DECAY = 1e-4
THRESHOLD = 0.3
SEED = 7
STATS = ("words", "chars", "word_length", "symbols", "upper", "digits", "marks", "wide", "distinct", "neighbours", "lines", "spaces")
N_FEATURES = (1 << WORD_BITS) + len(STATS) * BINS
_KIND = np.zeros((5, 256), bool)
_KIND[0, [ord(c) for c in "#*$%&|<>"]] = True
_KIND[1, 65:91] = True
_KIND[2, 48:58] = True
_KIND[3, [ord(c) for c in "!?.,;:'\"()-[]{}=/\\_~^`+@"]] = True
_KIND[4, 128:] = True
#: Inner edges of a share's bins: fine near zero, coarse above.
_SHARE_EDGES = np.array([1e-9, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8])
_LENGTH_EDGES = np.array([1, 2, 5, 10, 20, 50, 100, 300, 1000, 3000, 10000], float)


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with words and those equal in words to an earlier line, of each document."""
    n_docs = len(offsets) - 1
    if not len(words.start):
        return np.zeros(n_docs), np.zeros(n_docs)
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    line = newline[words.start]
    head = np.ones(len(line), bool)
    head[1:] = (line[1:] != line[:-1]) | (words.doc[1:] != words.doc[:-1])
    at = np.flatnonzero(head)
    place = np.arange(len(line)) - np.repeat(at, np.diff(np.append(at, len(line))))
    salted = (words.hash ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    h = np.add.reduceat(salted ^ (salted >> np.uint64(31)), at)
    doc = words.doc[at]
    order = np.lexsort((h, doc))
    h, owner = h[order], doc[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(doc, minlength=n_docs), np.bincount(owner, again, n_docs)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature index, value, offsets by document), sorted by document then index."""
    n = len(offsets) - 1
    w = Words(data, offsets)
    count = w.counts
    size = np.diff(offsets)
    key = (w.doc << WORD_BITS) | (w.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    exact = np.unique((w.hash & np.uint64((1 << 40) - 1)).astype(np.int64) | (w.doc.astype(np.int64) << 40))
    distinct = np.bincount(exact >> 40, minlength=n) if len(exact) else np.zeros(n)
    key, times = np.unique(key, return_counts=True)
    doc, slot = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    norm = np.sqrt(np.bincount(doc, times.astype(float) ** 2, n)) if len(doc) else np.ones(n)
    value = times / norm[doc]
    same = np.zeros(len(w.hash))
    if len(same) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    same = np.bincount(w.doc, same, n) if len(same) else np.zeros(n)
    letters = np.bincount(w.doc, w.end - w.start, n) if len(w.doc) else np.zeros(n)
    lines, again = _repeated_lines(data, offsets, w)
    kinds = [_per_doc(k[data], offsets) for k in _KIND]
    one = lambda a, b: a / np.maximum(b, 1)
    stats = [np.digitize(count, _LENGTH_EDGES), np.digitize(size / 6, _LENGTH_EDGES), np.digitize(one(letters, count), [2, 3, 4, 5, 6, 7, 8, 10, 13, 20, 40])]
    stats += [np.digitize(one(k, letters), _SHARE_EDGES) for k in kinds]
    stats += [np.digitize(one(distinct, count), np.linspace(0.08, 0.95, BINS - 1)), np.digitize(one(same, count), _SHARE_EDGES), np.digitize(one(again, lines), _SHARE_EDGES), np.digitize(one(size - letters, size), np.linspace(0.05, 0.5, BINS - 1))]
    bins = np.stack(stats, 1) + (1 << WORD_BITS) + np.arange(len(STATS)) * BINS
    index = np.concatenate([slot, bins.ravel()])
    owner = np.concatenate([doc, np.repeat(np.arange(n), len(STATS))])
    # Bins weigh as much as the words together.
    value = np.concatenate([value, np.full(n * len(STATS), 1 / np.sqrt(len(STATS)))])
    order = np.lexsort((index, owner))
    return index[order], value[order], np.searchsorted(owner[order], np.arange(n + 1))


def margins(model: dict, index: np.ndarray, value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The raw score of each document, in linear time."""
    if not len(offsets) - 1:
        return np.zeros(0)
    starts = offsets[:-1]  # every document has its bins, so no run is empty
    linear = np.add.reduceat(model["w"][index] * value, starts)
    vx = model["v"][index] * value[:, None]
    total = np.add.reduceat(vx, starts, axis=0)
    squares = np.add.reduceat((vx * vx).sum(1), starts)
    return model["b"] + linear + 0.5 * ((total * total).sum(1) - squares)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], rank: int = RANK, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> dict:
    """rows: (label, index, value). Logistic loss, Adagrad over small batches."""
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(N_FEATURES), rng.normal(0, 0.05, (N_FEATURES, rank)), 0.0
    model = {"w": w, "v": v, "b": b}
    if rows:
        share = np.clip(np.mean([r[0] for r in rows]), 0.02, 0.98)
        model["b"] = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, rank), 1e-6), 1e-6
    for _ in range(epochs if len({r[0] for r in rows}) > 1 else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 32):
            batch = [rows[i] for i in order[at : at + 32]]
            offsets = np.concatenate([[0], np.cumsum([len(r[1]) for r in batch])])
            index, value = np.concatenate([r[1] for r in batch]), np.concatenate([r[2] for r in batch])
            y = np.array([r[0] for r in batch], float)
            gap = (1 / (1 + np.exp(-margins(model, index, value, offsets))) - y) / len(batch)
            each = np.repeat(gap, np.diff(offsets))
            vx = v[index] * value[:, None]
            total = np.repeat(np.add.reduceat(vx, offsets[:-1], axis=0), np.diff(offsets), axis=0)
            dv = each[:, None] * value[:, None] * (total - vx)
            dw = each * value
            sort = np.argsort(index, kind="stable")
            used, first = np.unique(index[sort], return_index=True)
            dw, dv = np.add.reduceat(dw[sort], first) + DECAY * w[used], np.add.reduceat(dv[sort], first, axis=0) + DECAY * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
            gb += gap.sum() ** 2
            model["b"] -= rate * gap.sum() / np.sqrt(gb)
    return {"w": w.astype(np.float32), "v": v.astype(np.float32), "b": float(model["b"])}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Features of at most `limit` labelled documents outside the held-out fold, in id order."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # bounded, so it is broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(2)):
                index, value, offs = features(data, offsets)
                cut = pa.array(offs, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b].cast(pa.int32()), pa.ListArray.from_arrays(cut, pa.array(index, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(value, pa.float32()))],
                    ["doc_id", "quality", "index", "value"],
                )

    table = texts.mapInArrow(run, "doc_id bigint, quality int, index array<int>, value array<float>").toArrow()
    ids = table.column("doc_id").to_numpy()
    index, value, marks = (table.column(c).combine_chunks() for c in ("index", "value", "quality"))
    if not len(ids):
        return []
    return [(int(marks[i].as_py()), index[i].values.to_numpy().astype(np.int64), value[i].values.to_numpy().astype(float)) for i in map(int, np.argsort(ids, kind="stable"))]


def score(docs: DataFrame, model: dict, keep: str = "doc_id") -> DataFrame:
    """(doc_id, score) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                m = margins(shared.value, *features(data, offsets))
                p = 1 / (1 + np.exp(-np.clip(m.astype(float), -40, 40)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(p, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(keep).cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    ship(docs.sparkSession)
    model = fit(training_rows(docs, labels))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
