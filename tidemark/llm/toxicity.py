"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence with known words has the chance p = sigmoid(bias + sum of its words'
weights); the document's chance is the noisy-or of its sentences and of a leak that stands for labels no sentence
explains: P = 1 - (1 - leak) * prod(1 - p). Only document labels are known; bias, weights and leak are trained through
the noisy-or by gradient descent, so that blame settles on the sentences that separate the bags. Scoring then names
the worst sentence of each document.

Words are hashed to BITS bits. The model is fitted on a bounded sample of labelled rows (of the TRAIN_ROWS labels with the
smallest hashes, TRAIN_ROWS different texts; a documented parameter): the rows are chosen by id and hash of the text alone, and their whole
texts are hashed word for word by the tasks that read them. Words enter the model when they are seen in at least MIN_DOCS documents of the sample and their share
of label-1 documents is far from the base rate (|z| >= Z), which Spark counts; only where such words stand comes to the driver. Scoring reads every text whole, in one pass without a shuffle.

Edge cases: null or empty texts have no sentences and score the leak. Labels that are null or contradict each other for one
document count as the largest. With no labels to learn from all scores are 0. Rows that repeat come out as they come in, and
count once in the fit. An empty table gives no rows. Other columns are ignored (toxicity) or kept (clean), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import cut

BITS = 20
TRAIN_ROWS = 8000
MIN_DOCS = 3
Z = 4.0
THRESHOLD = 0.7
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


class Model(NamedTuple):
    words: np.ndarray  # sorted hashes of the known words
    weights: np.ndarray
    bias: float
    leak: float


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _sentences(buf: np.ndarray, off: np.ndarray) -> tuple[T.Words, np.ndarray, np.ndarray]:
    """Words of the rows, each word's hashed feature, and each word's sentence number, which grows over all rows."""
    w = T.Words(buf, off, T.ALNUM)
    breaks = np.union1d(np.flatnonzero(_STOP[buf]), w.off[1:-1] - 1)
    return w, (w.hash >> T.U64(64 - BITS)).astype(np.int64), np.searchsorted(breaks, w.abs_start, side="left")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per labelled document: all of its words' features by sentence."""
    for batch in batches:
        buf, off = T.raw(batch.column(2))
        for a, b in T.row_groups(off):
            w, feature, sentence = _sentences(buf[off[a] : off[b]], off[a : b + 1])
            keys = []
            for i in range(b - a):
                s = slice(w.first[i], w.first[i + 1])
                local = sentence[s] - (sentence[s][0] if len(sentence[s]) else 0)
                keys.append(np.unique((local << BITS) | feature[s]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), _lists(keys)], names=["doc_id", "label", "keys"])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) for p in parts])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def _only(words: np.ndarray):
    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bags with the features of these words alone."""
        for batch in batches:
            lists = batch.column(2)
            off, keys = lists.offsets.to_numpy(), lists.values.to_numpy()
            parts = [keys[off[i] : off[i + 1]] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists([k[np.isin(k & ((1 << BITS) - 1), words)] for k in parts])], names=["doc_id", "label", "keys"])

    return only


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most `rows` of the labelled documents given."""
    sample = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # at most `rows` narrow rows, twice: bounded broadcasts. A document that repeats is one
    sample = cut(sample)
    texts = texts.withColumn("h", F.xxhash64("text"))
    chosen = cut(texts.select("doc_id", "h").join(F.broadcast(sample), "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(rows))
    found = texts.join(F.broadcast(chosen), ["doc_id", "h"]).select("doc_id", "label", "text").mapInArrow(_features, "doc_id long, label int, keys array<long>")
    bags = cut(found.distinct())
    base = bags.agg(F.avg("label")).first()[0]
    if not base or base == 1:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, float(base or 0.0))
    each = bags.select("label", F.explode(F.array_distinct(F.transform("keys", lambda k: k.bitwiseAND(F.lit((1 << BITS) - 1))))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("seen"), F.sum("label").alias("hit"))
    far = F.abs(F.col("hit") - base * F.col("seen")) >= (Z - 0.01) * F.sqrt(base * (1 - base) * F.col("seen"))  # fit() takes the exact bound
    words = np.array(sorted(r["word"] for r in each.where((F.col("seen") >= MIN_DOCS) & far).select("word").collect()), dtype=np.int64)  # of 2 ** BITS at most
    bags = bags.mapInArrow(_only(words), "doc_id long, label int, keys array<long>").toArrow()
    y = bags.column("label").to_numpy().astype(np.float64)
    lists = bags.column("keys").combine_chunks()
    offsets, keys = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
    sums = np.add.reduceat(np.append(keys, 0), offsets[:-1]) * (np.diff(offsets) > 0) if len(y) else np.zeros(0, np.int64)
    order = np.lexsort((sums, bags.column("doc_id").to_numpy()))  # rows come in any order; the fit must not depend on it
    return fit(y[order], [keys[offsets[i] : offsets[i + 1]] for i in order])


def fit(y: np.ndarray, bags: list[np.ndarray], steps: int = 400, rate: float = 0.2, ridge: float = 1e-3) -> Model:
    """Noisy-or by Adam on the full sample. bags: (sentence << BITS | feature) of each document."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, float(y.mean()) if len(y) else 0.0)
    mask = (1 << BITS) - 1
    doc_words = [np.unique(k & mask) for k in bags]
    flat = np.concatenate(doc_words)
    seen = np.bincount(flat, minlength=1 << BITS)
    hit = np.bincount(flat, weights=np.repeat(y, [len(w) for w in doc_words]), minlength=1 << BITS)
    base = y.mean()
    z_all = (hit - base * seen) / np.sqrt(base * (1 - base) * np.maximum(seen, 1))
    words = np.flatnonzero((seen >= MIN_DOCS) & (np.abs(z_all) >= Z))
    z = z_all[words]
    place = np.full(1 << BITS, -1, dtype=np.int64)
    place[words] = np.arange(len(words))
    del flat, doc_words, seen, hit, z_all
    known = [k[place[k & mask] >= 0] for k in bags]  # few words are known: nothing else is laid end to end
    doc = np.repeat(np.arange(len(bags)), [len(k) for k in known])
    key = np.concatenate(known)
    col = place[key & mask]
    _, sent = np.unique(doc * (1 << 40) + (key >> BITS), return_inverse=True)
    n_sent = int(sent.max(initial=-1)) + 1
    sent_doc = np.zeros(n_sent, dtype=np.int64)
    sent_doc[sent] = doc
    theta = np.concatenate([np.where(z > 0, 2.0, -2.0), [-3.0, np.log(base / 2 / (1 - base / 2))]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = len(y)
    for t in range(1, steps + 1):
        w, bias, leak = theta[:-2], theta[-2], theta[-1]
        logit = bias + np.bincount(sent, weights=w[col], minlength=n_sent)
        soft = np.logaddexp(0, logit)
        total = np.logaddexp(0, leak) + np.bincount(sent_doc, weights=soft, minlength=n)
        total = np.maximum(total, 1e-9)
        d_total = (1 - y - y / np.expm1(np.minimum(total, 50))) / n
        p = 1 / (1 + np.exp(-logit))
        d_logit = d_total[sent_doc] * p
        grad = np.concatenate([np.bincount(col, weights=d_logit[sent], minlength=len(words)) + ridge * w / 10, [d_logit.sum() + ridge * (bias + 3) / 10], [d_total.sum() / (1 + np.exp(-leak))]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9) / (1 + 0.01 * t)
    return Model(words, theta[:-2], float(theta[-2]), float(1 / (1 + np.exp(-theta[-1]))))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", flag: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, worst_start, worst_end (bytes of the worst sentence's words), worst_score of every document."""
    sent_ = docs.sparkSession.sparkContext.broadcast(tuple(model))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (flag if flag is not None else F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent_.value)
        for batch in batches:
            s, n, a_, b_, p_ = scores(batch.column(2), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array(n), pa.array(a_, mask=a_ < 0), pa.array(b_, mask=b_ < 0), pa.array(p_)],
                                             names=["doc_id", "held_out", "score", "n_sentences", "worst_start", "worst_end", "worst_score"])

    found = rows.mapInArrow(score, "doc_id long, held_out boolean, score double, n_sentences long, worst_start long, worst_end long, worst_score double")
    return found.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under the threshold, with all their columns; texts are scored in place, nothing is joined or shuffled."""
    sent_ = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent_.value)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(batch.schema.get_field_index(text_col)), model)[0] < threshold))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(keep, docs.schema)


def scores(col: pa.Array, model: Model) -> tuple[np.ndarray, ...]:
    """Per row: score, sentences, start and end of the worst sentence's words (-1: none), its chance."""
    buf, off = T.raw(col)
    table = np.full(1 << BITS, np.nan)
    table[model.words] = model.weights
    outs = []
    for a, b in T.row_groups(off):
        w, feature, sentence = _sentences(buf[off[a] : off[b]], off[a : b + 1])
        n = b - a
        row = np.repeat(np.arange(n), w.count)
        heads = np.flatnonzero(np.diff(sentence, prepend=-1) > 0)
        n_sent = np.bincount(row[heads], minlength=n).astype(np.int64)
        x = table[feature]
        known = np.flatnonzero(~np.isnan(x))
        total = np.full(n, -np.log1p(-min(model.leak, 1 - 1e-9)))
        start, end, worst = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n)
        if len(known):
            # a word counts once in its sentence, as in training
            pair = np.unique(sentence[known] * (1 << BITS) + feature[known])
            sent, at = np.unique(pair >> BITS, return_inverse=True)
            logit = model.bias + np.bincount(at, weights=table[pair & ((1 << BITS) - 1)])
            first = np.searchsorted(sentence, sent, side="left")
            last = np.searchsorted(sentence, sent, side="right") - 1
            doc = row[first]
            np.add.at(total, doc, np.logaddexp(0, logit))
            best = np.lexsort((-sent, logit, doc))
            best = best[np.append(doc[best][1:] != doc[best][:-1], True)]
            start[doc[best]] = w.abs_start[first[best]] - w.off[doc[best]]
            end[doc[best]] = w.abs_end[last[best]] - w.off[doc[best]]
            worst[doc[best]] = 1 / (1 + np.exp(-logit[best]))
        outs.append((-np.expm1(-total), n_sent, start, end, worst))
    if not outs:
        return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*outs, strict=True))
