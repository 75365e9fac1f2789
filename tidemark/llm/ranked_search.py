"""Ranked lexical search, score at a time over impact-ordered postings.

A document's score for an item is the sum of the impacts of the item's terms in it, an impact being a term's whole-number weight
times its saturated frequency (see `impact`). Everything is whole numbers but the logarithm of a weight.

1. The items' terms are gathered; documents are read once and leave a narrow row each: number of terms, and number and
   frequency of those terms that some item has. Counts of all documents (N, L, df) are sums over these rows.
2. Each task cuts its rows into shards of at most SHARD documents. A shard's index lists, for each term, its postings in groups of
   exactly equal impact, highest first. For an item the groups of all its terms are taken in descending order of impact and added
   to accumulators. The next impacts of its terms, added up, bound what a document can still gain. When that bound is
   under the kth score reached so far (by this task's earlier shards too), no further document can enter; only documents
   whose accumulator with that bound reaches the kth score are candidates, and their scores are completed from the
   shard's rows by document.
3. A task keeps k documents an item; the k best of those of all tasks are the answer, which is exact.

Items are taken in blocks of about TERMS terms (one pass over the documents a block), so what a task holds is bounded whatever the number of items.

Edge cases: a null or empty text has no term: as a document it isn't counted or found, as an item it has no rows. Rows of one
item_id (or without one) are one item with the terms of them all. Each row of documents is a document, also where it repeats an
id or has none; equal scores go by ascending id, rows without one last. A term that all documents hold can have weight 0, and
a score of 0 is not found. An empty table on either side gives an empty one. Further columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut

K = 10
SHARD = 1 << 16
#: terms of items in a block, about, and postings in a shard
TERMS = 200_000
POSTINGS = 1 << 22
#: items whose best documents leave a task together
OUT = 1000
#: a step takes all groups down to this part of the highest next impact
STEP = 0.8
#: A-Z to a-z; what is neither a digit, a letter nor beyond ASCII to a space
_FOLD = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text (UTF-8), in order: no byte beyond ASCII is a separator, so whole characters stay together."""
    return text.translate(_FOLD).split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(item, t) for item, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True) for t in sorted(set(terms(text)))]
        item, term = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(term, pa.binary())], names=["item_id", "term"])


def _rows(vocabulary: dict[bytes, int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, number of terms, and number and frequency of those in the vocabulary, of documents that have a term."""
        known = vocabulary.keys()
        for batch in batches:
            n, at, number, times, keep = [], [0], [], [], []
            for i, text in enumerate(_texts(batch.column(1))):
                words = terms(text)
                if not words:
                    continue
                found = Counter(words)
                own = sorted((vocabulary[w], found[w]) for w in known & found.keys())
                keep.append(i)
                n.append(len(words))
                number += [x for x, _ in own]
                times += [x for _, x in own]
                at.append(len(number))
            off = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(off, pa.array(number, pa.int32())), pa.ListArray.from_arrays(off, pa.array(times, pa.int64()))],
                names=["doc_id", "n", "terms", "times"])

    return rows


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of weight w that stands tf times in a document of n terms adds to its score."""
    wide = n.astype(object) if len(n) and int(n.max()) * 90 * n_docs >= 1 << 63 else n
    m = (100 - 90 + 90 * wide * n_docs // n_terms).astype(np.int64)
    return w * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class _Shard:
    """Impact-ordered index of some documents."""

    def __init__(self, ids: pa.Array, off: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.no_id, self.id = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        self.off, self.term, self.value, self.size = off, term, value, len(ids)
        doc = np.repeat(np.arange(self.size), np.diff(off))
        order = np.lexsort((doc, -value, term))
        order = order[value[order] > 0]
        t, v, self.doc = term[order], value[order], doc[order]
        head = np.ones(len(t), bool)
        head[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
        self.start = np.append(np.flatnonzero(head), len(t))  # postings of group g: start[g] to start[g + 1]
        self.impact = v[head]
        self.of_term = t[head]

    def groups(self, term: int) -> tuple[int, int]:
        return int(np.searchsorted(self.of_term, term)), int(np.searchsorted(self.of_term, term, side="right"))

    def search(self, item: np.ndarray, k: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of all documents here that can be among the k best, given the scores of k found elsewhere (or fewer)."""
        lists = [(a, b) for a, b in map(self.groups, item) if a < b]
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        got = np.zeros(self.size, np.int64)
        at, end = [a for a, _ in lists], [b for _, b in lists]
        down = [-self.impact[a:b] for a, b in lists]
        kth = 0
        while True:
            next_ = [int(self.impact[p]) if p < e else 0 for p, e in zip(at, end, strict=True)]
            rest = sum(next_)
            reached = np.concatenate([best, got[got > 0]])
            kth = int(np.partition(reached, -k)[-k]) if len(reached) >= k else 0
            if not rest or rest < kth:
                break
            least = max(1, int(max(next_) * STEP))
            for i, (a, _) in enumerate(lists):
                if next_[i] >= least:
                    to = a + int(np.searchsorted(down[i], -least, side="right"))
                    p, q = self.start[at[i]], self.start[to]
                    got[self.doc[p:q]] += np.repeat(self.impact[at[i] : to], np.diff(self.start[at[i] : to + 1]))
                    at[i] = to
        places = np.flatnonzero((got > 0) & (got + rest >= kth))
        return places, self.complete(places, item) if rest else got[places]

    def complete(self, places: np.ndarray, item: np.ndarray) -> np.ndarray:
        n = self.off[places + 1] - self.off[places]
        row = np.repeat(np.arange(len(places)), n)
        which = np.arange(len(row)) + np.repeat(self.off[places] - (np.cumsum(n) - n), n)
        own = np.isin(self.term[which], item)
        scores = np.zeros(len(places), np.int64)
        np.add.at(scores, row[own], self.value[which[own]])
        return scores


def _search(items: list[tuple[int | None, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none, none.astype(bool))] * len(items)  # scores, ids and whether there is none, best first

        def searched(held: list[pa.RecordBatch]) -> None:
            ids, n, term, tf = (pa.concat_arrays([b.column(i) for b in held]) for i in range(4))
            off = term.offsets.to_numpy().astype(np.int64)
            term, tf, off = term.values.to_numpy()[off[0] : off[-1]], tf.values.to_numpy()[off[0] : off[-1]], off - off[0]
            shard = _Shard(ids, off, term, impact(weights[term], tf, np.repeat(n.to_numpy(), np.diff(off)), n_docs, n_terms))
            for i, (_, item) in enumerate(items):
                score, id_, no_id = best[i]
                places, scores = shard.search(item, k, score)
                score, id_, no_id = np.concatenate([score, scores]), np.concatenate([id_, shard.id[places]]), np.concatenate([no_id, shard.no_id[places]])
                top = np.lexsort((id_, no_id, -score))[:k]
                best[i] = score[top], id_[top], no_id[top]

        held, docs, postings = [], 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, SHARD):
                part = batch.slice(a, SHARD)
                held.append(part)
                docs, postings = docs + part.num_rows, postings + len(part.column(2).flatten())
                if docs >= SHARD or postings >= POSTINGS:
                    searched(held)
                    held, docs, postings = [], 0, 0
        if held:
            searched(held)
        for a in range(0, len(items), OUT):
            score, id_, no_id = (np.concatenate(x) for x in zip(*best[a : a + OUT], strict=True))
            item = [i for (i, _), (s, *_) in zip(items[a : a + OUT], best[a : a + OUT], strict=True) for _ in s]
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(id_, pa.int64(), mask=no_id), pa.array(score)], names=["item_id", "doc_id", "score"])

    return search


def _block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """The k best of each task for the items of (item_id, term) rows."""
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
    of_item: dict[int | None, list[int]] = {}
    for r in rows:
        of_item.setdefault(r["item_id"], []).append(vocabulary[bytes(r["term"])])
    items = [(i, np.array(sorted(t))) for i, t in of_item.items()]
    kept = cut(docs.mapInArrow(_rows(vocabulary), "doc_id long, n long, terms array<int>, times array<long>"))
    total = kept.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    df = {r["t"]: r["count"] for r in kept.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # a row for each term of the block at most
    weights = np.array([weight(total["docs"], df[t]) if t in df else 0 for t in range(len(vocabulary))], np.int64)
    return kept.mapInArrow(_search(items, weights, total["docs"], total["terms"] or 1, k), "item_id long, doc_id long, score long")


def top_documents(docs: DataFrame, items: DataFrame, k: int = K, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of the highest scores above 0 of each item."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = cut(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_item_terms, "item_id long, term binary").distinct())
    blocks = -(-asked.count() // TERMS)
    found = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # about TERMS rows
        if rows:
            found.append(_block(texts, rows, k))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = functools.reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_SQL_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, unnest({_SQL_TERMS}) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY ALL),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY ALL)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= {K}
"""
