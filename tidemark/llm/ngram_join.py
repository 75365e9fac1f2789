"""N-gram Jaccard self-join of documents with token-combination prefixes.

A document is the set of its 5-word shingles. Two documents link when 100 * intersection >= 80 * union. Equal sets are one
node from the start, so copies are never expanded into pairs.

1. Which sets can link at all. In any fixed order of tokens, two sets that link share their first min(k_x, k_y) common tokens
   within their prefixes of length n - ceil(.8 n) + k. In hash order with k = ceil(.1 n), a set has to have ceil(.08 n)
   tokens in its prefix that stand in another row's prefix too. All others are settled by exploding under a third of their
   tokens. A task leaves out copies of what it has met; copies in different tasks only let a set through to step 2.
2. Token-combination prefixes. The rest order their tokens from rare to frequent (over all sets left; the order is global) and
   extend the prefix by one token: two sets that link then share two prefix tokens at least. Tokens of one set are dropped.
3. Stars. Every prefix token proposes three pivots of its own; members are verified against them. That joins groups of
   near copies of any size with a number of pairs in proportion to their rows.
4. Completeness. Tokens whose sets are all in one component need nothing more. Of the others, a rare token (at most
   RARE sets) is indexed alone, a frequent one in combinations of two (alone where the larger set has LONG tokens or more, whose
   combinations would be too many). An entry's place in the order bounds the common tokens from there on, and so the sizes that
   a partner can have. Entries meet by size class: a set is found under its own class if its bound leaves room for a partner of its
   size or more, and looks for smaller ones in the classes that its bound leaves room for. Texts that share a long passage and little else
   leave no room, and meet nobody. Pairs of different components are verified. Nothing is capped: every
   link between different texts is found, or lies inside a component that is already joined.
5. Components by alternating large and small stars, each step a join, written to the shared folder.

Verification compares exact sets of 64-bit shingle hashes; a node is named by the 64-bit hash of its set.

Edge cases: null, empty or white-space texts have the empty set, n_shingles 0, and are linked with nothing (component: own id).
Fewer than five words are one shingle. Rows that repeat come out as often as they come in. A null doc_id takes part in links;
its component is the smallest non-null id, null if there is none. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import broadcast_if_small, cut, unused

SHINGLE = 5
#: similarity in hundredths
PERCENT = 80
#: tokens that the first prefix has besides, in hundredths of the set
EXTRA = 10
#: of a token's hash in the first step, which only has to let through what can link
BITS = 48
#: sets up to which a token is indexed alone
RARE = 16
#: tokens from which a set's frequent tokens are not combined
LONG = 1000
#: ratio of the bounds of a size class
CLASS = 1.05
#: parts in which the nodes of a component get their id
SALTS = 32
#: copies of one set beyond which its rows don't meet their component under one key
HOT = 1000
#: such sets that are broadcast at most (24 bytes each); with more of them Spark splits what is skewed
HOT_NODES = 500_000


def shingle_sets(col: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    buf, off = T.raw(col)
    for a, b in T.row_groups(off):
        w = T.Words(buf[off[a] : off[b]], off[a : b + 1], T.SOLID)
        g = T.grams(w.hash, SHINGLE)
        for i in range(b - a):
            n = int(w.count[i])
            if n >= SHINGLE:
                yield np.unique(g[w.first[i] : w.first[i + 1] - SHINGLE + 1])
            else:
                yield T.grams(w.row(i), n) if n else np.zeros(0, T.U64)


def _ceil(n: np.ndarray | int, percent: int):
    return (n * percent + 99) // 100


def _node(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) for p in parts])
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, row, n, node."""
    for batch in batches:
        sets = [(len(s), _node(s) if len(s) else None) for s in shingle_sets(batch.column(2))]
        n, node = zip(*sets, strict=True) if sets else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64())], names=["doc_id", "row", "n", "node"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and the prefix in hash order, in BITS bits a token, of each set that this task meets for the first time."""
    seen: set[int] = set()
    for batch in batches:
        nodes, prefix = [], []
        for s in shingle_sets(batch.column(0)):
            if (k := len(s)) and (x := _node(s)) not in seen:
                seen.add(x)
                nodes.append(x)
                prefix.append(s[: k - _ceil(k, PERCENT) + _ceil(k, EXTRA)] >> T.U64(64 - BITS))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _lists(prefix)], names=["node", "prefix"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s for s in shingle_sets(batch.column(0)) if len(s)]
        yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), _lists(sets)], names=["node", "tokens"])


def components(edges: DataFrame) -> DataFrame:
    """node, comp (its smallest node) of every node of the edges (a, b)."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.union(e.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())


def verified(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    common = F.size(F.array_intersect("ta", "tb"))
    found = pairs.join(tokens.toDF("a", "ta"), "a").join(tokens.toDF("b", "tb"), "b").withColumn("both", common)
    return found.where(F.col("both") * 100 >= PERCENT * (F.size("ta") + F.size("tb") - F.col("both"))).select("a", "b")


def _apart(x: DataFrame, key: str) -> DataFrame:
    """Rows of x under keys that still meet different components; rows: node, comp, the key and more."""
    open_ = x.groupBy(key).agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("many")).where("c0 <> c1").select(key, "many")
    return x.join(open_, key)


def candidates(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components under one signature whose sizes and places leave room for a link; entries: node, n, comp, at, sig, long."""
    # a link meets under its first two common tokens (or one of them): one common token at most comes before the entry's last
    room = F.floor((1 + F.col("n") - F.col("at")) * (100 + PERCENT) / PERCENT) - F.col("n")
    class_ = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(CLASS)))
    x = entries.withColumn("room", room)
    home = x.where("room >= n").withColumn("class", class_(F.col("n")))
    low, high = F.floor((F.col("n") * PERCENT + 99) / 100), F.least("n", "room")
    seeks = x.where((high >= low) & (~F.col("long") | (F.col("n") >= LONG))).withColumn("class", F.explode(F.sequence(class_(low), class_(high))))
    a, b = seeks.alias("x"), home.alias("y")
    fits = (F.col("y.n") >= F.floor((F.col("x.n") * PERCENT + 99) / 100)) & (F.col("y.n") <= F.col("x.room")) & (F.col("x.n") <= F.col("y.room"))
    once = (F.col("y.n") < F.col("x.n")) | (F.col("y.n") == F.col("x.n")) & (F.col("x.node") < F.col("y.node"))
    met = a.join(b, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.comp") != F.col("y.comp")) & fits & once)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def link_nodes(base: DataFrame, rows: DataFrame) -> DataFrame:
    """node, comp of all nodes that link; base: node, n, row; rows: doc_id, text."""
    each = rows.select("text").mapInArrow(_prefixes, "node long, prefix array<long>").select("node", F.explode("prefix").alias("token"))
    shared = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("token")
    hits = each.join(shared, "token").groupBy("node").agg(F.count(F.lit(1)).alias("hits"))
    own = base.where("node IS NOT NULL").groupBy("node", "row").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("times"))
    own = own.groupBy("node").agg(F.max("n").alias("n"), F.min(F.struct("row", "times")).alias("r")).join(hits, "node")
    active = cut(own.where(F.col("hits") * 1000 >= F.col("n") * (EXTRA * PERCENT // 10)).select("node", "r.*"))
    many = active.count()

    def taken(chosen: DataFrame) -> DataFrame:
        ids = broadcast_if_small(chosen.select(F.col("row").alias("_row")), many)
        texts = rows.join(ids, F.xxhash64("doc_id", "text") == F.col("_row"), "left_semi").select("text")
        return texts.mapInArrow(_tokens, "node long, tokens array<long>")

    tokens, often = taken(active.where("times = 1")), active.where("times > 1")
    if not often.isEmpty():  # rows that repeat to the letter
        tokens = tokens.union(taken(often).groupBy("node").agg(F.any_value("tokens").alias("tokens")))
    tokens = cut(tokens)

    each = tokens.select("node", F.explode("tokens").alias("token"))
    df = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = each.join(df, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order"))  # one document's own tokens
    mine = mine.join(tokens.select("node", F.size("tokens").alias("n")), "node")
    need = F.floor((F.col("n") * PERCENT + 99) / 100)
    mine = mine.withColumn("lone", F.col("n") - F.size("order")).where(F.size("order") >= need)
    prefix = mine.select("node", "n", "lone", F.posexplode(F.slice("order", 1, (F.col("n") - need + 2 - F.col("lone")).cast("int"))).alias("p", "o"))
    prefix = prefix.select("node", "n", "lone", (F.col("lone") + F.col("p")).alias("at"), "o.token")
    prefix = cut(prefix)

    # the least changed set of a group of near copies has the fewest tokens of its own, and links with the most others
    ranks = [F.struct("lone", F.xxhash64("node").alias("h"), "node", "n"), F.struct("lone", (-F.xxhash64("node")).alias("h"), "node", "n"), F.struct(F.lit(0).alias("lone"), F.xxhash64("node").alias("h"), "node", "n")]
    pivots = prefix.groupBy("token").agg(*[F.min(r).alias(f"p{i}") for i, r in enumerate(ranks)], F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    fits = lambda n, m: F.least(n, m) * 100 >= PERCENT * F.greatest(n, m)
    stars = prefix.join(pivots, "token").select("node", "n", F.array_distinct(F.array("p0", "p1", "p2")).alias("p"))
    stars = stars.select("node", F.explode(F.filter("p", lambda p: (p["node"] != F.col("node")) & fits(p["n"], F.col("n")))).alias("p"))
    stars = stars.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
    first = cut(verified(stars, tokens))
    comp = components(first)

    x = prefix.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    x = cut(_apart(x.drop("lone"), "token"))
    alone = x.where(F.col("many") <= RARE).select("node", "n", "comp", "at", F.col("token").alias("sig"))
    often = x.where(F.col("many") > RARE)
    long_ = often.where(F.col("n") * 100 >= LONG * PERCENT).select("node", "n", "comp", "at", F.xxhash64(F.lit("long"), "token").alias("sig"), F.lit(True).alias("long"))
    group = often.where(F.col("n") < LONG).groupBy("node", "n", "comp").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("t"))
    two = F.flatten(F.transform("t", lambda v, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda w: F.struct(w["at"].alias("at"), F.xxhash64(v["token"], w["token"]).alias("sig")))))
    pairs_of = _apart(group.select("node", "n", "comp", F.explode(two).alias("s")).select("node", "n", "comp", "s.at", "s.sig"), "sig").drop("many")
    entries = alone.unionByName(pairs_of).withColumn("long", F.lit(False)).unionByName(long_)
    rest = candidates(entries)
    more = cut(verified(rest, tokens))
    if more.isEmpty():
        return comp
    return components(more.union(comp.where("node <> comp").select("node", "comp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, row (hash of id and text) and comp (the component's node; null without words) of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(_signed, "doc_id long, row long, n long, node long")
    base = cut(base)
    linked = cut(link_nodes(base, rows))
    small = base.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    joined = cut(small.drop("copies").join(linked, "node"))
    # a component's smallest id meets its nodes in SALTS parts, so that a giant one is not one task's work; the others are their own
    lows = joined.groupBy("comp").agg(F.min("low").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = joined.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(lows, ["comp", "salt"]).select("node", "component_id", F.col("comp").alias("joint"))
    ids = small.join(named, "node", "left").select("node", F.when(F.col("joint").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("joint", "node").alias("comp"), "copies")
    # at most one node in HOT rows is hot: these are sent to all tasks where they are few, and left to the join of all where not
    hot = cut(ids.where(F.col("copies") > HOT).drop("copies"))
    many = hot.count()
    rest = base.where("node IS NOT NULL")
    columns = ["doc_id", "n", "component_id", "row", "comp"]
    if 0 < many <= HOT_NODES:
        apart = rest.join(F.broadcast(hot), "node").select(*columns)
        rest = rest.join(F.broadcast(hot.select("node")), "node", "left_anti")
        out = rest.join(ids.where(F.col("copies") <= HOT), "node").select(*columns).union(apart)
    else:
        out = rest.join(ids, "node").select(*columns)
    empty = base.where("node IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"), "row", F.lit(None).cast("long").alias("comp"))
    return out.union(empty).withColumnRenamed("n", "n_shingles")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: that with the smallest id (then the smallest hash of its row). Documents without words all stay."""
    found = cut(near_duplicates(docs, id_col, text_col))
    times = found.where("comp IS NOT NULL").groupBy("comp", "row").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("times"))
    stay = times.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "times")).alias("s")).select("s.row", "s.times")
    # rows without words stay however often they come
    stay = cut(stay.union(found.where("comp IS NULL").select("row", F.lit(1).cast("long")).distinct()))
    many = stay.count()
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    (row,) = unused(docs, "_row")
    out = docs.withColumn(row, key)
    once = out.join(broadcast_if_small(stay.where("times = 1").select(F.col("row").alias(row)), many), row, "left_semi")
    often = out.join(broadcast_if_small(stay.where("times > 1").select(F.col("row").alias(row)), many), row, "left_semi").dropDuplicates([row])
    return once.unionByName(often).select(*docs.columns)
