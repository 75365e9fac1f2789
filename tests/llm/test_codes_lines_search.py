"""Vector codes, line dedup and ranked search against brute force, ranges that cut runs, hot groups, odd rows and empty tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import line_dedup, ranked_search, vector_codes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def lloyd(rows):
    """(vec_id, code, error) rows and the final entries, by whole distance tables."""
    x = np.floor(np.array([v for _, v in rows], float) * 1024).astype(np.int64)
    ids = sorted({i for i, _ in rows})[:256]
    first = x[[min(j for j, (i, _) in enumerate(rows) if i == k) for k in ids]]
    cut = [x.shape[1] * p // 4 for p in range(5)]
    codes, far, books = [], 0, []
    for a, b in zip(cut, cut[1:], strict=False):
        part, book = x[:, a:b], first[:, a:b].copy()
        for r in range(5):
            d = ((part[:, None] - book[None]) ** 2).sum(2)
            near = d.argmin(1)
            if r < 4:
                for e in set(near.tolist()):
                    own = part[near == e]
                    book[e] = own.sum(0) // len(own)
        codes.append(near)
        far = far + d.min(1)
        books.append(book)
    return [(i, "".join(f"{c[j]:02x}" for c in codes), int(far[j])) for j, (i, _) in enumerate(rows)], books


@pytest.mark.parametrize("width", [16, 7, 3])
def test_codes_equal_whole_tables(spark, width, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_BYTES", 4 * width * 200)
    rng = np.random.default_rng(width)
    centre = rng.standard_normal((12, width))
    v = centre[rng.integers(0, 12, 900)] + 0.05 * rng.standard_normal((900, width))
    v[100:400] = v[7]  # a third of all rows are one vector
    v[400:420] = np.round(v[400:420], 1)  # and some are tied
    rows = [(i, x.tolist()) for i, x in enumerate(v.astype(np.float32))]
    want, books = lloyd(rows)
    df = spark.createDataFrame([(i, x, None if i % 5 == 0 else i % 3) for i, x in rows], "vec_id long, embedding array<float>, label int").repartition(5)
    got = vector_codes.digest(df).collect()
    assert {(r.vec_id, r.code, r.error) for r in got} == set(want) and len(got) == 900
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(y) for b in books for y in b.ravel()).encode()).hexdigest()}
    total = Counter()
    for i, _, e in want:
        total[None if i % 5 == 0 else i % 3] += e
    assert all(r.label_error == total[None if r.vec_id % 5 == 0 else r.vec_id % 3] for r in got)


def test_subtrees_go_whole():
    rng = np.random.default_rng(0)
    x = np.concatenate([c + rng.integers(-3, 4, (500, 4)) for c in ([0, 0, 0, 0], [900, 0, 0, 0], [0, 900, 0, 900])])
    tree = vector_codes.Tree.build(x)
    steps = list(tree.assigned(x[[0, 600, 1200]]))
    assert sum(b - a for a, b, e, _ in steps if e >= 0) > 1200 and len(steps) < 30
    for big in (1, 1 << 14):  # doubles, then 64-bit whole numbers
        book = x[rng.integers(0, 1500, 40)] * big
        entry, far = vector_codes.Tree.build(x * big).entries_of(book)
        d = ((x[:, None] * big - book[None]) ** 2).sum(2)
        assert (entry == d.argmin(1)).all() and (far == d.min(1)).all()


def test_codes_of_odd_rows(spark):
    v = [1.0, -0.5, 0.25, 0.0]
    rows = [(1, v, 1), (1, v, 2), (2, None, 1), (3, [], 1), (4, [1.0, None, 0.0, 0.0], 1), (5, [float("nan")] * 4, 1), (6, [float("inf")] * 4, 1), (7, [1.0, 2.0], 1), (None, [0.9, -0.5, 0.2, 0.0], None), (8, [1e9, 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string")
    got = sorted(map(repr, ((r.vec_id, r.code, r.label_error) for r in vector_codes.digest(df).collect())))
    # the entries move to the floor of the mean of the three rows
    a, b = 1024, 921
    mean = (2 * a + b) // 3
    third = (2 * 256 + 204) // 3
    e = lambda x, z: (x - mean) ** 2 + (z - third) ** 2
    assert got == sorted(map(repr, [(1, "00000000", e(a, 256)), (1, "00000000", e(a, 256)), (None, "00000000", e(b, 204))]))
    assert vector_codes.digest(df.limit(0)).count() == vector_codes.digest(df.where("vec_id IS NULL")).count() == 0


def lines_left(rows, least, first=False):
    key = lambda x: x.strip(SPACE).translate(LOW)
    who = lambda i, t: ("id", i) if i is not None else ("text", t)
    held, order = defaultdict(set), {}
    for i, t in rows:
        for p, x in enumerate((t or "").split("\n")):
            held[key(x)].add(who(i, t))
            order.setdefault(key(x), set()).add((i, t, p))
    goes = {k for k, d in held.items() if k and len(d) >= least}
    out = []
    for i, t in rows:
        stay = lambda p, x: key(x) not in goes or first and min(order[key(x)]) == (i, t, p)  # noqa: E731, B023
        own = (t or "").split("\n")
        kept = [x for p, x in enumerate(own) if stay(p, x)]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_lines_equal_brute_force(spark, parts):
    rng = np.random.default_rng(3)
    rows = [(int(i), "\n".join(rng.choice(["  Hot LINE ", "hot line\r", "rare %d" % i, "often %d" % (i % 9), "half %d" % (i % 23), "", "\t"], rng.integers(1, 30)))) for i in range(200)]
    rows += [(5, "hot line\nother\noften 3"), (None, "hot line\nnew"), (None, "hot line\nold"), (None, "hot line\nold"), (900, None), (901, ""), (902, "x\n" * 5000 + "hot line")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, _keep string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        for least in (10, 50, 1000):
            got = line_dedup.without_lines(df, least=least, counts=True)
            assert got.columns == ["doc_id", "text", "_keep", "n_lines", "n_dropped"]
            assert sorted(map(repr, ((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()))) == sorted(map(repr, lines_left(rows, least)))
        numbered = [r for r in rows[:200] if r[0] is not None]
        got = line_dedup.without_lines(spark.createDataFrame(numbered, "doc_id long, text string"), least=2, keep="first", counts=True)
        assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == sorted(lines_left(numbered, 2, True))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bitmaps(spark):
    rows = [(i, f"same\nown {i}\nsame\nend") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.keep_bitmaps(df).collect()
    assert len(got) == 12 and all(line_dedup.kept_bits(r.keep, r.n_lines).tolist() == [False, True, False, False] and r.n_dropped == 3 for r in got)
    assert line_dedup.keep_bitmaps(df.limit(0)).count() == line_dedup.without_lines(df.limit(0)).count() == 0
    assert [r.text for r in line_dedup.without_lines(spark.createDataFrame([(i, "a") for i in range(10)], "doc_id long, text string")).collect()] == [""] * 10


def ranked(docs, items, k=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    own = [(i, Counter(word.findall((t or "").translate(LOW)))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, n_terms, df = len(own), sum(sum(c.values()) for _, c in own), Counter(w for _, c in own for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(word.findall((t or "").translate(LOW)))
    out = []
    for item, words in asked.items():
        got = []
        for i, c in own:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words if c[w])
            if s > 0:
                got.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(got)[:k], 1)]
    return out


@pytest.mark.parametrize("shard", [7, 64, 1 << 16])
def test_search_equals_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD", shard)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)] + ["The", "é", "ß9", "数"]
    p = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=p / p.sum()))
    docs = [(i, text(int(rng.integers(1, 120)))) for i in range(400)] + [(1000 + i, "w3 w7, W7-w9 the hot copy w40") for i in range(200)]
    docs += [(5, "w3 w7 w9"), (None, "w3 w7, W7-w9 the hot copy w40"), (None, text(50)), (2000, None), (2001, "... !"), (2002, "w1 " * 20000 + "w299")]
    items = [(i, text(12)) for i in range(30)] + [(40, "w3 w7 w9 hot"), (41, None), (42, "unseen words"), (43, "w0"), (43, "w299"), (None, "copy é")]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, terms string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(repr, ranked(docs, items)))
    assert sorted(map(repr, map(tuple, ranked_search.top_documents(df, asked).collect()))) == want
    monkeypatch.setattr(ranked_search, "TERMS", 60)  # several blocks of items
    assert sorted(map(repr, map(tuple, ranked_search.top_documents(df, asked).collect()))) == want
    assert ranked_search.top_documents(df.limit(0), asked).count() == ranked_search.top_documents(df, asked.limit(0)).count() == 0


def test_search_stops_early():
    import pyarrow as pa

    n = 5000
    term = np.tile([0, 1], n)
    value = np.empty(2 * n, np.int64)
    value[0::2] = np.where(np.arange(n) % 500 == 0, 10_000 + np.arange(n), 900)  # few high impacts of a rare term
    value[1::2] = np.arange(n) % 7 + 1
    shard = ranked_search._Shard(pa.array(range(n)), np.arange(0, 2 * n + 1, 2), term, value)
    places, scores = shard.search(np.array([0, 1]), 10, np.zeros(0, np.int64))
    assert len(places) == 10 and (scores == value[0::2][places] + value[1::2][places]).all()
    assert (np.sort(value.reshape(-1, 2).sum(1))[-10:] == np.sort(scores)).all()
