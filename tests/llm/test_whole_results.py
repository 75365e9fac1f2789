"""Rows that the corpus operators used to lose, or to keep wrongly."""

import numpy as np

from tidemark.llm import decontamination, ngram_join, topk_search

ITEM = "the river runs past the old stone mill and turns twice before it meets the quiet lake"


def test_copy_in_capitals_is_a_leak(spark):
    items = spark.createDataFrame([(1, ITEM), (2, "in 1 2 3 4 5 6 7 8 9 10 11 12 apples")], "item_id long, text string")
    texts = [f"so then {ITEM.upper()} and on", f"so then {ITEM} and on", "he wrote 1 2 3 4 5 6 7 8 9 10 11 12 on it", "The River runs", "he wrote 2 3 4 5 6 7 8 9 10 11 12 13 on it in capitals"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.item_id, r.words_matched, r.first_word, r.n_slots) for r in decontamination.leaks(docs, items).collect()}
    assert got == {0: (1, 17, 2, 0), 1: (1, 17, 2, 0), 2: (2, 12, 2, 0), 4: (2, 11, 2, 0)}
    assert [r.doc_id for r in decontamination.clean(docs, items).collect()] == [3]


def test_short_items_and_few_literals(spark):
    """Items of few words, and templates of few words that are no placeholders."""
    items = spark.createDataFrame([(1, "what is 17 x 23"), (2, "yes indeed"), (3, "12 13 14 15 16"), (4, "Paris"), (5, "...")], "item_id long, text string")
    texts = ["so what is 99 x 41 then", "what is 5 x 5", "what is x", "Yes, indeed!", "yes indeed it is", "1 2 3 4 5", "see 12 13 14 15 16 there", "paris", "in Paris", "", "... !"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.words_matched) for r in decontamination.leaks(docs, items).collect()}
    assert got == {(0, 1, 5), (3, 2, 2), (6, 3, 5), (7, 4, 1)}  # in 1 one number stands for two


def test_different_texts_without_an_id_stay(spark):
    same = "one two three four five six seven eight nine ten"
    texts = [(None, "alpha beta gamma delta epsilon zeta"), (None, "red green blue black white grey"), (None, "north east south west up down"), (7, same), (None, same), (None, same), (None, None), (None, None), (8, ""), (8, "")]
    kept = ngram_join.without_near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [*texts[:4], *texts[6:]]))


def test_leaks_and_items_without_an_id(spark):
    other = "a tall ship left the narrow harbour at dawn and came back with salt and silver"
    items = spark.createDataFrame([(None, ITEM), (None, other), (3, "none of the words of this item stand in any text here")], "item_id long, text string")
    rows = [(None, f"so {ITEM}"), (None, "a clean text"), (-1, "a clean text too"), (5, f"well {other}"), (5, "nothing in it"), (None, None), (-1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.words_matched) for r in decontamination.leaks(docs, items).collect()}
    assert got == {(None, None, 17), (5, None, 16)}
    assert sorted(map(repr, map(tuple, decontamination.clean(docs, items).collect()))) == sorted(map(repr, [*rows[1:3], *rows[4:]]))


def test_long_vectors_and_repeated_ids(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 128))
    x[1] = x[0] + 0.01 * rng.standard_normal(128)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2, (-x[2]).tolist()), (3, x[3].tolist()), (90, x[5][:100].tolist()), (91, None)]
    codes = topk_search.codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    all_ = [(r.id, r.code & (2**64 - 1)) for r in codes.collect()]
    assert sorted(i for i, _ in all_) == sorted([*range(40), 2])
    want = set()
    for q in range(4):
        near = sorted(((c ^ d).bit_count(), i) for p, c in all_ if p == q for i, d in all_)[:10]
        want |= {(q, k, i, n) for k, (n, i) in enumerate(near, 1)}
    got = {tuple(r) for r in topk_search.top_k(codes.where("id < 4"), codes).collect()}
    assert got == want
    assert (0, 2, 1) in {r[:3] for r in got}


def test_shorter_vectors_have_no_code(spark):
    rows = [(i, [1.0, -1.0, 1.0, float(i)]) for i in range(3)] + [(3, [1.0, -1.0]), (4, [float("nan")] * 4)]
    codes = topk_search.codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {r.id: r.code for r in codes.collect()} == {0: 10, 1: 11, 2: 11}
