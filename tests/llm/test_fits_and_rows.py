"""Held-out figures, whole rows against brute force, targets, hot groups and odd rows of the corpus operators."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import _spark, decontamination, language_id, license_scan, mixing, ngram_join, pii, token_counts, token_output, topk_search, toxicity
from tidemark.llm.queries import op2_pii, op5_language_id, op6_toxicity, tokenizer

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, _row string, _key string, _leak int")


def test_language_held_out(spark, docs):
    rows = op5_language_id(spark, D).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").toPandas()
    assert len(rows) > 100 and (rows.lang == rows.lang_pred).mean() >= 0.95
    assert rows.score.between(0, 1).all()


def test_language_equals_one_text_at_a_time(spark, docs):
    """Every prediction and margin, by compressing each piece of each text with a coder made for it alone."""
    import unicodedata

    import zstandard

    train = docs.where(~language_id.held_out())
    model = language_id.learn(train)
    assert sorted(model) == sorted({r.lang for r in train.where("lang IS NOT NULL AND length(text) > 0").select("lang").distinct().collect()})
    got = {r.doc_id: (r.lang_pred, round(r.margin, 9)) for r in language_id.language_id(docs, model).collect()}

    def size(text, known):
        d = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coder = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        d.precompute_compress(level=language_id.LEVEL)
        data = text.encode()
        return sum(len(coder.compress(data[a : a + language_id.PIECE])) for a in range(0, len(data), language_id.PIECE))

    rows, n = docs.select("doc_id", "text").orderBy("doc_id").toPandas(), 0
    for i, text in zip(rows.doc_id, rows.text):
        if not text or not any(unicodedata.category(c)[0] == "L" for c in text):
            assert got[i] == ("und", 0.0)
            continue
        sizes = sorted((size(text, known), lang) for lang, known in model.items())
        assert got[i] == (sizes[0][1], round(sizes[1][0] / sizes[0][0] - 1, 9)), i
        n += 1
    assert n > 100


def test_language_odd_rows(spark, docs):
    model = language_id.learn(docs)
    odd = [(1, "½ ²"), (2, None), (3, ""), (4, "123 . !"), (5, "é"), (5, "é"), (None, "la maison " * 40000)]
    got = language_id.language_id(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 3, 4)] == ["und"] * 4
    assert len(got) == len(odd) and all(r.lang_pred != "und" for r in got if r.doc_id in (5, None))
    assert {r.lang_pred for r in language_id.language_id(docs.limit(3), {}).collect()} == {"und"}


def test_language_learns_from_whole_texts(spark):
    rows = [(i, "x", ("tail" if k else "head ") * 5000) for i in range(2) for k in range(2)]
    found = language_id.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"))["x"]
    assert b"tail" in found and b"head" in found and len(found) <= language_id.DICT_BYTES
    rows = [(1, "x", "a" * 100_000 + "b" * 100_000)]
    assert {*language_id.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"))["x"]} == {*b"ab"}


def test_toxicity_held_out(spark, docs):
    d = "/root/testdata/sf0.1"  # a hundred held-out rows of the rarer label need the larger table
    rows = op6_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    pos, neg = rows.score[rows.toxic == 1].to_numpy(), rows.score[rows.toxic == 0].to_numpy()
    auc = (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2
    assert auc >= 0.93 and (pos >= 0.7).mean() >= 0.75 and (neg >= 0.7).mean() <= 0.01


def test_worst_sentence(spark):
    words = [f"w{i}" for i in range(40)]
    rng = random.Random(1)
    rows = []
    for i in range(200):
        s = [" ".join(rng.sample(words, 6)) for _ in range(4)]
        if i % 2:
            s[rng.randrange(4)] += " vile grub"
        rows.append((i, ". ".join(s), i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    for r in toxicity.toxicity(docs, model).collect():
        assert r.predicted == r.doc_id % 2
        if r.predicted:
            assert "vile grub" in rows[r.doc_id][1][r.worst_start : r.worst_end]


def test_repeated_rows_weigh_once_in_the_fit(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows = [(i, f"plain words {i} " + ("awful thing" if i % 2 else "fine thing")) for i in range(40)]
    a = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    b = toxicity.learn(spark.createDataFrame(rows + [rows[1]] * 500, "doc_id long, text string"), labels)
    assert np.array_equal(a.words, b.words) and np.allclose(a.weights, b.weights)


def test_pii_rows_against_brute_force(spark, docs):
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    kinds = ("email", "ip", "card", "phone")
    for r in op2_pii(spark, D).collect():
        base = pii.base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, *_ in base) for k in kinds)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_pii_added_spans():
    """Recall and precision of what the field adds, on entities written as the base patterns miss them."""
    weights = pii.fit(pii.training_windows([]))
    rng = random.Random(99)
    hit = found = 0
    for i in range(300):
        kind = ("email", "phone")[i % 2]
        s = pii._rewritten(kind, pii._made_up(kind, rng), rng) if kind == "email" else rng.choice(["({}) {}-{}", "{}-{}-{}"]).format(rng.randint(200, 989), rng.randint(200, 989), rng.randint(1000, 9999))
        text = f"please reach us: {s} before noon"
        got = [x[:3] for x in pii.decode(text, weights)]
        hit += (kind, 17, 17 + len(s)) in got
        found += len(got)
    nothing = sum(len(pii.decode(f"the order of 20{rng.randint(10, 25)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)} cost {rng.randint(10, 99)}.{rng.randint(10, 99)} in all", weights)) for _ in range(200))
    assert hit >= 270 and found <= hit * 1.1 and nothing <= 4


def test_long_text_with_many_spans():
    text = "a@b.cd 10.0.0.1 " * 20000
    assert len(pii.decode(text, {}, [(a, b) for _, a, b in pii.base_spans(text)])) == 0


def _components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


@pytest.mark.parametrize(("rare", "hot", "hot_nodes"), [(1, 1, 10), (4, 1, 0), (16, 1000, 10)])
def test_jaccard_with_combinations(spark, monkeypatch, rare, hot, hot_nodes):
    """Tokens over RARE are indexed in pairs: one shared passage, a giant component, chains of near copies, texts on both sides of 0.8, and hot copies."""
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "HOT_NODES", hot_nodes)
    rng = random.Random(rare)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=12))
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(30, 90))
        for _ in range(6):
            v = list(base)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = rng.choice(words)
            texts.append(" ".join(v) + (" " + passage if rng.random() < 0.7 else ""))
    big = rng.choices(words, k=120)
    texts += [" ".join([*big[:i], f"z{i}", *big[i + 1 :]]) for i in range(40)] + [texts[0]] * 5
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _components(texts)


@pytest.mark.parametrize(("docs_a_shard", "blocks"), [(1, 64), (4, 64), (50, 300), (4096, 16384)])
def test_mix_meets_its_targets(spark, docs, monkeypatch, docs_a_shard, blocks):
    monkeypatch.setattr(mixing, "SHARD_DOCS", docs_a_shard)
    monkeypatch.setattr(mixing, "BLOCKS", blocks)
    rows = mixing.mix(docs).toPandas()
    assert (rows.taken <= 2 * rows["size"]).all() and (rows.taken >= 0).all()
    each = rows.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    block = max(1, each["size"].sum() * 1.5 // blocks)
    assert (abs(each.taken - each.target) <= block + 0.02 * each.target).all()
    assert abs(each.target.sum() - 1.5 * each["size"].sum()) < 1


def test_mixed_documents_hold_the_words_taken(spark, docs, monkeypatch):
    odd = docs.limit(200).withColumn("_key", F.lit("mine")).withColumn("_place", F.lit(5)).withColumn("row", F.lit("r"))
    odd = odd.union(odd.limit(9)).union(odd.limit(9)).unionByName(odd.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.checkpoint()
    want = mixing.mix(odd).groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0").toPandas().set_index("doc_id").n.to_dict()
    words = F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    first = mixing.mixed_documents(odd)
    assert first.columns == odd.columns
    got = first.groupBy("doc_id").agg(F.sum(words).alias("n")).toPandas().set_index("doc_id").n.to_dict()
    key = lambda d: {(-1 if pd.isna(k) else int(k)): v for k, v in d.items()}
    assert key(got) == key(want)
    monkeypatch.setattr(mixing, "broadcast_if_small", lambda df, rows, limit=0: df)
    assert sorted(map(repr, mixing.mixed_documents(odd).collect())) == sorted(map(repr, first.collect()))


def test_license_labels(spark):
    none = ["under the mit q w e " * 12, "creative commons attribution q w " * 10, "released under the q w " * 3, None, ""]
    rng = random.Random(3)
    edited = []
    for label, t in license_scan.TEMPLATES:
        if len(t.split()) < 20:
            continue
        for _ in range(5):
            v = [x for x in t.split() if rng.random() > 0.03]
            edited.append((label, "words before it " + " ".join(y for x in v for y in ([x, "foo"] if rng.random() < 0.03 else [x])) + " and after"))
    got = {r.doc_id: r.labels.split(",") for r in license_scan.license_scan(spark.createDataFrame(list(enumerate([*none, *(t for _, t in edited)])), "doc_id long, text string")).collect()}
    assert all(got[i] == [""] for i in range(len(none)))
    assert np.mean([label in got[i + len(none)] for i, (label, _) in enumerate(edited)]) >= 0.9


NOTICES = {
    "mit": "Released under the MIT License.", "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, so far.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-nd": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-nd": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "apache-2": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def test_license_families(spark):
    """A notice has its own label and no other, alone and among words; so has every template; two licenses in one text both count."""
    texts = [*NOTICES.items(), *[(k, f"some words first {v} and some words after it") for k, v in NOTICES.items()], *license_scan.TEMPLATES, *[(x, p) for p, x in license_scan.PHRASES.items()]]
    texts += [("cc-by,gpl", f"{NOTICES['gpl']} and for the pictures of it {NOTICES['cc-by']}"), ("gpl", "licensed under the GNU General Public License version 2"), ("lgpl", "licensed under the GNU Lesser General Public License version 3")]
    got = {r.doc_id: r.labels for r in license_scan.license_scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()}
    assert {i: got[i] for i in got} == {i: x for i, (x, _) in enumerate(texts)}


def test_license_rows_of_one_id(spark):
    rows = [(1, NOTICES["mit"]), (1, NOTICES["mit"]), (1, NOTICES["gpl"]), (None, NOTICES["mpl-2"]), (None, None)]
    got = license_scan.license_scan(spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, labels int")).collect()
    assert sorted((str(r.doc_id), r.labels) for r in got) == [("1", "gpl"), ("1", "mit"), ("1", "mit"), ("None", ""), ("None", "mpl-2")]


def _linked(texts):
    """Components by brute force over 5-word shingles."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in texts]
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize(("long_", "rare"), [(1000, 16), (60, 1), (1000, 1)])
def test_near_duplicates_under_hot_signatures(spark, monkeypatch, long_, rare):
    """Texts of different lengths that share much of one passage; some link, most don't."""
    monkeypatch.setattr(ngram_join, "LONG", long_)
    monkeypatch.setattr(ngram_join, "RARE", rare)
    rng = random.Random(long_ + rare)
    passage = [f"p{i}" for i in range(90)]
    pool = [[f"q{k}-{i}" for i in range(12)] for k in range(6)]
    texts = []
    for _ in range(160):
        a, b = rng.choice([0, 3, 10, 25]), rng.choice([90, 88, 80, 60])
        tail = [y for k in rng.sample(range(6), rng.choice([0, 1, 2])) for y in pool[k]] + [f"own{rng.random()}" for _ in range(rng.choice([0, 2, 9]))]
        texts.append(" ".join(passage[a:b] + tail))
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == _linked(texts)


def test_texts_that_share_a_passage_meet_nobody(spark):
    """A signature in all texts makes no pairs where places and sizes leave no room for a link."""
    rows = [(i, 104, i, 19, 7, False) for i in range(3000)] + [(5000, 85, 5000, 2, 7, False), (5001, 100, 5001, 2, 7, False), (5002, 99, 5002, 3, 7, False)]
    got = ngram_join.candidates(spark.createDataFrame(rows, "node long, n long, comp long, at long, sig long, long boolean"))
    assert {tuple(r) for r in got.collect()} == {(5001, 5002), (5000, 5001), (5000, 5002)} | {(i, 5000) for i in range(3000)}


def test_search_with_ties_nulls_and_few_rows(spark):
    rng = np.random.default_rng(5)
    x = np.sign(rng.standard_normal((300, 96)))
    x[100:160] = x[7]  # one vector that many rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (400, [float("nan")] * 96), (401, None), (402, []), (403, x[1][:95].tolist())]
    codes = topk_search.codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    all_ = [(r.id, r.code & (2**64 - 1)) for r in codes.collect()]
    assert sorted(i for i, _ in all_) == list(range(300))
    queries = [0, 7, 130, 299]
    want = {(q, k, i, n) for q in queries for k, (n, i) in enumerate(sorted(((c ^ dict(all_)[q]).bit_count(), i) for i, c in all_)[:10], 1)}
    assert {tuple(r) for r in topk_search.top_k(codes.where(F.col("id").isin(queries)), codes).collect()} == want
    few = codes.where("id < 3")
    assert topk_search.top_k(few, few).count() == 9


def test_empty_tables(spark, nothing):
    model = toxicity.fit(np.zeros(0), [])
    for out in (toxicity.toxicity(nothing, model), toxicity.clean(nothing, model), language_id.language_id(nothing, language_id.learn(nothing)), pii.find(nothing, pii.fit([])),
                token_counts.token_counts(nothing, tokenizer("word_bpe_49k.json")), token_output.token_digest(nothing, tokenizer("byte_bpe_50k.json")), ngram_join.without_near_duplicates(nothing),
                mixing.mixed_documents(nothing), decontamination.clean(nothing, spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string"))):
        assert out.count() == 0
    assert decontamination.clean(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 1


def test_token_places_of_odd_rows(spark):
    rows = [(5, "b"), (None, "first"), (5, "a"), (3, None), (3, None), (9, ""), (9, "x" * 50_000)]
    got = token_output.token_digest(spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, start string, n_tokens int"), tokenizer("byte_bpe_50k.json")).collect()
    assert len(got) == len(rows)
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert [i for i in ids if i is not None] == sorted(i for i in ids if i is not None)


def test_stages_one_by_one(spark, nothing):
    """Clean documents stay with all their columns, whatever these are called; what a stage is for goes."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    item = " ".join(rng.choices(words, k=20))
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t), f"r{i}", "k", i) for i, t in enumerate(texts)]
    near = " ".join([*texts[4].split()[:-1], "zz"])
    more = [(100, texts[3], "en", "s0", 1, "copy", "k", 0), (101, near, "en", "s0", 1, "near", "k", 0), (None, "", None, None, None, None, None, None), (102, None, None, None, None, None, None, None)]
    leak = (103, f"so {item} it is", "en", "s1", 1, "leak", "k", 0)
    docs = spark.createDataFrame([*rows, *more, leak], nothing.schema)
    kept = ngram_join.without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r._row or "" for r in kept.collect()) == sorted([*(r[5] for r in rows), "leak", "", ""])
    clean = decontamination.clean(kept, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert clean.columns == docs.columns and clean.count() == kept.count() - 1 and clean.where("_row = 'leak'").isEmpty()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]


def test_made_names_meet_no_column(spark):
    assert _spark.unused(spark.range(1).selectExpr("id AS _row", "id AS __row"), "_row", "x") == ["___row", "x"]
