"""Planted rows through the pipeline's stages, huge texts against the library, clashing columns, rows without an id."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import license_scan, line_dedup, mixing, pii, token_counts, token_output, topk_search, toxicity
from tidemark.llm.queries import tokenizer

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The driver's documents with rows planted among them: (folder, ids that have to go by stage, ids that have to stay)."""
    folder = tmp_path_factory.mktemp("planted")
    docs, labels, items = (pd.read_parquet(f"{D}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = toxicity.learn(*(spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels")))
    scored = toxicity.toxicity(spark.read.parquet(f"{D}/documents.parquet"), model).toPandas().set_index("doc_id").score
    clean = [i for i in docs.doc_id if scored[i] < 0.2]
    text = docs.set_index("doc_id").text
    long_ = [i for i in clean if len((text[i] or "").split()) > 100][:4]
    bad = scored[scored >= 0.9].index[0]
    words = text[long_[1]].split()
    rows = {900_000: text[bad] + " It was a quiet day after that.", 900_001: text[long_[0]], 900_002: " ".join([*words[:40], "changed", *words[41:]]), 900_003: f"Well then. {items.text[0]} So it goes on.",
            900_004: "a plain text of its own about seven grey geese that crossed the frozen river before dawn"}
    more = pd.DataFrame([{"doc_id": i, "text": t, "lang": "en", "source": docs.source[0], "n_chars": len(t)} for i, t in rows.items()] + [{"doc_id": 900_005, "text": None, "lang": None, "source": None, "n_chars": None}])
    all_ = pd.concat([docs, more], ignore_index=True)
    all_["n_chars"] = all_.n_chars.astype("Int64")
    all_.to_parquet(folder / "documents.parquet")
    labels.to_parquet(folder / "labels.parquet")
    items.to_parquet(folder / "benchmark.parquet")
    return str(folder), {"toxicity": {900_000, int(bad)}, "near_duplicates": {900_001, 900_002}, "decontamination": {900_003}}, {900_004, 900_005}


def test_planted_rows_through_the_stages(spark, planted):
    folder, gone, stay = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r[0] for r in docs.select("doc_id").collect()}
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns
        ids = {r[0] for r in kept.select("doc_id").collect()}
        assert gone[name] <= before and not gone[name] & ids and stay <= ids, name
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, folder)
    assert mixed.columns == docs.columns and {r[0] for r in mixed.select("doc_id").distinct().collect()} <= ids
    out = corpus_pipeline.STAGES[4][1](spark, mixed, folder)
    assert out.count() == mixed.count()


def test_pipeline_end_to_end(spark, planted):
    folder, gone, _ = planted
    out = corpus_pipeline.run(spark, folder).collect()
    assert not {r.doc_id for r in out} & set().union(*gone.values())
    assert sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)


def test_huge_texts_equal_the_library(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(8)
    parts = ["word ", "Ünïcode ", "数字数字", "<|endoftext|>", "    ", "\n\n", "don't ", "x" * 40, "1234567.89 ", "é ", "[UNK] ", "\t"]
    texts = ["".join(rng.choice(parts, 12_000)), "no-space" * 5000, "".join(rng.choice(parts[:2], 30_000)), " " * 50_000, ""]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, part int")
    word, byte = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df, tokenizer("word_bpe_49k.json")).collect()}
    assert got == {i: (len(t.encode()), len(word.encode(t, add_special_tokens=False))) for i, t in enumerate(texts)}
    ids = {i: [*byte.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_output.token_digest(df, tokenizer("byte_bpe_50k.json")).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()}
    assert token_counts.token_counts(df.limit(0), tokenizer("word_bpe_49k.json")).count() == token_output.token_digest(df.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0


def test_clashing_columns(spark):
    rows = [(i, [1.0, -1.0, float(i - 1)], 7, "x", "y", 1.5) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, code string, n string, v double")
    codes = topk_search.codes(df)
    assert codes.columns == ["id", "code"] and topk_search.top_k(codes.where("id = 0"), codes).count() == 4
    docs = spark.createDataFrame([(i, "same line\nown %d" % i, "a", "b", "c", "d") for i in range(12)], "doc_id long, text string, _id string, _hash string, n_lines string, line string")
    got = line_dedup.without_lines(docs, counts=True)
    assert got.columns == [*docs.columns, "_n_lines", "n_dropped"] and {r.text for r in got.collect()} == {f"own {i}" for i in range(12)}
    assert mixing.mix(docs.withColumn("source", F.lit("s"))).count() == 12


def test_personal_data_of_rows_without_an_id(spark):
    hand = ["Mail me at jo.bloggs+x@mail.example.org, or ring +44 20 7946 0958.", "Our server 10.1.2.3 was down; card 4111 1111 1111 1111 was charged.", "On 3 May 2021 version 1.2.3 shipped to 12345 users."]
    df = spark.createDataFrame([(None, hand[0], 1), (None, hand[1], 2), (5, hand[2], 3), (None, None, 4)], "doc_id long, text string, spans int")
    got = pii.find(df, pii.fit(pii.training_windows([]))).collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == [("5", 0, 0, 0, 0), ("None", 0, 0, 0, 0), ("None", 0, 1, 1, 0), ("None", 1, 0, 0, 1)]
    assert [r.spans for r in got if r.doc_id == 5] == [""]
    assert license_scan.license_scan(df).where("doc_id IS NULL").count() == 3
