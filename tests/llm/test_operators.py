import os
import re
import zlib

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import decontamination, license_scan, mixing, ngram_join, pii, token_counts, token_output, toxicity, topk_search
from tidemark.llm.queries import queries, tokenizer

D = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, "The words of one text, here. Under the MIT license.", "a"), (1, "The words of one text, here. Under the MIT license.", "a"), (2, None, "a"), (3, "", None), (None, "no id at all in this row of words", "b"),
       (4, " \n\t", "b"), (5, "long " * 30000 + "+1 (017) 555-7713", "b"), (6, "ß é 数 x@y.de 10.0.0.1", None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "extra", 7) for r in ODD], "doc_id long, text string, source string, row string, n int").withColumnRenamed("n", "size")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{D}/documents.parquet")


@pytest.mark.parametrize("name", [k for k in queries() if k in entry.oracle_sql()])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    got, want = entry.queries()[name](spark, D).toPandas(), c.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_license_base(spark, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = word.findall((t or "").translate(LOW))
        at = [(k, lab) for p, lab in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want[i] = (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in entry.queries()["op1_license_scan"](spark, D).collect()}
    assert got == want


def test_pii_base(docs):
    email, ip, card, phone = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))
    hard = ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "300.1.1.1 1.1.1.1", "+1 (234) 567-8901 10.0.0.1", "4111 1111-1111 1111", "x@y z@w.com.", "+12345678.", "@a.b c@.d"]
    for t in [*hard, *docs.text.fillna("")]:
        want = [("email", m.start(), m.end()) for m in email.finditer(t)] + [("ip", m.start(), m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
        for k, r, lo, hi in (("card", card, 13, 19), ("phone", phone, 9, 15)):
            for m in r.finditer(t):
                d = re.sub("[^0-9]", "", m.group())
                if lo <= len(d) <= hi and (k == "phone" or pii.luhn(d)):
                    want.append((k, m.start(), m.end()))
        assert pii.base_spans(t) == want


def test_pii_field():
    w = pii.fit(pii.training_windows([]))
    kinds = lambda s: [x[0] for x in pii.decode(s, w)]
    assert kinds("call me at (212) 555-0187 now") == ["phone"]
    assert kinds("write to jane.doe (at) example (dot) com please") == ["email"]
    assert kinds("on 2024-05-11 at noon 1234567 times") == []


def test_jaccard_against_brute_force(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words[:k] + ["z%d" % k] + words[k + 1 :]) for k in range(0, 60, 7)]
    texts = [" ".join(words), *near, " ".join(words), "a b", "a b", "A  B", "a b c", "", None, " ".join(words[:40] + words[:20])]
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = min(comp[a], comp[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in range(len(texts))}


def test_tokens_equal_the_library(spark, odd, docs):
    from tokenizers import Tokenizer

    word, byte = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    texts = dict(zip(docs.doc_id, docs.text.fillna(""), strict=True))
    got = {r.doc_id: r.n_tokens for r in entry.queries()["op7_token_counts"](spark, D).collect()}
    assert got == {i: len(word.encode(t, add_special_tokens=False)) for i, t in texts.items()}
    start, want = 0, {}
    for i in sorted(texts):
        ids = [*byte.encode(texts[i], add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in entry.queries()["op8_token_output"](spark, D).collect()} == want
    assert token_counts.token_counts(odd, tokenizer("word_bpe_49k.json")).count() == len(ODD)


def test_odd_rows(spark, odd):
    assert license_scan.license_scan(odd).where("n_base = 1").count() == 2
    assert pii.find(odd, pii.fit(pii.training_windows([]))).where("n_phone = 1 OR n_email = 1").count() == 2
    assert ngram_join.near_duplicates(odd).count() == len(ODD)
    assert ngram_join.without_near_duplicates(odd).count() == len(ODD) - 1
    assert mixing.mix(odd).count() == len(ODD)
    assert set(mixing.mixed_documents(odd).columns) == set(odd.columns)
    model = toxicity.learn(odd, spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, toxic int"))
    assert toxicity.toxicity(odd, model).count() == len(ODD)
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None)], "item_id long, text string")
    assert decontamination.clean(odd, items).count() == len(ODD)
    assert token_output.token_digest(odd, tokenizer("byte_bpe_50k.json")).count() == len(ODD)


def test_reparameterised_question(spark):
    items = spark.createDataFrame([(1, "if Anna has 12 apples and gives 3 apples to Bob how many apples of the 12 are left")], "item_id long, text string")
    texts = ["so if Carl has 40 apples and gives 7 apples to Dora how many apples of the 40 are left then", "so if Carl has 40 apples and gives 7 apples to Dora how many apples of the 41 are left then", "nothing like it"]
    found = decontamination.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items)
    assert [r.doc_id for r in found.collect()] == [0]


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert ngram_join.near_duplicates(none).count() == mixing.mix(none).count() == license_scan.license_scan(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    codes = topk_search.codes(vectors)
    assert topk_search.top_k(codes, codes).count() == 0


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, D).collect()
    assert out and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)
