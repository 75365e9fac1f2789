"""The pipeline's rows, stage by stage, against plain Python: noisy-or over sentences, all pairs of shingle sets, the SQL of leaks and of the mix, the tokenizers library."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tidemark.llm import _text, decontamination, mixing, toxicity
from tidemark.llm.queries import tokenizer

D = "/root/testdata/sf0.01"
LOW = {c: c + 32 for c in range(65, 91)}
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and what it returned, as pandas."""
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), {}
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, D).write.parquet(path)
        kept = spark.read.parquet(path)
        out[name] = (docs.toPandas(), kept.toPandas())
        docs = kept
    return out


def feature(word: str) -> int:
    raw = word.encode()
    return int(_text.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), _text.ALNUM).hash[0]) >> (64 - toxicity.BITS)


def chance(text: str | None, model: toxicity.Model) -> float:
    weights = dict(zip(map(int, model.words), model.weights))
    clean = 1 - model.leak
    for sentence in re.split(r"[.!?\n]", (text or "").translate(LOW)):
        known = {feature(w) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", sentence)} & set(weights)
        if known:
            clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(weights[f] for f in known))))
    return 1 - clean


def test_toxicity_stage(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.learn(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet").where(~toxicity.held_out()))
    scored = {i: chance(t, model) for i, t in zip(before.doc_id, before.text)}
    assert sorted(after.doc_id) == sorted(i for i, s in scored.items() if s < toxicity.THRESHOLD)
    assert len(after) < len(before)


def test_near_duplicates_stage(stages):
    before, after = stages["near_duplicates"]
    sets = {}
    for i, t in zip(before.doc_id, before.text):
        w = re.findall(WORD, (t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    by_size = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    for at, a in enumerate(by_size):
        for b in by_size[at + 1 :]:
            if 80 * len(sets[b]) > 100 * len(sets[a]):
                break
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert sorted(after.doc_id) == sorted(i for i in sets if top(i) == i)
    assert len(after) < len(before)


def test_decontamination_stage(stages):
    documents, after = stages["decontamination"]
    benchmark = pd.read_parquet(f"{D}/benchmark.parquet")
    with duckdb.connect() as c:
        c.register("documents", documents)
        c.register("benchmark", benchmark)
        leaks = set(c.execute(decontamination.ORACLE_SQL).df().doc_id)
    assert leaks and sorted(after.doc_id) == sorted(set(documents.doc_id) - leaks)


def test_mixing_stage(stages):
    documents, after = stages["mixing"]
    with duckdb.connect() as c:
        c.register("documents", documents)
        taken = c.execute(mixing.ORACLE_SQL).df().set_index("doc_id").taken
    words = Counter()
    text = dict(zip(documents.doc_id, documents.text))
    for i, t in zip(after.doc_id, after.text):
        words[i] += len(re.findall(WORD, t))
        given = " ".join(re.findall(WORD, text[i]))
        assert " ".join(re.findall(WORD, t)) in given or all(" ".join(re.findall(WORD, run)) in given for run in t.split("\n"))
    assert words == Counter({i: int(n) for i, n in taken.items() if n})
    assert after.doc_id.value_counts().max() <= mixing.MOST and (after.n_chars == after.text.str.len()).all()


def test_token_stage(stages):
    from tokenizers import Tokenizer

    before, after = stages["token_output"]
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = Counter()
    for i, t in zip(before.doc_id, before.text):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert want == Counter(zip(after.doc_id, after.n_tokens, after.ids_crc32))
    placed = after.sort_values("start")
    assert placed.doc_id.is_monotonic_increasing and (placed.start == placed.n_tokens.cumsum() - placed.n_tokens).all()


def test_run_is_its_stages(spark, stages):
    key = ["doc_id", "start", "n_tokens", "ids_crc32"]
    got, want = corpus_pipeline.run(spark, D).toPandas(), stages["token_output"][1]
    assert sorted(zip(got.doc_id, got.n_tokens, got.ids_crc32)) == sorted(zip(want.doc_id, want.n_tokens, want.ids_crc32)) and sorted(got.columns) == sorted(key)
