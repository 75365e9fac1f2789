"""All spans of the license scan against plain loops over every document, template and diagonal."""

import random
import re
from collections import defaultdict

from tidemark.llm import license_scan as L

D = "/root/testdata/sf0.01"
LOW = {c: c + 32 for c in range(65, 91)}
LIBRARY = L.library()
OWN = L.own_runs()


def spans(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    places = defaultdict(list)
    for p in range(len(words) - L.K + 1):
        places[tuple(words[p : p + L.K])].append(p)
    good = []
    for i, runs, label, base, w in LIBRARY:
        on = defaultdict(set)
        for t in range(runs):
            for p in places.get(tuple(w[t : t + L.K]), ()):
                on[p - t].add(t)
        reach = 0.5 if base else max(float(L.DRIFT), (runs + L.K - 1) / 8)
        at = {d: d * 1000 / reach // 1 for d in on}
        found = {d: set().union(*(on[e] for e in on if 0 <= at[e] - at[d] <= 1000)) for d in on}
        order = {d: (len(found[d]), -d) for d in on}
        for d in on:
            if order[d] != max(order[e] for e in on if abs(at[e] - at[d]) <= 1000):
                continue
            share = len(found[d]) / runs
            if share == 1 if base else share >= L.COVER and len(found[d] & set(OWN[i])) >= L.OWN * len(OWN[i]):
                end = max(e + max(on[e]) for e in on if 0 <= at[e] - at[d] <= 1000) + L.K
                good.append((i, label, base, d + min(found[d]), end, len(found[d]), share))
    rivals = [g for g in good if not g[2]]
    beaten = lambda g: any(o[1] != g[1] and o[3] < g[4] and o[4] > g[3] and (o[6], o[5]) > (g[6], g[5]) for o in rivals)
    return sorted((i, label, start, end, votes) for i, label, base, start, end, votes, share in good if base or not beaten((i, label, base, start, end, votes, share)))


def test_spans_equal_plain_loops(spark):
    rng = random.Random(11)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    texts = [t for _, t in L.TEMPLATES]
    made = []
    for k in range(120):  # licenses with words left out and put in, one after the other, doubled, cut off
        some = [x for t in rng.sample(texts, 1 + k % 3) for x in t.split()[rng.choice([0, 0, 3]) :]]
        some = [y for x in some if rng.random() > 0.05 for y in ([x, "foo"] if rng.random() < 0.05 else [x])]
        made.append(" ".join(some * (1 + k % 2)) + " under the MIT License" * (k % 4))
    rows = docs + [(10**6 + k, t) for k, t in enumerate([*made, None, "", "mit"])]
    got = {r.doc_id: sorted((s.template, s.label, s.start, s.end, s.votes) for s in r.spans) for r in L.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: spans(t) for i, t in rows}
    assert sum(map(bool, want.values())) > 100
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
