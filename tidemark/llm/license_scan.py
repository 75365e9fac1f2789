"""License scan by diagonal voting.

Every rolling run of K words of every text is hashed; Spark joins the hashes to the positions of the same runs in the
license templates. A match of text position p with template position t votes for the diagonal p - t. Votes are gathered
by diagonal, and neighbouring diagonals of a template are merged: words inserted or left out shift a license text by as many
diagonals, so a span takes those from one diagonal to DRIFT more (to an eighth of the template's words, where that is more) and no
further. A span is verified: each vote already had its words compared, a phrase needs all its runs on one diagonal, and
a longer template needs COVER of its runs, each counted once however often the text repeats it, and OWN of those runs that no
template of another label has: these are what tells the licenses of one family apart. Of spans of a template that overlap in
diagonals the one that covers most stays, then the first; of spans of different labels that overlap in words the one with
the larger share of its template, then with more runs. Phrases always stay.

Only runs whose hash is in the template library leave the scan. The library is a constant of this module (a few hundred
runs, whatever the size of the corpus), so it is broadcast. Votes are summed with partial aggregates before they are
shuffled by row, and nothing is gathered beyond one document's own votes.

Edge cases: a null or empty text has no words: counts 0, first and last null, labels "", score 0. Rows that repeat a
doc_id and its text give equal rows, one each; rows that share a doc_id and differ in text are scanned apart. A null
doc_id is kept. Other columns of the input are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as T

K = 3
#: diagonals that a span reaches over, at least
DRIFT = 6
#: share of a template's runs that a span needs, and of its runs that no other label has
COVER = 0.6
OWN = 0.4

# The phrases of the contract and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Words of public licenses (whole texts, then their best-known sentences and the notices that stand for them).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
            "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
            "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
            "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
            "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
            "arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
            "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
            "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
            "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
            "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
            "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
            "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software "
            "even if advised of the possibility of such damage"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
            "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
            "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
            "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
             "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
             "1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
             "2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
             "3 this notice may not be removed or altered from any source distribution"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "released under the mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
                 "see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license version 3"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def library() -> list[tuple[int, int, str, bool, list[str]]]:
    """(template, runs, label, is a phrase, words) of all phrases and templates."""
    all_ = [(label, phrase, True) for phrase, label in PHRASES.items()] + [(label, text, False) for label, text in TEMPLATES]
    return [(i, len(w) - K + 1, label, base, w) for i, (label, text, base) in enumerate(all_) for w in [_WORD.findall(text)]]


def _hashes(words: list[str]) -> np.ndarray:
    text = " ".join(words).encode()
    w = T.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), T.ALNUM)
    return T.grams(w.hash, K)


def own_runs() -> dict[int, list[int]]:
    """Of each template, the positions of the runs that no template of another label has."""
    runs = {i: [tuple(w[t : t + K]) for t in range(n)] for i, n, _, _, w in library()}
    label = {i: x for i, _, x, _, _ in library()}
    holders: dict[tuple, set[str]] = {}
    for i, all_ in runs.items():
        for r in all_:
            holders.setdefault(r, set()).add(label[i])
    return {i: [t for t, r in enumerate(all_) if len(holders[r]) == 1] for i, all_ in runs.items()}


def template_runs(spark: SparkSession) -> DataFrame:
    rows = [(int(h.view(np.int64)), i, t, " ".join(words[t : t + K])) for i, _, _, _, words in library() for t, h in enumerate(_hashes(words))]
    return spark.createDataFrame(rows, "run long, template int, tpos int, run_words string")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document (pos null) with its number of words and text digest, then one per run that the library holds."""
    known = np.unique(np.concatenate([_hashes(w) for *_, w in library()]))
    for batch in batches:
        ids, (buf, off) = batch.column(0), T.raw(batch.column(1))
        for a, b in T.row_groups(off):
            part = buf[off[a] : off[b]]
            w = T.Words(part, off[a : b + 1], T.ALNUM)
            digest = np.zeros(b - a, dtype=np.int64)
            for i in range(b - a):
                digest[i] = np.frombuffer(_digest(part[w.off[i] : w.off[i + 1]]), np.int64)[0]
            g = T.grams(w.hash, K)
            at = np.searchsorted(known, g)
            at[at == len(known)] = 0
            hit = np.flatnonzero(known[at] == g)
            row = np.searchsorted(w.first, hit, side="right") - 1
            hit, row = hit[hit + K <= w.first[row + 1]], row[hit + K <= w.first[row + 1]]
            text = [b" ".join(bytes(T._LOWER[part[w.abs_start[j] : w.abs_end[j]]]) for j in range(p, p + K)).decode("utf-8", "replace") for p in hit]
            n = b - a
            doc_ids = ids.slice(a, n)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([doc_ids, doc_ids.take(pa.array(row))]),
                pa.array(np.concatenate([digest, digest[row]])),
                pa.array(np.concatenate([w.count, w.count[row]]).astype(np.int64)),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array((hit - w.first[row]).astype(np.int64))]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(g[hit].view(np.int64))]),
                pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(text, pa.string())]),
            ], names=["doc_id", "digest", "n_words", "pos", "run", "run_words"])


def _digest(data: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_64_digest(data.tobytes())


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with their spans: doc_id, digest, n_words, copies (equal rows), spans array<struct<template, label, base, start, end (words, end exclusive), votes, coverage>>."""
    spark = docs.sparkSession
    runs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _scan, "doc_id long, digest long, n_words long, pos long, run long, run_words string")
    own = own_runs()
    info = spark.createDataFrame([(i, n, label, base, own[i]) for i, n, label, base, _ in library()], "template int, runs int, label string, base boolean, own array<int>")
    votes = runs.join(F.broadcast(template_runs(spark)), ["run", "run_words"], "left")
    key = ["doc_id", "digest"]
    diagonals = votes.groupBy(*key, "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(F.col("pos").isNull(), 1)).alias("rows"),
        F.collect_set("tpos").alias("runs_here"),  # at most the runs of a template
    )
    # diagonals in thousandths of what a span reaches over; those of a phrase lie too far apart to meet
    reach = F.when(F.col("base"), F.lit(0.5)).otherwise(F.greatest(F.lit(float(DRIFT)), (F.col("runs") + K - 1) / 8))
    diagonals = diagonals.join(F.broadcast(info), "template", "left").withColumn("at", F.floor(F.col("diagonal") * 1000 / reach))
    line = Window.partitionBy(*key, "template").orderBy("at")
    ahead, around = line.rangeBetween(0, 1000), line.rangeBetween(-1000, 1000)
    spans = diagonals.withColumn("found", F.array_distinct(F.flatten(F.collect_list("runs_here").over(ahead)))).withColumn("votes", F.size("found"))
    spans = spans.withColumn("end", F.max(F.col("diagonal") + F.array_max("runs_here")).over(ahead) + K).withColumn("coverage", F.col("votes") / F.col("runs"))
    order = F.struct("coverage", -F.col("diagonal"))
    spans = spans.withColumn("first", F.max(order).over(around) == order)
    known = F.size(F.array_intersect("found", "own")) >= OWN * F.size("own")
    good = F.col("first") & F.when(F.col("base"), F.col("votes") == F.col("runs")).otherwise((F.col("coverage") >= COVER) & known)
    spans = spans.withColumn("good", good).withColumn("start", F.col("diagonal") + F.array_min("found"))
    # spans that can overlap start near each other: what is gathered is bounded by the templates
    reach = int(1.125 * max(n + K for _, n, *_ in library())) + DRIFT
    near = F.collect_list(F.when(F.col("good") & ~F.col("base"), F.struct("label", "start", "end", "coverage", "votes"))).over(Window.partitionBy(*key).orderBy("start").rangeBetween(-reach, reach))
    better = lambda o: (o["label"] != F.col("label")) & (o["start"] < F.col("end")) & (o["end"] > F.col("start")) & (F.struct(o["coverage"], o["votes"]) > F.struct("coverage", "votes"))
    spans = spans.withColumn("near", near).withColumn("stays", F.col("good") & (F.col("base") | ~F.exists("near", better)))
    return spans.groupBy(*key).agg(
        F.max("n_words").alias("n_words"),
        F.max("rows").alias("copies"),
        F.max(F.col("coverage")).alias("best"),
        F.collect_list(F.when(F.col("stays"), F.struct("template", "label", "base", "start", "end", "votes", "coverage"))).alias("spans"),
    )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the spans."""
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    out = license_spans(docs, id_col, text_col).select(
        "doc_id", "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["start"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.when(F.size("spans") > 0, F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0))).otherwise(F.coalesce("best", F.lit(0.0)) * 0.5).alias("score"),
        "spans",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return out.drop("copy")
