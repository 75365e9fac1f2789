"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of a bounded, seeded sample of its texts. A text is cut into
pieces of PIECE bytes and every piece is compressed with every dictionary; the language whose dictionary leaves the fewest
bytes over all pieces wins. Pieces are short, so that what a long text teaches about itself does not drown the dictionary.
The margin of the second language over the first gives the score, and a margin under REJECT marks the answer as rejected
(column `rejected`; the prediction stays).

The sample is the only thing fitted: the SAMPLE_ROWS texts of each language with the smallest hashes. Each gives an equal share
of DICT_BYTES (of ALL_BYTES / languages where there are very many), as SLICES evenly spaced slices of the whole text. Only
these slices come to the driver, and are sent to the tasks; scoring is one pass without a shuffle, and every text is read whole.

Edge cases: a null text, or one without a letter, is `und` with score 0. Ties go to the language that sorts first. With nothing
to learn from, every prediction is `und`. Rows that repeat come out as often as they come in; null ids are kept. An empty
table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import broadcast_if_small, cut

SAMPLE_ROWS = 512
DICT_BYTES = 112 << 10
#: of all dictionaries together
ALL_BYTES = 64 << 20
SLICES = 4
#: groups of partitions in which the sample is narrowed, ending with one
SALTS = (512, 8, 1)
PIECE = 1024
LEVEL = 6
REJECT = 0.02
#: margin at which the score is 1 - 1/e
SCALE = 0.05

_LETTER = regex.compile(r"\p{L}")


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(train: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> dict[str, bytes]:
    """Raw-content dictionaries by language, from a bounded sample of the rows given. Rows of one id and text count once."""
    text = F.col(text_col).cast("string")
    rows = train.where(F.col(lang_col).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("long"), F.lit(7)).alias("h"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row"))
    rows = rows.groupBy("lang", "h", "row").agg(F.count(F.lit(1)).alias("times"))
    # the first of each group of partitions, then the first of those: a language's rows never meet in one task
    rows = rows.withColumn("salt", F.spark_partition_id())
    for groups in SALTS:
        first = Window.partitionBy("lang", "salt").orderBy("h", "row")
        rows = rows.withColumn("salt", F.col("salt") % groups).withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_ROWS)
    rows = cut(rows.select("lang", "row", "n"))
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("many"))
    n = langs.count()
    budget = max(1, min(DICT_BYTES, ALL_BYTES // max(n, 1)))
    least = min(64 * SLICES, budget)
    rows = rows.where(F.col("n") <= budget // least).join(langs, "lang")  # so many languages that a text's least share is too much: fewer texts
    rows = rows.withColumn("share", F.greatest(F.lit(least), F.floor(F.lit(budget) / F.col("many")))).select(F.col("lang").alias("_lang"), F.col("row").alias("_row"), "share")
    found = train.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row"), text.alias("text"))
    found = found.join(broadcast_if_small(rows, n * SAMPLE_ROWS), (F.col("lang") == F.col("_lang")) & (F.col("row") == F.col("_row")))
    step, size = F.length("text") / SLICES, F.ceil(F.col("share") / SLICES)
    slices = F.concat(*[F.substring("text", F.floor(step * i).cast("int") + 1, F.least(size, F.ceil(step)).cast("int")) for i in range(SLICES)])
    sample = found.select("lang", "row", F.when(F.length("text") <= F.col("share"), F.col("text")).otherwise(slices).alias("text")).dropDuplicates(["lang", "row"])
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for r in sample.collect():
        texts.setdefault(r["lang"], []).append((r["row"], r["text"].encode()))
    return {lang: b"\n".join(t for _, t in sorted(all_))[-budget:] for lang, all_ in sorted(texts.items())}


def language_id(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", flag: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected of every document."""
    langs = sorted(dictionaries)
    sent = docs.sparkSession.sparkContext.broadcast([dictionaries[x] for x in langs])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coders = [zstandard.ZstdCompressor(level=LEVEL, dict_data=_ready(zstandard, d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in sent.value]
        for batch in batches:
            preds, scores, margins = [], [], []
            for text in batch.column(2).to_pylist():
                pred, score, margin = "und", 0.0, 0.0
                if coders and text and _LETTER.search(text):
                    data = memoryview(text.encode())
                    pieces = [data[a : a + PIECE] for a in range(0, len(data), PIECE)]
                    sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in coders], dtype=np.float64)
                    order = np.argsort(sizes, kind="stable")
                    pred = langs[order[0]]
                    margin = float(sizes[order[1]] / sizes[order[0]] - 1) if len(langs) > 1 else 1.0
                    score = float(1 - np.exp(-margin / SCALE))
                preds.append(pred)
                scores.append(score)
                margins.append(margin)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score", "margin"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (flag if flag is not None else F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(classify, "doc_id long, held_out boolean, lang_pred string, score double, margin double")
    return found.withColumn("rejected", (F.col("lang_pred") != "und") & (F.col("margin") < REJECT))


def _ready(zstandard, data: bytes):
    d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return d
