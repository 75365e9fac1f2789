"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A question whose numbers or names were changed is still the question. Texts and benchmark items become the same kind of
template: words in lower case, but one placeholder for a number, one for a unit of measurement right after a number, and one for a
name (a capitalised word that does not begin a sentence). All windows of WINDOW template words of all documents are hashed
and joined to those of the items. Matches of one item on one diagonal (document position less item position) are one
passage; it counts when it covers PASSAGE words or COVER of the item. Then its slots are checked: over the passage, each value
in the item must stand for one value in the document and the other way round, so `3 ... 3` against `5 ... 7` is no copy.

A copy word for word is one whatever its letter case and its slots. So the windows of plain words in lower case, without
placeholders, are hashed and joined as well. A passage of them counts by the words they cover; it has no
slots, and is given where no passage of templates of that item holds.

Items of fewer words than WINDOW are matched by windows of their own length; items of fewer than MIN_WORDS words by documents that
are no longer than they are, since two or three words inside a text are no sign of a leak. A window of templates needs a word that is
no placeholder, and a passage of templates MIN_LITERAL of them, or all that the item has: runs of numbers do not match each other, and
"what is 99 x 41" is a copy of "what is 17 x 23".

Scale: the first pass turns each document into an array of window hashes inside its row, and only hashes are exploded, next to
an id. Item windows are broadcast only when there are at most BROADCAST of them, else both sides are shuffled by hash.
Matches are few; only documents with matches are read again to compare slots.

Edge cases: null or empty texts and items match nothing. An item without words is ignored. Rows that repeat
give one row. Several passages of one item in one document give the longest (then the first). A null doc_id or item_id is kept;
documents and items are told apart by the hash of id and text, so clean() removes the rows that leak and no others of their id.
An empty table on either side gives no rows (clean: all documents). Other columns are ignored (leaks) or kept (clean), whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import broadcast_if_small, cut, unused

WINDOW = 8
MIN_LITERAL = 4
MIN_WORDS = 4
PASSAGE = 10
COVER = 0.6
BROADCAST = 500_000

# Units of measurement that follow a number.
UNITS = ["mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards", "mi", "mile", "miles", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "lb", "lbs", "pound", "pounds", "oz", "ounce", "ounces", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "gal", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "cent", "cents", "euro", "euros", "usd", "eur", "mph", "kmh", "c", "f", "k", "meter", "meters", "metre", "metres", "kilometer", "kilometers"]

_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: what a number doesn't follow inside a word: the mark of a sentence is no part of it
_IN = r"^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\ue003"
# private characters, one a word: a number, a unit, a name; before a word that begins a sentence; for the point inside a number
NUMBER, UNIT, NAME, _MARK, _POINT = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
_SLOTS = [NUMBER, UNIT, NAME]


def marked(text: Column) -> Column:
    """The text with _MARK before each word that begins a sentence; a number with its points is one word, and ends before a letter."""
    # every pattern begins with a plain class, so that most characters fail at the first test
    t = F.regexp_replace(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), "[.,:](?<=[0-9].)(?=[0-9])", _POINT)
    t = F.regexp_replace(t, "([0-9])(?=[A-Za-z])", "$1 ")
    return F.regexp_replace(t, r"[.!?:;\n|][\s\x22\x27(]*", f" {_MARK}")


def words_of(t: Column) -> Column:
    """The words of a marked text, with their marks; a mark alone is no word."""
    t = F.regexp_replace(t, f"{_MARK}(?!{_WORD})", " ")
    return F.split(F.trim(F.regexp_replace(t, _SPLIT, " ")), " ")


def canonical(t: Column) -> Column:
    """The words of a marked text with each number, unit and name as one private character, after one empty word; as many as words_of gives."""
    t = F.regexp_replace(t, f"[0-9](?<![{_IN}][0-9]){_WORD}*", NUMBER)
    t = F.regexp_replace(t, f"({NUMBER}{_SPLIT})(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?!{_WORD})", f"$1{UNIT}")
    t = F.regexp_replace(t, f"[A-Z\u00c0-\u00de](?<!{_WORD}[A-Z\u00c0-\u00de]){_WORD}*", NAME)
    return F.split(F.lower(t), f"{_SPLIT[:-2]}{_MARK}]+")


def plain(t: Column) -> Column:
    """The words of a marked text in lower case, after one empty word; as many as words_of gives."""
    return F.split(F.lower(t), f"{_SPLIT[:-2]}{_MARK}]+")


def _held(rows: DataFrame, *, keep: list[str], **made: Column) -> DataFrame:
    """rows with the columns made, each computed once: a generator over one array keeps later expressions from repeating them for every element."""
    return rows.select(*keep, F.explode(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))).alias("_w")).select(*keep, "_w.*")


def _steps(h: str, step: int) -> Column:
    """Hashes of the pairs of elements of h that stand `step` apart."""
    n = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, 1 + step, n), lambda a, b: F.xxhash64(a, b))


def _fours(rows: DataFrame, keep: list[str], words: list[str]) -> DataFrame:
    """rows with the hashes of all runs of four words of these columns, by position from 0 (the empty word in front is skipped)."""
    rows = _held(rows, keep=keep, **{c: F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda w: F.xxhash64(w)) for c in words})
    rows = _held(rows, keep=keep, **{c: _steps(c, 1) for c in words})
    return _held(rows, keep=keep, **{c: _steps(c, 2) for c in words})


def _windows(fours: str, n: int) -> Column:
    """Hashes of all windows of n words (MIN_WORDS to WINDOW, which two runs of four cover), by position from 0."""
    return _steps(fours, n - 4)


def _literals(words: Column, at: Column, n: Column) -> Column:
    return F.size(F.filter(F.slice(words, at + 2, n), lambda w: ~w.isin(_SLOTS)))


def _short(canon: str, low: str) -> Column:
    """(plain, hash of all words together) of a text of fewer than MIN_WORDS words, as templates and as plain words."""
    whole = lambda c: F.xxhash64(F.array_join(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), " "))
    return F.array(*[F.struct(F.lit(k).alias("plain"), whole(c).alias("window")) for k, c in ((False, canon), (True, low))])


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (hash of id and text), item_id, words (marked), canon, n_words, len, plain, windows (positions and hashes; of templates with enough literal words) of the items."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull()).dropDuplicates()
    rows = rows.withColumn("item", F.xxhash64("item_id", "text"))
    t = marked(F.col("text"))
    rows = rows.select("item", "item_id", F.explode(F.array(F.struct(words_of(t).alias("words"), canonical(t).alias("canon"), plain(t).alias("low")))).alias("w")).select("item", "item_id", "w.*")
    rows = rows.withColumn("n_words", F.size(F.filter("words", lambda w: w != ""))).where("n_words > 0").withColumn("len", F.least(F.col("n_words"), F.lit(WINDOW)))
    # the last mark of a text leaves an empty word
    short = rows.where(F.col("n_words") < MIN_WORDS).withColumns({c: F.slice(c, 1, F.col("n_words") + 1) for c in ("canon", "low")})
    short = short.select("item", "item_id", "words", "canon", "n_words", "len", F.explode(_short("canon", "low")).alias("w"))
    short = short.select("item", "item_id", "words", "canon", "n_words", "len", "w.plain", F.lit(0).alias("at"), "w.window")
    rows = rows.where(F.col("n_words") >= MIN_WORDS)

    def hashes(fours: str) -> Column:
        found = F.when(F.col("len") == MIN_WORDS, _windows(fours, MIN_WORDS))
        for n in range(MIN_WORDS + 1, WINDOW + 1):
            found = found.when(F.col("len") == n, _windows(fours, n))
        return found

    rows = _fours(rows.withColumn("canon4", F.col("canon")), ["item", "item_id", "words", "canon", "n_words", "len"], ["canon4", "low"])
    both = F.array(*[F.struct(F.lit(k).alias("plain"), hashes(fours).alias("hashes")) for k, fours in ((False, "canon4"), (True, "low"))])
    rows = rows.select("item", "item_id", "words", "canon", "n_words", "len", F.explode(both).alias("w"))
    rows = rows.select("item", "item_id", "words", "canon", "n_words", "len", "w.plain", F.posexplode("w.hashes").alias("at", "window"))
    rows = rows.where(F.col("at") + F.col("len") <= F.col("n_words"))  # a text's last mark leaves an empty word
    return rows.unionByName(short).where(F.col("plain") | (_literals(F.col("canon"), F.col("at"), F.col("len")) > 0))


def _leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """row (hash of doc_id and text) and the columns of leaks()."""
    items_ = cut(item_windows(items, item_col, item_text_col))
    n = items_.count()
    lengths = [r[0] for r in items_.where(F.col("len") >= MIN_WORDS).select("len").distinct().collect()]  # at most WINDOW values
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    texts = _held(rows, keep=["row"], t=marked(F.col("text")))
    arrays = _held(texts, keep=["row"], canon=canonical(F.col("t")), low=plain(F.col("t")))
    texts = _fours(arrays, ["row"], ["canon", "low"])
    none = F.array().cast("array<bigint>")
    entry = lambda n, a, b: F.struct(F.lit(n).alias("len"), a.alias("canon"), b.alias("low"))
    per_length = F.array(*[entry(n, _windows("canon", n), _windows("low", n)) for n in lengths] or [entry(0, none, none)])
    each = texts.select("row", F.explode(per_length).alias("w")).select("row", "w.*").select("row", "len", F.posexplode(F.arrays_zip("canon", "low")).alias("pos", "w")).select("row", "len", "pos", "w.*")
    if n <= BROADCAST:  # a look at one number drops what no item holds, before rows are made of templates and plain words
        known = F.broadcast(items_.select("window").distinct())
        for side in ("canon", "low"):
            each = each.join(known.select(F.col("window").alias(side), F.lit(True).alias("in_" + side)), side, "left")
        each = each.where("in_canon OR in_low")
    each = each.select("row", "len", "pos", F.explode(F.array(*[F.struct(F.lit(k).alias("plain"), F.col(side).alias("window")) for k, side in ((False, "canon"), (True, "low"))])).alias("w")).select("row", "len", "pos", "w.*")
    if lengths_short := [r[0] for r in items_.where(F.col("len") < MIN_WORDS).select("len").distinct().collect()]:
        # a last mark leaves an empty word
        n_words = F.size(F.filter(F.slice("low", 2, F.greatest(F.size("low") - 1, F.lit(0))), lambda w: w != ""))
        few = arrays.where(F.size("low") <= MIN_WORDS + 1).withColumn("len", n_words).where(F.col("len").isin(lengths_short))
        few = few.withColumns({c: F.slice(c, 1, F.col("len") + 1) for c in ("canon", "low")})
        each = each.unionByName(few.select("row", "len", F.lit(0).alias("pos"), F.explode(_short("canon", "low")).alias("w")).select("row", "len", "pos", "w.*"))
    targets = items_.select("item", "plain", "len", "window", "at", "n_words")
    hits = each.join(broadcast_if_small(targets, n, BROADCAST), ["plain", "len", "window"]).withColumn("diagonal", F.col("pos") - F.col("at"))
    # one row per passage; equal rows of the input count once
    passages = hits.groupBy("row", "item", "n_words", "plain", "len", "diagonal").agg(F.array_sort(F.collect_set("at")).alias("at"))  # at most the windows of an item
    # the words that the passage's windows cover
    covered = F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a, a + F.col("len") - 1))))
    matched = F.when(F.col("plain"), F.size(covered)).otherwise(F.size("at") + F.col("len") - 1)
    passages = passages.withColumn("words_matched", F.least(F.col("n_words"), matched)).withColumn("coverage", F.col("words_matched") / F.col("n_words"))
    passages = cut(passages.where((F.col("words_matched") >= PASSAGE) | (F.col("coverage") >= COVER)))
    found = passages.count()
    mine = rows.join(broadcast_if_small(passages.select("row").distinct(), found), "row", "left_semi").dropDuplicates(["row"])
    mine = mine.select("row", "doc_id", F.explode(F.array(words_of(marked(F.col("text"))))).alias("doc_words"))
    text_of = items_.select("item", "item_id", F.col("words").alias("item_words"), "canon").dropDuplicates(["item"])
    pairs = passages.join(mine, "row").join(broadcast_if_small(text_of, n, BROADCAST // 10), "item")
    bare = lambda w: F.lower(F.translate(w, _MARK, ""))
    # those of the covered words that are slots
    slots = F.filter(covered, lambda i: ~F.col("plain") & F.get("canon", i + 1).isin(_SLOTS))
    pair = F.transform(slots, lambda i: F.struct(bare(F.get("item_words", i)).alias("a"), bare(F.get("doc_words", i + F.col("diagonal"))).alias("b")))
    pairs = pairs.withColumn("pairs", F.array_distinct(pair)).withColumn("n_slots", F.size(slots))
    values = lambda k: F.size(F.array_distinct(F.transform("pairs", lambda p: p[k])))
    literal = lambda at: F.size(F.filter(at, lambda i: ~F.get("canon", i + 1).isin(_SLOTS)))
    enough = literal(covered) >= F.least(F.lit(MIN_LITERAL), literal(F.sequence(F.lit(0), F.col("n_words") - 1)))
    good = pairs.where((F.col("plain") | enough) & (values("a") == F.size("pairs")) & (values("b") == F.size("pairs")))
    best = F.max_by(F.struct("words_matched", "coverage", (F.col("diagonal") + F.col("at")[0]).alias("first_word"), "n_slots"), F.struct(~F.col("plain"), "words_matched", -F.col("diagonal")))
    return good.groupBy("row", "doc_id", "item_id").agg(best.alias("b")).select("row", "doc_id", "item_id", "b.*")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, words_matched, coverage, first_word, n_slots of every passage of an item in a document; a document without one is absent."""
    return _leaks(docs, items, id_col, text_col, item_col, item_text_col).drop("row")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without a leak, with all their columns."""
    (leak,) = unused(docs, "_leak")
    found = cut(_leaks(docs, items, id_col, text_col).select(F.col("row").alias(leak)).distinct())
    text = F.col(text_col).cast("string")
    row = F.when(text.isNotNull(), F.xxhash64(F.col(id_col).cast("long"), text))
    return docs.join(broadcast_if_small(found, found.count()), row == F.col(leak), "left_anti")


def _sql_words(text: str) -> str:
    t = f"coalesce({text}, '')"
    for _ in range(2):  # no look-ahead here: the second time joins what the first had to step over
        t = rf"regexp_replace({t}, '([0-9])[.,:]([0-9])', '\1{_POINT}\2', 'g')"
    t = rf"regexp_replace({t}, '([0-9])([A-Za-z])', '\1 \2', 'g')"
    t = rf"regexp_replace({t}, '(?:^|[.!?:;\n|])[\s\x22\x27(]*', ' {_MARK}', 'g')"
    return f"list_filter(string_split_regex({t}, '{_SPLIT}'), lambda w: w <> '' AND w <> '{_MARK}')"


def _sql_template(words: str) -> str:
    number = lambda w: f"regexp_matches({w}, '^{_MARK}?[0-9]')"
    units = ", ".join(f"'{u}'" for u in UNITS)
    return (f"list_transform({words}, lambda w, i: CASE WHEN {number('w')} THEN '{NUMBER}' WHEN regexp_matches(w, '^[A-Z\u00c0-\u00de]') THEN '{NAME}' "
            f"WHEN i > 1 AND w IN ({units}) AND {number(f'{words}[i - 1]')} THEN '{UNIT}' ELSE lower(replace(w, '{_MARK}', '')) END)")


_PLAIN = f"list_transform(words, lambda w: lower(replace(w, '{_MARK}', '')))"
_SLOT_LIST = f"('{NUMBER}', '{UNIT}', '{NAME}')"
_COVERED = "list_distinct(flatten(list_transform(ks, lambda a: range(a, a + n))))"
ORACLE_SQL = f"""
WITH d0 AS (SELECT DISTINCT doc_id, text, {_sql_words("text")} AS words FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, text, words, {_sql_template("words")} AS canon, {_PLAIN} AS low FROM d0),
b0 AS (SELECT DISTINCT item_id, {_sql_words("text")} AS words FROM benchmark WHERE text IS NOT NULL),
b AS (SELECT item_id, words, {_sql_template("words")} AS canon, {_PLAIN} AS low, len(words) AS n_words, least(len(words), {WINDOW}) AS n FROM b0 WHERE len(words) >= 1),
bw AS (SELECT item_id, words AS item_words, canon AS item_canon, low, n_words, n, unnest(range(0, n_words - n + 1)) AS k FROM b),
bx AS (
  SELECT *, false AS plain, array_to_string(item_canon[k + 1 : k + n], ' ') AS win FROM bw WHERE len(list_filter(item_canon[k + 1 : k + n], lambda w: w NOT IN {_SLOT_LIST})) > 0
  UNION ALL SELECT *, true, array_to_string(low[k + 1 : k + n], ' ') FROM bw),
ns AS (SELECT DISTINCT n FROM b),
dw AS (SELECT doc_id, text, canon, low, ns.n, unnest(range(0, len(canon) - ns.n + 1)) AS pos FROM d, ns WHERE len(canon) = ns.n OR len(canon) > ns.n AND ns.n >= {MIN_WORDS}),
dx AS (SELECT doc_id, text, n, pos, false AS plain, array_to_string(canon[pos + 1 : pos + n], ' ') AS win FROM dw UNION ALL SELECT doc_id, text, n, pos, true, array_to_string(low[pos + 1 : pos + n], ' ') FROM dw),
p AS (
  SELECT doc_id, text, item_id, item_words, item_canon, n_words, plain, dx.n, pos - k AS diagonal, list_sort(list(DISTINCT k)) AS ks
  FROM dx JOIN bx USING (n, plain, win) GROUP BY ALL),
q AS (SELECT *, least(n_words, CASE WHEN plain THEN len({_COVERED}) ELSE len(ks) + n - 1 END) AS words_matched FROM p),
r AS (
  SELECT q.*, d.words AS doc_words, CASE WHEN plain THEN [] ELSE list_filter({_COVERED}, lambda i: item_canon[i + 1] IN {_SLOT_LIST}) END AS slots,
         len(list_filter({_COVERED}, lambda i: item_canon[i + 1] NOT IN {_SLOT_LIST})) >= least({MIN_LITERAL}, len(list_filter(item_canon, lambda w: w NOT IN {_SLOT_LIST}))) AS enough
  FROM q JOIN d ON q.doc_id IS NOT DISTINCT FROM d.doc_id AND q.text = d.text
  WHERE words_matched >= {PASSAGE} OR words_matched / n_words >= {COVER}),
s AS (
  SELECT *, list_distinct(list_transform(slots, lambda i: lower(replace(item_words[i + 1], '{_MARK}', '')) || '~' || lower(replace(doc_words[i + diagonal + 1], '{_MARK}', '')))) AS ab,
         list_distinct(list_transform(slots, lambda i: lower(replace(item_words[i + 1], '{_MARK}', '')))) AS a_,
         list_distinct(list_transform(slots, lambda i: lower(replace(doc_words[i + diagonal + 1], '{_MARK}', '')))) AS b_
  FROM r)
SELECT doc_id, item_id, words_matched::INTEGER AS words_matched, (words_matched / n_words)::DOUBLE AS coverage, (diagonal + ks[1])::INTEGER AS first_word, len(slots)::INTEGER AS n_slots
FROM s WHERE (plain OR enough) AND len(ab) = len(a_) AND len(ab) = len(b_)
QUALIFY row_number() OVER (PARTITION BY doc_id, text, item_id ORDER BY plain, words_matched DESC, diagonal) = 1
"""
