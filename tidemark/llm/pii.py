"""Personal data by a semi-Markov conditional random field, on top of exact base patterns.

Base spans are found by fixed patterns and checks, and always stay. Around them the field looks for what the patterns miss:
telephone numbers without a plus sign, addresses written with "(at)", cards with other separators. A text is cut into
regions that could hold such a thing at all (runs of digit groups; words around an at-mark). In a region, atoms are digit
groups or words. A candidate is a run of at most MAX_ATOMS atoms and MAX_CHARS characters, scored as a whole by features of
the span (digits, groups, separators, checksum, what stands left of it). Dynamic programming over the candidates of all regions chooses boundaries and kinds
together; an atom outside every span scores 0. A span is reported when its score is at least MARGIN and it touches no base span.

The weights are trained by gradient ascent on the likelihood of whole segmentations (forward and backward sums over the same
lattice). Examples are the base spans of a bounded sample of documents (SAMPLE_DOCS with the smallest hashes, WINDOWS windows
in all), rewritten in the ways above, and seeded made-up ones, with dates, amounts and long numbers that are nothing.
Only these windows come to the driver. Scoring reads every text whole, once, without a shuffle.

Edge cases: null or empty texts have no spans: counts 0, spans "". Rows that repeat come out as they come in. Null ids are kept.
Offsets are code points, end exclusive. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS = 7
MAX_CHARS = 64
MARGIN = 2.0
SAMPLE_DOCS = 4000
WINDOWS = 1200
PER_DOC = 6

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match begins where a run of digits does, and takes whole runs: nothing is scanned twice
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_HINT = re.compile(r"[0-9@]|[(\[](?:at|AT)[)\]]")

_NUMBERS = re.compile(r"[+(]?[0-9](?:[-+() ./]{0,3}[0-9])+")
_GROUP = re.compile(r"[+(]?[0-9]+")
_AT = re.compile(r"@|[(\[](?:at|AT)[)\]]")
_WORDS_LEFT = re.compile(r"\S+\s?$")
_SOLID = re.compile(r"\S+")
_CUES = {"phone": re.compile(r"phone|tel|call|mobile|fax|sms", re.I), "card": re.compile(r"card|visa|credit|debit|payment", re.I), "ip": re.compile(r"\bip\b|host|server|address", re.I), "email": re.compile(r"mail|contact|write", re.I)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            low = m.end()
        at = text.find("@", max(at + 1, low))


def base_spans(text: str) -> list[Span]:
    """The base spans by kind, then start."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def regions(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """What could hold a span: ("number" or "address", atoms)."""
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() >= 7:
            yield "number", [(g.start(), g.end()) for g in _GROUP.finditer(text, m.start(), m.end())]
    last = 0
    for m in _AT.finditer(text):
        left = max(last, m.start() - MAX_CHARS)
        w = _WORDS_LEFT.search(text[left : m.start()])
        start = left + w.start() if w else m.start()
        right = text[m.end() : m.end() + MAX_CHARS]
        end = m.end()
        for k, s in enumerate(_SOLID.finditer(right)):
            if k > 3:
                break
            end = m.end() + s.end()
        if start < m.start() and end > m.end():
            # the mark that ends a sentence is no part of a word
            ends = [(s.start(), s.start() + len(s.group().rstrip(".,;:!?\"'"))) for s in _SOLID.finditer(text, start, end)]
            yield "address", [(a, b) for a, b in ends if b > a]
            last = m.end()


def candidates(text: str, kind: str, atoms: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, list[str]]]:
    """(first atom, atom after the last, kind, features)."""
    for i in range(len(atoms)):
        for j in range(i + 1, min(len(atoms), i + MAX_ATOMS) + 1):
            start, end = atoms[i][0], atoms[j - 1][1]
            if end - start > MAX_CHARS:
                break
            for k in ("email",) if kind == "address" else ("ip", "card", "phone"):
                f = features(text, start, end, k)
                if f:
                    yield i, j, k, f


def features(text: str, start: int, end: int, kind: str) -> list[str]:
    """Features of a whole span as a span of this kind; none: it can't be one."""
    s = text[start:end]
    before = text[max(0, start - 24) : start]
    out = [f"{kind}", f"{kind}:cue={bool(_CUES[kind].search(before))}",
           f"{kind}:left={'w' if before[-1:].isalnum() else before[-1:] if before[-1:] in '#$€-/.=' else 's'}", f"{kind}:right={'w' if text[end : end + 1].isalnum() else 's'}"]
    if kind == "email":
        m = _AT.search(s)
        if not m or not s[: m.start()].strip():
            return []
        local, domain = s[: m.start()].strip(), s[m.end() :].strip()
        domain = re.sub(r"\s*[(\[](?:dot|DOT)[)\]]\s*| dot ", ".", domain)
        good = bool(_DOMAIN.fullmatch(domain))
        tail = domain.rpartition(".")[2]
        return [*out, f"email:mark={m.group()[0]}", f"email:local={all(c in _LOCAL for c in local)}", f"email:domain={good}", f"email:tail={good and tail.isalpha() and 2 <= len(tail) <= 6}", f"email:words={min(s.count(' '), 4)}"]
    digits = _NOT_DIGIT.sub("", s)
    n = len(digits)
    if not 7 <= n <= 19:
        return []
    seps = _NOT_DIGIT.findall(s)
    groups = [len(g) for g in _NOT_DIGIT.split(s) if g]
    look = "".join(sorted(set("".join(seps)))) or "none"
    out += [f"{kind}:n={n}", f"{kind}:groups={len(groups)}", f"{kind}:look={look}", f"{kind}:plus={s[0] == '+'}", f"{kind}:paren={s[0] == '(' or '(' in s}"]
    if kind == "card":
        if n < 13:
            return []
        return [*out, f"card:luhn={luhn(digits)}", f"card:fours={groups[:3] == [4, 4, 4]}", f"card:even={len(set(seps)) <= 1}"]
    if kind == "ip":
        parts = [g for g in _NOT_DIGIT.split(s) if g]
        return [*out, f"ip:octets={all(len(p) <= 3 and int(p) <= 255 for p in parts)}"] if len(parts) == 4 and set(seps) == {"."} else []
    if n > 15 or n < 9:
        return []
    return [*out, f"phone:tail={groups[-2:] == [3, 4]}", f"phone:ten={groups[-3:] == [3, 3, 4]}", f"phone:date={bool(re.search(r'(?:19|20)[0-9]{2}[-/.][01]?[0-9][-/.]', s))}", f"phone:even={len(set(seps)) <= 2}", f"phone:bare={not seps}"]


def decode(text: str, weights: dict[str, float], taken: list[tuple[int, int]] = ()) -> list[tuple[str, int, int, float]]:
    """The best segmentation of the regions, away from `taken`: (kind, start, end, score). Regions of different kinds can overlap: their spans can't."""
    out = []
    taken = sorted(taken)
    starts, ends_ = [s for s, _ in taken], []
    for _, e in taken:
        ends_.append(max(e, ends_[-1] if ends_ else 0))

    def touched(a: int, b: int) -> bool:
        k = bisect.bisect_left(starts, b)  # those that begin before b; the last end among them
        return k > 0 and ends_[k - 1] > a

    spans: list[tuple[int, int, str, float]] = []
    for kind, atoms in regions(text):
        atoms = [a for a in atoms if not touched(*a)]
        for i, j, k, f in candidates(text, kind, atoms):
            a, b = atoms[i][0], atoms[j - 1][1]
            s = 0.0 if touched(a, b) else sum(weights.get(x, 0.0) for x in f)
            if s >= MARGIN:
                spans.append((a, b, k, s))
    spans.sort(key=lambda x: x[:2])
    # runs of spans that overlap, of whatever region, are chosen from together
    run: list[tuple[int, int, str, float]] = []
    reach = 0
    for x in spans:
        if run and x[0] >= reach:
            out += _chosen(run)
            run = []
        run.append(x)
        reach = max(reach, x[1])
    return out + _chosen(run)


def _chosen(run: list[tuple[int, int, str, float]]) -> list[tuple[str, int, int, float]]:
    """Of spans (start, end, kind, score), those that don't overlap and have the largest sum of scores; of equal sums the one whose spans end first."""
    run = sorted(run, key=lambda x: (x[1], x[0]))
    ends = [x[1] for x in run]
    best, way = [0.0], []
    for a, _, _, s in run:
        i = bisect.bisect_right(ends, a)  # spans that end before this one begins
        here = best[i] + s
        way.append(i if here > best[-1] else -1)
        best.append(max(best[-1], here))
    out, n = [], len(run)
    while n:
        if way[n - 1] < 0:
            n -= 1
        else:
            a, b, k, s = run[n - 1]
            out.append((k, a, b, s))
            n = way[n - 1]
    return out


def _log_add(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


def fit(examples: list[tuple[str, list[Span]]], epochs: int = 10, rate: float = 0.3, ridge: float = 1e-3) -> dict[str, float]:
    """Weights that make the given spans of the examples likely, by AdaGrad on the likelihood of whole segmentations."""
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    lattices = []
    for text, gold in examples:
        for kind, atoms in regions(text):
            cands = list(candidates(text, kind, atoms))
            right = {(a, b, k) for k, a, b in gold}
            lattices.append((len(atoms), cands, [(atoms[i][0], atoms[j - 1][1], k) in right for i, j, k, _ in cands]))
    order = random.Random(7)
    for _ in range(epochs):
        order.shuffle(lattices)
        for n, cands, gold in lattices:
            score = [sum(weights.get(x, 0.0) for x in f) for *_, f in cands]
            into: list[list[int]] = [[] for _ in range(n + 1)]
            outof: list[list[int]] = [[] for _ in range(n + 1)]
            for c, (i, j, _, _) in enumerate(cands):
                into[j].append(c)
                outof[i].append(c)
            ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                ahead[j] = _log_add([ahead[j - 1]] + [ahead[cands[c][0]] + score[c] for c in into[j]])
            for i in range(n - 1, -1, -1):
                behind[i] = _log_add([behind[i + 1]] + [behind[cands[c][1]] + score[c] for c in outof[i]])
            for c, (i, j, _, f) in enumerate(cands):
                slope = gold[c] - math.exp(min(0.0, ahead[i] + score[c] + behind[j] - ahead[n]))
                if abs(slope) > 1e-4:
                    for x in f:
                        g = slope - ridge * weights.get(x, 0.0)
                        squares[x] = squares.get(x, 1e-8) + g * g
                        weights[x] = weights.get(x, 0.0) + rate * g / math.sqrt(squares[x])
    return weights


def _rewritten(kind: str, s: str, rng: random.Random) -> str:
    """The same entity as the base patterns would miss it."""
    d = _NOT_DIGIT.sub("", s)
    if kind == "email":
        a, b = rng.choice([(" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", ".")])
        local, _, domain = s.partition("@")
        return local + a + domain.replace(".", b)
    if kind == "card":
        sep = rng.choice([".", "/"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    if kind == "ip":
        return s
    d = d[-10:]
    return rng.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"]) if len(d) == 10 else s


def _made_up(kind: str, rng: random.Random) -> str:
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
        return f"{word()}.{word()}@{word()}.{rng.choice(['com', 'org', 'net', 'de'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))
    if kind == "card":
        head = num(15)
        return next(head + c for c in "0123456789" if luhn(head + c))
    if kind == "phone":
        return f"+{rng.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}"
    return rng.choice([num(rng.randint(7, 19)), f"20{num(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"0{rng.randint(1, 9)}/{rng.randint(10, 28)}/19{num(2)} {num(2)}", f"{num(3)} {num(3)} {num(3)}", f"{num(2)}.{num(2)}.20{num(2)} {num(4)}",
                       f"{num(4)} {num(5)} {num(4)}", f"{num(4)}-{num(4)}", f"{num(3)}-{num(2)}-{num(5)}-{num(3)}", ".".join([num(3)] * 2 + [str(rng.randint(256, 999)), num(2)])])


def training_windows(found: list[tuple[str, str, str, str]]) -> list[tuple[str, list[Span]]]:
    """Examples from the corpus's own base spans (kind, left, entity, right), each as it stands and rewritten, and made-up ones."""
    rng = random.Random(11)
    out = []
    carriers = [(a, b) for _, a, _, b in found] or [("the ", " and "), ("see: ", ". Then")]
    made = [(k, *rng.choice(carriers)[:1], _made_up(k, rng), rng.choice(carriers)[1]) for k in (*KINDS, "none", "none", "none") for _ in range(120)]
    for kind, left, s, right in [*found, *made]:
        for v in {s, _rewritten(kind, s, rng)} if kind != "none" else {s}:
            out.append((left + v + right, [(kind, len(left), len(left) + len(v))] if kind != "none" else []))
    # a card number that fails its check is nothing, however it is written
    for kind, left, s, right in made:
        if kind == "card":
            d = s[:-1] + str((int(s[-1]) + 1) % 10)
            out.append((left + rng.choice([d, _rewritten("card", d, rng)]) + right, []))
    return out


def _plain(s: str) -> str:
    return re.sub(r"[0-9@+]", "x", s)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, windows: int = WINDOWS) -> dict[str, float]:
    """Weights from at most `windows` windows of the `sample_docs` documents with the smallest hashes."""
    h = F.xxhash64(F.col(id_col).cast("long"), F.lit(11))
    last = docs.select(h.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    if last is None:
        return fit(training_windows([]))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, rows = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, a, b in base_spans(text or "")[:PER_DOC]:
                    if b - a <= MAX_CHARS:
                        hs.append(key)
                        rows.append((k, _plain(text[max(0, a - 24) : a]), text[a:b], _plain(text[b : b + 12])))
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), *(pa.array([r[c] for r in rows], pa.string()) for c in range(4))], names=["h", "kind", "before", "entity", "after"])

    sample = docs.select(h.alias("h"), F.col(text_col).cast("string").alias("text")).where(F.col("h") <= last)
    found = sample.mapInArrow(collect, "h long, kind string, before string, entity string, after string").orderBy("h", "kind", "entity", "before").limit(windows).collect()
    return fit(training_windows([(r["kind"], r["before"], r["entity"], r["after"]) for r in found]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_more (spans that the field adds) of every document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, more = [], []
                if text and _HINT.search(text):
                    base = base_spans(text)
                    more = [x[:3] for x in decode(text, weights, [(a, b) for _, a, b in base])]
                all_ = sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1], x[2])) if more else base
                counts = [sum(k == x[0] for x in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(all_), len(more)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_more"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_more long")
