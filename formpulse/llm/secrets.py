"""Secret scan: fixed patterns, and a guess-cost estimate of values in a credential context.

A value that follows a credential word (``pwd=``, ``auth: Bearer`` ...) is a secret if it would be
costly to guess. The cost is that of the cheapest way to spell it as a sequence of common words,
dates, repeats, keyboard walks, character sequences and brute-force spans, found by dynamic
programming over its positions; a segmentation of k parts costs the product of its parts times k!.

Words rank by how many documents hold them outside of credential contexts (``word_ranks``), behind a
short list of words that are common in such values; so ordinary words after a context word are no
secrets, and a secret does not become a word by being repeated.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Least decimal order of guesses from which a value counts as a secret.
GUESSES = 8.0
#: A longer value is judged in overlapping parts of this many characters.
PART = 64

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")

#: What introduces a credential, and its value. The value may hold any visible character but quotes
#: and brackets.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|"""
    r"""(?:api|access|private|secret|client|auth|encryption)[_-]?(?:key|secret|token)|login)["']?"""
    r"""\x20*(?:=>|:=|[:=])\x20*["']?(?:(?:bearer|basic)\x20+)?([^\s"'`<>(){}\[\],;]{6,})""",
    re.I | re.A)
_HINT = re.compile(rb"pass|pwd|secret|token|credential|auth|bearer|key|login")
_HEX_TO_H = bytes(0x68 if c in b"0123456789abcdef" else 0 for c in range(256))

#: Common words in values that are no secrets, most frequent first; the place is the guess number.
COMMON = (
    "password 123456 12345678 qwerty admin letmein welcome monkey dragon master login secret test "
    "user root guest changeme default example sample hello world love star sun moon summer winter "
    "spring autumn football baseball shadow freedom whatever trust access token key pass word my your "
    "the none null true false undefined todo placeholder insert here value string api app server "
    "client database data system public private name mail email demo temp abc xyz foo bar secure "
    "super computer internet service account manager office home family company"
).split()
RANK = {word: place for place, word in enumerate(COMMON, 1)}
#: Words of a dictionary: how many at most (the most frequent; 20 letters each), and in how many
#: documents at least.
DICTIONARY, DOCUMENTS = 20_000, 3
LONGEST = 20
WORD = re.compile(rf"(?<![a-z0-9])[a-z]{{3,{LONGEST}}}(?![a-z0-9])", re.A)
UNLEET = str.maketrans("@430$517", "aaeossit")
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik9ol0p")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0?[1-9]|1[0-2])(?:[-/.]?(?:0?[1-9]|[12]\d|3[01]))?)?"
                  r"|(?:0?[1-9]|[12]\d|3[01])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:(?:19|20)\d\d|\d\d)", re.A)


def _alphabet(part: str) -> int:
    size = 0
    size += 26 * any("a" <= c <= "z" for c in part)
    size += 26 * any("A" <= c <= "Z" for c in part)
    size += 10 * any("0" <= c <= "9" for c in part)
    size += 33 * any(c.isascii() and not c.isalnum() for c in part)
    return size + 100 * any(not c.isascii() for c in part)


def _walks(value: str) -> Iterator[tuple[int, int]]:
    """Runs of three or more along a keyboard row, or by a fixed step of -1, 0 or 1 in code."""
    low = value.lower()
    for row in (*KEYBOARD, *(r[::-1] for r in KEYBOARD)):
        at = {c: i for i, c in enumerate(row)}
        start = 0
        for i in range(1, len(low) + 1):
            if i == len(low) or at.get(low[i], -9) != at.get(low[i - 1], -99) + 1:
                if i - start >= 3:
                    yield start, i
                start = i
    start, step = 0, None
    for i in range(1, len(value) + 1):
        now = ord(value[i]) - ord(value[i - 1]) if i < len(value) else None
        if now != step or now is None:
            if step in (-1, 0, 1) and i - start >= 3:
                yield start, i
            start, step = i - 1, now


def log_guesses(value: str, ranks: Mapping[str, int] = RANK) -> float:
    """Decimal order of the guesses that the cheapest segmentation needs; 0 for an empty value."""
    n, low = len(value), value.lower()
    plain = low.translate(UNLEET)
    parts: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]  # by end: (start, log10 cost)
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            rank = ranks.get(low[i:j]) or 2 * ranks.get(plain[i:j], 0)
            if rank:
                cased = 1 if value[i:j] == low[i:j] else 2 if value[i:j].isupper() or value[i:j].istitle() else 2 ** min(j - i, 10)
                parts[j].append((i, math.log10(rank * cased + 1)))
        for found in (m for k in (10, 9, 8, 7, 6, 5, 4) if (m := DATE.fullmatch(value, i, min(n, i + k)))):
            parts[found.end()].append((i, math.log10(365 * 120 if found.end() - i > 4 else 120)))
    for i, j in _walks(value):
        for a in range(i, j - 2):
            for b in range(a + 3, j + 1):
                parts[b].append((a, math.log10(50 * (b - a))))
    for size in range(2, n // 2 + 1):  # a block that repeats
        i = 0
        while i + 2 * size <= n:
            times = 1
            while value[i + times * size: i + (times + 1) * size] == value[i: i + size]:
                times += 1
            if times > 1:
                cost = size * math.log10(max(_alphabet(value[i: i + size]), 10))
                parts[i + times * size].append((i, cost + math.log10(times)))
                i += (times - 1) * size
            i += 1
    each = math.log10(max(_alphabet(value), 10)) if n else 0.0
    # best[j][k]: cheapest spelling of the first j characters in k parts. Spellings that already cost
    # more than one brute-force span of the whole are left out; parts and k! only add to them.
    most = each * n + 1e-9
    best: list[dict[int, float]] = [{0: 0.0}]
    for j in range(1, n + 1):
        here: dict[int, float] = {}
        for i, cost in [*parts[j], *((i, each * (j - i)) for i in range(j))]:
            for k, before in best[i].items():
                if before + cost + math.log10(math.factorial(k + 1)) <= most and before + cost < here.get(k + 1, math.inf):
                    here[k + 1] = before + cost
        best.append(here)
    return min(cost + math.log10(math.factorial(k)) for k, cost in best[n].items())


def costly(value: str, guesses: float = GUESSES, ranks: Mapping[str, int] = RANK) -> bool:
    """Whether any part of PART characters (all, for a shorter value) needs that many guesses."""
    starts = range(0, max(1, len(value) - PART // 2), PART // 2)
    return any(log_guesses(value[i: i + PART], ranks) >= guesses for i in starts)


def scan(text: str | None, guesses: float = GUESSES, ranks: Mapping[str, int] = RANK) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret in a whole text, in code points, by start and kind."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    found = []
    if _HINT.search(low):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if costly(m[1], guesses, ranks)]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if b"h" * 32 in raw.translate(_HEX_TO_H):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(start, KINDS[kind], end) for start, kind, end in sorted(found)]


def prose_words(text: str | None) -> set[str]:
    """The words of a whole text outside of credential contexts, lower-cased."""
    if not text:
        return set()
    if _HINT.search(text.lower().encode("utf-8", "surrogatepass")):
        text = CONTEXT.sub(" ", ASSIGN.sub(" ", text))
    return {m[0] for m in WORD.finditer(text.lower())}


def word_ranks(docs: DataFrame, size: int = DICTIONARY, documents: int = DOCUMENTS) -> dict[str, int]:
    """Guess numbers of words: the common ones, then the ``size`` words that most documents hold, of
    equal ones the first by letters.

    Counts cover all rows and whole texts and are folded per batch before the shuffle. The driver keeps
    ``size`` words of at most 20 letters, out of as many from each task. Null and empty texts hold none; repeated rows count each; an
    empty frame leaves the common words.
    """
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            held: Counter[str] = Counter()
            for text in batch.column(0):
                held.update(prose_words(text.as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(batches, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # Each task sends ``size`` rows at most, of which the driver keeps ``size``.
    most = counts.where(F.col("n") >= documents).orderBy(F.desc("n"), "word").limit(size).collect()
    ranks = dict(RANK)
    for row in most:
        ranks.setdefault(row.word, len(ranks) + 1)
    return ranks


def secret_spans(docs: DataFrame, key: str = "doc_id", guesses: float = GUESSES,
                 ranks: Mapping[str, int] = RANK) -> DataFrame:
    """key, spans array<struct<start, kind, end>> by start, then kind; one row per row.

    Kinds: assign, access and hex by pattern, guess by guess cost. Null and empty texts have no
    spans; texts are scanned whole; spans of different kinds may overlap. Keys may be null or repeat,
    each row stands for itself. An empty frame gives an empty frame. Other columns are not read.
    ``ranks`` are guess numbers of words, such as ``word_ranks``; they are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(ranks))
    kind = docs.schema[key].dataType.simpleString()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
        for batch in rows:
            spans = [[{"start": s, "kind": k, "end": e} for s, k, e in scan(text.as_py(), guesses, shared.value)]
                     for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, shape)], [key, "spans"])

    return docs.select(key, "text").mapInArrow(
        batches, f"`{key}` {kind}, spans array<struct<start: bigint, kind: string, end: bigint>>")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; counts and digest are of the fixed patterns only."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for listed in batch.column(1).to_pylist():
                base = [s for s in listed if s["kind"] != "guess"]
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(s["kind"] == kind for s in base))
                text = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base)
                out["base_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                out["spans"].append(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in listed))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, pa.int64()) for v in list(out.values())[:3]),
                 *(pa.array(v, pa.string()) for v in list(out.values())[3:])], ["doc_id", *out])

    docs = table(spark, sf_dir, "documents")
    return secret_spans(docs, ranks=word_ranks(docs)).mapInArrow(
        batches, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
