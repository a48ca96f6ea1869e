"""Secret scans: fixed patterns, and the guess cost of values that stand where credentials stand.

A value's guess cost is the least total over all its segmentations into dictionary words, dates, repeats, keyboard
walks, sequences and brute-force spans, found by dynamic programming over its prefixes. Values that would take at
least MIN_GUESSES guesses (as a power of ten) are reported as kind ``guess``, whatever their length. The dictionary is
a short list of password words and, behind it, the words of a public vocabulary in the order of its ranks, which stand
for their frequency. Unquoted names, paths and compounds (dictionary words joined by _, ., - or /) and what is called in
code are no values, nor are URLs; a password within one is.
"""

import base64
import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.memory import tidy
from tessera.llm.storage import arrow_batches

# The base patterns and the least length that counts, by kind in the order of the report.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_VALUE = 12
KINDS = {"assign": 0, "access": 1, "hex": 2, "guess": 3}
#: Where credentials stand: a name, a separator, perhaps a scheme word, and a value that is no URL; or the password of a URL.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?)["']?\s*(?::=|=>|[:=])\s*["']?(?:(?:bearer|basic|digest|token)\s+["']?)?(?![a-z][a-z0-9+.-]*://)([^\s"'`,;<>(){}\[\]]{8,})""",
    re.IGNORECASE | re.ASCII,
)
URL_PASSWORD = re.compile(r"://[^\s/:@]*:([^\s/@]{8,})@")
#: What names in code look like, their words, and what can be called.
NAME = re.compile(r"(?:\.{0,2}/)?[A-Za-z]+(?:[._/-][A-Za-z]+)+/?")
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
CALLED = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
MIN_GUESSES = 12.0
#: Longest segment that is looked up as a word or a date.
LONGEST = 32
#: Vocabulary file whose ranked words are the dictionary.
VOCABULARY = "byte_bpe_50k.tiktoken"
# Common password words, most common first.
WORDS = """password admin welcome login letmein monkey dragon master qwerty iloveyou sunshine princess football baseball shadow superman batman trustno
secret test guest root user default change changeme system server data base public private key token access hello world love money
summer winter spring autumn monday friday january june july august december google apple windows linux oracle mysql postgres docker
prod production stage staging develop developer local host example sample demo temp temporary none null true false your my the and for with
api client service account manager office company network internet email mail phone house family mother father sister brother flower
tiger eagle lion horse rabbit cookie coffee chocolate orange banana cherry purple yellow green silver golden diamond star moon""".split()
LEET = str.maketrans("0134578@$!", "oieastbasi")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_SEAT = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)?\d\d")
_DATE_COST = math.log10(366 * 120)


def _char_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 1000)


@lru_cache(4)
def ranks(vocabulary: str | None = None) -> dict[str, int]:
    """Rank of each dictionary word, from 1: WORDS, then the vocabulary's words of three letters or more in lower case."""
    out = {w: k for k, w in enumerate(WORDS, 1)}
    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as lines:
        for line in lines:
            piece = base64.b64decode(line.split()[0])
            if len(piece) > 3 and piece[:1] == b" " and piece[1:].isalpha() and piece.isascii():
                out.setdefault(piece[1:].decode().lower(), len(out) + 1)
    return out


@lru_cache(4)
def _heads(vocabulary: str | None = None) -> set[str]:
    return {w[:3] for w in ranks(vocabulary)}


def _word_cost(part: str, vocabulary: str | None = None) -> float | None:
    known, low = ranks(vocabulary), part.lower()
    rank = known.get(low)
    extra = 0.0
    if rank is None:
        rank, extra = known.get(low.translate(LEET)), 0.6
    if rank is None:
        return None
    caps = sum(c.isupper() for c in part)
    return math.log10(rank + 1) + extra + (0 if not caps else 0.3 if caps in (1, len(part)) else math.log10(math.comb(len(part), caps) + 1))


def _lower(value: str) -> str:
    """value in lower case, character by character: as long as before."""
    low = value.lower()
    return low if len(low) == len(value) else "".join(c.lower()[:1] for c in value)


def _walk_ends(value: str) -> list[int]:
    """For each place the end of the longest keyboard walk or alphabetic or numeric sequence from there."""
    low, n = _lower(value), len(value)
    out = [k + 1 for k in range(n)]
    walk = up = down = n
    for k in range(n - 2, -1, -1):  # runs that start one place later, carried on or cut
        here, there = _SEAT.get(low[k]), _SEAT.get(low[k + 1])
        near = here and there and here != there and abs(here[0] - there[0]) <= 1 and abs(here[1] - there[1]) <= 1
        step = ord(low[k + 1]) - ord(low[k]) if low[k].isalnum() else 0
        walk, up, down = walk if near else k + 1, up if step == 1 else k + 1, down if step == -1 else k + 1
        out[k] = max(walk, up, down)
    return out


def guesses(value: str, enough: float = math.inf, vocabulary: str | None = None) -> float:
    """Least total guess cost (power of ten) over all segmentations. Every segment adds half a digit for its place.

    It may end early with ``enough`` once no segmentation costs less than that. Time grows with the value's length.
    """
    n = len(value)
    best = [0.0] + [math.inf] * n
    plain = [0.0]
    for c in value:
        plain.append(plain[-1] + _char_cost(c))
    walks, heads = _walk_ends(value), _heads(vocabulary)
    low_case = _lower(value)
    leet = low_case.translate(LEET)
    repeated = [[0] * (n + 1) for _ in range(17)]  # by block size: how many characters from here equal those a block later
    for size in range(1, min(16, n // 2) + 1):
        run = repeated[size]
        for k in range(n - size - 1, -1, -1):
            run[k] = run[k + 1] + 1 if value[k] == value[k + size] else 0
    lead: dict[tuple[int, int], int] = {}
    low = 0  # the last place that is reached for less than enough
    brute = 0.0  # the least of best - plain so far: what a brute-force span up to here costs, but for its characters

    def offer(end: int, cost: float) -> None:
        nonlocal low
        if cost < best[end]:
            best[end] = cost
            if cost < enough + 0.5:
                low = max(low, end)

    for start in range(n):
        if start:
            offer(start, brute + plain[start] + 0.5)
            brute = min(brute, best[start] - plain[start])
            if start > low:
                return enough
        base = best[start] + 0.5
        if low_case[start : start + 3] in heads or leet[start : start + 3] in heads:
            for end in range(start + 3, min(n, start + LONGEST) + 1):
                word = _word_cost(value[start:end], vocabulary)
                if word is not None:
                    offer(end, base + word)
        for end in range(start + 3, min(walks[start], start + LONGEST) + 1):
            offer(end, base + math.log10(47) + 0.6 + math.log10(end - start))
        if value[start].isdigit():
            for end in range(start + 4, min(n, start + 10) + 1):
                if _DATE.fullmatch(value, start, end):
                    offer(end, base + _DATE_COST)
        for size in range(1, min(16, (n - start) // 2) + 1):  # repeats of a block, whatever their length
            stop = start + repeated[size][start] // size * size + size
            if stop == start + size:
                continue
            # a start in a run that an earlier one reaches as cheaply, whatever the end, adds nothing
            first = lead.get((size, start % size))
            if first is not None and first + repeated[size][first] >= start and best[start] >= best[first] + math.log10(1 + (start - first) // size / 2):
                continue
            lead[size, start % size] = start
            block = value[start : start + size]
            inner = _word_cost(block, vocabulary) or plain[start + size] - plain[start]
            for end in range(start + 2 * size, stop + 1, size):
                offer(end, base + inner + math.log10((end - start) // size))
    return min(best[n], brute + plain[n] + 0.5) - 0.5 if n else 0.0


@lru_cache(20_000)
def _verdict(value: str, least: float, vocabulary: str | None) -> bool:
    return guesses(value, least, vocabulary) >= least


def is_name(value: str, vocabulary: str | None = None) -> bool:
    """Whether the value is dictionary words, or parts of two letters or fewer, joined as names in code, paths and compounds are."""
    if not NAME.fullmatch(value):
        return False
    known = ranks(vocabulary)
    return all(len(w) < 3 or w.lower() in known for w in CAMEL.findall(value))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns: leftmost, non-overlapping per kind, too short ones dropped."""
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def guessed_spans(text: str, least: float = MIN_GUESSES, vocabulary: str | None = None) -> list[tuple[int, int, str]]:
    """Values in a credential's place that take at least 10**least guesses."""
    if ":" not in text and "=" not in text:
        return []
    found = {m.span(1) for p in (CONTEXT, URL_PASSWORD) for m in p.finditer(text) if p is CONTEXT or "://" in text}
    out = []
    for a, b in sorted(found):
        value = text[a:b]
        bare = text[a - 1] not in "\"'`"
        if bare and (is_name(value, vocabulary) or text[b : b + 1] == "(" and CALLED.fullmatch(value)):
            continue
        # long values are judged each time, so that the cache stays small
        if _verdict(value, least, vocabulary) if b - a <= 256 else guesses(value, least, vocabulary) >= least:
            out.append((a, b, "guess"))
    return out


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS[s[2]], s[1])))


def _scan(least: float, vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                kinds = [k for _, _, k in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + guessed_spans(text, least, vocabulary))))
            made = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(made, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = MIN_GUESSES, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row; offsets are code points, ends excluded.

    Null and empty texts have no spans (the digest is that of the empty string). Equal spans of different kinds are
    listed by kind. Repeated rows each get a row; other columns of docs are not read. vocabulary: path of a file of ranked
    pieces (base64, one a line) that every task reads.
    """
    arrow_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return docs.select(docs[key].alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(tidy(_scan(least, vocabulary)), schema)
