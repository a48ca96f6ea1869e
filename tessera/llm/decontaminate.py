"""Benchmark decontamination: an FM-index per shard of documents, searched for every window of every benchmark item.

Texts are read as words [0-9 a-z and all characters from U+0080], A-Z in lower case. A shard is a bounded number of
bytes of consecutive documents within a task. Its index covers the maximal runs of words that the benchmark knows and
that are long enough to hold its shortest window; no window can occur elsewhere. Windows are searched backward through
wavelet-tree ranks, occurrences located by sampled suffixes, checked word by word, and merged to spans.

The benchmark is cut into blocks of at most BLOCK_BYTES. A block's windows are laid out once, on the driver, as arrays
of some three bytes a byte of text, and broadcast. With several blocks the documents are read once and written in two
parts: those that hold a window by a bit map of all windows of the benchmark (every one that does, and few others), and
the rest, which is done. A pass a block reads the former only and writes nothing but hits.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.fmindex import FMIndex
from tessera.llm.memory import tidy
from tessera.llm.storage import arrow_batches, cut, fresh, new_path
from tessera.llm.words import hashes, string_bytes, word_spans

WINDOW = 10
#: Bytes of benchmark text in one broadcast, of those laid out at once, and of documents in one shard.
BLOCK_BYTES, STEP_BYTES, SHARD_BYTES = 16 << 20, 1 << 20, 8 << 20
#: Windows that are searched at once.
SEARCHED = 1 << 16
#: The bit map of windows: bits for each byte of benchmark text, the least and most powers of two, and probes a window.
MAP_BITS, LEAST_BITS, MOST_BITS, PROBES = 8, 20, 29, 4
FOUND = ("found_text", "found_words", "found_spans", "found_items")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Windows:
    """The distinct windows of a block of items, over numbered words (from 1), as arrays."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        named = [(str(item), text) for item, text in items if text]
        self.items = sorted({name for name, _ in named})
        place = {name: k for k, name in enumerate(self.items)}
        owner = np.array([place[name] for name, _ in named], np.int32)
        found, counts, spelt = [], [], {}
        for texts in _steps([t for _, t in named]):
            raw, offsets = string_bytes(pa.array(texts, pa.large_string()))
            starts, ends, first = word_spans(raw, offsets)
            h = hashes(raw, starts, ends)
            found.append(h)
            counts.append(np.diff(first))
            new, at = np.unique(h, return_index=True)
            for x, k in zip(new.tolist(), at.tolist(), strict=True):
                if x not in spelt:
                    spelt[x] = raw[starts[k] : ends[k]].tobytes().translate(_LOWER)
        every = np.concatenate(found) if found else np.zeros(0, np.uint64)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.hash = np.unique(every)
        self.ids = (np.searchsorted(self.hash, every) + 1).astype(np.int32)  # the items' words, one item behind the other
        words = [spelt[x] for x in self.hash.tolist()]
        self.bytes, self.ends = b"".join(words), np.cumsum([0, *map(len, words)]).astype(np.int32)
        self._distinct(n, owner, window)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def _distinct(self, n: np.ndarray, owner: np.ndarray, window: int) -> None:
        """start, length: where in ids each distinct window stands. item_at, item: the items of each."""
        self.window = window
        many = np.where(n > 0, np.maximum(1, n - window + 1), 0)
        begin = np.cumsum(n) - n
        of = np.repeat(np.arange(len(n)), many)
        start = begin[of] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        length = np.minimum(n[of], window)
        marks = [length.astype(np.uint64) for _ in range(2)]
        for k in range(window):
            inside = k < length
            word = self.ids[np.where(inside, start + k, 0)].astype(np.uint64) * inside if len(self.ids) else np.zeros(0, np.uint64)
            for m, odd in zip(marks, (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), strict=True):
                m += word
                m *= np.uint64(odd)
                m ^= m >> np.uint64(32)
        order = np.lexsort((owner[of], *marks))
        start, length, who = start[order], length[order], owner[of][order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (marks[0][order][1:] != marks[0][order][:-1]) | (marks[1][order][1:] != marks[1][order][:-1])
        for k in range(window):  # equal marks are equal windows
            same = ~fresh & (k < length)
            at = np.flatnonzero(same)
            if (self.ids[start[at] + k] != self.ids[start[at - 1] + k]).any() or (length[at] != length[at - 1]).any():
                raise ArithmeticError("two windows share a 128-bit mark")
        self.start, self.length = start[fresh].astype(np.int32), length[fresh].astype(np.int8)
        twice = np.zeros(len(order), bool)
        twice[1:] = ~fresh[1:] & (who[1:] == who[:-1])
        group = np.cumsum(fresh)[~twice] - 1
        self.item = who[~twice]
        self.item_at = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=len(self.start))))).astype(np.int32)
        self.shortest = int(self.length.min(initial=window))

    def __len__(self) -> int:
        return len(self.start)

    def words(self, some: slice) -> np.ndarray:
        """Word numbers of some windows, shorter ones filled up on the right."""
        at = np.minimum(self.start[some, None].astype(np.int64) + np.arange(self.window), len(self.ids) - 1)
        return np.where(np.arange(self.window) < self.length[some, None], self.ids[at], 0)

    def word(self, number: int) -> bytes:
        return self.bytes[self.ends[number - 1] : self.ends[number]]

    def names(self, k: int) -> list[str]:
        """The items of a window."""
        return [self.items[x] for x in self.item[self.item_at[k] : self.item_at[k + 1]].tolist()]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each word by its hash, 0 for a word that no item has. Hits are checked later by their bytes."""
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
        if len(maybe) and len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, h[maybe]), len(self.hash) - 1)
            same = self.hash[at] == h[maybe]
            out[maybe[same]] = at[same] + 1
        return out


def _place(mark: np.ndarray, probe: int, power: int) -> np.ndarray:
    """A window's place in the bit map; probes are independent of each other."""
    x = mark + np.uint64((probe + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x >> np.uint64(64 - power)


def _window_marks(h: np.ndarray, first: np.ndarray, length: np.ndarray | int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, mark) of all windows of ``length`` words (one for all texts, or one each) over the words' hashes."""
    n = np.diff(first)
    size = np.broadcast_to(length, n.shape)
    for words in np.unique(size[(n >= size) & (size > 0)]).tolist():
        use = np.flatnonzero((size == words) & (n >= words))
        many = n[use] - words + 1
        text = np.repeat(use, many)
        start = first[text] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        mark = np.full(len(start), words, np.uint64)
        for k in range(words):
            mark += h[start + k]
            mark *= np.uint64(0x9E3779B97F4A7C15)
            mark ^= mark >> np.uint64(32)
        yield text, mark


def _item_probes(power: int, window: int):
    """(length, place): every window of the items in the bit map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_bytes(batch.column(0))
            starts, ends, first = word_spans(raw, offsets)
            length = np.minimum(np.diff(first), window)
            for text, mark in _window_marks(hashes(raw, starts, ends), first, length):
                size = pa.array(length[text].astype(np.int32))
                for probe in range(PROBES):
                    yield pa.RecordBatch.from_arrays([size, pa.array(_place(mark, probe, power).astype(np.int64))], ["length", "place"])

    return run


def _bit_map(items: DataFrame, total: int, window: int) -> tuple[np.ndarray, list[int], int]:
    """The bit map of all windows in words of 64 bits, their lengths, and the map's power of two; 64 MB at most."""
    power = min(MOST_BITS, max(LEAST_BITS, int(total * MAP_BITS).bit_length()))
    probes = cut(items.select("t").mapInArrow(tidy(_item_probes(power, window)), "length int, place bigint"), "probes")
    lengths = sorted(r.length for r in probes.select("length").distinct().collect())  # window numbers at most
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    bits = np.zeros(1 << (power - 6), np.int64)
    for part in probes.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow().to_batches():
        bits[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return bits.view(np.uint64), lengths, power


def _suspects(spread):
    """Words of every text and whether it can hold a window, in place of the last two columns; the text is the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths, power = spread.value
        for batch in batches:
            words, held = [], []
            for a, b in _slices(batch.column(0)):
                raw, offsets = string_bytes(batch.column(0).slice(a, b - a))
                starts, ends, first = word_spans(raw, offsets)
                h, found = hashes(raw, starts, ends), np.zeros(b - a, bool)
                for length in lengths:
                    for text, mark in _window_marks(h, first, length):
                        for probe in range(PROBES):
                            at = _place(mark, probe, power)
                            live = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
                            text, mark = text[live], mark[live]
                        found[text] = True
                words.append(np.diff(first))
                held.append(found)
            done = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((words, np.int64), (held, bool))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(done[0].astype(np.int64)), pa.array(done[1])], batch.schema.names)

    return run


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about STEP_BYTES."""
    ends, start = np.cumsum(np.diff(string_bytes(texts)[1])), 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = min(len(texts), max(start + 1, int(np.searchsorted(ends, base + STEP_BYTES))))
        yield start, stop
        start = stop


def _steps(texts: list[str]) -> Iterator[list[str]]:
    """The texts, some at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > STEP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _runs(known: np.ndarray, first: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (excluded) of the runs of known words within a text that have at least ``shortest`` words."""
    inside = np.zeros(len(known) + 2, bool)
    inside[1:-1] = known
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = first[1:-1]
    edge = edge[(edge > 0) & (edge < len(known))]
    opens[edge], closes[edge - 1] = known[edge], known[edge - 1]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = b - a >= shortest
    return a[long], b[long]


class Shard:
    """Consecutive texts of bounded size: their known runs, then their index and its hits."""

    def __init__(self, windows: Windows):
        self.windows, self.rows, self.bytes = windows, 0, 0
        self.symbols: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []  # row, word number, first byte, last byte + 1 of each symbol
        self.n_words: list[np.ndarray] = []
        self.texts: list[bytes] = []

    def add(self, texts: pa.Array) -> None:
        raw, offsets = string_bytes(texts)
        starts, ends, first = word_spans(raw, offsets)
        self.n_words.append(np.diff(first))
        number = self.windows.numbers(hashes(raw, starts, ends)) if len(self.windows) else np.zeros(len(starts), np.int64)
        a, b = _runs(number > 0, first, self.windows.shortest)
        if len(a):
            size = b - a + 1  # a terminator ends each run
            at = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            stop = np.cumsum(size) - 1
            at[stop] = b - 1
            symbols = number[at]
            symbols[stop] = 0
            row = np.searchsorted(first, at, "right") - 1
            self.symbols.append(symbols)
            self.owner.append(np.stack((row + self.rows, at - first[row], starts[at] - offsets[row], ends[at] - offsets[row]), axis=1))
        self.texts.append((raw, offsets))
        self.rows += len(texts)
        self.bytes += len(raw)

    def word(self, row: int, a: int, b: int) -> bytes:
        for raw, offsets in self.texts:
            if row < len(offsets) - 1:
                return raw[offsets[row] + a : offsets[row] + b].tobytes().translate(_LOWER)
            row -= len(offsets) - 1
        raise IndexError(row)

    def hits(self) -> tuple[list[list[tuple[int, int, int, int]]], list[set[str]]]:
        """Per row: the occurrences (word from, word to, byte from, byte to; ends excluded) and the items found."""
        spans: list[list] = [[] for _ in range(self.rows)]
        items: list[set[str]] = [set() for _ in range(self.rows)]
        if not self.symbols:
            return spans, items
        symbols, owner = np.concatenate(self.symbols), np.concatenate(self.owner)
        index, w = FMIndex(symbols), self.windows
        which, rows = [], []
        for k in range(0, len(w), SEARCHED):
            low, high = index.ranges(w.words(slice(k, k + SEARCHED)), w.length[k : k + SEARCHED])
            count = high - low
            which.append(np.repeat(np.arange(k, k + len(count)), count))
            rows.append(np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count))
        which, rows = np.concatenate(which), np.concatenate(rows)
        if not len(which):
            return spans, items
        at = index.locate(rows)
        # words are numbered by hash: each word of a hit is compared once
        length = w.length[which].astype(np.int64)
        covered = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + length, -1)
        wrong = np.zeros(len(symbols), bool)
        for p in np.flatnonzero(np.cumsum(covered)[:-1] > 0).tolist():
            row, _, a, b = owner[p].tolist()
            wrong[p] = self.word(row, a, b) != w.word(int(symbols[p]))
        if wrong.any():
            bad = np.concatenate(([0], np.cumsum(wrong)))
            fine = bad[at + length] == bad[at]
            at, which, length = at[fine], which[fine], length[fine]
        head, tail = owner[at], owner[at + length - 1]
        for row, a, b, c, d, k in zip(head[:, 0].tolist(), head[:, 1].tolist(), (tail[:, 1] + 1).tolist(), head[:, 2].tolist(), tail[:, 3].tolist(), which.tolist(), strict=True):
            spans[row].append((a, b, c, d))
            items[row].update(w.names(k))
        return spans, items


def merge(spans: list[tuple]) -> list[tuple]:
    """Spans that touch or overlap by words become one."""
    out: list[list] = []
    for a, b, c, d in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1], out[-1][3] = max(b, out[-1][1]), max(d, out[-1][3])
        else:
            out.append([a, b, c, d])
    return [tuple(x) for x in out]


def without(text: str, cuts: list[int]) -> str:
    """The text without its spans (four numbers each, bytes last); white space on both sides of one is left once."""
    raw, parts, done = text.encode(), [], 0
    for a, b in zip(cuts[2::4], cuts[3::4], strict=True):
        parts.append(raw[done:a])
        done = b + 1 if raw[b : b + 1] in (b" ", b"\n") and (not a or raw[a - 1 : a] in (b" ", b"\n")) else b
    return (b"".join(parts) + raw[done:]).decode()


def _search(block, clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = block.value

        def flush(shard: Shard, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spans, items = shard.hits()
            words, row = np.concatenate(shard.n_words), 0
            for part in parts:
                n, k = part.num_rows, part.num_columns - 3  # texts, words, spans and items come last
                old_spans, old_items = part.column(k + 1).to_pylist(), part.column(k + 2).to_pylist()
                merged = [merge([tuple(o[x : x + 4]) for x in range(0, len(o), 4)] + s) if s or o else [] for o, s in zip(old_spans, spans[row : row + n], strict=True)]
                flat = [[v for s in m for v in s] for m in merged]
                found = [sorted({*o, *s}) for o, s in zip(old_items, items[row : row + n], strict=True)]
                body = part.column(k - 1)
                if clean and any(flat):
                    body = pa.array([without(v.as_py(), cuts) if cuts else v.as_py() for v, cuts in zip(body, flat, strict=True)], body.type)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: k - 1], body, pa.array(words[row : row + n], pa.int64()), pa.array(flat, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))], part.schema.names
                )
                row += n

        shard, parts = Shard(windows), []
        for batch in batches:
            text = batch.column(batch.num_columns - 4)
            size = np.diff(string_bytes(text)[1])
            start = 0
            while start < batch.num_rows:
                stop = start + max(1, int(np.searchsorted(np.cumsum(size[start:]), 1 << 20)))
                stop = min(stop, batch.num_rows)
                shard.add(text.slice(start, stop - start))
                parts.append(batch.slice(start, stop - start))
                start = stop
                if shard.bytes >= SHARD_BYTES:
                    yield from flush(shard, parts)
                    shard, parts = Shard(windows), []
        if parts:
            yield from flush(shard, parts)

    return run


def occurrences(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, clean: bool = False) -> DataFrame:
    """docs' columns in ``keep`` (default: all), then four more: found_text, found_words, found_spans, found_items.

    found_words: the text's words. found_spans: merged occurrences of windows, four numbers each: first word, last word
    + 1, first byte, last byte + 1. found_items: sorted ids, as strings, of the items whose windows occur. An item of
    fewer words than a window is one window; one without words (null, empty) has none. A benchmark row with a null id is no
    item: its text is neither searched for nor cut. Null texts have no words.
    Repeated rows each get a row; repeated items count once by id. Where docs has a column of such a name, the new one
    gets underscores in front. With clean, found_text has the spans cut out; they then refer to the text as it was.
    """
    arrow_batches(docs.sparkSession)
    spark, kept = docs.sparkSession, docs.columns if keep is None else keep
    t, w, s, i, at, row = fresh(docs.select(*kept), *FOUND, "place", "row")
    nothing = [F.lit(0).cast("bigint").alias(w), F.array().cast("array<bigint>").alias(s), F.array().cast("array<string>").alias(i)]
    items = benchmark.select(benchmark[item].cast("string").alias("item"), benchmark[item_text].cast("string").alias("t")).filter("item is not null and t is not null").distinct()
    total = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK_BYTES)) if total > BLOCK_BYTES else 1

    def search(state: DataFrame, k: int, cuts: bool) -> DataFrame:
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == k)
        held = spark.sparkContext.broadcast(Windows([(r.item, r.t) for r in part.toLocalIterator()], window))  # of about BLOCK_BYTES of text at most
        return state.mapInArrow(tidy(_search(held, cuts)), state.schema)

    state = docs.select(*kept, docs[text].cast("string").alias(t), *nothing)
    if blocks == 1:
        return search(state, 0, clean)
    bits = spark.sparkContext.broadcast(_bit_map(items, total, window))
    h = fresh(state, "held")[0]
    marked = docs.select(docs[text].cast("string").alias(t), *kept, F.monotonically_increasing_id().alias(at), nothing[0], F.lit(False).alias(h))
    path = new_path(spark, "suspects")
    done = marked.mapInArrow(tidy(_suspects(bits)), marked.schema)
    done.write.partitionBy(h).parquet(path)
    parts = spark.read.schema(marked.schema).parquet(path).select(*kept, t, w, *nothing[1:], at, h)
    plain = parts.filter(~F.col(h)).select(*state.columns)
    suspects = parts.filter(F.col(h)).drop(h)
    hits = [cut(search(suspects.select(at, t, w, s, i), k, False).filter(F.size(s) > 0).select(at, s, i), "hits") for k in range(blocks - 1)]
    found = hits[0]
    for more in hits[1:]:
        found = found.union(more)
    found = found.groupBy(F.col(at).alias(row)).agg(F.flatten(F.collect_list(s)).alias("s"), F.array_distinct(F.flatten(F.collect_list(i))).alias("i"))
    joined = suspects.join(found, F.col(at) == F.col(row), "left")
    rest = joined.select(*(suspects[c] for c in [*kept, t, w]), F.coalesce(found["s"], suspects[s]).alias(s), F.coalesce(found["i"], suspects[i]).alias(i))
    return plain.union(search(rest, blocks - 1, clean))


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row; see ``occurrences``."""
    found = occurrences(docs.select(docs[key].alias("doc_id"), docs[options.pop("text", "text")].alias("text")), benchmark, keep=["doc_id"], **options)
    text, words, spans, items = FOUND
    starts = F.sequence(F.lit(1), F.size(spans), F.lit(4))
    hit = F.aggregate(starts, F.lit(0).cast("bigint"), lambda acc, k: acc + F.element_at(spans, k + 1) - F.element_at(spans, k))
    hit = F.when(F.size(spans) > 0, hit).otherwise(F.lit(0).cast("bigint"))
    return found.select("doc_id", F.col(words).alias("n_words"), hit.alias("n_hit"), items).select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with every merged span cut out of the text (white space left on both sides becomes what stood before it).

    All rows and columns stay; a text without an occurrence stays as it is, null included.
    """
    found = occurrences(docs, benchmark, text=text, clean=True, **options)
    body = found.columns[-4]
    return found.select(*(F.col(body).alias(text) if c == text else F.col(c) for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS t FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, ns WHERE len(w) >= n)),
h AS (SELECT r, dw.n, k, item FROM dw JOIN bw USING (n, t)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM h)) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN i USING (r)
"""
