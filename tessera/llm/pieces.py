"""SentencePiece BPE encoding and decoding by a table of last tokens per prefix.

A byte-pair encoding is fixed by its adjacent pairs: a token sequence is the encoding of a string exactly if every
token is the encoding of itself and every neighbouring pair is the encoding of its joined text. So each prefix of a
chunk has one last token. An automaton over the vocabulary yields the tokens that end at each position; the one that
is compatible with the last token of the prefix before it goes into the table; ids are read backwards from the end.

No piece of such a vocabulary has the space mark behind another character, so a text falls into chunks, each with its
leading space marks, and further into runs between characters that no piece holds side by side. Equal chunks are
encoded once while they stay in a cache that is bounded in bytes.
"""

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tessera.llm.memory import tidy
from tessera.llm.storage import arrow_batches, fresh

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of each of the two generations of cached chunks, and the overhead of one; remembered pairs.
CACHED_BYTES, ENTRY_BYTES, CACHED_PAIRS = 24 << 20, 160, 200_000
#: Chunks of so many characters are encoded one by one and not cached; shorter ones together, up to so many characters at once.
LONG, BATCH_CHARS = 64, 100_000
#: Characters of text that are split and encoded together; a longer text goes alone.
TEXT_CHARS = 1 << 20


class Encoder:
    """One model's vocabulary, its automaton and its caches. Raises ValueError for a model outside the supported kind."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = range(model.get_piece_size())
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.ids: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [model.unk_id()] * 256
        for i in kinds:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"" if model.is_control(i) else " ⁇ ".encode())
            else:
                self.ids[piece] = i
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        probe = " ﬁ  Ａ½\né \x00"
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE) or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("only identity-normalised models whose space marks lead their pieces are supported")
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.text_of = {i: p for p, i in self.ids.items()}
        self.touching = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.alone: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0  # bytes of young
        self._tables()

    def _tables(self) -> None:
        """Arrays for whole batches: character numbers, lengths of tokens, touching characters, remembered pairs."""
        chars = sorted({c for p in self.ids for c in p})
        self.width = len(chars) + 1
        number = {c: k for k, c in enumerate(chars, 1)}
        self.char_number = np.zeros(0x110000, np.int32)
        self.char_number[[ord(c) for c in chars]] = range(1, self.width)
        self.touch_key = np.array(sorted(number[x[0]] * self.width + number[x[1]] for x in self.touching), np.int64)
        self.length_of = np.zeros(len(self.bytes_of), np.int64)
        for piece, i in self.ids.items():
            self.length_of[i] = len(piece)
        self.ascii_ids = np.array(self.byte_ids[:128], np.int32)
        self.stands = np.full(len(self.bytes_of), -1, np.int8)
        self.pair_key = np.full(1 << 20, -1, np.int64)
        self.pair_fits = np.zeros(1 << 20, bool)

    def merged(self, text: str) -> list[str]:
        """The definition: the adjacent pair with the best-scored joined piece merges first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, left: int, right: int) -> bool:
        known = self.pairs.get(left << 32 | right)
        if known is None:
            a, b = self.text_of[left], self.text_of[right]
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[left << 32 | right] = self.merged(a + b) == [a, b]
        return known

    def _all_fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_fits`` of many pairs: a direct-mapped table first, the definition for what it lacks."""
        key = left.astype(np.int64) << 32 | right
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        out, miss = self.pair_fits[slot], np.flatnonzero(self.pair_key[slot] != key)
        if len(miss):
            unique, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            found = np.array([self._fits(k >> 32, k & 0xFFFFFFFF) for k in unique.tolist()], bool)
            out[miss] = found[back]
            at = slot[miss][first]
            self.pair_key[at], self.pair_fits[at] = unique, found
        return out

    def _alone(self, token: int) -> bool:
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self.merged(self.text_of[token]) == [self.text_of[token]]
        return known

    def _all_alone(self, token: np.ndarray) -> np.ndarray:
        for t in np.unique(token[self.stands[token] < 0]).tolist():
            self.stands[t] = self._alone(t)
        return self.stands[token] > 0

    def _run(self, run: str) -> list[int]:
        """Ids of a run of characters that are pieces themselves."""
        last, length = [0] * (len(run) + 1), [0] * (len(run) + 1)
        for end, token in self.automaton.iter(run):
            end, size = end + 1, len(self.text_of[token])
            if not length[end]:
                before = end - size
                if self._fits(last[before], token) if before and length[before] else not before and self._alone(token):
                    last[end], length[end] = token, size
        out, end = [], len(run)
        while end:
            out.append(last[end])
            end -= length[end]
        return out[::-1]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk as little-endian 32-bit integers."""
        out: list[int] = []
        start = 0
        for k in range(1, len(chunk) + 1):
            if k < len(chunk) and chunk[k - 1 : k + 1] in self.touching:
                continue
            run = chunk[start:k]
            if len(run) == 1:
                i = self.ids.get(run)
                out += [i] if i is not None else [self.byte_ids[b] for b in run.encode()]
            else:
                out += self._run(run)
            start = k
        return np.array(out, "<u4").tobytes()

    def _many(self, chunks: list[str]) -> list[bytes]:
        """``_chunk`` of many short chunks at once: all prefixes of one length are looked at together."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        bound = np.concatenate(([0], np.cumsum(size)))
        char = self.char_number[points].astype(np.int64)
        n = len(char)
        # runs end between chunks and between characters that no piece holds side by side
        near = char[:-1] * self.width + char[1:]
        at = np.minimum(np.searchsorted(self.touch_key, near), len(self.touch_key) - 1)
        opens = np.ones(n + 1, bool)
        opens[1:n] = self.touch_key[at] != near
        opens[bound] = True
        starts = np.flatnonzero(opens)
        starts, length = starts[:-1], np.diff(starts)
        # what the automaton finds: where a token ends and which; what begins before its run doesn't count
        run = np.repeat(np.arange(len(starts)), length)
        found = np.fromiter(chain.from_iterable(self.automaton.iter("".join(chunks))), np.int64).reshape(-1, 2)
        end, token = found[:, 0], found[:, 1]
        begin, first = end - self.length_of[token] + 1, starts[run[end]]
        inside = begin >= first
        end, token, begin, first = end[inside], token[inside], begin[inside], first[inside]
        # prefixes of one length are looked at together, the shortest first: each has one last token
        size_of = end - first + 1
        order = np.argsort(size_of, kind="stable")
        end, token, begin, whole = end[order], token[order], begin[order], (begin == first)[order]
        last, reach = np.full(n, -1, np.int32), np.zeros(n, np.int64)
        cuts = np.cumsum(np.bincount(size_of, minlength=1)) if len(size_of) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            some = np.arange(a, b)
            at = some[whole[a:b]]
            fine = at[self._all_alone(token[at])]
            rest = some[~whole[a:b]]
            rest = rest[last[begin[rest] - 1] >= 0]
            rest = rest[self._all_fit(last[begin[rest] - 1], token[rest])]
            for kept in (fine, rest):
                last[end[kept]], reach[end[kept]] = token[kept], end[kept] - begin[kept] + 1
        out = np.full(n, -1, np.int32)
        end, first = starts + length - 1, starts
        while len(end):
            plain = last[end] >= 0
            lone = end[~plain]  # an unknown character is a run of its own
            out[lone] = self.ascii_ids[np.minimum(points[lone], 127)]
            end, first = end[plain], first[plain]
            begin = end - reach[end] + 1
            out[begin] = last[end]
            more = begin > first
            end, first = begin[more] - 1, first[more]
        odd = np.add.reduceat((char == 0) & (points > 127), bound[:-1]) > 0
        count = np.concatenate(([0], np.cumsum(out >= 0)))[bound] * 4
        flat = out[out >= 0].astype("<u4").tobytes()
        return [self._chunk(c) if strange else flat[a:b] for c, strange, a, b in zip(chunks, odd.tolist(), count[:-1].tolist(), count[1:].tolist(), strict=True)]

    def _chunks(self, text: str) -> list[str]:
        """A text's chunks, each without its last leading space mark."""
        parts = text.split(" ")
        if SPACE not in text and "" not in parts:
            return parts
        marked, start, parts = SPACE + text.replace(" ", SPACE), 1, []
        for k in range(2, len(marked) + 1):
            if k == len(marked) or marked[k] == SPACE and marked[k - 1] != SPACE:
                parts.append(marked[start:k])
                start = k + 1
        return parts if len(marked) > 1 else [""]

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Puts chunks into the cache, pieces of bounded size at a time, and gives back the ids of those too long for it."""
        if self.held > CACHED_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        once: dict[str, bytes] = {}
        todo, waiting = [], 0

        def keep(some: list[str], ids: list[bytes]) -> None:
            self.young.update(zip(some, ids, strict=True))
            self.held += ENTRY_BYTES * len(some) + 4 * sum(map(len, some)) + sum(map(len, ids))

        known = chunks & self.old.keys()
        keep(list(known), [self.old[c] for c in known])
        for c in chunks - known:
            if len(c) >= LONG:
                once[c] = self._chunk(SPACE + c)
            else:
                todo.append(c)
                waiting += len(c) + 1
                if waiting > BATCH_CHARS:
                    keep(todo, self._many([SPACE + c for c in todo]))
                    todo, waiting = [], 0
        if todo:
            keep(todo, self._many([SPACE + c for c in todo]))
        return once

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, begin and end ids included."""
        first, final = (np.array([i], "<u4").tobytes() for i in (self.bos, self.eos))
        split = [self._chunks(t) if t else [] for t in texts]
        every = set().union(*split)
        new = every - self.young.keys()
        once = self._learn(every if self.held > CACHED_BYTES else new) if new else {}
        young = self.young
        get = young.__getitem__ if not once else lambda c: young[c] if c in young else once[c]
        return [b"".join([first, *map(get, parts), final]) for parts in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, byte pieces gathered to characters, the leading space mark dropped."""
        pieces = self.bytes_of
        text = b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _some(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column, nulls as empty, some at a time."""
    held, chars = [], 0
    for value in column:
        held.append(value.as_py() or "")
        chars += len(held[-1])
        if chars > TEXT_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def tokens(docs: DataFrame, text: str = "text", model: str | None = None, keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """docs with its tokens: the columns in keep (default: all), then ids, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have the begin and end ids only, and decode to the empty text. A kept column that bears one
    of the new names is left out. with_ids=False leaves ids out. The model is a file that every worker opens by the path
    that the driver resolves.
    """
    arrow_batches(docs.sparkSession)
    path = model or public_tokenizers.path(MODEL)
    new = ["ids"] * with_ids + ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    df = docs.select(*kept, docs[text].cast("string").alias(fresh(docs, "body")[0]))
    kinds = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]] + [f"{c} {kinds[c]}" for c in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = Encoder(path)  # for one task: its tables and caches don't stay in the worker
        for whole in batches:
            done = 0
            for texts in _some(whole.column(whole.num_columns - 1)):
                batch = whole.slice(done, len(texts))
                done += len(texts)
                encoded = use.encode_all(texts)
                columns = [
                    pa.array([len(ids) // 4 for ids in encoded], pa.int64()), pa.array([hashlib.sha256(ids).hexdigest() for ids in encoded]),
                    pa.array([hashlib.sha256(use.decode(ids).encode()).hexdigest() for ids in encoded]),
                ]
                if with_ids:
                    ends = np.cumsum([0, *(len(ids) // 4 for ids in encoded)]).astype(np.int32)
                    columns.insert(0, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), "<i4"))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *new])

    return df.mapInArrow(tidy(run), schema)
