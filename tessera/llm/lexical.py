"""Ranked lexical search by Fagin's threshold algorithm over a sharded impact index.

The forward index is made in one pass over the documents: of each, how often it holds which terms of the items (runs of
0-9, letters and characters from U+0080, A-Z in lower case), and how many terms it has at all. It is written to the shared folder.

A shard is what a task reads of the index, in pieces of at most PIECE postings. For each piece the postings lists are
sorted by impact, w * tf part, highest first. An item's lists are read in turn, a stretch of each; every document met for the
first time is scored in full by a lookup in the forward index. The threshold is the sum of the impacts where the lists stand:
no document still unseen can score more. Reading stops only when the threshold falls strictly below the item's kth best
score, so that ties are all seen. What earlier pieces of the task gave counts for the kth best. A task returns its best
k of each item, and the best of these are the best of all.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.memory import tidy
from tessera.llm.storage import arrow_batches, cut, write
from tessera.llm.words import hashes, string_bytes, word_spans

TOP = 50
#: Distinct terms that are looked for at once (12 bytes each in a worker), terms and items of a block of items.
VOCABULARY, BLOCK_TERMS, BLOCK_ITEMS = 1 << 22, 1 << 22, 1 << 16
#: Postings of a piece, and the first stretch that is read of each list; stretches double.
PIECE, STRETCH = 1 << 20, 32
#: Items whose rows a task returns at once.
GIVEN = 4096
#: Rows of one item are first ranked in so many parts.
PARTS = 64
#: Bytes of text whose terms are counted at once.
STEP_BYTES = 1 << 20
#: Stands for a null id, which ranks behind all others.
NO_ID = (1 << 63) - 1


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of all texts in order, and the number of terms of each."""
    raw, offsets = string_bytes(texts)
    starts, ends, first = word_spans(raw, offsets)
    return hashes(raw, starts, ends).view(np.int64), np.diff(first)


def _steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    ends, start = np.cumsum(np.diff(string_bytes(texts)[1])), 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = min(len(texts), max(start + 1, int(np.searchsorted(ends, base + most))))
        yield start, stop
        start = stop


def _lists(size: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(values))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, terms): each item's distinct terms."""
    for batch in batches:
        term, n = _terms(batch.column(1))
        pairs = np.unique(np.rec.fromarrays((np.repeat(np.arange(len(n)), n), term))) if len(term) else None
        size = np.bincount(pairs.f0, minlength=len(n)) if pairs is not None else np.zeros(len(n), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(size, pairs.f1.copy() if pairs is not None else np.zeros(0, np.int64))], ["item", "terms"])


def _index(spread):
    """Per document (key, n, terms, tfs, docs = 0), terms as numbers in the vocabulary; per task its document frequencies, with docs and n as its totals."""
    names = ["key", "n", "terms", "tfs", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spread.value
        df, docs, total = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            for a, b in _steps(batch.column(1)):
                term, n = _terms(batch.column(1).slice(a, b - a))
                docs, total = docs + int(np.count_nonzero(n)), total + int(n.sum())
                at = np.minimum(np.searchsorted(known, term), len(known) - 1)
                hit = known[at] == term
                cell, tf = np.unique(np.repeat(np.arange(len(n)), n)[hit] * len(known) + at[hit], return_counts=True)
                doc, number = np.divmod(cell, len(known))
                df += np.bincount(number, minlength=len(known))
                some, size = np.unique(doc, return_counts=True)
                if len(some):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(some)), pa.array(n[some]), _lists(size, number.astype(np.int32)), _lists(size, tf.astype(np.int64)), pa.nulls(len(some), pa.int64()).fill_null(0)], names)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([total]), _lists(np.array([len(some)]), some.astype(np.int32)), _lists(np.array([len(some)]), df[some]), pa.array([max(docs, 1)])], names) if docs else pa.RecordBatch.from_pylist([], pa.schema([("key", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64())), ("docs", pa.int64())]))

    return run


@dataclass
class Corpus:
    """Documents with a term, all their terms, and the weight of each term of the vocabulary."""

    documents: int
    terms: int
    weight: np.ndarray

    def impacts(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What each posting adds to a score; n: terms of its document."""
        most = int(n.max(initial=0))
        if 50 * most * self.documents < 1 << 63:
            m = 50 + 50 * n * self.documents // self.terms
        else:
            m = np.array([50 + 50 * int(v) * self.documents // self.terms for v in n.tolist()], np.int64)
        return self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class Piece:
    """Some documents' postings by document (the forward index), and by term with falling impact."""

    def __init__(self, key: np.ndarray, size: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        self.key, self.term, self.impact = key, term, impact
        self.begin = np.concatenate(([0], np.cumsum(size)))
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        order = np.lexsort((-impact, term))
        self.listed, self.fall = doc[order], impact[order]
        self.lists, self.start = np.unique(term[order], return_index=True)
        self.start = np.append(self.start, len(term))

    def score(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Whole scores of documents by lookups in the forward index; wanted: whether a term is the item's."""
        size = self.begin[docs + 1] - self.begin[docs]
        into = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(into[-1]) + np.repeat(self.begin[docs] - into[:-1], size)
        return np.add.reduceat(np.where(wanted[self.term[at]], self.impact[at], 0), into[:-1])

    def search(self, terms: np.ndarray, wanted: np.ndarray, score: np.ndarray, key: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The item's best (score, key) among those given and this piece's, and the postings that were read."""
        at = np.minimum(np.searchsorted(self.lists, terms), len(self.lists) - 1)
        at = at[self.lists[at] == terms]
        begin, end = self.start[at], self.start[at + 1]
        stand, seen, stretch, read = begin.copy(), np.zeros(len(self.key), bool), STRETCH, 0
        while len(begin):
            stop = np.minimum(stand + stretch, end)
            met = np.concatenate([self.listed[a:b] for a, b in zip(stand.tolist(), stop.tolist(), strict=True)])
            read, stand, stretch = read + len(met), stop, stretch * 2
            new = np.unique(met[~seen[met]])
            if len(new):
                seen[new] = True
                made = self.score(new, wanted)
                score, key = best(np.concatenate((score, made)), np.concatenate((key, self.key[new])), top)
            more = stand < end
            threshold = int(self.fall[stand[more]].sum())  # of what stands next in each list
            if not more.any() or len(score) == top and threshold < score[-1] or threshold == 0:
                break
        return score, key, read


def best(score: np.ndarray, key: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest scores above 0, equal ones by key."""
    if len(score) > 4 * top:  # all that can be among the first
        least = np.partition(score, len(score) - top)[len(score) - top]
        score, key = score[score >= least], key[score >= least]
    order = np.lexsort((key, -score))[:top]
    order = order[score[order] > 0]
    return score[order], key[order]


def _search(spread, top: int):
    """(item, key, score) of a task's best documents of every item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, items = spread.value
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        wanted = np.zeros(len(corpus.weight), bool)
        held: list[tuple] = []

        def flush() -> None:
            if not held:
                return
            key, n, size, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            piece = Piece(key, size, term, corpus.impacts(term, tf, np.repeat(n, size)))
            for k, (_, terms) in enumerate(items):
                wanted[terms] = True
                found[k] = piece.search(terms, wanted, *found[k], top)[:2]
                wanted[terms] = False

        for batch in batches:
            key = np.where(np.asarray(batch.column(0).is_null()), NO_ID, batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            size = np.diff(np.asarray(batch.column(2).offsets))
            held.append((key, batch.column(1).to_numpy(), size, batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()))
            if sum(len(h[3]) for h in held) >= PIECE:
                flush()
        flush()
        for a in range(0, len(items), GIVEN):
            some = found[a : a + GIVEN]
            item = np.repeat([k for k, _ in items[a : a + GIVEN]], [len(score) for score, _ in some])
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int64)), *(pa.array(np.concatenate([f[c] for f in some])) for c in (1, 0))], ["item", "key", "score"])

    return run


def _weights(index: DataFrame, size: int) -> Corpus:
    """The corpus' counts: a row a term of the vocabulary comes to the driver."""
    tasks = index.filter("docs > 0")
    documents, terms = tasks.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(size, np.int64)
    each = tasks.select(F.explode(F.arrays_zip("terms", "tfs")).alias("e")).groupBy(F.col("e.terms").alias("term")).agg(F.sum("e.tfs").alias("df"))
    for part in each.toArrow().to_batches():
        df[part.column(0).to_numpy()] = part.column(1).to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * v + 1))) for v in df.tolist()], np.int64)
    return Corpus(documents, terms, weight)


def _numbered(items: DataFrame, known: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(item, ascending numbers of its terms in the vocabulary) of every item, by item."""
    out = []
    for batch in items.select("item", "terms").toArrow().to_batches():
        at = np.asarray(batch.column(1).offsets)
        number = np.searchsorted(known, batch.column(1).flatten().to_numpy()).astype(np.int32)
        out += [(item, np.sort(number[a - at[0] : b - at[0]])) for item, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return sorted(out, key=lambda x: x[0])


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``top`` highest-scoring documents of every item.

    Every row of items is an item of its own, so repeated rows and ids repeat their ranks, a null id included; an item
    without a term has no rows. Every row of docs is a document, copies included; equal scores rank by ascending id, a
    null id last. Null texts have no terms. Terms are told apart by 64-bit hashes. docs is read once, but once for
    every 2**22 distinct terms of items if they have more; its index is read once for each block of items.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    numbered, items_path = write(items.select(F.monotonically_increasing_id().alias("item"), items[item].alias("item_id"), items[item_text].cast("string").alias("t")), "items")
    wanted = cut(numbered.select("item", "t").mapInArrow(tidy(_item_terms), "item bigint, terms array<bigint>").filter(F.size("terms") > 0), "item-terms")
    n, terms = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-n * 2 // BLOCK_ITEMS) if n > BLOCK_ITEMS else 1, -(-terms * 2 // BLOCK_TERMS) if terms > BLOCK_TERMS else 1)
    distinct = lambda d: d.select(F.explode("terms").alias("h")).distinct()
    block = lambda b: wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
    groups = [list(range(blocks))] if blocks == 1 or distinct(wanted).limit(VOCABULARY + 1).count() <= VOCABULARY else [[b] for b in range(blocks)]
    found, kind = None, "item bigint, key bigint, score bigint"
    body = docs.select(docs[key].cast("bigint").alias("k"), docs[text].cast("string").alias("t")).filter("t is not null")
    for group in groups:
        known = np.sort(distinct(wanted if len(group) == blocks else block(group[0])).toArrow().column(0).combine_chunks().to_numpy())
        if not len(known):
            continue
        index, _ = write(body.mapInArrow(tidy(_index(spark.sparkContext.broadcast(known))), "key bigint, n bigint, terms array<int>, tfs array<bigint>, docs bigint"), "forward-index")
        corpus = _weights(index, len(known))
        for b in group:
            spread = spark.sparkContext.broadcast((corpus, _numbered(block(b), known)))  # a block's items: BLOCK_TERMS terms
            part = index.filter("docs = 0").select("key", "n", "terms", "tfs").mapInArrow(tidy(_search(spread, top)), kind)
            found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], kind)
    ranked = lambda d, *by: d.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "key"))).filter(F.col("rank") <= top)
    few = ranked(found.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS))), "item", "part").drop("part")
    out = ranked(few, "item").join(numbered.select("item", "item_id"), "item")
    return out.select("item_id", "rank", F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "score")


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
q AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM (SELECT row_number() OVER () AS i, * FROM benchmark) b),
s AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM s) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p GROUP BY term),
e AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY i, item_id, r, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS rank, doc_id, score FROM e WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50
"""
