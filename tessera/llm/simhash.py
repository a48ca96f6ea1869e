"""SimHash near-duplicates: fingerprints, and their links at a few differing bits, through anchor points.

Anchors are the words of a covering code. A 64-bit fingerprint is read as bands; of two fingerprints with at most
DISTANCE differing bits, some band differs in at most DISTANCE // bands of them. Within a band of 16-bit quarters the
anchors are the words of the perfect [15, 11] code times both values of the sixteenth bit: covering radius one a
quarter. A fingerprint's home is the anchor that covers it; it is replicated to every anchor that covers a fingerprint
within the band's threshold, all of which lie within covering radius plus threshold. So two linked fingerprints meet
at the home of either, and are compared there by all 64 bits.

Only distinct fingerprints travel, so copies cost nothing. An anchor with very many fingerprints (a large group of near
copies) is dealt in blocks over several tasks: its homes over some, its replicas over others, every pair of blocks
once. From a block go the links of a spanning forest only, never all its pairs.
"""

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bitmap
from tessera.llm.components import components
from tessera.llm.memory import tidy
from tessera.llm.storage import arrow_batches, cut, fresh

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: By number of bands: replicas of a fingerprint, and anchors of a band. The links found are the same.
PLANS = {4: (34.2, 1 << 12), 2: (286.5, 1 << 24)}
#: Measured seconds of a core that a replica costs on its way (by number of bands), and a comparison at its anchor.
REPLICA, COMPARISON = {4: 3e-6, 2: 1e-5}, 4e-9
#: Fingerprints of one anchor on either side of a comparison.
BLOCK = 8192
#: Fingerprints up to which all are counted to find hot anchors, replicas that a block shows in a sample, and the most hot anchors (24 bytes each).
COUNTED, SEEN, HOT = 1 << 16, 32, 1 << 20
#: Bits of a block's row, and of its column; an anchor takes 33 bits at most.
BLOCK_BITS = 14
#: Comparisons at once: their intermediate results stay in a core's cache.
TILE = 1 << 18


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is set if it is in more than half of the shingles' hashes, repeats included. No words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[: -SHINGLE] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[k : k + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.array([fingerprint(v.as_py()) for v in batch.column(2)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fp)], ["doc_id", "mark", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, fp bigint) of every row: whole texts, lower-cased A-Z, words between ASCII white space. Null: no words.

    mark is a hash of the text, by which rows with one id can be told apart.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(docs[key].cast("bigint").alias("doc_id"), F.xxhash64(docs[text]).alias("mark"), docs[text].cast("string").alias("t"))
    return rows.mapInArrow(tidy(_fingerprints), "doc_id bigint, mark bigint, fp bigint")


class Anchors:
    """The covering code of one band and the anchors to visit within a threshold."""

    def __init__(self, bands: int):
        if bands not in (2, 4):
            raise ValueError("bands are 2 or 4")
        self.bands, self.quarters, self.threshold = bands, 4 // bands, DISTANCE // bands
        values = np.arange(1 << 16, dtype=np.int64)
        syndrome = np.zeros(1 << 16, np.int64)
        for position in range(1, 16):
            syndrome ^= np.where(values >> (position - 1) & 1, position, 0)
        self.home = np.where(syndrome > 0, values ^ (1 << np.maximum(syndrome - 1, 0)), values)
        # visits[c]: for each value of a quarter the anchors that c flips reach and fewer don't, filled up with -1
        reached = [self.home[:, None]]
        for flips in range(1, self.threshold + 1):
            masks = np.array([sum(1 << p for p in c) for c in combinations(range(16), flips)])
            found = np.sort(self.home[values[:, None] ^ masks], axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            for k in range(found.shape[1]):
                for earlier in reached:
                    found[(found[:, k : k + 1] == earlier).any(axis=1), k] = -1
            found = -np.sort(-found, axis=1)
            reached.append(found[:, : max(1, int((found >= 0).sum(axis=1).max()))])
        self.visits = reached

    def replicate(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row of fp, is home) of every copy: anchors are numbered over all bands."""
        fp = fp.view(np.uint64)
        anchors, rows, homes = [], [], []
        for band in range(self.bands):
            parts = [(fp >> np.uint64(16 * (band * self.quarters + q)) & np.uint64(0xFFFF)).astype(np.int64) for q in range(self.quarters)]
            for costs in product(range(self.threshold + 1), repeat=self.quarters):
                if sum(costs) > self.threshold:
                    continue
                at = np.zeros((len(fp), 1), np.int64)
                for part, cost in zip(parts, costs, strict=True):
                    step = self.visits[cost][part]
                    at = np.where((at[:, :, None] < 0) | (step[:, None, :] < 0), -1, at[:, :, None] << 16 | step[:, None, :]).reshape(len(fp), -1)
                row, column = np.nonzero(at >= 0)
                anchors.append(at[row, column] * self.bands + band)
                rows.append(row)
                homes.append(np.full(len(row), not any(costs)))
        return np.concatenate(anchors), np.concatenate(rows), np.concatenate(homes)


_anchors: dict[int, Anchors] = {}


def _code(bands: int) -> Anchors:
    if bands not in _anchors:
        _anchors[bands] = Anchors(bands)
    return _anchors[bands]


def _sizes(bands: int):
    """(anchor, n, h): replicas and homes at the anchors, as far as a task has fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(fp), 2048):
                anchor, _, home = _code(bands).replicate(fp[k : k + 2048])
                at, back = np.unique(anchor, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.bincount(back)), pa.array(np.bincount(back[home], minlength=len(at)))], ["anchor", "n", "h"])

    return run


def _placed(bands: int, spread):
    """(cell, fp) of every replica, those at hot anchors dealt over blocks: homes along a row of blocks, all others, homes too, down a column.

    A cell holds, from the top, the anchor, the block's row and column, and whether the replica is a home.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rows, cols = spread.value
        for batch in batches:
            all_fp = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(all_fp), 2048):
                fp = all_fp[k : k + 2048]
                anchor, row, home = _code(bands).replicate(fp)
                fp = fp[row]
                at = np.minimum(np.searchsorted(hot, anchor), max(len(hot) - 1, 0))
                split = hot[at] == anchor if len(hot) else np.zeros(len(anchor), bool)
                high, wide = (np.where(split, x[at], 1) if len(hot) else np.ones(len(anchor), np.int64) for x in (rows, cols))
                mix = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                for as_home, some, times in ((True, np.flatnonzero(home), wide), (False, np.arange(len(fp)), high)):
                    each = np.repeat(some, times[some])
                    step = np.arange(len(each)) - np.repeat(np.cumsum(times[some]) - times[some], times[some])
                    r, c = (mix[each] % high[each], step) if as_home else (step, mix[each] % wide[each])
                    cell = ((anchor[each] << BLOCK_BITS | r) << BLOCK_BITS | c) << 1 | as_home
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp[each])], ["cell", "fp"])

    return run


def forest(homes: np.ndarray, others: np.ndarray, near, pairs: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between two lists of nodes. near(a, b): which of a x b are linked.

    Equal nodes are one. Rows are compared in tiles that grow up to ``pairs`` pairs, each row once and with all others; pairs already connected are dropped before the rest
    is looked at, so that dense groups don't pile up pairs.
    """
    nodes, at = np.unique(np.concatenate((homes, others)), return_inverse=True)
    left, right = at[: len(homes)], at[len(homes) :]
    label = np.arange(len(nodes))
    edges: list[tuple[int, int]] = []
    k, tile = 0, 16
    while k < len(left):
        tile = max(1, min(tile, pairs // max(1, len(right))))
        i, j = np.nonzero(near(homes[k : k + tile], others))
        i, j = left[k + i], right[j]
        a, b = label[i], label[j]
        new = a != b
        if new.any():
            pair, first = np.unique(np.minimum(a, b)[new] * len(nodes) + np.maximum(a, b)[new], return_index=True)
            i, j = i[new][first], j[new][first]
            parent: dict[int, int] = {}

            def root(x: int, parent: dict[int, int] = parent) -> int:
                while x in parent:
                    if parent[x] in parent:
                        parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for p, q, u, v in zip((pair // len(nodes)).tolist(), (pair % len(nodes)).tolist(), i.tolist(), j.tolist(), strict=True):
                p, q = root(p), root(q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    edges.append((u, v))
            if parent:
                to = np.arange(len(nodes))
                for x in parent:
                    to[x] = root(x)
                label = to[label]
        k += tile
        tile *= 4
    if not edges:
        return nodes[:0], nodes[:0]
    ends = np.array(edges)
    return nodes[ends[:, 0]], nodes[ends[:, 1]]


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= DISTANCE


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of each group of rows with equal first ``keys`` columns; the rows come sorted by them."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        change = np.zeros(len(columns[0]), bool)
        for c in columns[:keys]:
            change[1:] |= c[1:] != c[:-1]
        change[0] = bool(held) and any(c[0] != h[-1] for c, h in zip(columns[:keys], held[-1], strict=False))
        bounds = np.flatnonzero(change)
        start = 0
        for stop in bounds.tolist():
            if stop > start:
                held.append([c[start:stop] for c in columns])
            if held:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, start = [], stop
        held.append([c[start:] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    us, vs, n = [], [], 0
    cells = (pa.RecordBatch.from_arrays([pa.array(c >> 1), b.column(1), pa.array(c & 1 == 1)], ["block", "fp", "home"]) for b in batches for c in [b.column(0).to_numpy()])
    for _, fp, home in groups(cells, 1):
        if len(fp) < 3 or not home.any():  # a home alone is there twice
            continue
        u, v = forest(fp[home], fp[~home], _near)
        if len(u):
            us.append(u)
            vs.append(v)
            n += len(u)
        if n > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
            us, vs, n = [], [], 0
    if us:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def _hot(distinct: DataFrame, bands: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors with more than a block of replicas, and by how many rows and columns of blocks each is dealt.

    Counted over all fingerprints while they are few, else over a share of them by hash, of which a block's worth still
    shows SEEN. How evenly blocks fill depends on it; every home meets every visitor of its anchor whatever the numbers.
    """
    n = distinct.count()
    share = min(1.0, max(SEEN / block, COUNTED / max(n, 1)))
    some = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    size = cut(some.mapInArrow(tidy(_sizes(bands)), "anchor bigint, n bigint, h bigint").groupBy("anchor").agg((F.sum("n") / share).alias("n"), (F.sum("h") / share).alias("h")), "anchors")
    while (hot := size.filter(F.col("n") > block)).count() > HOT or (hot.agg(F.max("n")).first()[0] or 0) / block >= (1 << BLOCK_BITS) - 1:
        block *= 2
    found = sorted(tuple(r) for r in hot.select("anchor", F.ceil(F.greatest("h", F.lit(1)) / block), F.ceil(F.col("n") / block)).collect())  # HOT rows at most
    return tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def links(distinct: DataFrame, bands: int = 4, block: int = BLOCK) -> DataFrame:
    """(fp) distinct to (u, v): links that connect exactly the fingerprints that chains of DISTANCE bits connect.

    Replicas are made once and shuffled once, already dealt to their blocks.
    """
    spark = distinct.sparkSession
    # dealt out anew: the table is small for the work that each of its rows makes
    wide = distinct.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "fp")
    placed = wide.mapInArrow(tidy(_placed(bands, spark.sparkContext.broadcast(_hot(wide, bands, block)))), "cell bigint, fp bigint")
    parts = placed.repartition(F.shiftright("cell", 1)).sortWithinPartitions("cell")
    return parts.mapInArrow(tidy(_compare), "u bigint, v bigint")


def cost(n: int, bands: int) -> float:
    """Seconds of a core a fingerprint, of n distinct ones spread evenly, with so many bands."""
    replicas, anchors = PLANS[bands]
    return replicas * (REPLICA[bands] + n / anchors * COMPARISON)


def _named(marks: DataFrame, bands: int | None, block: int) -> DataFrame:
    """(class_fp, root, component_id) of every distinct fingerprint of marks."""
    lowest = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    if bands is None:
        n = lowest.count()
        bands = min(PLANS, key=lambda b: cost(n, b))
    linked = components(links(lowest.select("fp"), bands, block))
    classes = lowest.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    roots = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut(classes.join(roots, "root").select(F.col("fp").alias("class_fp"), "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id reachable by links.

    Texts without words (null and empty ones too) have fingerprint zero and are linked like any other. Repeated rows
    each get a row. A null key gets a row, and is never a component_id unless the component has no other key.
    Other columns of docs are not read.
    """
    marks = cut(fingerprints(docs, key, text), "fingerprints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marks.join(_named(marks, bands, block), F.col("fp") == F.col("class_fp")).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row of each component: that with the least id, a null id last, among equal ids that with the least text hash.

    All columns stay. Of rows with equal id and text one stays, whichever it is where their other columns differ. Neither
    the texts that stay nor those that go are shuffled: a bit map of what goes lets the rest through, and only what it
    can't tell apart, some rows in thousands, is looked up. Where very much goes the map fills up and more is looked up.
    """
    marks = cut(fingerprints(docs, key, text), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.col("mark").alias("mark"))
    first = marks.join(_named(marks, bands, block), F.col("fp") == F.col("class_fp")).groupBy("root").agg(F.min(rank).alias("r"))
    chosen = first.select(F.col("r.id").alias("id"), F.col("r.mark").alias("own"))
    each = marks.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    found = each.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("own")), "left")
    state = cut(found.select("doc_id", "mark", F.col("own").isNotNull().alias("stays"), "n"), "states")
    place = lambda i, m, seed=0: F.xxhash64(F.lit(seed), i, m)
    gone = bitmap.made(state.filter("not stays or n > 1"), place(F.col("doc_id"), F.col("mark")))
    met = bitmap.holds(state.filter("stays"), place(F.col("doc_id"), F.col("mark")), gone, "met")
    saved = cut(met.filter("met").select("doc_id", "mark"), "saved")
    again = bitmap.made(saved, place(F.col("doc_id"), F.col("mark"), 1))
    i, m, h, a, si, sm = fresh(docs, "id", "mark", "held", "again", "saved_id", "saved_mark")
    own = docs.withColumn(i, docs[key].cast("bigint")).withColumn(m, F.xxhash64(docs[text]))
    held = bitmap.holds(own, place(F.col(i), F.col(m)), gone, h)
    doubtful = bitmap.holds(held.filter(F.col(h)), place(F.col(i), F.col(m), 1), again, a).filter(F.col(a))
    named = saved.select(F.col("doc_id").alias(si), F.col("mark").alias(sm))
    kept = doubtful.join(named, F.col(i).eqNullSafe(F.col(si)) & (F.col(m) == F.col(sm)), "left_semi").dropDuplicates([i, m])
    return held.filter(~F.col(h)).select(*docs.columns).union(kept.select(*docs.columns))
