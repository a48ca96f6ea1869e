"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut into halves; each half has its own codebook, and pairs of codes form the product grid of cells.
Codes grow with the number of vectors, and where a label has few, neighbouring codes are read as one, so that a cell
has about HOMES vectors. A vector's multi-sequence traversal visits cells by growing lower bound of their distance, the
sum over both halves of the squared distance to the code's region. A pair counts if either of its ends visits the
other's cell. Candidates are verified in double precision.

The traversal goes to 1 - c, half the squared distance at cosine c, and misses no pair: in each half the ends' distances
to the plane between their codes add up to at most their distance, so the bounds of the two ends add up to at most
2 - 2c, and one of them is at most half of it. A target recall below 1 stops earlier, at that quantile over simulated
partners, sample vectors turned by the threshold's angle in random directions. Real pairs that differ along few
directions can fall below such a target.

What travels to the cells is small: an id, the cells and AXES bytes, the vector's place along the main axes. Two places
are never further apart than their vectors, so comparing them only ever drops pairs that aren't linked. Vectors are
fetched for those that have a candidate left. Neighbouring cells of a label share a region of about REGION vectors, so
that a vector travels once for all its cells there.

Equal vectors of one label are one node with a count, so that copies never meet pairwise. Codebooks are fitted on a
bounded sample; every vector is indexed. A region with very many vectors is dealt in blocks over several tasks.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.components import components
from tessera.llm.memory import tidy
from tessera.llm.simhash import forest
from tessera.llm.storage import cut, discard, write

COSINE, RECALL = 0.98, 1.0
#: Most codes per half; vectors in the codebooks' sample, at least and per code; rounds of their fit.
CODES, SAMPLE, PER_CODE, ROUNDS = 1024, 4096, 16, 10
#: Vectors of a cell, of a region, and of a region's block on each side of a comparison.
HOMES, REGION, BLOCK = 64, 1 << 17, 1 << 17
#: Bytes of a vector's place along the main axes (8 to a long), and steps of one between 0 and 1.
AXES, STEPS = 16, 127
#: Lengths of vectors that have codebooks, the most frequent ones; vectors of others share one cell a label.
LENGTHS = 16
#: Pairs of vectors that are compared at once.
PAIRS = 1 << 22
#: Slack for rounding in bounds that decide where to look; what is found is verified exactly.
SLACK = 1e-9


def codebook(half: np.ndarray, codes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codes of a half by k-means, in the order of their main axis; fewer distinct rows than codes give fewer codes."""
    distinct = np.unique(half, axis=0)
    rng = np.random.default_rng(11)
    book = distinct[rng.permutation(len(distinct))[:codes]]
    for _ in range(rounds):
        near = _squares(half, book).argmin(1)
        n = np.bincount(near, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, near, half)
        book[n > 0] = total[n > 0] / n[n > 0, None]
    if len(book) > 1:
        book = book[np.argsort((book - book.mean(0)) @ np.linalg.svd(book - book.mean(0), full_matrices=False)[2][0], kind="stable")]
    return book


def _squares(half: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((half**2).sum(1)[:, None] + (book**2).sum(1) - 2 * half @ book.T).clip(0)


def starts(codes: int, number: int) -> np.ndarray:
    """First code of each of ``number`` runs of neighbouring codes that are read as one."""
    number = max(1, min(number, codes))
    return np.arange(number) * codes // number


def bounds(half: np.ndarray, book: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run of each row's code, squared lower bound of each row's distance to each run's region)."""
    distance = _squares(half, book)
    own = distance.argmin(1)
    apart = np.sqrt(_squares(book, book))
    gap = (distance - distance[np.arange(len(half)), own][:, None]) / np.maximum(2 * apart[own], 1e-6)
    gap[np.arange(len(half)), own] = 0
    return np.searchsorted(first, own, "right") - 1, np.minimum.reduceat(gap.clip(0) ** 2, first, axis=1)


def traverse(left: np.ndarray, right: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multi-sequence traversal of each row's grid: (row, left place, right place) by growing sum, up to the limit.

    Each row holds, for every left place in the order of its bounds, the next right place; the least sum is taken and
    its left place moves on. All rows take a step together.
    """
    by_left, by_right = np.argsort(left, axis=1, kind="stable"), np.argsort(right, axis=1, kind="stable")
    a, b = np.take_along_axis(left, by_left, 1), np.take_along_axis(right, by_right, 1)
    wide, high = max(1, int((a + b[:, :1] <= limit).sum(1).max(initial=0))), max(1, int((b + a[:, :1] <= limit).sum(1).max(initial=0)))
    a, b = a[:, :wide], np.concatenate((b[:, :high], np.full((len(b), 1), np.inf)), axis=1)
    row, place, front = np.arange(len(a)), np.zeros(a.shape, np.int64), a + b[:, :1]
    rows, xs, ys = [], [], []
    while len(row):
        x = front.argmin(1)
        every = np.arange(len(row))
        live = front[every, x] <= limit
        if not live.all():
            row, place, front, x = row[live], place[live], front[live], x[live]
            every = np.arange(len(row))
        y = place[every, x]
        rows.append(row)
        xs.append(by_left[row, x])
        ys.append(by_right[row, y])
        place[every, x] = y + 1
        front[every, x] = a[row, x] + b[row, y + 1]
    row, x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (rows, xs, ys))
    order = np.argsort(row, kind="stable")
    return row[order], x[order], y[order]


def unit(column: pa.Array) -> np.ndarray:
    """Rows of an array column as unit vectors in double precision; all have one length and are finite and non-zero."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    v = flat.reshape(len(column), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@dataclass
class Grid:
    """Codebooks of both halves, main axes (orthonormal columns), and how far traversals go."""

    books: tuple[np.ndarray, np.ndarray]
    axes: np.ndarray
    limit: float

    @classmethod
    def fit(cls, v: np.ndarray, codes: int, cosine: float, recall: float) -> "Grid":
        h = v.shape[1] // 2
        books = codebook(v[:, :h], codes), codebook(v[:, h:], codes)
        axes = np.linalg.svd(v, full_matrices=False)[2][:AXES].T
        return cls(books, axes, reach(v, books, cosine, recall))

    def visits(self, v: np.ndarray, fine: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(row, cell) of every visit, nearest first; each row's own cell; cells a side of the second half."""
        h = v.shape[1] // 2
        first = [starts(len(b), fine) for b in self.books]
        (a, left), (b, right) = bounds(v[:, :h], self.books[0], first[0]), bounds(v[:, h:], self.books[1], first[1])
        row, x, y = traverse(left, right, self.limit)
        width = len(first[1])
        return row, x * width + y, a * width + b, width

    def places(self, v: np.ndarray) -> np.ndarray:
        """AXES bytes of each row as longs."""
        out = np.zeros((len(v), AXES), np.int8)
        out[:, : self.axes.shape[1]] = np.rint(v @ self.axes * STEPS)
        return out.view(np.int64)


def reach(v: np.ndarray, books: tuple, cosine: float, recall: float) -> float:
    """How far traversals go for the target recall; at 1 no pair is beyond it from both ends."""
    most = 1 - cosine + SLACK
    if recall >= 1 or v.shape[1] < 2 or not len(v):
        return most
    v = np.repeat(v, -(-4096 // len(v)), axis=0)
    away = np.random.default_rng(13).normal(size=v.shape)
    away -= (away * v).sum(1, keepdims=True) * v
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
    partner, h = cosine * v + np.sqrt(max(0.0, 1 - cosine**2)) * away, v.shape[1] // 2
    cost = np.zeros(len(v))
    for book, part in zip(books, (slice(0, h), slice(h, None)), strict=True):
        every = np.arange(len(book))
        cost += bounds(v[:, part], book, every)[1][np.arange(len(v)), bounds(partner[:, part], book, every)[0]]
    return min(most, float(np.quantile(cost, recall)) + SLACK)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A list column: values cut at ``at`` (one more than rows)."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))


def _index(grids):
    """(g, node, fine, side, v) to a row for every region that a vector visits."""
    names = ["g", "region", "node", "own", "home", "cells", "seen", *PLACES]

    def part(g: np.ndarray, node: np.ndarray, fine: int, side: int, v: np.ndarray, grid: Grid | None) -> pa.RecordBatch:
        n = len(node)
        if grid is None:
            row, cell, own, width = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), 1
            places = np.zeros((n, AXES // 8), np.int64)
        else:
            row, cell, own, width = grid.visits(v, fine)
            places = grid.places(v)
        height = 1 if grid is None else len(starts(len(grid.books[0]), fine))

        def region(c: np.ndarray) -> np.ndarray:
            return c // width * min(side, height) // height * side + c % width * min(side, width) // width

        seen = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n))))
        r = region(cell)
        order = np.lexsort((r, row))
        change = np.flatnonzero(np.concatenate(([True], (np.diff(row[order]) != 0) | (np.diff(r[order]) != 0)))) if len(row) else np.zeros(0, np.int64)
        i, at = row[order][change], r[order][change]
        home = region(own)[i] == at
        # only the home copy carries all cells that the vector visits
        size = np.where(home, np.diff(seen)[i], 0)
        bound = np.concatenate(([0], np.cumsum(size)))
        listed = cell[np.arange(bound[-1]) - np.repeat(bound[:-1] - seen[i], size)]
        columns = [pa.array(g[i]), pa.array(at.astype(np.int32)), pa.array(node[i]), pa.array(own[i].astype(np.int32)), pa.array(home), _lists(cell[order], np.append(change, len(row))), _lists(listed, bound)]
        return pa.RecordBatch.from_arrays(columns + [pa.array(places[i, k]) for k in range(AXES // 8)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, node, fine, side = (batch.column(k).to_numpy() for k in range(4))
            size = batch.column(4).value_lengths().to_numpy()
            kinds, kind = np.unique(np.stack((size, fine, side), axis=1), axis=0, return_inverse=True)
            for k, (d, f, s) in enumerate(kinds.tolist()):
                rows = np.flatnonzero(kind.ravel() == k)
                for x in range(0, len(rows), 1024):
                    some = rows[x : x + 1024]
                    yield part(g[some], node[some], f, s, unit(batch.column(4).take(pa.array(some))), grids.value.get(d))

    return run


PLACES = [f"p{k}" for k in range(AXES // 8)]
_KEYS = ["g", "region", "r", "c"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block, which come together: those with equal _KEYS, the first columns."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(len(_KEYS))], axis=1)
        cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in range(len(_KEYS))):
            yield joined()
            held = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and a:
                yield joined()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield joined()


class _Block:
    """A block's rows as arrays: homes by cell, and which row visits which cell that has homes."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, names = batch, batch.schema.names
        self.node, self.own, self.home, self.visits = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("node", "own", "home", "visits"))
        cells = batch.column(names.index("cells"))
        size = cells.value_lengths().to_numpy()
        row, cell = np.repeat(np.arange(len(size)), size), cells.flatten().to_numpy()
        homes = np.flatnonzero(self.home)
        self.homes = homes[np.argsort(self.own[homes], kind="stable")]
        of = self.own[self.homes]
        use = self.visits[row] & (np.searchsorted(of, cell, "right") > np.searchsorted(of, cell))
        row, cell = row[use], cell[use]
        order = np.argsort(cell, kind="stable")
        self.row, self.cell = row[order], cell[order]

    def cells(self) -> Iterator[tuple[int, np.ndarray, slice]]:
        """(cell, its homes, the visits to it as a slice of row) of every cell with both."""
        of = self.own[self.homes]
        if not len(self.cell):
            return
        heads = np.flatnonzero(np.concatenate(([True], np.diff(self.cell) != 0)))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(self.cell)], strict=True):
            c = self.cell[a]
            yield int(c), self.homes[np.searchsorted(of, c) : np.searchsorted(of, c, "right")], slice(a, b)


def _candidates(cosine: float):
    """Leaves out rows, and visits of rows, whose places along the main axes are too far from all they would be compared with."""
    # rounding moves each coordinate by half a step at most; the sums below are whole numbers, exact in single precision
    most = (np.sqrt(max(0.0, 2 - 2 * cosine)) * STEPS + np.sqrt(AXES) + 1e-3) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            block, names = _Block(batch), batch.schema.names
            place = np.ascontiguousarray(np.stack([batch.column(names.index(p)).to_numpy() for p in PLACES], axis=1)).view(np.int8).astype(np.float32)
            norm = (place * place).sum(1)
            wanted, visit = np.zeros(batch.num_rows, bool), np.zeros(len(block.row), bool)
            for _, h, span in block.cells():
                o = block.row[span]
                tile = max(1, PAIRS // len(h))
                for k in range(0, len(o), tile):
                    i = o[k : k + tile]
                    near = norm[i][:, None] + norm[h] - 2 * (place[i] @ place[h].T) <= most
                    near &= block.node[i][:, None] != block.node[h]
                    visit[span.start + k : span.start + k + len(i)] = near.any(1)
                    wanted[h] |= near.any(0)
            row, cell = block.row[visit], block.cell[visit]
            some = wanted.copy()
            some[row] = True
            keep = np.flatnonzero(some)
            order = np.argsort(row, kind="stable")
            size = np.bincount(row, minlength=batch.num_rows)[keep]
            kept = batch.take(pa.array(keep))
            columns = {c: kept.column(names.index(c)) for c in (*_KEYS, "node", "own", "seen")} | {
                "home": pa.array(wanted[keep]), "visits": pa.array(size > 0), "cells": _lists(cell[order], np.concatenate(([0], np.cumsum(size)))),
            }
            yield pa.RecordBatch.from_arrays([columns[c] for c in _KEPT], list(_KEPT))

    return run


_KEPT = {"g": "bigint", "region": "int", "r": "int", "c": "int", "node": "bigint", "own": "int", "home": "boolean", "visits": "boolean", "cells": "array<int>", "seen": "array<int>"}


def linked(v: np.ndarray, i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows i are linked with which rows j; left and right hold them in single precision. Cosines too near to the threshold for single precision are summed in one fixed order, the same from both ends."""
    s = left @ right.T
    slack = np.float32(max(1e-6, 4 * v.shape[1] * 6e-8))
    out = s >= cosine + slack
    a, b = np.nonzero(~out & (s >= cosine - slack))
    for k in range(0, len(a), 1 << 15):
        x, y = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
        out[x, y] = (v[i[x]] * v[j[y]]).sum(1) >= cosine
    return out


def _verify(cosine: float):
    def result(batch: pa.RecordBatch) -> list[np.ndarray]:
        block, names = _Block(batch), batch.schema.names
        n, v = batch.column(names.index("n")).to_numpy().astype(np.float64), unit(batch.column(names.index("v")))
        narrow = v.astype(np.float32)
        seen = batch.column(names.index("seen"))
        at, seen = np.concatenate(([0], np.cumsum(seen.value_lengths().to_numpy()))), seen.flatten().to_numpy()
        count = np.zeros(len(n))
        us, ws = [], []
        for _, h, span in block.cells():
            o = block.row[span]
            # which homes visit the cells of their visitors, and so count the pair themselves
            cells, cell_of = np.unique(block.own[o], return_inverse=True)
            sees = np.zeros((len(h), len(cells)), bool)
            for k, x in enumerate(h.tolist()):
                sees[k] = np.isin(cells, seen[at[x] : at[x + 1]])
            place = {x: k for k, x in enumerate(h.tolist())}
            others, all_see = narrow[o], sees.all()

            def near(i: np.ndarray, j: np.ndarray, sees=sees, place=place, cell_of=cell_of, others=others, all_see=all_see) -> np.ndarray:
                link = linked(v, i, j, narrow[i], others, cosine)
                link &= block.node[i][:, None] != block.node[j]
                count[j] += n[i] @ link
                if not all_see:
                    count[i] += (link & ~sees[[place[x] for x in i.tolist()]][:, cell_of]) @ n[j]
                return link

            u, w = forest(h, o, near, PAIRS)
            us.append(u)
            ws.append(w)
        keep = np.flatnonzero(count > 0)
        u, w = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, ws))
        none = np.zeros(len(u), np.int64)
        return [np.concatenate((block.node[keep], block.node[u])), np.concatenate((count[keep].astype(np.int64), none)), np.concatenate((np.full(len(keep), -1), block.node[w]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in result(batch)], ["node", "links", "other"])

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, recall: float = RECALL, codes: int = CODES, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are rows of equal, non-null label with cosine or more.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null label, link with
    nothing. Vectors of different length link with nothing. Repeated rows are vectors of their own and link with each
    other. component_id is the least vec_id reachable; kept says whether it is the row's own. Other columns aren't read.
    """
    spark = vectors.sparkSession
    number = "float" if vectors.schema[vector].dataType.elementType == T.FloatType() else "double"
    v = vectors.select(vectors[key].cast("bigint").alias("vec_id"), vectors[label].cast("string").alias("label"), vectors[vector].cast(f"array<{number}>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # zeros of either sign are one value
    rows = v.select("vec_id", F.when(usable, F.col("label")).alias("label"), F.when(usable, F.transform("v", lambda x: x + F.lit(0.0).cast(number))).alias("v"))
    rows = cut(rows.withColumns({"a": F.xxhash64("v"), "b": F.xxhash64(F.lit(1), "v"), "usable": F.col("v").isNotNull()}), "vectors")
    keyed = ["label", "a", "b"]
    classes = rows.filter("usable").groupBy(*keyed).agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    classes, spent = write(classes.withColumns({"node": F.monotonically_increasing_id(), "size": F.size("v")}), "vector-classes")
    labels = classes.groupBy("size", "label").agg(F.count(F.lit(1)).alias("count"))
    labels = cut(labels.select("*", F.monotonically_increasing_id().alias("g"), F.ceil(F.sqrt(F.col("count") / HOMES)).cast("int").alias("fine"), F.ceil(F.sqrt(F.col("count") / REGION)).cast("int").alias("side")), "labels")
    grids = {}
    for size, most in labels.groupBy("size").agg(F.max("fine").alias("most"), F.sum("count").alias("all")).orderBy(F.desc("all")).limit(LENGTHS).select("size", "most").collect():
        wanted = min(codes, most)
        chosen = classes.filter(F.col("size") == size).orderBy(F.xxhash64("a", F.lit("sample")), "node").limit(max(sample, PER_CODE * wanted)).select("v").toPandas()["v"]
        grids[size] = Grid.fit(unit(pa.array(chosen.tolist(), pa.list_(pa.float64()))), wanted, cosine, recall)
    copies, visited = write(_visits(classes, labels, spark.sparkContext.broadcast(grids)), "visits")  # some MB at CODES codes
    pairs = cut(_links(copies, classes, cosine, block), "links")
    discard(spark, visited)
    together = components(pairs.filter("other <> -1").select(F.col("node").alias("u"), F.col("other").alias("v"))).select("node", "root")
    counts = pairs.filter("links > 0").groupBy("node").agg(F.sum("links").alias("others"))
    full = classes.drop("v").join(counts, "node", "left").join(together, "node", "left")
    full = full.select(*keyed, F.coalesce("root", "node").alias("root"), "least", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    roots = full.groupBy("root").agg(F.min("least").alias("component"))
    named = cut(full.join(roots, "root").select(F.col("label").alias("l"), F.col("a").alias("x"), F.col("b").alias("y"), "n_links", "component"), "named")
    discard(spark, spent)
    on = (F.col("label") == F.col("l")) & (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))
    out = rows.filter("usable").join(named, on).select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    # rows that link with nothing don't meet at a null key
    out = out.unionByName(rows.filter("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _visits(classes: DataFrame, labels: DataFrame, grids) -> DataFrame:
    """A row for every region that a vector visits: its cells there and its place, without the vector."""
    placed = classes.join(labels.select(F.col("label").alias("l"), F.col("size").alias("s"), "g", "fine", "side"), (F.col("label") == F.col("l")) & (F.col("size") == F.col("s")))
    longs = ", ".join(f"{p} bigint" for p in PLACES)
    schema = f"g bigint, region int, node bigint, own int, home boolean, cells array<int>, seen array<int>, {longs}"
    return placed.select("g", "node", "fine", "side", "v").mapInArrow(tidy(_index(grids)), schema)


def _links(copies: DataFrame, classes: DataFrame, cosine: float, block: int) -> DataFrame:
    """(node, links, other): linked rows of a node by block, with other -1; and edges that connect what is linked, with links 0."""
    size = copies.groupBy("g", "region").agg(F.count(F.lit(1)).alias("m"), F.count_if("home").alias("h")).filter(F.col("m") > block)
    hot = size.select(F.col("g").alias("hg"), F.col("region").alias("hr"), F.ceil(F.col("m") / block).cast("int").alias("cols"), F.ceil(F.greatest("h", F.lit(1)) / block).cast("int").alias("rows"))
    dealt = copies.join(hot, (F.col("g") == F.col("hg")) & (F.col("region") == F.col("hr")), "left")
    rows, cols, mix = F.coalesce("rows", F.lit(1)), F.coalesce("cols", F.lit(1)), F.xxhash64("node")
    own_row, own_col = F.pmod(mix, rows).cast("int"), F.pmod(mix, cols).cast("int")
    # a home meets every block of visitors, a visitor every block of homes
    along = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), cols - 1), lambda c: F.struct(own_row.alias("r"), c.alias("c")))).otherwise(F.array())
    down = F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.struct(r.alias("r"), own_col.alias("c")))
    spread = dealt.select("*", own_row.alias("i"), own_col.alias("j"), F.explode(F.array_distinct(F.concat(along, down))).alias("p"))
    home = F.col("home") & (F.col("p.r") == F.col("i"))
    spread = spread.select("g", "region", "p.r", "p.c", "node", "own", home.alias("home"), (F.col("p.c") == F.col("j")).alias("visits"), "cells", F.when(home, F.col("seen")).otherwise(F.array().cast("array<int>")).alias("seen"), *PLACES)
    found = spread.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(tidy(_candidates(cosine)), ", ".join(f"{c} {t}" for c, t in _KEPT.items()))
    full = found.join(classes.select(F.col("node").alias("id"), "n", "v"), F.col("node") == F.col("id")).select(*_KEPT, "n", "v")
    return full.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(tidy(_verify(cosine)), "node bigint, links bigint, other bigint")


ORACLE = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reached AS (SELECT r AS a, r AS b FROM v UNION SELECT reached.a, l.b FROM reached JOIN l ON reached.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = v.r)::BIGINT AS n_links, c.component AS component_id, vec_id = c.component AS kept
FROM v JOIN (SELECT reached.a, min(w.vec_id) AS component FROM reached JOIN v w ON w.r = reached.b GROUP BY reached.a) c ON c.a = v.r
"""
