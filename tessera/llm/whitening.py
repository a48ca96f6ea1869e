"""Embedding whitening by matrix-free block subspace iteration.

An entry c becomes the integer floor(1024 * c) + 100000; sums of those are exact, so rows are centred exactly. The
covariance matrix is never formed: each Spark pass multiplies it by a block, Z'(ZQ) / n over the centred rows Z, from
partial sums that tasks make. What the driver holds has one row a dimension, however many vectors there are.

A pass multiplies the block that the last one gave, made orthonormal (QR) to all blocks before it. A Rayleigh-Ritz step over
the kept blocks gives the components so far; their residuals certify them: the passes end when all k residuals are
within TOLERANCE of the largest eigenvalue, or where the space is used up. Keeping earlier blocks is what makes few
passes do where eigenvalues lie close together (isotropic vectors); beyond KEEP blocks the best directions go on alone.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.memory import tidy
from tessera.llm.storage import arrow_batches, fresh

COMPONENTS = 8
# An entry's scale and offset.
SCALE, OFFSET = 1024.0, 100000
#: Columns of a block beyond the components, blocks that are kept, and the most passes.
SPARE, KEEP, PASSES = 8, 12, 1000
#: Residual of a component, as a share of the largest eigenvalue, that certifies it; eigenvalues below FLAT of it count as zero.
TOLERANCE, FLAT = 2e-14, 1e-12
#: Past this a residual that no longer falls is as small as the sums' rounding lets it be.
STALLED = 1e-12
#: Entries of a row from which on its integers would not be exact.
LARGEST = 2.0**42
#: Entries that are worked on at once.
STEP = 1 << 20


@dataclass
class Fit:
    """What the passes over all vectors gave. ``sums`` and ``n`` are exact; components are columns, by falling eigenvalue."""

    n: int
    sums: list[int]
    bound: int
    trace: float = 0.0
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    residuals: np.ndarray = field(default_factory=lambda: np.zeros(0))
    passes: int = 0
    identity_error: float = 0.0

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as int64 where that holds it, else as Python integers."""
        if self.n * self.bound < 1 << 61:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.spread(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n * x - S) squared, exact."""
        d = self.spread(x)
        if d.dtype != object and d.size and int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 63:
            d = d.astype(object)
        return (d * d).sum(1).tolist()

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values))


def integers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The integers, a row a vector, of an Arrow list column without nulls whose vectors have one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(flat * SCALE).astype(np.int64) + OFFSET).reshape(len(vectors), -1)


def _usable(vectors: DataFrame, name: str) -> DataFrame:
    """Rows whose vector is neither null nor holds a null, an entry that isn't finite, or one beyond LARGEST."""
    fit = lambda e: e.isNotNull() & (F.abs(e.cast("double")) < F.lit(LARGEST))  # noqa: E731  NaN counts as larger than any number
    return vectors.filter(F.col(name).isNotNull()).filter(F.forall(name, fit))


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, place, n) of a task's vectors: their number at place -1, the largest integer at -2, the sums by dimension."""
    sums: dict[int, list] = {}
    for batch in batches:
        sizes = np.diff(np.asarray(batch.column(0).offsets))
        for size in np.unique(sizes).tolist():
            x = integers(batch.column(0).filter(pa.array(sizes == size))) if size else np.zeros((int((sizes == 0).sum()), 0), np.int64)
            known = sums.setdefault(size, [0, 0, [0] * size])
            known[0] += len(x)
            known[1] = max(known[1], int(np.abs(x).max(initial=0)))
            exact = x if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62 else x.astype(object)
            known[2] = [a + int(b) for a, b in zip(known[2], exact.sum(0), strict=True)]
    for size, (n, most, total) in sums.items():
        yield pa.RecordBatch.from_pydict({"length": pa.array([size] * (size + 2), pa.int32()), "place": pa.array([-1, -2, *range(size)], pa.int32()), "n": pa.array([str(v) for v in (n, most, *total)])})


def _product(spread, work):
    """Sums over a task's vectors of what ``work`` makes of each step's centred rows, one row (place, v) an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, q = spread.value
        total = None
        for batch in batches:
            step = max(1, STEP // max(1, fit.dimensions))
            for k in range(0, batch.num_rows, step):
                part = work(fit, integers(batch.column(0).slice(k, step)), q)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["place", "v"])

    return run


def _summed(vectors: DataFrame, fit: Fit, q: np.ndarray, work, shape: tuple) -> np.ndarray:
    """One Spark pass: ``shape`` numbers come to the driver, as many a task are shuffled."""
    spread = vectors.sparkSession.sparkContext.broadcast((fit, q))  # dimensions x block
    rows = vectors.mapInArrow(tidy(_product(spread, work)), "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).collect()
    spread.unpersist()
    out = np.zeros(int(np.prod(shape)))
    for r in rows:
        out[r.place] = r.v
    return out.reshape(shape)


def _multiply(fit: Fit, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Z'(ZQ) with Z's squares added up in one more row."""
    z = fit.centred(x)
    return np.vstack((z.T @ (z @ q), np.full((1, q.shape[1]), (z * z).sum())))


def _second_moment(fit: Fit, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    w = fit.whiten(x)
    return np.vstack((w.T @ w, w.sum(0)))


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """QR of what is left of a block outside the basis, twice for accuracy; directions that are no more than rounding go."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10]
    return np.linalg.qr(block)[0] if block.shape[1] else block


def iterate(multiply, dimensions: int, components: int = COMPONENTS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(eigenvalues, eigenvectors as columns, residuals, passes) of the matrix that ``multiply`` applies to a block."""
    k = min(components, dimensions)
    width = min(dimensions, k + SPARE)
    block = np.linalg.qr(np.random.default_rng(11).normal(size=(dimensions, width)))[0]
    basis, image, last = np.zeros((dimensions, 0)), np.zeros((dimensions, 0)), np.inf
    for done in range(1, PASSES + 1):
        basis, image = np.hstack((basis, block)), np.hstack((image, multiply(block)))
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        values, turn = values[order], turn[:, order]
        ritz, moved = basis @ turn, image @ turn
        rest = moved[:, :width] - ritz[:, :width] * values[:width]
        size = np.linalg.norm(rest, axis=0) / max(values[0], 1e-300)
        worst = float(size[:k].max(initial=0))
        if worst <= tolerance or worst < STALLED and worst >= last / 2 or values[0] <= 0:
            break
        last = min(last, worst)
        if basis.shape[1] + width > max(KEEP * width, 2 * width) and basis.shape[1] < dimensions:
            basis, image = ritz[:, : 2 * width], moved[:, : 2 * width]
        block = _orthonormal(rest, basis)
        if not block.shape[1]:
            break
    return values[:k], np.linalg.qr(ritz[:, :k])[0], size[:k], done


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Fit:
    """Exact sums, components and the whitening's identity error over all usable vectors of the most frequent length.

    Of lengths as frequent as each other the longest counts. Components whose variance is none (below FLAT of the
    largest) are left out: nothing can be divided by their root. An empty table has no components.
    """
    arrow_batches(vectors.sparkSession)
    only = _usable(vectors.select(vectors[vector].alias("v")), "v")
    found: dict[int, dict[int, int]] = {}
    summed = only.mapInArrow(tidy(_start), "length int, place int, n string")
    number = F.col("n").cast("decimal(38,0)")
    for r in summed.groupBy("length", "place").agg(F.sum(number).cast("string").alias("total"), F.max(number).cast("string").alias("most")).collect():  # a row a dimension
        found.setdefault(r.length, {})[r.place] = int(r.most if r.place == -2 else r.total)
    if not found:
        return Fit(0, [], 0)
    length = max(found, key=lambda size: (found[size][-1], size))
    mine = found[length]
    out = Fit(mine[-1], [mine[d] for d in range(length)], mine[-2])
    if not length:
        return out
    only = only.filter(F.size("v") == length)

    def multiply(q: np.ndarray) -> np.ndarray:
        got = _summed(only, out, q, _multiply, (length + 1, q.shape[1]))
        out.trace = float(got[-1, 0]) / out.n
        return got[:-1] / out.n

    values, vectors_, residuals, out.passes = iterate(multiply, length, components)
    live = values > max(values[0] * FLAT, 0) if len(values) else values > 0
    out.values, out.components, out.residuals = values[live], vectors_[:, live], residuals[live]
    k = len(out.values)
    if k:
        got = _summed(only, out, np.zeros((0, 0)), _second_moment, (k + 1, k)) / out.n
        out.identity_error = float(np.abs(got[:-1] - np.outer(got[-1], got[-1]) - np.eye(k)).max())
    return out


def whitened(df: DataFrame, model: Fit, vector: str = "embedding", name: str = "whitened") -> DataFrame:
    """The usable rows of df of the model's length with an array of their whitened components, all columns kept.

    A column of df that bears the new one's name is left out.
    """
    return _added(df, model, vector, f"`{name}` array<double>", name)


def _added(df: DataFrame, model: Fit, vector: str, schema: str, name: str, keep: list[str] | None = None, deviations: bool = False) -> DataFrame:
    arrow_batches(df.sparkSession)
    body = fresh(df, "body")[0]
    kept = df.select(*[c for c in (df.columns if keep is None else keep) if c.lower() != name.lower()], df[vector].alias(body))
    kept = _usable(kept, body).filter((F.size(body) == model.dimensions) & F.lit(len(model.values) > 0))
    spread = df.sparkSession.sparkContext.broadcast(model)  # dimensions x components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = spread.value
        k = len(fit.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(batch.column(batch.num_columns - 1))
            w = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * k + 1, k, dtype=np.int32)), pa.array(fit.whiten(x).ravel()))
            columns, names = [*batch.columns[:-1], w], [*batch.schema.names[:-1], name]
            if deviations:
                columns, names = [*columns, pa.array([str(d) for d in fit.deviation(x)])], [*names, "wide"]
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [schema])
    return kept.mapInArrow(tidy(run), fields)


def report(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, model: Fit | None = None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) of every usable row and component.

    Rows whose vector is null, holds a null or an entry that isn't finite or is 2**42 or more, or has another length
    than most, are left out; copies each get their rows, null ids included. ``deviation`` is null where it exceeds a
    long (many millions of vectors); ``deviation_exact`` holds it as text always.
    """
    model = model or fit(df, vector, components)
    d = _added(df.select(df[key].alias("vec_id"), df[vector].alias("v")), model, "v", "whitened array<double>, wide string", "whitened", ["vec_id"], deviations=True)
    each = d.select("vec_id", "wide", F.posexplode("whitened").alias("place", "whitened"))
    total = model.trace or 1.0
    share = F.element_at(F.array(*(F.lit(float(v / total)) for v in model.values)) if len(model.values) else F.array(F.lit(0.0)), F.col("place") + 1)
    return each.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), F.col("wide").try_cast("bigint").alias("deviation"), "whitened",
        share.alias("explained"), F.lit(model.identity_error).alias("identity_error"), F.col("wide").alias("deviation_exact"),
    )
