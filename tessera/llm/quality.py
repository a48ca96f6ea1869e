"""Quality scores by attention-based multiple-instance learning: a document is a bag of passages with one label.

Every passage (PASSAGE bytes of the whole text, the last one shorter) is encoded: the square roots of its byte n-grams'
shares (orders one to three, digits alike, hashed), and how much it repeats itself, pass one dense layer. Gated attention
(a tanh and a sigmoid layer, multiplied) weighs the passages; the weights, like all others, are learned from document
labels alone. The weighted sum of the encodings is the document's representation, which a logistic layer scores.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.memory import tidy
from tessera.llm.storage import arrow_batches, fresh
from tessera.llm.words import string_bytes

PASSAGE = 512
#: Hash buckets of n-grams of two and three bytes; single bytes have 256 columns before them, three measures stand behind.
BUCKETS = 1 << 12
GRAMS = 256 + BUCKETS
WIDTH = GRAMS + 3
#: Sizes of the encoding and of the attention.
ENCODE, ATTEND = 24, 16
#: Bound of the training sample: documents of each label.
PER_LABEL = 1000
EPOCHS, BATCH, RATE, DECAY = 6, 16, 0.003, 1e-4
#: The passes for few documents end no sooner than this number of steps.
STEPS = 400
#: Passages that are laid out densely at once, and bytes of text that are looked at once.
STEP, STEP_BYTES = 512, 1 << 20
FOLDS, HELD_OUT, LEAST = 4, 2, 0.7

_DIGITS = np.arange(256, dtype=np.uint8)
_DIGITS[48:58] = 48


def passages(size: np.ndarray) -> np.ndarray:
    """Passages of texts with so many bytes; an empty text has none."""
    return -(-size // PASSAGE)


@dataclass
class Bags:
    """Passages of some texts: all bytes, where each passage begins, ends and its text ends, and each text's first passage."""

    raw: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    last: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> "Bags":
        raw, offsets = string_bytes(texts)
        n = passages(np.diff(offsets))
        first = np.concatenate(([0], np.cumsum(n)))
        begin = np.repeat(offsets[:-1], n) + (np.arange(first[-1]) - np.repeat(first[:-1], n)) * PASSAGE
        last = np.repeat(offsets[1:], n)
        return cls(raw, begin, np.minimum(begin + PASSAGE, last), last, first)

    def dense(self, a: int, b: int) -> np.ndarray:
        """Passages a to b as rows: roots of the n-grams' shares, and three measures of repetition. An n-gram belongs to the passage that it begins in."""
        low, high = self.begin[a], self.end[b - 1]
        raw = _DIGITS[self.raw[low : high + 2]]
        size = self.end[a:b] - self.begin[a:b]
        row, left = np.repeat(np.arange(b - a), size), np.repeat(self.last[a:b], size) - np.arange(low, high)
        cells, code = [row * GRAMS + raw[: len(row)]], raw.astype(np.uint32)
        for order in (2, 3):
            code = code[:-1] << np.uint32(8) | raw[order - 1 :] if len(raw) >= order else code[:0]
            h = (code * np.uint32(0x9E3779B1) + np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(20)
            whole = np.flatnonzero(left[: len(code)] >= order)  # none runs into the next text
            cells.append(row[whole] * GRAMS + 256 + h[whole])
        share = np.bincount(np.concatenate(cells), minlength=(b - a) * GRAMS).reshape(b - a, GRAMS).astype(np.float32)
        total = share.sum(1)
        out = np.empty((b - a, WIDTH), np.float32)
        out[:, GRAMS] = np.count_nonzero(share, 1) / total
        share /= total[:, None]
        out[:, GRAMS + 1] = -np.log(np.maximum(np.einsum("pg,pg->p", share, share), 1e-12)) / 6
        out[:, GRAMS + 2] = np.log(total) / 8
        np.sqrt(share, out=out[:, :GRAMS])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _shapes() -> dict[str, tuple]:
    return {"W": (WIDTH, ENCODE), "b": (ENCODE,), "V": (ENCODE, ATTEND), "U": (ENCODE, ATTEND), "w": (ATTEND,), "v": (ENCODE,), "c": (1,)}


class Network:
    """Parameters by name; ``shift`` turns the training sample's share of labels into that of all labels."""

    def __init__(self, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        scale = {"W": 0.6, "V": 0.4, "U": 0.4, "w": 0.4, "v": 0.4}
        self.p = {k: (rng.normal(size=s) * scale.get(k, 0)).astype(np.float32) for k, s in _shapes().items()}
        self.shift = 0.0

    def encode(self, bags: Bags, a: int, b: int) -> np.ndarray:
        """One row per passage a to b; never more than STEP passages are laid out at once."""
        out = np.empty((b - a, ENCODE), np.float32)
        for k in range(a, b, STEP):
            x = bags.dense(k, min(b, k + STEP))
            out[k - a : k - a + len(x)] = np.tanh(x @ self.p["W"] + self.p["b"])
        return out

    def attention(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, s = np.tanh(h @ self.p["V"]), _sigmoid(h @ self.p["U"])
        return (t * s) @ self.p["w"], t, s

    def logits(self, bags: Bags) -> np.ndarray:
        """Per text, the shift included; that of a text without passages is its offset."""
        h = self.encode(bags, 0, int(bags.first[-1]))
        a, _, _ = self.attention(h)
        n = np.diff(bags.first)
        out = np.full(len(n), float(self.p["c"][0]))
        some = np.flatnonzero(n)
        if len(some):
            at = bags.first[some]
            weight = np.exp(a - np.repeat(np.maximum.reduceat(a, at), n[some]))
            z = np.add.reduceat(weight[:, None] * h, at, axis=0) / np.add.reduceat(weight, at)[:, None]
            out[some] += z @ self.p["v"]
        return out + self.shift

    def scores(self, bags: Bags) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(bags), -60, 60)))

    def gradients(self, bags: Bags, label: float) -> tuple[dict[str, np.ndarray], float]:
        """Of the logistic loss of one document, and its loss."""
        p, n = self.p, int(bags.first[-1])
        h = self.encode(bags, 0, n)
        a, t, s = self.attention(h)
        weight = np.exp(a - a.max())
        weight /= weight.sum()
        z = weight @ h
        logit = float(z @ p["v"] + p["c"][0])
        d = float(_sigmoid(np.array(logit)) - label)
        d_z = d * p["v"]
        g = {"v": d * z, "c": np.array([d], np.float32)}
        d_a = weight * (h @ d_z - float(z @ d_z))
        g["w"] = (t * s).T @ d_a
        d_t, d_s = d_a[:, None] * p["w"] * s * (1 - t * t), d_a[:, None] * p["w"] * t * s * (1 - s)
        g["V"], g["U"] = h.T @ d_t, h.T @ d_s
        d_h = (weight[:, None] * d_z + d_t @ p["V"].T + d_s @ p["U"].T) * (1 - h * h)
        g["b"], g["W"] = d_h.sum(0), np.zeros_like(p["W"])
        for k in range(0, n, STEP):
            g["W"] += bags.dense(k, min(n, k + STEP)).T @ d_h[k : k + STEP]
        return g, float(np.logaddexp(0, logit) - label * logit)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Network:
    """The network after Adam steps over shuffled batches of documents; empty texts teach nothing."""
    net = Network()
    use = [k for k, t in enumerate(texts) if t]
    known = {labels[k] for k in use}
    if len(known) < 2:  # nothing to tell apart: all texts get the one label's side
        net.p["v"][:] = 0
        net.p["c"][0] = 4.0 if known != {0} else -4.0
        return net
    bags = {k: Bags.of(pa.array([texts[k]], pa.large_string())) for k in use}
    rng, step = np.random.default_rng(6), 0
    m, v = ({k: np.zeros(s, np.float32) for k, s in _shapes().items()} for _ in range(2))
    rounds = max(epochs, -(-STEPS // -(-len(use) // BATCH)))
    total = rounds * -(-len(use) // BATCH)
    for _ in range(rounds):
        order = rng.permutation(np.array(use))
        for at in range(0, len(order), BATCH):
            batch, mean = order[at : at + BATCH], None
            for k in batch.tolist():
                g, _ = net.gradients(bags[k], labels[k])
                mean = g if mean is None else {name: mean[name] + g[name] for name in g}
            step += 1
            rate = RATE * min(1.0, 2 * (1 - step / (total + 1))) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, value in mean.items():
                value = value / len(batch) + DECAY * net.p[name]
                m[name] = 0.9 * m[name] + 0.1 * value
                v[name] = 0.999 * v[name] + 0.001 * value * value
                net.p[name] -= (rate * m[name] / (np.sqrt(v[name]) + 1e-8)).astype(np.float32)
    return net


def _fold(column):
    return F.crc32(column.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = PER_LABEL) -> Network:
    """The network of labelled documents whose fold (crc32 of the id as text, modulo 4) isn't 2.

    At most per_label documents of each label, chosen by a hash of the id, are gathered; labels other than 0 and 1 and
    null or empty texts are left out. The score's offset follows the share of labels among all learnable labels. A
    document that is labelled twice is learned from twice, with both labels if they differ.
    """
    known = labels.select(labels[key].alias("k"), labels[label].cast("int").alias("y")).filter("k is not null and y in (0, 1)").filter(_fold(F.col("k")) != HELD_OUT)
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    place = F.xxhash64("k", F.lit("sample"))
    chosen = known.filter("y = 1").orderBy(place, "k").limit(per_label).unionByName(known.filter("y = 0").orderBy(place, "k").limit(per_label))
    # per_label rows of each label at most: 2 * PER_LABEL ids are broadcast
    body = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t")).filter("t <> ''").join(F.broadcast(chosen), "k")
    rows = sorted((r.k, r.t, r.y) for r in body.orderBy(place, "k").limit(2 * per_label).toLocalIterator())
    net = train([r[1] for r in rows], [r[2] for r in rows])
    taken = [sum(r[2] == y for r in rows) for y in (0, 1)]
    if all(taken):
        net.shift = float(np.log(sizes[1] / sizes[0]) - np.log(taken[1] / taken[0]))
    return net


def _score(spread, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = spread.value
        for batch in batches:
            text, parts, start = batch.column(batch.num_columns - 1), [], 0
            ends = np.cumsum(np.diff(string_bytes(text)[1]))
            while start < batch.num_rows:
                base = ends[start - 1] if start else 0
                stop = min(batch.num_rows, max(start + 1, int(np.searchsorted(ends, base + STEP_BYTES))))
                parts.append(net.scores(Bags.of(text.slice(start, stop - start))))
                start = stop
            made = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made)], [*batch.schema.names[:-1], name])

    return run


def scored(docs: DataFrame, network: Network, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """docs (or its columns in ``keep``) and the score, 0 to 1, of every row's whole text; null and empty texts have no passage and get the offset's score.

    A column of docs that bears the score's name is left out.
    """
    arrow_batches(docs.sparkSession)
    kept = docs.select(*[c for c in (docs.columns if keep is None else keep) if c.lower() != name.lower()], docs[text].cast("string").alias(fresh(docs, "body")[0]))
    spread = docs.sparkSession.sparkContext.broadcast(network)  # WIDTH x ENCODE numbers and a few more: 420 KB
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [f"`{name}` double"])
    return kept.mapInArrow(tidy(_score(spread, name)), schema)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", network: Network | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; predicted is 1 from a score of LEAST.

    A null id is neither learned from nor held out. Without labels of both kinds all scores are equal. Repeated rows
    each get a row; other columns of docs are not read.
    """
    network = network or fit(docs, labels, key, text, label)
    d = scored(docs.select(docs[key].alias("doc_id"), docs[text].alias("t")), network, "t", keep=["doc_id"])
    return d.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))
