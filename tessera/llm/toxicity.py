"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words (runs of 0-9, letters and characters from U+0080, A-Z in lower case) enter with two learned vectors: one
of the word itself, if enough training texts have it, and the mean of its character n-grams' (three and four bytes, with
marks at both ends). Labels reach the network through its loss alone. In training each word loses either vector now and
then, so that neither leans on the other. Windows of WINDOW words start every STRIDE words, the last ends with the text,
so every word is scored, most in two windows. Each window is read in both directions; attention weighs the states; a
text's score is its highest window's. In training the highest window carries the text's label.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.memory import tidy
from tessera.llm.storage import arrow_batches, fresh
from tessera.llm.words import hashes, string_bytes, word_spans

WINDOW, STRIDE = 64, 48
#: Sizes of the word, n-gram and state vectors (states per direction) and of the attention.
WORD, GRAM, STATE, ATTEND = 12, 12, 12, 12
#: Bound of the training sample: documents of each label. Words and n-grams of at least RARE of them have vectors.
PER_LABEL, RARE, MOST_WORDS, MOST_GRAMS = 1000, 3, 20_000, 30_000
EPOCHS, BATCH, RATE, DECAY = 4, 32, 0.01, 1e-4
#: Chance that a word's vector, and that its n-grams' mean, is left out of a training step.
LEFT_OUT = 0.2
#: The passes for few documents end no sooner than this number of steps.
STEPS = 250
#: Bytes of text whose words are looked up at once, and windows that are scored at once.
STEP_BYTES, STEP_WINDOWS = 1 << 19, 1024
FOLDS = 5


def windows(n: int) -> list[int]:
    """First words of a text's windows."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def word_grams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of every n-gram of every word, word of every n-gram); a code holds the bytes themselves."""
    size = ends - starts + 2
    bound = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(len(starts)), size)
    within = np.arange(bound[-1]) - bound[owner]
    inner = (within > 0) & (within < size[owner] - 1)
    letter = np.ones(bound[-1], np.uint32)
    letter[inner] = raw[(starts[owner] + within - 1)[inner]]
    letter[inner & (letter >= 65) & (letter <= 90)] += 32
    codes, owners = [], []
    for order in (3, 4):
        if len(letter) >= order:
            code = np.zeros(len(letter) - order + 1, np.uint32)
            for k in range(order):
                code = code << np.uint32(8) | letter[k : len(letter) - order + 1 + k]
            same = owner[: len(code)] == owner[order - 1 :]
            codes.append(code[same])
            owners.append(owner[: len(code)][same])
    if not codes:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    code, own = np.concatenate(codes), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return code[order], own[order]


@dataclass
class Words:
    """The words of some texts: distinct words with their hashes and n-grams, and which word stands where."""

    word: np.ndarray
    gram: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> "Words":
        raw, offsets = string_bytes(texts)
        starts, ends, first = word_spans(raw, offsets)
        word, place, at = np.unique(hashes(raw, starts, ends), return_index=True, return_inverse=True)
        gram, owner = word_grams(raw, starts[place], ends[place])
        return cls(word, gram, owner, at, first)


def _lookup(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Row of each value in the sorted known values, len(known) for others."""
    if not len(known):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, len(known))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters by name; vectors of unknown words and n-grams are the last row, which stays zero."""

    words: np.ndarray
    grams: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, words: np.ndarray, grams: np.ndarray, seed: int = 3) -> "Network":
        rng = np.random.default_rng(seed)
        some = lambda *shape, scale=0.1: (rng.normal(size=shape) * scale).astype(np.float32)
        net = cls(words, grams, {"E": some(len(words) + 1, WORD), "G": some(len(grams) + 1, GRAM)})
        net.p["E"][-1] = net.p["G"][-1] = 0
        for d in ("f", "b"):
            net.p |= {f"Wx{d}": some(WORD + GRAM, 3 * STATE, scale=0.4), f"Wh{d}": some(STATE, 3 * STATE, scale=0.3), f"bx{d}": np.zeros(3 * STATE, np.float32)}
        net.p |= {"A": some(2 * STATE, ATTEND, scale=0.4), "a": some(ATTEND, scale=0.4), "v": some(2 * STATE, scale=0.4), "c": np.zeros(1, np.float32)}
        return net

    def inputs(self, w: Words, drop: np.random.Generator | None = None) -> tuple[np.ndarray, tuple]:
        """A vector per distinct word, and one of zeros at the end for places beyond a text's end."""
        e, g = _lookup(self.words, w.word), _lookup(self.grams, w.gram)
        n = np.maximum(np.bincount(w.owner, minlength=len(w.word)), 1).astype(np.float32)
        kept = np.ones((2, len(w.word)), np.float32) if drop is None else (drop.random((2, len(w.word))) >= LEFT_OUT).astype(np.float32)
        mean = np.zeros((len(w.word), GRAM), np.float32)
        if len(g):
            heads = np.flatnonzero(np.concatenate(([True], w.owner[1:] != w.owner[:-1])))
            mean[w.owner[heads]] = np.add.reduceat(self.p["G"][g], heads, axis=0)
        scale = kept[1] / n
        x = np.concatenate((self.p["E"][e] * kept[0][:, None], mean * scale[:, None]), axis=1)
        return np.concatenate((x, np.zeros((1, x.shape[1]), np.float32))), (e, g, kept[0], scale)

    def _scan(self, d: str, x: np.ndarray, idx: np.ndarray, mask: np.ndarray | None, keep: bool):
        """States of one direction: steps x windows x STATE."""
        steps = range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1)
        wx, wh = self.p[f"Wx{d}"], self.p[f"Wh{d}"]
        table = x @ wx + self.p[f"bx{d}"]
        h = np.zeros((len(idx), STATE), np.float32)
        out = np.empty((WINDOW, len(idx), STATE), np.float32)
        tape = []
        for t in steps:
            g, u = table[idx[:, t]], h @ wh
            zr = _sigmoid(g[:, : 2 * STATE] + u[:, : 2 * STATE])
            z, r, un = zr[:, :STATE], zr[:, STATE:], u[:, 2 * STATE :]
            n = np.tanh(g[:, 2 * STATE :] + r * un)
            new = n + z * (h - n)
            if mask is not None:
                new = np.where(mask[:, t : t + 1], new, h)
            if keep:
                tape.append((t, h, z, r, n, un))
            h = out[t] = new
        return out, tape

    def forward(self, x: np.ndarray, idx: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logit per window; with keep also what ``backward`` needs."""
        f, tf = self._scan("f", x, idx, mask, keep)
        b, tb = self._scan("b", x, idx, mask, keep)
        h = np.concatenate((f, b), axis=2)
        q = np.tanh(h @ self.p["A"])
        s = q @ self.p["a"]
        if mask is not None:
            s = np.where(mask.T, s, np.float32(-1e9))
        w = np.exp(s - s.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tn,tnh->nh", w, h)
        return pooled @ self.p["v"] + self.p["c"][0], (h, q, w, pooled, tf, tb)

    def backward(self, x: np.ndarray, idx: np.ndarray, mask: np.ndarray, kept: tuple, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters, and of the input vectors."""
        h, q, w, pooled, tf, tb = kept
        g = {"v": pooled.T @ d_logit, "c": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * self.p["v"]
        d_h = w[:, :, None] * d_pooled
        d_w = np.einsum("tnh,nh->tn", h, d_pooled)
        d_s = w * (d_w - (w * d_w).sum(0))
        g["a"] = np.einsum("tna,tn->a", q, d_s)
        d_q = d_s[:, :, None] * self.p["a"] * (1 - q * q)
        g["A"] = np.einsum("tnh,tna->ha", h, d_q)
        d_h += d_q @ self.p["A"].T
        d_x = np.zeros_like(x)
        for d, tape, part in (("f", tf, d_h[:, :, :STATE]), ("b", tb, d_h[:, :, STATE:])):
            wx, wh = self.p[f"Wx{d}"], self.p[f"Wh{d}"]
            d_table = np.zeros((len(x), 3 * STATE), np.float32)
            d_wh = np.zeros_like(wh)
            carry = np.zeros((len(idx), STATE), np.float32)
            for t, before, z, r, n, un in reversed(tape):
                d = part[t] + carry
                live = mask[:, t : t + 1]
                d_new = np.where(live, d, 0)
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z = d_new * (before - n) * z * (1 - z)
                d_r = d_n * un * r * (1 - r)
                d_u = np.concatenate((d_z, d_r, d_n * r), axis=1)
                np.add.at(d_table, idx[:, t], np.concatenate((d_z, d_r, d_n), axis=1))
                d_wh += before.T @ d_u
                carry = np.where(live, d_new * z + d_u @ wh.T, d)
            name = "f" if tape is tf else "b"
            g[f"Wh{name}"], g[f"Wx{name}"], g[f"bx{name}"] = d_wh, x.T @ d_table, d_table[:-1].sum(0) + d_table[-1]
            d_x += d_table @ wx.T
        return g, d_x

    def scores(self, w: Words) -> np.ndarray:
        """Score of every text: its highest window's, 0 for a text without words."""
        n = np.diff(w.first)
        out = np.zeros(len(n))
        if not len(w.at):
            return out
        x, _ = self.inputs(w)
        logit = np.full(len(n), -np.inf)
        long = np.flatnonzero(n >= WINDOW)
        short = np.flatnonzero((n > 0) & (n < WINDOW))
        if len(long):
            counts = -(-(n[long] - WINDOW) // STRIDE) + 1
            text = np.repeat(long, counts)
            k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            start = w.first[text] + np.minimum(k * STRIDE, n[text] - WINDOW)
            for a in range(0, len(start), STEP_WINDOWS):
                idx = w.at[start[a : a + STEP_WINDOWS, None] + np.arange(WINDOW)]
                np.maximum.at(logit, text[a : a + STEP_WINDOWS], self.forward(x, idx, None)[0])
        for a in range(0, len(short), STEP_WINDOWS):
            some = short[a : a + STEP_WINDOWS]
            idx, mask = _padded(w, w.first[some], n[some], len(x) - 1)
            logit[some] = self.forward(x, idx, mask)[0]
        out[n > 0] = 1 / (1 + np.exp(-np.clip(logit[n > 0].astype(np.float64), -60, 60)))
        return out


def _padded(w: Words, start: np.ndarray, size: np.ndarray, filler: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.arange(WINDOW) < size[:, None]
    place = np.minimum(start[:, None] + np.arange(WINDOW), max(len(w.at) - 1, 0))
    return np.where(mask, w.at[place], filler), mask


def _common(values: list[np.ndarray], least: int, most: int) -> np.ndarray:
    """Values of at least so many texts, the most frequent if there are too many, sorted."""
    v, n = np.unique(np.concatenate([np.unique(x) for x in values]) if values else np.zeros(0, np.uint64), return_counts=True)
    v, n = v[n >= least], n[n >= least]
    return np.sort(v[np.lexsort((v, -n))[:most]])


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Network:
    """The network after Adam steps over shuffled batches; batches hold both labels in the sample's proportion."""
    every = [Words.of(pa.array([t], pa.large_string())) for t in texts]
    filled = [k for k, w in enumerate(every) if len(w.at)]
    net = Network.new(_common([every[k].word for k in filled], RARE, MOST_WORDS), _common([every[k].gram for k in filled], RARE, MOST_GRAMS))
    y = np.array(labels, np.float32)
    if len({labels[k] for k in filled}) < 2:
        net.p["c"][0] = 4.0 if any(labels[k] for k in filled) else -4.0
        net.p["v"][:] = 0
        return net
    rng, drop, moments, step = np.random.default_rng(9), np.random.default_rng(10), {}, 0
    rounds = max(epochs, -(-STEPS // max(1, -(-len(filled) // BATCH))))
    total = rounds * -(-len(filled) // BATCH)
    for _ in range(rounds):
        shuffled = rng.permutation(np.array(filled))
        for at in range(0, len(shuffled), BATCH):
            batch = shuffled[at : at + BATCH]
            w = Words.of(pa.array([texts[i] for i in batch], pa.large_string()))
            x, (e, g, of_word, of_gram) = net.inputs(w, drop)
            count = np.diff(w.first)
            text, start = [], []
            for i, c in enumerate(count.tolist()):
                s = windows(c)
                text += [i] * len(s)
                start += s
            text, start = np.array(text), np.array(start)
            best = np.full(len(batch), -np.inf)
            chosen = np.zeros(len(batch), np.int64)
            for a in range(0, len(text), STEP_WINDOWS):
                part = slice(a, a + STEP_WINDOWS)
                idx, mask = _padded(w, w.first[text[part]] + start[part], count[text[part]] - start[part], len(x) - 1)
                logit = net.forward(x, idx, mask)[0]
                for j, v in enumerate(logit.tolist(), a):
                    if v > best[text[j]]:
                        best[text[j]], chosen[text[j]] = v, j
            idx, mask = _padded(w, w.first[text[chosen]] + start[chosen], count[text[chosen]] - start[chosen], len(x) - 1)
            logit, kept = net.forward(x, idx, mask, keep=True)
            d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[batch]) / len(batch)).astype(np.float32)
            grads, d_x = net.backward(x, idx, mask, kept, d)
            d_word, d_gram = d_x[:-1, :WORD] * of_word[:, None], (d_x[:-1, WORD:] * of_gram[:, None])[w.owner]
            step += 1
            rate = RATE * min(1.0, 2 * (1 - step / (total + 1))) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, value in grads.items():
                _adam(net.p[name], slice(None), value, moments, name, rate)
            for name, rows, value in (("E", e, d_word), ("G", g, d_gram)):
                last = len(net.p[name]) - 1
                live = (rows < last) & (np.abs(value).max(1, initial=0) > 0)
                at, back = np.unique(rows[live], return_inverse=True)
                summed = np.zeros((len(at), value.shape[1]), np.float32)
                np.add.at(summed, back, value[live])
                _adam(net.p[name], at, summed, moments, name, rate)
    return net


def _adam(p: np.ndarray, rows, g: np.ndarray, moments: dict, name: str, rate: float) -> None:
    m, v = moments.setdefault(name, (np.zeros_like(p), np.zeros_like(p)))
    g = g + DECAY * p[rows]
    m[rows] = 0.9 * m[rows] + 0.1 * g
    v[rows] = 0.999 * v[rows] + 0.001 * g * g
    p[rows] -= rate * m[rows] / (np.sqrt(v[rows]) + 1e-8)


def _fold(column):
    return F.crc32(column.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = PER_LABEL) -> Network:
    """The network of labelled documents whose fold (crc32 of the id as text, modulo 5) isn't 0.

    At most per_label documents of each label, chosen by a hash of the id, are gathered; labels other than 0 and 1 and
    null texts are left out. A document that is labelled twice is learned from twice, with both labels if they differ.
    """
    known = labels.select(labels[key].alias("k"), labels[label].cast("int").alias("y")).filter("k is not null and y in (0, 1)").filter(_fold(F.col("k")) != 0)
    place = F.xxhash64("k", F.lit("sample"))
    chosen = known.filter("y = 1").orderBy(place, "k").limit(per_label).unionByName(known.filter("y = 0").orderBy(place, "k").limit(per_label))
    # per_label rows of each label at most: 2 * PER_LABEL ids are broadcast
    body = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t")).filter("t is not null").join(F.broadcast(chosen), "k")
    rows = sorted((r.k, r.t, r.y) for r in body.orderBy(place, "k").limit(2 * per_label).toLocalIterator())
    return train([r[1] for r in rows], [r[2] for r in rows])


def _score(spread, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = spread.value
        for batch in batches:
            text, parts, start = batch.column(batch.num_columns - 1), [], 0
            ends = np.cumsum(np.diff(string_bytes(text)[1]))
            while start < batch.num_rows:
                base = ends[start - 1] if start else 0
                stop = min(batch.num_rows, max(start + 1, int(np.searchsorted(ends, base + STEP_BYTES))))
                parts.append(net.scores(Words.of(text.slice(start, stop - start))))
                start = stop
            made = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made)], [*batch.schema.names[:-1], name])

    return run


def scored(docs: DataFrame, network: Network, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """docs (or its columns in ``keep``) and the score, 0 to 1, of every row's whole text; 0 for texts without words, null included.

    A column of docs that bears the score's name is left out.
    """
    arrow_batches(docs.sparkSession)
    kept = docs.select(*[c for c in (docs.columns if keep is None else keep) if c.lower() != name.lower()], docs[text].cast("string").alias(fresh(docs, "body")[0]))
    spread = docs.sparkSession.sparkContext.broadcast(network)  # at most MOST_WORDS + MOST_GRAMS vectors: some 3 MB
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [f"`{name}` double"])
    return kept.mapInArrow(tidy(_score(spread, name)), schema)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", network: Network | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    A null id is neither learned from nor held out. Without labels of both kinds all scores but those of texts without
    words are equal. Repeated rows each get a row; other columns of docs are not read.
    """
    network = network or fit(docs, labels, key, text, label)
    d = scored(docs.select(docs[key].alias("doc_id"), docs[text].alias("t")), network, "t", keep=["doc_id"])
    return d.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, network: Network, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows that score below ``least``, all columns."""
    (name,) = fresh(docs, "toxicity")
    return scored(docs, network, text, name=name).filter(F.col(name) < least).drop(name)
