"""Language identification: sparse multinomial logistic regression on TF-IDF weights of character n-grams.

N-grams of one to three letters (A to Z and all other letters in lower case, everything else one break) are hashed
into BUCKETS. Document frequencies are counted over every learnable document. The classifier is fitted on a bounded
sample, PER_LANGUAGE documents of each language or fewer, with follow-the-regularised-leader updates under an
elastic-net penalty; a temperature, fitted on sample documents that the updates don't see, calibrates its scores.

One classifier has at most CLASSES classes. If there are more languages, the most frequent are classes of their own and
the others are folded, CLASSES at most to a class; a classifier of each fold's own languages then tells these apart. Each
fold is fitted in a task of its own, so fitting takes the memory of one classifier, whatever the number of languages.
"""

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.memory import tidy
from tessera.llm.storage import arrow_batches, cut

BUCKETS, ORDERS = 1 << 14, 3
#: Bound of the fitting sample: documents a language, and in all (at least 20 a language).
PER_LANGUAGE, SAMPLE = 1000, 6000
#: Learning rate, its offset, the two penalties and the passes of the updates.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.01, 0.01, 3
#: Classes of one classifier, and how many of them are languages by themselves where there are more languages than that.
CLASSES, ALONE = 256, 128
#: Every so manieth document of the sample fits the temperature only.
CALIBRATION = 5
#: Characters that are hashed at once.
STEP = 1 << 18
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point the lower-case letter, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            table[k] = ord(c.lower()[0])
    return table


def counts(text: str) -> np.ndarray:
    """Occurrences per bucket of the whole text; all zero if it has no letter."""
    out = np.zeros(BUCKETS, np.int64)
    last = np.zeros(1, np.uint32)
    for k in range(0, len(text), STEP):
        c = _letters()[np.frombuffer(text[k : k + STEP].encode("utf-32-le", "surrogatepass"), np.uint32)]
        c = np.concatenate((last, c, np.zeros(1, np.uint32) if k + STEP >= len(text) else c[:0]))
        c = c[np.concatenate(([True], (c[1:] > 0) | (c[:-1] > 0)))]  # a run of breaks is one
        fresh = len(last)
        h = np.zeros(len(c), np.uint32)
        for order in range(1, ORDERS + 1):
            h = h[: len(c) - order + 1] * np.uint32(0x01000193) + c[order - 1 :] + np.uint32(order)
            begin = max(0, fresh - order + 1)  # n-grams of the last step's characters only were counted there
            use = h[begin:][c[begin : len(h)] + c[begin + order - 1 : begin + order - 1 + len(h) - begin] > 0] if order > 1 else h[begin:][c[begin:] > 0]
            out += np.bincount((use * np.uint32(0x9E3779B1)) >> np.uint32(18), minlength=BUCKETS)
        last = c[-(ORDERS - 1) :]
    return out


def _fold(column) -> "F.Column":
    return F.crc32(column.cast("string").cast("binary")) % 4


@dataclass
class Model:
    """Languages, inverse document frequencies, the buckets whose weights aren't all zero and these weights (bucket x language), offsets and the temperature."""

    languages: list[str]
    idf: np.ndarray
    buckets: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    temperature: float = 1.0

    def weight(self, bucket: int) -> np.ndarray:
        k = np.searchsorted(self.buckets, bucket)
        return self.weights[k] if k < len(self.buckets) and self.buckets[k] == bucket else np.zeros(len(self.languages))

    def compact(self) -> "Model":
        """The same with weights of two bytes each: many languages' penalties leave most of them."""
        return Model(self.languages, self.idf, self.buckets, self.weights.astype(np.float16), self.offset, self.temperature)

    def logits(self, n: np.ndarray) -> np.ndarray:
        every = n * self.idf
        x = every[self.buckets]
        use = np.flatnonzero(x)
        return (x[use] @ self.weights[use].astype(np.float64, copy=False)) / max(np.sqrt((every * every).sum()), 1e-12) + self.offset

    def best(self, n: np.ndarray) -> tuple[str, float]:
        p = softmax(self.logits(n) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])

    def predict(self, text: str | None) -> tuple[str, float]:
        n = counts(text) if text else None
        return self.best(n) if n is not None and n.any() and self.languages else (UNKNOWN, 0.0)


@dataclass
class Folded:
    """A classifier of the frequent languages and the folds, and by fold one of its languages. A score is the product of both."""

    top: Model
    folds: dict[str, Model]

    @property
    def languages(self) -> list[str]:
        return sorted([x for x in self.top.languages if x not in self.folds] + [x for f in self.folds.values() for x in f.languages])

    def predict(self, text: str | None) -> tuple[str, float]:
        n = counts(text) if text else None
        if n is None or not n.any():
            return UNKNOWN, 0.0
        name, p = self.top.best(n)
        if name not in self.folds:
            return name, p
        name, q = self.folds[name].best(n)
        return name, p * q


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(sample: list[tuple[str, np.ndarray, np.ndarray]], frequency: np.ndarray, documents: int) -> Model:
    """sample: (language, buckets, occurrences). frequency: documents by bucket, of ``documents`` in all."""
    languages = sorted({s[0] for s in sample})
    idf = np.log((1 + documents) / (1 + frequency)) + 1
    rows, place = [], {language: k for k, language in enumerate(languages)}
    for language, at, n in sample:
        x = n * idf[at]
        rows.append((place[language], at, x / np.sqrt((x * x).sum())))
    order = np.random.default_rng(5).permutation(len(rows))
    fit = [rows[k] for k in order[np.arange(len(order)) % CALIBRATION != 0]] or rows
    z, n2 = np.zeros((BUCKETS + 1, len(languages))), np.zeros((BUCKETS + 1, len(languages)))

    def weight(at: np.ndarray) -> np.ndarray:
        strength = np.maximum(np.abs(z[at]) - L1, 0)
        return -np.sign(z[at]) * strength / ((BETA + np.sqrt(n2[at])) / ALPHA + L2)

    for _ in range(PASSES):
        for y, at, x in fit:
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)  # the last row is the offset
            w = weight(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n2[at] + g * g) - np.sqrt(n2[at])) / ALPHA
            z[at] += g - sigma * w
            n2[at] += g * g
    full = weight(np.arange(BUCKETS + 1))
    some = np.flatnonzero(np.abs(full[:-1]).max(1, initial=0) > 0)
    model = Model(languages, idf, some, full[some], full[-1])
    held = [rows[k] for k in order[:: CALIBRATION]]
    logits = np.array([x @ full[at] + model.offset for _, at, x in held])
    truth = np.array([y for y, _, _ in held])
    if len(languages) > 1 and len(held):
        grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a task's documents, and the packed counts of those in the sample."""
    names = ["bucket", "n", "lang", "packed"]
    types = [pa.int32(), pa.int64(), pa.string(), pa.binary()]
    frequency, documents = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        kept = []
        for text, lang, chosen in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n = counts(text.as_py())
            if n.any():
                documents += 1
                frequency += n > 0
                if chosen:
                    at = np.flatnonzero(n)
                    kept.append((lang, at.astype("<u2").tobytes() + n[at].astype("<f4").tobytes()))
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([-2] * len(kept), types[0]), pa.array([1] * len(kept), types[1]), pa.array([k[0] for k in kept]), pa.array([k[1] for k in kept], types[3])], names)
    at = np.flatnonzero(frequency)
    at, n = np.append(at, -1), np.append(frequency[at], documents)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n), pa.nulls(len(at), types[2]), pa.nulls(len(at), types[3])], names)


def _unpacked(lang: str, packed: bytes) -> tuple[str, np.ndarray, np.ndarray]:
    size = len(packed) // 6
    return lang, np.frombuffer(packed, "<u2", size).astype(np.int32), np.frombuffer(packed, "<f4", size, size * 2)


def _sample(found: DataFrame, most: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    return [_unpacked(r.lang, r.packed) for r in found.select("lang", "packed").orderBy(F.xxhash64("packed"), "lang").limit(most).toLocalIterator()]


def _fit_folds(named: DataFrame, frequency: np.ndarray, documents: int) -> dict[str, Model]:
    """A classifier a fold, each fitted in a task; a fold has CLASSES languages with a bounded sample each."""
    spread = named.sparkSession.sparkContext.broadcast((frequency, documents))  # a number a bucket

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mix", "lang"], kind="stable")
        model = train([_unpacked(x, p) for x, p in zip(rows["lang"], rows["packed"], strict=True)], *spread.value).compact()
        return pd.DataFrame({"class": rows["class"].iloc[:1], "model": [pickle.dumps(model)]})

    made = named.withColumn("mix", F.xxhash64("packed")).groupBy("class").applyInPandas(fitted, "class string, model binary")
    return {r["class"]: pickle.loads(r["model"]) for r in cut(made, "folds").toLocalIterator()}


def folds(sizes: dict[str, int]) -> dict[str, str]:
    """The class of each language: itself, or the fold it is in. Folds hold languages that follow each other by name."""
    if len(sizes) <= CLASSES:
        return {x: x for x in sizes}
    order = sorted(sizes, key=lambda x: (-sizes[x], x))
    rare = sorted(order[ALONE:])
    return {x: x for x in order[:ALONE]} | {x: f"\0{k // CLASSES}" for k, x in enumerate(rare)}


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model | Folded:
    """The model of the documents whose fold (crc32 of the id as text, modulo 4) isn't 2 and whose language is known; every language is learned.

    The driver and a task hold the sample and the state of one classifier of at most CLASSES classes, and the driver the
    weights of all, two bytes each where there are folds: 33 KB a language. More languages than folds can hold (ALONE + (CLASSES - ALONE) * CLASSES, 32,896) raise
    ``ValueError``: such a column doesn't hold languages.
    """
    arrow_batches(docs.sparkSession)
    d = docs.select(docs[key].cast("string").alias("k"), docs[text].cast("string").alias("t"), docs[lang].cast("string").alias("l")).filter("t is not null and l is not null").filter(_fold(F.col("k")) != 2)
    sizes = cut(d.groupBy("l").agg(F.count(F.lit(1)).alias("n")), "languages")
    most = ALONE + (CLASSES - ALONE) * CLASSES
    counted = {r.l: r.n for r in sizes.limit(most + 1).collect()}
    if len(counted) > most:
        raise ValueError(f"more than {most} languages")
    languages, kind = len(counted), folds(counted)
    each = min(per_language, max(20, sample // max(1, languages)))
    d = d.join(F.broadcast(sizes), "l")  # a row a language
    chance = F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    found = cut(d.select("t", "l", (chance < F.lit(float(each)) / F.col("n")).alias("chosen")).mapInArrow(tidy(_gather), "bucket int, n bigint, lang string, packed binary"), "ngrams")
    frequency, documents = np.zeros(BUCKETS, np.int64), 0
    for r in found.filter("bucket >= -1").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        if r.bucket < 0:
            documents = r.n
        else:
            frequency[r.bucket] = r.n
    chosen = found.filter("bucket = -2")
    if all(x == y for x, y in kind.items()):
        return train(_sample(chosen, each * max(1, languages) * 2), frequency, documents)
    names = docs.sparkSession.createDataFrame(list(kind.items()), "lang string, class string")
    named = cut(chosen.join(F.broadcast(names), "lang"), "classes")  # a row a language
    classes = sorted(set(kind.values()))
    share = max(20, sample // len(classes))
    ranked = named.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy(F.xxhash64("packed"), "lang"))).filter(F.col("place") <= share)
    top = train(_sample(ranked.select(F.col("class").alias("lang"), "packed"), share * len(classes)), frequency, documents)
    return Folded(top.compact(), _fit_folds(named.filter("class <> lang"), frequency, documents))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | Folded | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row by its whole text.

    Texts that are null or have no letter, and all texts if nothing could be learned, give und with score 0. A null id
    is neither learned from nor held out. Repeated rows each get a row; other columns of docs are not read.
    """
    model = model or fit(docs, key, text, lang)
    spread = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x (languages + 1) numbers at most
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = spread.value
        for batch in batches:
            made = [use.predict(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(_fold(docs[key]) == 2, F.lit(False))
    return docs.select(docs[key].alias("doc_id"), held.alias("held_out"), docs[text].cast("string").alias("t")).mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
