"""Quality scores: held-out accuracy, features and gradients against loops, edge cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import quality

SF = "/root/testdata/sf0.1"


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


def column(gram):
    if len(gram) == 1:
        return gram[0]
    h = (int.from_bytes(gram, "big") * 0x9E3779B1 + (len(gram) * 0x85EBCA6B & 0xFFFFFFFF)) & 0xFFFFFFFF
    return 256 + ((h * 0xC2B2AE35 & 0xFFFFFFFF) >> 20)


def plain_rows(text):
    """A row a passage, by loops over the bytes."""
    raw, rows = bytes(48 if 48 <= c < 58 else c for c in text.encode()), []
    for a in range(0, len(raw), quality.PASSAGE):
        seen = Counter(column(raw[p : p + k]) for p in range(a, min(len(raw), a + quality.PASSAGE)) for k in (1, 2, 3) if p + k <= len(raw))
        row, total = [0.0] * quality.WIDTH, sum(seen.values())
        for c, n in seen.items():
            row[c] = math.sqrt(n / total)
        row[quality.GRAMS :] = [len(seen) / total, -math.log(sum((n / total) ** 2 for n in seen.values())) / 6, math.log(total) / 8]
        rows.append(row)
    return rows


def test_passages_match_loops():
    texts = ["", "a", "ab", "héllo 123, wörld! " * 90, "x" * 512, "y" * 513, "日本語 " * 300, ""]
    bags = quality.Bags.of(pa.array(texts, pa.large_string()))
    want = [r for t in texts for r in plain_rows(t)]
    assert bags.first.tolist() == np.cumsum([0, *(len(plain_rows(t)) for t in texts)]).tolist()
    assert np.allclose(bags.dense(0, len(want)), want, atol=1e-5) and np.allclose(bags.dense(3, 5), want[3:5], atol=1e-5)


def test_gradients_match_differences():
    text = "some text of a few passages, 12 of them " * 40
    bags, net = quality.Bags.of(pa.array([text], pa.large_string())), quality.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    assert bags.first[-1] > 2
    g, _ = net.gradients(bags, 1.0)
    rng = np.random.default_rng(0)
    for name, value in g.items():
        live = np.argwhere(np.abs(value) > 1e-6)
        for at in map(tuple, live[rng.permutation(len(live))[:4]]):
            p, eps = net.p[name], 1e-2
            p[at] += eps
            up = net.gradients(bags, 1.0)[1]
            p[at] -= 2 * eps
            down = net.gradients(bags, 1.0)[1]
            p[at] += eps
            assert value[at] == pytest.approx((up - down) / 2 / eps, rel=0.03, abs=2e-5), name


def test_scores_match_loops(monkeypatch):
    """Attention, pooling and the logistic layer by plain loops; steps and neighbours change nothing."""
    texts, net = ["", "one passage", "two $$$ passages " * 50, "Many many many " * 300], quality.Network()
    got = net.scores(quality.Bags.of(pa.array(texts, pa.large_string())))
    for text, score in zip(texts, got):
        z, weights = np.zeros(quality.ENCODE), []
        h = [np.tanh(np.array(r) @ net.p["W"] + net.p["b"]) for r in plain_rows(text)]
        for r in h:
            weights.append(math.exp(float((np.tanh(r @ net.p["V"]) / (1 + np.exp(-(r @ net.p["U"])))) @ net.p["w"])))
        for r, w in zip(h, weights):
            z += r * w / sum(weights)
        assert score == pytest.approx(1 / (1 + math.exp(-float(z @ net.p["v"] + net.p["c"][0]))), abs=1e-5)
    monkeypatch.setattr(quality, "STEP", 2)
    assert np.allclose([net.scores(quality.Bags.of(pa.array([t], pa.large_string())))[0] for t in texts], got, atol=1e-5)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and [f.dataType.simpleString() for f in out.schema] == ["bigint", "boolean", "double", "int"]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (fold(r.doc_id) == 2) for r in rows.values())
    held = [(rows[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in rows and fold(r.doc_id) == 2]
    good, bad = ([r for r, q in held if q == k] for k in (1, 0))
    assert np.mean([g.score > b.score for g in good for b in bad]) > 0.99
    assert np.mean([r.predicted for r in good]) > 0.99 and np.mean([r.predicted for r in bad]) < 0.1


def test_quality_ignores_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    made = lambda f: spark.createDataFrame([(r.doc_id, f(r)) for r in labels], "doc_id long, quality int")
    a, b = quality.fit(docs, made(lambda r: r.quality)), quality.fit(docs, made(lambda r: 1 - r.quality if fold(r.doc_id) == 2 else r.quality))
    assert a.shift == b.shift and all((a.p[k] == b.p[k]).all() for k in a.p)


def test_quality_cases(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (4, 0), (6, 1), (9, None), (None, 1), (7, 5), (99, 1)], "doc_id long, quality int")
    rows = quality.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1  # null and empty
    assert len({round(r.score, 5) for r in rows if r.doc_id == 4}) == 1 and not next(r for r in rows if r.doc_id is None).held_out
    for some in (labels.limit(0), labels.filter("quality = 1"), labels.filter("quality = 0")):
        (score,) = {round(r.score, 5) for r in quality.score(odd, some).collect()}
        assert (score > 0.7) == (some.filter("quality = 0").count() == 0)
    assert quality.score(odd.limit(0), labels).count() == 0
    assert quality.scored(odd, quality.Network()).columns == [c for c in odd.columns if c != "score"] + ["score"]
