"""Trained operators: held-out accuracy, gradients and edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_counts_do_not_depend_on_steps(monkeypatch):
    text = "Éa b, cdé  fg1h ÀÖ" * 40
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "STEP", 7)
    assert (langid.counts(text) == whole).all()
    assert not langid.counts("12 .,!\n").any() and not langid.counts("").any()


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.identify(docs)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["bigint", "boolean", "string", "double"]
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = out.collect()
    assert len(rows) == len(truth) and all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_language_ignores_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    rows = docs.collect()
    spoiled = spark.createDataFrame([(r.doc_id, r.text, "zz" if fold(r.doc_id, 4) == 2 else r.lang) for r in rows], "doc_id long, text string, lang string")
    a, b = langid.fit(docs), langid.fit(spoiled)
    assert a.languages == b.languages and (a.buckets == b.buckets).all() and (a.weights == b.weights).all() and a.temperature == b.temperature


def test_language_cases(spark, odd):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id in (2, 3, 5):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.identify(odd.limit(0)).count() == 0
    unlabelled = odd.withColumn("lang", odd.lang.substr(10, 1).cast("int").cast("string")).filter("text = 'a b c d e f'")
    assert {r.lang_pred for r in langid.identify(unlabelled.selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()} == {"und"}


def plain_grams(text):
    """Documented n-grams by loops: runs of breaks are one break, n-grams of breaks alone don't count."""
    out, letters = Counter(), "\0"
    for c in text:
        c = c.lower()[0] if c.isalpha() else "\0"
        letters += "" if c == letters[-1] == "\0" else c
    letters += "" if letters[-1] == "\0" else "\0"
    for order in (1, 2, 3):
        for k in range(len(letters) - order + 1):
            gram = letters[k : k + order]
            if gram[0] != "\0" or gram[-1] != "\0":
                out[gram] += 1
    return out


def plain_bucket(gram):
    h = 0
    for k, c in enumerate(gram, 1):
        h = (h * 0x01000193 + ord(c) + k) & 0xFFFFFFFF
    return (h * 0x9E3779B1 & 0xFFFFFFFF) >> 18


def test_gram_counts_match_loops():
    for text in ("", "a", " a ", "Hello, world", "a1b", "ÀÉ ß 日本 x", "...", "one  two\nTHREE", "aaaa bbbb"):
        want = np.zeros(langid.BUCKETS, np.int64)
        for gram, n in plain_grams(text).items():
            want[plain_bucket(gram)] += n
        assert (langid.counts(text) == want).all()


def test_gather_matches_loops(spark):
    """Document frequencies, their total and the sample of what Spark gathers, over several tasks, against loops."""
    texts = ["abc abd", "", "12 34", "abc", "éa b", "abc abd", "Ωmega"] * 3
    rows = [(t, f"l{k % 2}", k % 3 != 1) for k, t in enumerate(texts)]
    found = spark.createDataFrame(rows, "t string, l string, chosen boolean").repartition(4).mapInArrow(langid._gather, "bucket int, n bigint, lang string, packed binary").collect()
    frequency, documents, sample = Counter(), 0, Counter()
    for t, language, chosen in rows:
        grams = Counter()
        for g, n in plain_grams(t).items():
            grams[plain_bucket(g)] += n
        documents += bool(grams)
        frequency.update(dict.fromkeys(grams, 1))
        if grams and chosen:
            sample[language, tuple(sorted(grams.items()))] += 1
    got = Counter()
    for r in found:
        if r.bucket >= -1:
            got[r.bucket] += r.n
    assert got.pop(-1) == documents and got == frequency
    taken = Counter()
    for r in found:
        if r.bucket == -2:
            size = len(r.packed) // 6
            taken[r.lang, tuple(zip(np.frombuffer(r.packed, "<u2", size).tolist(), np.frombuffer(r.packed, "<f4", size, size * 2).tolist()))] += 1
    assert taken == sample


def test_many_languages_are_folded(spark, monkeypatch):
    """Frequent languages stand alone, the others share classifiers; all are learned and told apart, with the product of both chances as the score."""
    r = np.random.default_rng(8)
    names = [f"l{k}" for k in range(9)]
    text = lambda k: " ".join("".join(r.choice(list("abcdefghijklmnopqrstuvwxyzßåø")[3 * k : 3 * k + 4], 6)) for _ in range(15))
    rows = [(i, text(k), names[k]) for i, k in enumerate(np.repeat(range(9), [90, 80, 40, 40, 40, 40, 40, 40, 40]).tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "CLASSES", 4)
    monkeypatch.setattr(langid, "ALONE", 2)
    model = langid.fit(docs)
    assert isinstance(model, langid.Folded) and model.languages == names and set(model.top.languages) == {"l0", "l1", "\x000", "\x001"}
    out = langid.identify(docs, model=model).collect()
    assert np.mean([x.lang_pred == rows[x.doc_id][2] for x in out if x.held_out]) > 0.95
    for x in out[:20]:
        n = langid.counts(rows[x.doc_id][1])
        group, p = model.top.best(n)
        assert x.score == pytest.approx(p * (model.folds[group].best(n)[1] if group in model.folds else 1))
    monkeypatch.setattr(langid, "CLASSES", 3)
    with pytest.raises(ValueError, match="more than 5 languages"):
        langid.fit(docs)
    assert langid.folds({"a": 1, "b": 2, "c": 2}) == {"a": "a", "b": "b", "c": "c"} and langid.folds({"a": 1, "b": 2, "c": 3, "d": 3}) == {"c": "c", "d": "d", "a": "\x000", "b": "\x000"}


def test_compact_weights_give_the_same_logits():
    rng = np.random.default_rng(9)
    weights = rng.normal(size=(50, 7)) * (rng.random((50, 7)) < 0.3)
    weights[4] = 0
    model = langid.Model([f"l{k}" for k in range(7)], rng.random(langid.BUCKETS) + 1, np.arange(3, 53), weights, rng.normal(size=7))
    assert model.compact().weights.nbytes * 4 == weights.nbytes
    for size in (0, 1, 40):
        n = np.zeros(langid.BUCKETS)
        n[rng.choice(60, size, replace=False)] = rng.integers(1, 9, size)
        assert np.allclose(model.logits(n), model.compact().logits(n), atol=0.02)


def test_training_matches_loops():
    """TF-IDF weights, every update and the temperature, coefficient by coefficient."""
    rng = np.random.default_rng(3)
    texts = [("".join(rng.choice(list("abc" if k % 3 == 0 else "bcd" if k % 3 == 1 else "cde"), 12)), f"l{k % 3}") for k in range(30)]
    sample, frequency = [], np.zeros(langid.BUCKETS, np.int64)
    for t, language in texts:
        n = langid.counts(t)
        at = np.flatnonzero(n)
        frequency[at] += 1
        sample.append((language, at, n[at].astype(float)))
    model = langid.train(sample, frequency, len(texts))

    names, rows = sorted({x for _, x in texts}), []
    for language, at, n in sample:
        x = {int(k): c * (math.log((1 + len(texts)) / (1 + frequency[k])) + 1) for k, c in zip(at, n)}
        norm = math.sqrt(sum(v * v for v in x.values()))
        rows.append((names.index(language), {k: v / norm for k, v in x.items()} | {langid.BUCKETS: 1.0}))
    order = np.random.default_rng(5).permutation(len(rows)).tolist()
    z, squares = defaultdict(float), defaultdict(float)

    def weight(k, c):
        if abs(z[k, c]) <= langid.L1:
            return 0.0
        return -(z[k, c] - math.copysign(langid.L1, z[k, c])) / ((langid.BETA + math.sqrt(squares[k, c])) / langid.ALPHA + langid.L2)

    def chances(logits, temperature=1.0):
        e = [math.exp(v / temperature) for v in logits]
        return [v / sum(e) for v in e]

    for _ in range(langid.PASSES):
        for place, r in enumerate(order):
            if place % langid.CALIBRATION == 0:
                continue
            y, x = rows[r]
            w = {(k, c): weight(k, c) for k in x for c in range(3)}
            p = chances([sum(v * w[k, c] for k, v in x.items()) for c in range(3)])
            for k, v in x.items():
                for c in range(3):
                    g = v * (p[c] - (c == y))
                    sigma = (math.sqrt(squares[k, c] + g * g) - math.sqrt(squares[k, c])) / langid.ALPHA
                    z[k, c] += g - sigma * w[k, c]
                    squares[k, c] += g * g
    for k in {k for _, x in rows for k in x}:
        got = model.offset if k == langid.BUCKETS else model.weight(k)
        assert got == pytest.approx([weight(k, c) for c in range(3)], abs=1e-9)
    assert (np.abs(model.weights).max(1) > 0).all()  # what the penalty set to zero isn't stored

    held = [rows[r] for place, r in enumerate(order) if place % langid.CALIBRATION == 0]

    def loss(temperature):
        return -sum(math.log(chances([sum(v * weight(k, c) for k, v in x.items()) for c in range(3)], temperature)[y]) for y, x in held)

    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    assert model.temperature == pytest.approx(min(grid, key=loss))
    text = "abcabd"
    n = langid.counts(text)
    x = {int(k): n[k] * (math.log((1 + len(texts)) / (1 + frequency[k])) + 1) for k in np.flatnonzero(n)}
    norm = math.sqrt(sum(v * v for v in x.values()))
    p = chances([sum(v / norm * weight(k, c) for k, v in x.items()) + weight(langid.BUCKETS, c) for c in range(3)], model.temperature)
    assert model.predict(text) == (names[int(np.argmax(p))], pytest.approx(max(p)))


def test_gradients():
    rng = np.random.default_rng(0)
    w = toxicity.Words.of(pa.array(["the idiot is here now", "clean words only go there and there", "x"], pa.large_string()))
    net = toxicity.Network.new(np.sort(w.word), np.unique(w.gram))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    way = np.array([1.0, -2.0, 0.5])

    def loss():
        x, _ = net.inputs(w)
        idx, mask = toxicity._padded(w, w.first[:-1], np.diff(w.first), len(x) - 1)
        logit, kept = net.forward(x.astype(np.float64), idx, mask, True)
        return (logit * way).sum(), (x.astype(np.float64), idx, mask, kept)

    _, (x, idx, mask, kept) = loss()
    grads, _ = net.backward(x, idx, mask, kept, way)
    for name, g in grads.items():
        i = tuple(rng.integers(0, s) for s in net.p[name].shape)
        old = net.p[name][i]
        sides = []
        for step in (1e-3, -1e-3):
            net.p[name][i] = old + step
            sides.append(loss()[0])
        net.p[name][i] = old
        assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(float(g[i]), abs=2e-3)
    d_x = net.backward(x, idx, mask, kept, way)[1]
    for _ in range(8):
        i = rng.integers(0, len(x)), rng.integers(0, x.shape[1])
        sides = []
        for step in (1e-4, -2e-4):
            x[i] += step
            sides.append((net.forward(x, idx, mask)[0] * way).sum())
        x[i] += 1e-4
        assert (sides[0] - sides[1]) / 2e-4 == pytest.approx(d_x[i], abs=2e-3)


def plain_score(net, text):
    """A text's score by loops over its windows, words and states, from the network's definition."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, n = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode()), toxicity.STATE
    places = {g: k for k, g in enumerate(net.grams.tolist())}

    @cache
    def vector(word):
        known = toxicity.Words.of(pa.array([word.decode()], pa.large_string())).word[0]
        at = np.flatnonzero(net.words == known)
        marked, grams = b"\x01" + word.lower() + b"\x01", []
        for size in (3, 4):
            grams += [int.from_bytes(marked[k : k + size], "big") for k in range(len(marked) - size + 1)]
        rows = [p["G"][places[g]] if g in places else np.zeros(toxicity.GRAM) for g in grams]
        return np.concatenate((p["E"][at[0]] if len(at) else np.zeros(toxicity.WORD), sum(rows, np.zeros(toxicity.GRAM)) / max(1, len(rows))))

    def states(xs, d):
        h, out = np.zeros(n), []
        for x in xs:
            g, u = x @ p[f"Wx{d}"] + p[f"bx{d}"], h @ p[f"Wh{d}"]
            z, r = (1 / (1 + np.exp(-(g[k : k + n] + u[k : k + n]))) for k in (0, n))
            new = np.tanh(g[2 * n :] + r * u[2 * n :])
            h = (1 - z) * new + z * h
            out.append(h)
        return out

    best = None
    for start in toxicity.windows(len(words)) if words else []:
        xs = [vector(w) for w in words[start : start + toxicity.WINDOW]]
        h = [np.concatenate(x) for x in zip(states(xs, "f"), states(xs[::-1], "b")[::-1], strict=True)]
        weight = np.exp([np.tanh(x @ p["A"]) @ p["a"] for x in h])
        pooled = sum(w * x for w, x in zip(weight / weight.sum(), h, strict=True))
        logit = pooled @ p["v"] + p["c"][0]
        best = logit if best is None else max(best, logit)
    return 0.0 if best is None else 1 / (1 + np.exp(-best))


def test_scores_match_plain_loops():
    """The network in whole arrays gives what loops over its definition give."""
    rng = np.random.default_rng(7)
    pool = ["alpha", "Beta", "gamma", "dél", "x", "unknown9", "日本", "zz"]
    texts = [" ".join(rng.choice(pool, n)) for n in (0, 1, 2, 63, 64, 65, 113, 150)] + ["one, two;three\nFOUR"]
    some = toxicity.Words.of(pa.array(["alpha beta gamma dél x zz one"], pa.large_string()))
    net = toxicity.Network.new(np.sort(some.word), np.unique(some.gram))
    for k in net.p:
        net.p[k] = (rng.normal(size=net.p[k].shape) * 0.5).astype(np.float32)
    net.p["E"][-1] = net.p["G"][-1] = 0
    got = net.scores(toxicity.Words.of(pa.array(texts, pa.large_string())))
    assert got == pytest.approx([plain_score(net, t) for t in texts], abs=1e-4)


def area(score, truth):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    ones = truth.sum()
    return (order[truth == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(truth) - ones))


def test_learned_vectors_carry_the_result(spark):
    """Held-out documents are ranked by the learned vectors: without them by chance, and without either kind the scores are worse."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.fit(docs, labels)
    rows = [r for r in docs.join(labels, "doc_id").filter("text is not null").select("doc_id", "text", "toxic").collect() if fold(r.doc_id, 5) == 0]
    words, truth = toxicity.Words.of(pa.array([r.text for r in rows], pa.large_string())), np.array([r.toxic for r in rows])
    whole = net.scores(words)
    assert area(whole, truth) > 0.95 and ((whole >= 0.5) == truth).mean() > 0.96
    e, g = net.p["E"].copy(), net.p["G"].copy()

    def loss(score):
        return -np.log(np.clip(np.where(truth == 1, score, 1 - score), 1e-6, 1)).mean()

    net.p["E"][:] = 0
    no_words = net.scores(words)
    net.p["G"][:] = 0
    neither = net.scores(words)
    net.p["E"][:] = e
    no_grams = net.scores(words)
    assert loss(whole) < min(loss(no_words), loss(no_grams), loss(neither))
    assert area(neither, truth) < 0.6 < area(no_grams, truth) < area(whole, truth)


def test_every_language_is_learned(spark):
    """However many languages there are, the rare ones are learned like the others."""
    rows = [(k, chr(0x4E00 + k % 210) * 3, f"l{k % 210:03}") for k in range(210 * 12)] + [(5000 + k, chr(0x4E00) * 3, "l000") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == [f"l{k:03}" for k in range(210)]
    assert sum(model.predict(chr(0x4E00 + k) * 3)[0] == f"l{k:03}" for k in range(210)) >= 200


def test_every_word_is_in_a_window():
    for n in range(0, 500):
        starts = toxicity.windows(n)
        assert {k for s in starts for k in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))


def test_scores_match_windows_one_by_one():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], n)) for n in (0, 1, 5, 63, 64, 65, 112, 113, 300)]
    whole = toxicity.Words.of(pa.array(texts, pa.large_string()))
    net = toxicity.Network.new(np.sort(whole.word), np.unique(whole.gram))
    got = net.scores(whole)
    for text, score in zip(texts, got, strict=True):
        words = text.split()
        parts = [" ".join(words[s : s + toxicity.WINDOW]) for s in toxicity.windows(len(words))] if words else []
        each = [net.scores(toxicity.Words.of(pa.array([p], pa.large_string())))[0] for p in parts]
        assert score == pytest.approx(max(each, default=0.0), abs=1e-5)


def test_toxicity(spark, odd):
    """A planted word decides the label; documents beyond the training fold are told apart."""
    rng = np.random.default_rng(1)
    plain = ["river", "stone", "cloud", "green", "walks", "under", "table", "seven", "north", "quiet"]
    rows = []
    for k in range(300):
        words = list(rng.choice(plain, rng.integers(5, 200)))
        bad = k % 4 == 0
        if bad:
            words[rng.integers(0, len(words))] = ["scoundrel", "villain", "rotter"][k % 3]
        rows.append((k, " ".join(words), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (10_000, None), (10_001, 7)], "doc_id long, toxic int")
    network = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, labels, network=network).collect()}
    held = [(got[i], y) for i, _, y in rows if fold(i, 5) == 0]
    assert all(r.held_out for r, _ in held) and np.mean([r.predicted == y for r, y in held]) > 0.95
    out = toxicity.score(odd, labels, network=network).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert all(r.score == 0 for r in out if r.doc_id in (2, 3, 5))
    assert toxicity.score(odd.limit(0), labels.limit(0)).count() == 0
