"""Operators on pairs against brute force."""

import itertools

import duckdb
import numpy as np
import pytest
import xxhash

from tessera.llm import components, linededup, multiindex, simhash

SF = "/root/testdata/sf0.001"


def closure(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5), (20, 3), (30, 31), (31, 30), (None, 4)] + [(k, k + 1) for k in range(100, 160)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == closure({x for e in real for x in e}, real)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_simhash(rows):
    fp = [plain_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fp[i] ^ fp[j]).bit_count() <= 4]
    group = closure(range(len(rows)), pairs)
    least = {}
    for i, g in group.items():
        if rows[i][0] is not None:
            least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    return sorted((str(rows[i][0]), f"{fp[i]:016x}", str(least.get(group[i]))) for i in range(len(rows)))


@pytest.mark.parametrize("bands,block", [(4, 8192), (4, 7), (2, 8192)])
def test_simhash(spark, documents, odd, bands, block):
    for docs in (documents, odd):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = sorted(tuple(map(str, r)) for r in simhash.near_duplicates(docs, bands=bands, block=block).collect())
        assert got == brute_simhash(rows)
    assert simhash.near_duplicates(odd.limit(0), bands=bands).count() == 0


@pytest.mark.parametrize("bands", [2, 4])
def test_anchor_links(spark, bands):
    """Clusters of fingerprints a few bits apart: every link is found, and nothing but links."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = {0, (1 << 64) - 1}
    for b in base.tolist():
        for _ in range(6):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            fps.add(b ^ sum(1 << int(f) for f in flips))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bands, 16).collect()
    assert all(((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 4 for r in edges)
    real = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert closure(signed, [(r.u, r.v) for r in edges]) == closure(signed, real)


def test_plans_by_cost():
    """The plan is the cheaper one by the stated cost, and its replicas are as many as stated."""
    fp = np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, 2048, dtype=np.int64)
    for bands, (replicas, anchors) in simhash.PLANS.items():
        code = simhash.Anchors(bands)
        assert len(code.replicate(fp)[0]) / len(fp) == pytest.approx(replicas, rel=0.02) and len(np.unique(code.home)) ** code.quarters == anchors
    assert simhash.cost(10**6, 4) < simhash.cost(10**6, 2) and simhash.cost(10**9, 4) > simhash.cost(10**9, 2)


def brute_vectors(rows, cosine=0.98):
    v = [None if l is None or e is None or not e or None in e or not np.isfinite(e).all() or not np.any(e) else np.array(e, np.float64) for _, e, l in rows]
    v = [None if x is None else x / np.linalg.norm(x) for x in v]
    ok = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if v[i] is not None and v[j] is not None and len(v[i]) == len(v[j]) and rows[i][2] == rows[j][2] and v[i] @ v[j] >= cosine]
    n = [0] * len(rows)
    for i, j in ok:
        n[i] += 1
        n[j] += 1
    group = closure(range(len(rows)), ok)
    least = {}
    for i, g in group.items():
        least[g] = min(least.get(g, 1 << 60), rows[i][0])
    return sorted((rows[i][0], n[i], least[group[i]], rows[i][0] == least[group[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("block", [4096, 5])
def test_embeddings(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 8)):
            rows.append((len(rows), (centre + rng.normal(size=16) * 0.12).tolist(), k % 3 if k % 7 else None))
    rows += [(1000 + i, [0.5] * 16, 1) for i in range(12)] + [(1100, [1.0] * 16, 1), (1101, [0.5] * 16, 2), (1102, [0.0] * 16, 1), (1103, None, 1), (1104, [], 1), (1105, [float("nan")] + [1.0] * 15, 1)]
    rows += [(1106, [None] + [1.0] * 15, 1), (1107, [float("inf")] + [1.0] * 15, 1), (1108, [1.0] * 8, 1), (1109, [1.0] * 8, 1), (1110, [-0.0] + [1.0] * 15, 1), (1111, [0.0] + [1.0] * 15, 1), (1112, [3.0], 1), (1113, [5.0], 1)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<float>, label int, n long, node string")
    got = sorted(tuple(r) for r in multiindex.near_duplicates(df, recall=1.0, block=block, codes=8).collect())
    narrow = [(i, None if e is None else [x if x is None else float(np.float32(x)) for x in e], l) for i, e, l in rows]
    assert got == brute_vectors(narrow)
    assert multiindex.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute_vectors([(r.vec_id, list(r.embedding), r.label) for r in df.collect()])
    assert sorted(tuple(r) for r in multiindex.near_duplicates(df, recall=1.0).collect()) == want
    got = sorted(tuple(r) for r in multiindex.near_duplicates(df).collect())
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)


def test_links_are_found_from_both_ends(spark):
    """Far below the target recall that a query would use, pairs still count for both of their ends."""
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=8).tolist(), 1) for k in range(40)]
    rows += [(100 + k, (np.array(rows[k % 40][1]) + rng.normal(size=8) * 0.12).tolist(), 1) for k in range(160)]
    want = sum(r[1] for r in brute_vectors(rows))
    for recall in (0.3, 0.6, 0.9):
        got = multiindex.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), recall=recall, codes=16).collect()
        total = sum(r.n_links for r in got)
        assert total % 2 == 0 and 0 < total <= want
        parts = {r.component_id for r in got}
        assert all((r.n_links > 0) == (sum(x.component_id == r.component_id for x in got) > 1) for r in got) and parts <= {r.vec_id for r in got}


@pytest.mark.parametrize("axes", [1, 3])
def test_embeddings_along_few_axes(spark, axes, monkeypatch):
    """A large group whose vectors differ along few directions crosses cells; none of its links is lost."""
    monkeypatch.setattr(multiindex, "HOMES", 1, raising=False)
    rng = np.random.default_rng(8)
    axis = np.linalg.qr(rng.normal(size=(64, axes + 1)))[0].T
    group = axis[0] + rng.normal(size=(600, axes)) * 0.3 @ axis[1:]
    v = np.concatenate((group, rng.normal(size=(1200, 64)))).astype(np.float32)
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(1) - 1
    df = spark.createDataFrame([(k, x, 1) for k, x in enumerate(v.tolist())], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in multiindex.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(v))] == want.tolist() and want.sum() > 10_000


def test_traversal():
    """Cells come by growing sum of their bounds, all up to the limit and none beyond."""
    rng = np.random.default_rng(4)
    left, right = rng.random((50, 9)) ** 3, rng.random((50, 7)) ** 3
    left[:, 2] = right[:, 3] = 0
    left[0, 4] = left[0, 5]
    row, x, y = multiindex.traverse(left, right, 0.3)
    cost = left[row, x] + right[row, y]
    assert (np.diff(cost)[np.diff(row) == 0] >= 0).all() and (np.diff(row) >= 0).all()
    want = {(i, a, b) for i in range(50) for a in range(9) for b in range(7) if left[i, a] + right[i, b] <= 0.3}
    assert len(row) == len(want) and set(zip(row.tolist(), x.tolist(), y.tolist(), strict=True)) == want


def test_grid_misses_no_pair():
    """Of two vectors at the threshold or nearer, one visits the other's cell, and their places are near."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(3000, 24))
    v[1000:2000] = v[:1000] + rng.normal(size=(1000, 24)) * 0.18
    v[2000:] = v[:1000] + np.eye(24)[rng.integers(0, 24, 1000)] * rng.normal(size=(1000, 1))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    grid = multiindex.Grid.fit(v[:1500], 40, 0.98, 1.0)
    i, j = np.nonzero(np.triu(v @ v.T >= 0.98, 1))
    assert len(i) > 500
    for fine in (1, 7, 40):
        row, cell, own, _ = grid.visits(v, fine)
        seen = set(zip(row.tolist(), cell.tolist(), strict=True))
        assert all((a, own[b]) in seen or (b, own[a]) in seen for a, b in zip(i.tolist(), j.tolist(), strict=True))
    place = grid.places(v).view(np.int8).astype(float)
    assert np.linalg.norm(place[i] - place[j], axis=1).max() <= np.sqrt(0.04) * multiindex.STEPS + np.sqrt(multiindex.AXES)


@pytest.mark.parametrize("region,block", [(40, 1 << 17), (200, 60)])
def test_embeddings_over_regions(spark, monkeypatch, region, block):
    """Many regions a label and several blocks a region: the same links, counted from both ends, as the definition gives."""
    monkeypatch.setattr(multiindex, "REGION", region)
    monkeypatch.setattr(multiindex, "HOMES", 4)
    rng = np.random.default_rng(12)
    centre = rng.normal(size=(60, 32))
    rows = [(k, (centre[k % 60] + rng.normal(size=32) * rng.choice([0.02, 0.1, 0.14, 0.5])).astype(np.float32).tolist(), k % 2) for k in range(1500)]
    got = sorted(map(tuple, multiindex.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=block).collect()))
    assert got == brute_vectors(rows) and sum(r[1] for r in got) > 5000


def test_line_dedup_oracle(spark, documents):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(linededup.ORACLE).fetchall(), key=str)
    got = linededup.dedup(documents, keep=["doc_id", "text"])
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert got.filter("n_removed > 0").count() > 0


def test_line_dedup_of_texts_with_one_id(spark):
    """Of different texts with one id, or a null one, that share a passage at the same line, one keeps it."""
    rows = [(i, f"a\nb\nc\nend {k}") for i in (None, 7) for k in range(3)] + [(7, "p\nq\nr\n1"), (7, "p\nq\nr\n2")] + [(None, "u\nv\nw")] * 2
    got = [r.text for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(t.startswith("a\nb\nc") for t in got) == 1 and sum(t.startswith("p\nq\nr") for t in got) == 1 and got.count("u\nv\nw") == 2


def test_line_dedup_cases(spark, odd):
    out = linededup.dedup(odd)
    assert out.columns == [*odd.columns, "n_removed"]
    got = {(r.doc_id, r.text, r.n_removed) for r in out.collect()}
    assert {(7, "one\ntwo\nthree\nfour", 0), (8, "zero", 3), (2, None, 0), (3, "", 0), (7, "other text", 0)} <= got
    assert out.count() == odd.count() and linededup.dedup(odd.limit(0)).count() == 0
    within = spark.createDataFrame([(1, "a\nb\nc\na\nb\nc\na"), (2, "a\na\na\na\na"), (3, "p\nq\nr"), (4, "p\nq\nr")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in linededup.dedup(within).collect()) == [(1, "a\nb\nc"), (2, "a"), (3, "p\nq\nr"), (4, "")]
