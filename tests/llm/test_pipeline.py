"""The pipeline's stages, each held against what its operator's definition gives on the rows before it."""

import re
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from test_models import plain_score
from test_pairs import brute_simhash
from tessera.llm import bitmap, pieces, registry, simhash, toxicity
from tessera.plans import metrics

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{where}/{k}")
        out.append(spark.read.parquet(f"{where}/{k}"))
    return out


def test_columns_and_shrinking(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "benchmark decontamination", "sentencepiece"]
    assert all(s.columns == steps[0].columns for s in steps[:5])
    n = [s.count() for s in steps]
    assert n[0] >= n[1] == n[2] > n[3] == n[4] == n[5]
    assert all(r.n_chars == len(r.text) for r in steps[4].collect())


def test_toxic_documents_go(spark, steps):
    """The first stage keeps what scores below 0.5, by loops over the network's definition for texts of up to 150 words, and nothing else."""
    net = toxicity.fit(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    whole = {r.doc_id: r.score for r in toxicity.scored(steps[0], net, keep=["doc_id"]).collect()}
    scores = {r.doc_id: plain_score(net, r.text) if len(r.text.split()) <= 150 else whole[r.doc_id] for r in steps[0].collect()}
    assert all(abs(s - 0.5) > 1e-3 for s in scores.values()) and any(s >= 0.5 for s in scores.values())
    assert sorted(r.doc_id for r in steps[1].collect()) == sorted(i for i, s in scores.items() if s < 0.5)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    """The queries that SQL can express, over the whole tables."""
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = registry.queries()[name](spark, SF), con.execute(registry.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in names]
    assert sorted(got.columns) == names
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(tuple(r[k] for k in at) for r in want.fetchall())


def test_lines(steps):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in steps[1:3])
    seen, want = set(), {}
    for i in sorted(before):
        lines, gone = before[i].split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            gone |= {k, k + 1, k + 2} if w in seen else set()
            seen.add(w)
        want[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    assert after == want


def test_one_of_each_group(steps):
    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    groups = {int(c) for _, _, c in brute_simhash(rows)}
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(groups)


@pytest.mark.parametrize("words", [1 << 20, 1])
def test_keep_one_of_copies_and_odd_rows(spark, odd, monkeypatch, words):
    """With the bit map at its size and with one of a single word, which lets all through: one row of each component, all columns, of repeated rows one."""
    monkeypatch.setattr(bitmap, "MAP_WORDS", words)
    docs = odd.unionByName(odd.filter("doc_id in (1, 7)")).withColumn("held", odd.doc_id).withColumn("mark", odd.n_chars)
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    named, groups = [(i, t) for i, t in rows], {}
    component = {int(k): c for k, _, c in brute_simhash([(k, t) for k, (_, t) in enumerate(named)])}  # numbers stand in for ids, so that null ones have a place
    for k, (i, t) in enumerate(named):
        groups.setdefault(component[k], []).append((i is None, i or 0, spark.range(1).select(F.xxhash64(F.lit(t))).first()[0], i, t))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for *_, i, t in (min(g, key=lambda x: x[:3]) for g in groups.values()))
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_near_dedup_shuffles_no_texts(spark, steps):
    moved = metrics.node_metrics(simhash.keep_one(steps[2])).filter("operator = 'ShuffleExchangeExec'").agg(F.sum("bytes")).first()[0]
    assert (moved or 0) < 0.05 * sum(len(r.text) for r in steps[2].collect())


def test_no_benchmark_passage_left(spark, steps):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        ws = word.findall(r.text.translate(low))
        for k in range(max(1, len(ws) - 9)):
            windows[tuple(ws[k : k + 10])].add(r.item_id)
    before = {r.doc_id: r.text for r in steps[3].collect()}
    changed = 0
    for r in steps[4].collect():
        ws, old = word.findall(r.text.translate(low)), word.findall(before[r.doc_id].translate(low))
        hit = {j for k in range(len(old) - 9) if tuple(old[k : k + 10]) in windows for j in range(k, k + 10)}
        assert ws == [w for k, w in enumerate(old) if k not in hit]
        changed += bool(hit)
        assert hit or r.text == before[r.doc_id]
    assert changed


def test_tokens(steps):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    text = {r.doc_id: r.text for r in steps[4].collect()}
    for r in steps[5].collect():
        assert r.ids == sp.encode(text[r.doc_id], add_bos=True, add_eos=True)


def test_run_and_odd_rows(spark, odd, steps):
    ran = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids_sha256) for r in ran.collect()) == sorted((r.doc_id, r.ids_sha256) for r in steps[5].collect())
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
    ids = [r.doc_id for r in docs.collect()]
    assert ids.count(7) == 2 and sorted(i for i in set(ids) if i is not None and ids.count(i) > 1) == [7]  # two texts of one id; of repeated rows one stays
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == len(ids)


def test_registered():
    names = list(registry.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))
    assert set(__spark_entry__.queries()) >= {*names, "pipeline"} and set(registry.oracle_sql()) <= set(names)
    assert np.all([callable(f) for f in __spark_entry__.queries().values()])
