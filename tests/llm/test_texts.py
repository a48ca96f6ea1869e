"""Operators on single texts against brute force, and sharding."""

import hashlib
import pickle
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tessera.llm import decontaminate, fmindex, pieces, sharding, storage

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_session_settings_stay(spark):
    """Arrow bounds are set where the session has none; what it has set stays, be it the default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own, other = spark.newSession(), spark.newSession()
    own.conf.set(key, "10000")
    storage.arrow_batches(own)
    storage.arrow_batches(other)
    assert (own.conf.get(key), other.conf.get(key)) == ("10000", "1000")


def test_shared_folder(spark):
    """Tables go to the named folder; a spent one is gone."""
    df, path = storage.write(spark.range(3), "some")
    assert path.startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir")) and df.count() == 3
    storage.discard(spark, path)
    assert not storage.exists(spark, path)


def test_pieces_fuzz():
    path = public_tokenizers.path(pieces.MODEL)
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Encoder(path)
    random.seed(4)
    bits = ["a", "b", "the", "ing", " ", "  ", "▁", "\n", "é", "ö", "日", "本", "😀", "\x00", ".", ",", "!", "(", '"', "19", "x" * 5, "http://", "é", " the", " " * 20, "\t", "=", "__"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 14))) for _ in range(3000)] + ["y" * 300, "ab" * 100 + " " + "q" * 70]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(text, add_bos=True, add_eos=True)
        assert own.decode(ids) == sp.decode(sp.encode(text, add_bos=True, add_eos=True))


def test_pieces_cache_is_bounded(monkeypatch):
    """The cache holds a bounded number of bytes, long chunks not at all, and what has left it is encoded anew."""
    monkeypatch.setattr(pieces, "CACHED_BYTES", 50_000)
    path = public_tokenizers.path(pieces.MODEL)
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Encoder(path)
    rng = random.Random(6)
    for k in range(60):
        text = " ".join("".join(rng.choice("abcdeéí日") for _ in range(rng.randrange(1, 9))) for _ in range(100)) + " " + "日本" * (2000 + k)
        assert np.frombuffer(own.encode(text), "<u4").tolist() == sp.encode(text, add_bos=True, add_eos=True)
        for held in (own.young, own.old):
            assert sum(len(c) * 4 + len(i) for c, i in held.items()) < 70_000 and all(len(c) < pieces.LONG for c in held)


def test_pieces_table(spark, documents, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    for docs in (documents, odd):
        out = pieces.tokens(docs).collect()
        assert len(out) == docs.count()
        for r in out:
            ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
            assert (r.ids, r.n_tokens) == (ids, len(ids))
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.tokens(odd.limit(0), keep=["doc_id"], with_ids=False).count() == 0


def test_fm_index():
    rng = np.random.default_rng(0)
    for trial in range(40):
        parts = [rng.integers(1, rng.integers(2, 6), rng.integers(1, 30)) for _ in range(rng.integers(1, 8))]
        parts += parts[:3] if trial % 3 == 0 else []
        symbols = np.concatenate([np.append(s, 0) for s in parts])
        index = fmindex.FMIndex(symbols)
        patterns = [rng.integers(1, 6, rng.integers(1, 5)) for _ in range(30)]
        padded = np.zeros((30, 5), int)
        for k, p in enumerate(patterns):
            padded[k, : len(p)] = p
        low, high = index.ranges(padded, np.array([len(p) for p in patterns]))
        for k, p in enumerate(patterns):
            want = [i for i in range(len(symbols) - len(p) + 1) if (symbols[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def brute_report(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        ws = word.findall((t or "").translate(LOWER))
        for k in range(max(1, len(ws) - 9) if ws else 0):
            windows[tuple(ws[k : k + 10])].add(str(i))
    out = []
    for i, t in docs:
        ws, hit, found = word.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(ws[k : k + n])]
        out.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark, documents, odd, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = brute_report(rows, items)
    assert sorted(map(tuple, decontaminate.report(documents, bench).collect()), key=str) == want
    assert any(w[5] for w in want)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)  # several blocks, one after another
    assert sorted(map(tuple, decontaminate.report(documents, bench).collect()), key=str) == want


def test_many_windows_stay_small():
    """A block of 8 MB is held in arrays of a few bytes a byte of text, which is what goes to the workers."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{k:x}" for k in range(60_000)])
    items = [(k, " ".join(words[rng.integers(0, len(words), 400)])) for k in range(3400)]
    size = sum(len(t) for _, t in items)
    assert size > 7 << 20
    block = decontaminate.Windows(items)
    assert len(block) > 1_300_000 and len(pickle.dumps(block)) < 6 * size
    tracemalloc.start()
    shard = decontaminate.Shard(block)
    shard.add(pa.array([items[7][1] + " other words " + items[9][1][:200]], pa.large_string()))
    spans, found = shard.hits()
    assert found == [{"7", "9"}] and decontaminate.merge(spans[0])[0][:2] == (0, 400)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_decontamination_cases(spark, odd):
    items = [(1, "b c"), (1, "b c"), (2, None), (3, "  "), (4, "Three FOUR"), (5, "e f"), (None, "a"), (6, "word " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.report(odd, bench).collect()), key=str)
    assert got == brute_report([(r.doc_id, r.text) for r in odd.collect()], [i for i in items if i[0] is not None])
    cleaned = decontaminate.remove(odd, bench)
    assert cleaned.columns == odd.columns and cleaned.count() == odd.count()
    texts = {(r.doc_id, r.text) for r in cleaned.collect()}
    assert {(1, "a d "), (2, None), (3, ""), (7, "one\ntwo\n"), (7, "other text")} <= texts
    empty = bench.limit(0)
    assert decontaminate.report(odd, empty).filter("contaminated").count() == 0
    assert decontaminate.report(odd.limit(0), bench).count() == 0


def check_shards(docs, out, shards=8):
    rows = out.collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert set(places) <= set(range(shards)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert {r.law for r in rows} <= {"bytes"} and all(r.grown_shard is None for r in rows)
    return rows


def test_sharding(spark, documents, odd):
    rows = check_shards(documents, sharding.shard(documents))
    load = defaultdict(int)
    where = defaultdict(set)
    for r in rows:
        load[r.shard] += r.size
        where[r.virtual_slot].add(r.shard)
    assert max(load.values()) - min(load.values()) <= max(r.size for r in rows)
    assert all(len(s) == 1 for s in where.values())
    check_shards(odd, sharding.shard(odd))
    assert sharding.shard(odd.limit(0)).count() == 0


def test_sharding_hot_group(spark):
    """A group of copies with over a third of all bytes is cut; the sizes stay near equal."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('copy ', 40) ELSE concat('text ', id, repeat('x', id % 200)) END AS text")
    rows = check_shards(docs, sharding.shard(docs))
    load = defaultdict(int)
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) < 1.02 * min(load.values())


def stored(spark, path, version):
    return {(r.virtual_slot, r.part): r.shard for r in spark.read.parquet(str(path)).filter(f"version = {version}").collect()}


def test_map_edit(spark, documents, tmp_path):
    """A version is an edit of the one before: what has room stays."""
    sharding.shard(documents, map_path=str(tmp_path / "map")).count()
    first, second = (stored(spark, tmp_path / "map", v) for v in (0, 1))
    assert first.keys() == second.keys() and all(s == k[0] % 8 for k, s in first.items())
    assert sum(first[k] == second[k] for k in first) > len(first) / 2


def test_only_suspects_are_searched_by_blocks(spark, monkeypatch):
    """The bit map lets through every text with a window of any length, and hardly another; what it holds back has its words counted."""
    r = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    items = [" ".join(r.choice(words) for _ in range(n)) for n in (1, 3, 9, 10, 11, 40)]
    plain = [" ".join(r.choice(words[1:]) for _ in range(30)) for _ in range(300)]
    dirty = ["x, " + items[1].upper() + " y", items[2], "a b " + " ".join(items[5].split()[7:17]), items[3] + "!"]
    q = spark.createDataFrame([(t,) for t in items], "t string")
    bits, lengths, power = decontaminate._bit_map(q, 2000, 10)
    assert lengths == [1, 3, 9, 10]
    texts = [t for t in plain if items[0] not in t.split()] + dirty + ["", None]
    df = spark.createDataFrame([(t, k, 0, False) for k, t in enumerate(texts)], "t string, k long, w long, h boolean")
    got = {x.k: x for x in df.mapInArrow(decontaminate._suspects(spark.sparkContext.broadcast((bits, lengths, power))), df.schema).collect()}
    held = [k for k, x in got.items() if x.h]
    first = len(texts) - len(dirty) - 2
    assert {first, first + 1, first + 2, first + 3} <= set(held) and len(held) <= 6
    assert [got[k].w for k in range(len(texts))] == [len(re.findall(r"\w+", t or "")) for t in texts]


def test_map_of_other_slots_is_refused(spark, documents, tmp_path):
    path = str(tmp_path / "map")
    sharding.shard(documents, map_path=path).count()
    for numbers in ({"slots": 64}, {"fine": 8}):
        with pytest.raises(ValueError, match="4096 slots of 64 parts"):
            sharding.shard(documents, map_path=path, **numbers)
    assert spark.read.parquet(path).agg({"version": "max"}).first()[0] == 1


@pytest.mark.parametrize("shards,entries", [(8, 300), (3, 130), (5, 1), (4, 64)])
def test_rebalance_matches_a_greedy_loop(spark, shards, entries):
    """Heaviest first, stay while there is room up to the mean, else go to the emptiest shard."""
    r = random.Random(entries)
    sizes = {k: r.choice([1, 5, 5, r.randint(1, 3000)]) for k in range(entries)}
    old = {k: r.randrange(shards + 2) for k in range(0, entries + 9) if k % 4}  # some are new, some have no rows, some shards are no more
    made = sharding.rebalance(
        spark.createDataFrame([(v, k, -1, (s + v) % (shards + 2)) for k, s in old.items() for v in (0, 1)] or [], "version int, virtual_slot int, part int, shard int"),
        spark.createDataFrame([(k, -1, b) for k, b in sizes.items()], "virtual_slot int, part int, bytes long"), shards,
    )
    load, want, mean = [0] * shards, {}, -(-sum(sizes.values()) // shards)
    for k in sorted(old.keys() | sizes.keys(), key=lambda k: (-sizes.get(k, 0), k)):
        here, size = (((old[k] + 1) % (shards + 2)) if k in old else k) % shards, sizes.get(k, 0)
        to = here if load[here] + size <= mean else load.index(min(load))
        load[to] += size
        want[k] = to
    rows = made.collect()
    assert {x.virtual_slot: x.shard for x in rows} == want and len(rows) == len(want) and {x.version for x in rows} == {2 if old else 0}


def test_map_lives_on(spark, tmp_path):
    """Later calls edit the stored map: rows come and go, a slot becomes heavy, and every row finds a place."""
    path = tmp_path / "map"
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id, repeat('x', id % 90)) AS text")
    rows = {r.doc_id: r for r in check_shards(docs, sharding.shard(docs, map_path=str(path)))}
    more = docs.filter("doc_id >= 100").unionByName(spark.range(5000, 5300).selectExpr("id AS doc_id", "concat('new ', id) AS text"))
    again = {r.doc_id: r for r in check_shards(more, sharding.shard(more, map_path=str(path)))}
    assert {r.map_version for r in rows.values()} == {1} and {r.map_version for r in again.values()} == {2}
    assert stored(spark, path, 2).keys() > stored(spark, path, 1).keys()
    assert sum(again[k].shard != rows[k].shard for k in range(100, 2000)) < 400
    hot = more.unionByName(spark.range(9000, 10_500).selectExpr("id AS doc_id", "concat('text 777', repeat('x', 57)) AS text"))
    third = check_shards(hot, sharding.shard(hot, map_path=str(path)))
    load, slot = defaultdict(int), {r.virtual_slot for r in third if r.doc_id == 9000}
    for r in third:
        load[r.shard] += r.size
    assert max(load.values()) < 1.05 * min(load.values()) and {k[1] for k in stored(spark, path, 3) if k[0] in slot} > {-1}
    back = check_shards(docs, sharding.shard(docs, map_path=str(path)))
    assert {r.map_version for r in back} == {4} and len(back) == 2000
    fewer = check_shards(docs, sharding.shard(docs, shards=5, map_path=str(path)), 5)
    assert {r.map_version for r in fewer} == {5}


def test_sharding_hot_id(spark):
    """A third of all rows bear one id, or none, and one text: their slot's one heavy part is cut by place."""
    docs = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7L ELSE id END AS doc_id", "CASE WHEN id % 3 < 2 THEN repeat('copy ', 40) ELSE concat('text ', id) END AS text")
    load = defaultdict(int)
    for r in check_shards(docs, sharding.shard(docs)):
        load[r.shard] += r.size
    assert max(load.values()) < 1.1 * min(load.values())
