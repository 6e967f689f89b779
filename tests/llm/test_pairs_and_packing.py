"""Parity-sketch join, packing and sharding against brute force."""

import itertools
import random
import zlib

import numpy as np
import pytest

from tunelode.llm import jaccard, packing, sharding

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((root(i), root(j)), key=lambda r: rows[r][0])
            parent[y] = x
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return {doc_id: (len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(rows)}


def near_copies():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE two"), (5, "one two three four five"), (6, "x " * 3000)]
    for size in (9, 30, 64, 70, 200, 900):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(12):
            text = list(base)
            for _ in range(rng.choice((0, 1, 2, max(1, size // 60), max(1, size // 45), size // 20))):
                at = rng.randrange(len(text))
                text[at : at + 1] = rng.choice(([], ["new"], [text[at], "more"]))
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("rows", [near_copies(), None])
def test_components_equal_brute_force(spark, rows):
    if rows is None:
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert len(got) == len(rows)


def test_drop_near_keeps_one_of_each_group(spark):
    rows = [(5, "a b c d e f", 1), (2, "A b c d e f", 2), (2, "A b c d e f", 3), (9, "other words are here now", 4), (None, "other words are here now", 5), (None, "alone", 6), (None, "alone", 7), (7, None, 8)]
    got = jaccard.drop_near(spark.createDataFrame(rows, "doc_id long, text string, node int")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == [(False, 2, "A b c d e f"), (False, 7, ""), (False, 9, "other words are here now"), (True, 0, "alone")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    assert jaccard.near_components(none).count() == jaccard.drop_near(none).count() == packing.pack(none, path).count() == sharding.shard(none).count() == 0


def test_packing_round_trip(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    odd = [(-1, None, "x"), (-2, "", "x"), (-3, "a" * 30_000, "x"), (-4, "<|endoftext|> Straße İstanbul ΣΑΣ\x1c o'clock 12,5%", "x"), (-5, "word " * 9000, "x")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = packing.pack(docs, path).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for doc_id, pieces in by_doc.items():
        ids = [*tok.encode(texts[doc_id], add_special_tokens=False).ids, 0]
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        for r in pieces:
            cut = np.array(ids[r.start : r.start + r.length], dtype="<u4")
            assert r.start == 2048 * r.piece and zlib.crc32(cut.tobytes()) == r.ids_crc32
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_seq) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_fullest_is_best_of_all_subsets():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = rng.integers(1, 12, rng.integers(0, 8)).tolist()
        room = int(rng.integers(0, 30))
        best = max(s for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n) if (s := sum(c)) <= room)
        used = packing.fullest(np.bincount(sizes, minlength=room + 1), room)
        assert sum(k * n for k, n in used.items()) == best and all(n <= sizes.count(k) for k, n in used.items())


def test_smallest_capacity_is_minimal():
    rng = np.random.default_rng(2)
    for _ in range(100):
        sizes = rng.integers(0, 20, rng.integers(1, 8))
        k = int(rng.integers(1, 5))
        cuts = itertools.combinations_with_replacement(range(len(sizes) + 1), k - 1)
        best = min(max(sizes[a:b].sum() for a, b in itertools.pairwise((0, *c, len(sizes)))) for c in cuts)
        assert sharding.smallest_capacity(sizes, k) == best
        of = sharding.minimax_cuts(sizes, k)
        assert (np.diff(of) >= 0).all() and of.max(initial=0) < k and np.bincount(of, sizes, k).max() <= best


def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.union(spark.createDataFrame([(-1, None, None, None, None), (-2, "", None, None, None), (-3, None, None, None, None)], docs.schema))
    rows = sharding.shard(docs.withColumn("shard", docs.lang)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    by_text, load, slots = {}, np.zeros(40), {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        assert by_text.setdefault(texts[r.doc_id], r.shard) == r.shard
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert load.max() < 1.25 * load.mean()
