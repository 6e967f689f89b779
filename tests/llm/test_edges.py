"""Mixing at scale and of small sources, hot groups of the parity-sketch join, the tokenizer's cache, and odd rows in every pipeline stage."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pairs_and_packing import brute_components

from tunelode.llm import ivfpq, jaccard, mixing, packing


def test_drawn_words_are_whole_stretches_and_one_in_part():
    rng = np.random.default_rng(3)
    for _ in range(300):
        sizes = rng.integers(0, 30, rng.integers(0, 12))
        total, block = int(sizes.sum()), int(rng.integers(1, 9))
        quota = int(rng.integers(0, 2 * total + 5))
        passes, taken = mixing.draw(sizes, quota, block, np.random.default_rng(1))
        room = [min(block, total - i) for i in range(0, total, block)]
        assert passes * total + taken.sum() == min(quota, 2 * total)
        assert len(taken) == len(room) and all(0 <= t <= r for t, r in zip(taken, room, strict=True))
        assert sum(0 < t < r for t, r in zip(taken, room, strict=True)) <= 1


def test_cuts_of_a_huge_source(spark):
    size, blocks = 40_000_000_000_000, 1_900_000_000_001
    rows = spark.createDataFrame([(size * k // 7,) for k in range(8)], "upto long")
    got = [r[0] for r in rows.select(mixing.cut_at(F.col("upto"), F.lit(blocks), F.lit(size))).collect()]
    want = [(2 * (size * k // 7) * blocks + size) // (2 * size) for k in range(8)]
    assert got[-1] == blocks and all(abs(g - w) <= 1 for g, w in zip(got, want, strict=True))


def test_small_sources_come_near_their_target(spark):
    docs = [(i, "word " * 40, "a") for i in range(50)] + [(90, "only five words stand here", "b"), (91, "one", "c"), (92, None, None)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    for source in "abc":
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
        assert all(r.taken <= 2 * r["size"] for r in mine)


def test_a_small_source_leaves_other_sources_blocks_alone(spark):
    """Every source's quota is of blocks of its own length, and its draw of stretches of that length."""
    assert [mixing.block_length(x, 32) for x in (10_000, 128, 127, 63, 4, 3, 0)] == [32, 32, 16, 8, 1, 1, 1]
    assert mixing.apportioned([6400.0, 3200.0, 10.0], [32, 32, 2]) == [200, 100, 5]
    assert [mixing.words_of(*x) for x in ((4, 32, 100.0), (3, 32, 100.0), (4, 32, 128.0), (0, 1, 0.2), (2, 1, 2.0))] == [100, 96, 128, 0, 2]
    big = [(i, "word " * 100, s) for s in "ab" for i in range(200)]
    taken = []
    for small in ([], [(900, "one two three", "c")]):
        docs = spark.createDataFrame(big + small, "doc_id long, text string, source string")
        rows = mixing.mix(docs, weights=(1, 5, 1), share=1.0, ranges=True).where("source = 'a'").collect()
        ends = sum(r.taken for r in rows)
        assert abs(ends - rows[0].target) <= 32
        once = [x.to - x["from"] for r in rows for x in r.ranges]
        assert sum(once) + sum(r.passes * r["size"] for r in rows) == ends
        assert max(once) >= 32
        taken.append(ends)
    assert abs(taken[0] - taken[1]) <= 32


def test_neighbours_across_borders_of_ranges(spark):
    """One hot key over many ranges, copies of rows, and keys of one node give a plain loop's neighbours."""
    rng = random.Random(4)
    rows = [(7, i) for i in range(5000)] + [(rng.randrange(-300, 300), rng.randrange(10**6)) for _ in range(3000)]
    rng.shuffle(rows)
    rows += rows[:50]
    want = {}
    for key, node in set(rows):
        want.setdefault(key, []).append(node)
    want = {(k, a, b) for k, v in want.items() for a, b in zip(sorted(v), sorted(v)[1:], strict=False)}
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        for parts in ("1", "16"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            done = []
            got = jaccard._met(spark.createDataFrame(rows, "key long, nth long").repartition(3), done).collect()
            assert {tuple(r) for r in got} == want and len(got) == len(want)
            assert done[0].where("part IS NOT NULL").select("part").distinct().count() == (1 if parts == "1" else 16)
            assert jaccard._met(spark.createDataFrame([], "key long, nth long"), done).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_mixing_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c " * 30, "x", 77, 5, "p"), (2, "d e f " * 30, "y", 88, 6, "q")], "doc_id long, text string, source string, _size int, _tie int, size string")
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    assert {(r.doc_id, r._size, r._tie, r["size"]) for r in out.collect()} == {(1, 77, 5, "p"), (2, 88, 6, "q")}


def test_mixing_leaves_out_texts_without_words(spark):
    """Empty, blank and null texts lie within the ranges that the mix takes, and leave no row."""
    rows = [(i, ["", None, " \n", f"a{i} b c d e f g"][i % 4], "xy"[i % 3 > 0]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.apply_mix(docs).collect()
    assert {r.doc_id for r in out} == {i for i, n in taken.items() if n}
    assert all(r.doc_id % 4 == 3 and r.text.strip() for r in out)
    words: dict[int, int] = {}
    for r in out:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: n for i, n in taken.items() if n}


def test_hot_group_of_copies_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # several blocks a segment
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.choice((2, 3, 4, 5, 6))):
            text[rng.randrange(0, 120, 6)] = f"x{rng.randrange(3)}"
        rows.append((i, " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components(rows)
    assert got == want and 2 < len({c for _, c in want.values()})


def pages(n, own):
    """n pages of one template of 120 words, each with some words of its own; every fifth page shares most of them with the one before."""
    rng = random.Random(9)
    template, rows, mine = [f"t{k}" for k in range(120)], [], []
    for i in range(n):
        if i % 5 != 4:
            mine = [f"p{i}w{k}" for k in range(rng.choice(own))]
        texts = mine if i % 5 != 4 else [*mine[:-2], f"p{i}"]
        rows.append((i, " ".join([*template[:60], *texts, *template[60:]])))
    return rows


@pytest.mark.parametrize("own", [(30,), (8, 12, 15, 20, 26, 33, 45)])
def test_template_pages_equal_brute_force(spark, monkeypatch, own):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows = pages(160, own)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components(rows)
    assert got == want and len({c for _, c in want.values()}) > 2


def test_one_id_with_two_texts_and_repeated_rows(spark):
    one, two = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(5, one), (2, one), (5, two), (5, two), (7, two), (None, two), (8, None), (8, "")]
    got = jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == [(0, 6, 5), (2, 6, 2), (5, 6, 2), (5, 6, 5), (5, 6, 5), (7, 6, 5), (8, 0, 8), (8, 0, 8)]


def test_tokenizer_cache_is_bounded_and_ids_stay_the_same():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rng = random.Random(2)
    texts = ["".join(rng.choice(["an", "É", "ß", "'s", "9", ".", ", ", " ", "\n", "Don't ", "x́", " ", "日本", "İ", "Σ", "<|endoftext|>"]) for _ in range(40)) for _ in range(400)]
    small, want = packing.WordTokenizer(path, 200_000), packing.WordTokenizer(path)
    for i in range(0, 400, 20):
        got = small.ids(texts[i : i + 20])
        assert got == [want._plain(t) for t in texts[i : i + 20]]
        assert (len(small.chunks) + len(small.words)) * small.ENTRY_BYTES <= 400_000


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def odd_documents():
    rng = random.Random(1)
    plain = lambda n: " ".join(f"{rng.choice(WORDS)}{rng.randrange(200)}" for _ in range(n))
    same = plain(80)
    long = plain(120_000)
    texts = [(1, same, "a"), (2, same, "b"), (2, same, "b"), (None, same, "a"), (3, None, "a"), (4, "", None), (5, long, "a"), (None, plain(70), None), (6, plain(90) + " mail jane@example.org now", "c"), (None, None, None), (7, plain(60), "c")]
    return [(i, t, None, s, None, "v", i, "w") for i, t, s in texts]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, _ledger long, node string"


def test_every_stage_takes_odd_rows_and_names(spark, tmp_path):
    docs = spark.createDataFrame(odd_documents(), SCHEMA)
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        assert name == "best-fit packing" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        if name == "PII":
            assert docs.where("text LIKE '%jane@%'").count() == 0 and docs.where("text LIKE '%[EMAIL]%'").count() == 1
    assert sizes[:3] == [8, 5, 5] and sizes[3] > 0 and sizes[4] >= sizes[3]


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_search_takes_tiny_huge_and_odd_vectors(spark):
    rows = [(0, [1e-200, 0.0]), (50, [3.0, 4.0]), (1, [1e200, 1e200]), (2, [5e-324, 0.0]), (3, [1.0, 2.0, 3.0]), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, None), (8, [])]
    got = ivfpq.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 50 = 0").collect()
    by = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50)}
    half = 0.5**0.5
    assert [i for i, _ in by[0]] == [2, 1, 50] and [s for _, s in by[0]] == pytest.approx([1, half, 0.6])
    assert [i for i, _ in by[50]] == [1, 0, 2] and [s for _, s in by[50]] == pytest.approx([1.4 * half, 0.6, 0.6])
