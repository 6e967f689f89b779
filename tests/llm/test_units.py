"""Piece encoding, periodic runs and fill-in-middle against plain versions, and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelode.llm import infill, pieces, queries, runs

ODD = [None, "", " ", "  ", "\n", "a", "▁", "▁ ▁a", " a", "a ", "日本語 text", "😀😀 x\n\n y", "<s> </s> <0x41>", "\0a", "é́", "\tx\r\n", "<unk>", " \n \n", "a\x1cb\x85c d", "x<P>y", "x <S", "<", "one two"]
SCHEMA = "doc_id long, text string, n int, form string, at int, `key` string, copies int, runs string"


def odd_rows():
    rng = random.Random(6)
    long = " ".join(rng.choice(["la", "le", "li", "lo", "été"]) + rng.choice(["", "x", "\n"]) for _ in range(60_000))
    texts = [*ODD, "a b c d e f " * 9, "a b c d e f " * 9, long]
    rows = [(i, t, i, "f", 1, "k", 2, "r") for i, t in enumerate(texts)]
    return rows + [rows[-2], rows[-2], (None, "la la " * 30, *rows[0][2:]), (None, None, *rows[0][2:]), (None, "la la " * 30, *rows[0][2:])]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    bits = ["a", "▁", " ", "  ", "\n", "é", "日", "😀", "the", "ing", " the", " ", "<0x0A>", "<s>", "٣", "<P>", "\u001c"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(n)]


# pieces


@pytest.fixture(scope="module")
def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def same_as_library(model, library, texts):
    got = model.encode(texts)
    for text, (ids, spans) in zip(texts, got, strict=True):
        want = library.encode((text or "").encode(), return_type="offset_mapping", return_bytes=True)
        assert np.frombuffer(ids, "<u4").tolist() == [library.bos_id(), *want["ids"], library.eos_id()] == library.encode(text or "", add_bos=True, add_eos=True)
        assert [tuple(s) for s in np.frombuffer(spans, "<u4").reshape(-1, 2).tolist()[1:-1]] == want["offsets"]
    assert model.decode([ids for ids, _ in got]) == [library.decode(library.encode(t or "", add_bos=True, add_eos=True)) for t in texts]


def test_pieces_and_spans_equal_the_library(model_path):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=model_path)
    same_as_library(pieces.PieceModel(model_path), library, ODD + random_texts(500))
    small = pieces.PieceModel(model_path, cache_bytes=20_000)
    for seed in range(5):
        same_as_library(small, library, random_texts(40, seed))
        assert small.held < 90_000  # the bound and what one batch brings


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_character_map_and_places_equal_the_library(rule, squeeze):
    from sentencepiece import SentencePieceNormalizer

    library = SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    own = pieces.Normalizer(b"".join(v for n, v, _ in pieces.fields(library.serialized_model_proto()) if n == 3), [])
    rng = random.Random(3)
    chars = ["a", "B", " ", "  ", "ﬁ", "Å", "①", "㌀", "ｶﾞ", "　", "é", "日", "😀", "¨", " ", "\t", "\n", "½", "ẛ̣", "ᄒ", "ᅡ", "ᆫ", "Σ", "İ"]
    for _ in range(1500):
        text = "".join(rng.choice(chars) for _ in range(rng.randrange(12)))
        want, places = library.normalize(text, with_offsets=True)
        got, at = own(text)
        assert got.decode() == want
        starts = np.cumsum([0, *[len(c.encode()) for c in want]])
        of_char = np.cumsum([0, *[len(c.encode()) for c in text]])
        assert [int(at[i]) for i in starts] == [int(of_char[i]) for i in places]


def test_symbols_are_taken_as_they_are():
    own = pieces.Normalizer(b"\x18\x00\x20\x00\x28\x01", ["<x y>"])
    text, at = own("é<x y> z")
    assert text.decode() == "é<x▁y>▁z" and at[-1] == len("é<x y> z".encode())


def test_pieces_of_odd_rows(spark, model_path):
    from sentencepiece import SentencePieceProcessor

    library, rows = SentencePieceProcessor(model_file=model_path), odd_rows()
    out = pieces.encode(spark.createDataFrame(rows, SCHEMA), model_path)
    got = out.withColumn("back", pieces.decoded(F.col("ids"), model_path)).withColumn("numbers", pieces.numbers(F.col("ids"))).collect()
    ids = {t: library.encode(t or "", add_bos=True, add_eos=True) for _, t, *_ in rows}
    order = lambda x: (x[0] is None, x[0], x[1])
    assert sorted([(r.doc_id, list(r.numbers), r.n_tokens, r.back) for r in got], key=order) == sorted([(i, ids[t], len(ids[t]), library.decode(ids[t])) for i, t, *_ in rows], key=order)
    assert pieces.encode(spark.createDataFrame([], SCHEMA), model_path).count() == 0


# runs


def brute_runs(words, shortest):
    n, out = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            size = j + p - i
            if size >= max(shortest, 2 * p) and not any(all(words[x] == words[x + q] for x in range(i, i + size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    return [w for k, w in enumerate(words) if not any(s + p <= k < s + n for s, n, p in found)]


def test_runs_equal_brute_force_on_random_words():
    rng = random.Random(3)
    for _ in range(400):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            w = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(50))]
            if rng.random() < 0.5 and w:
                a, p = rng.randrange(len(w)), 1 + rng.randrange(6)
                w = [w[i] if i < a else w[min(a + (i - a) % p, len(w) - 1)] for i in range(len(w))]
            docs.append(w)
        shortest = rng.choice([2, 5, 12])
        got = runs.runs(np.array([x for d in docs for x in d], dtype=np.int64), [len(d) for d in docs], shortest)
        assert list(map(tuple, got.tolist())) == [(i, s, n, p) for i, d in enumerate(docs) for s, n, p in sorted(brute_runs(d, shortest), key=lambda r: (r[0], r[2]))]


def test_next_smaller_of_hard_orders():
    rng = np.random.default_rng(0)
    for v in (rng.integers(0, 50, 3000), np.arange(700), np.arange(700)[::-1], np.repeat(np.arange(9), 100), np.r_[np.arange(500), np.arange(500)], np.zeros(0, dtype=np.int64)):
        got = runs.next_smaller(v)
        stack, want = [], np.full(len(v), len(v))
        for i, x in enumerate(v):
            while stack and v[stack[-1]] > x:
                want[stack.pop()] = i
            stack.append(i)
        assert (got == want).all()


def test_long_runs_of_a_long_text():
    words = np.array([k % 7 for k in range(150_000)] + list(range(100, 400)) + [5, 6] * 40_000)
    got = runs.runs(words, [len(words)], 12)
    assert got.tolist() == [[0, 0, 150_000, 7], [0, 150_300, 80_000, 2]]
    fibonacci, other = [1, 0], [1]
    while len(fibonacci) < 5000:
        fibonacci, other = fibonacci + other, fibonacci
    some = fibonacci[:300]
    assert [tuple(r[1:]) for r in runs.runs(np.array(some), [300]).tolist()] == brute_runs(some, 2)
    assert len(runs.runs(np.array(fibonacci), [len(fibonacci)])) < len(fibonacci)  # the runs theorem


def test_runs_of_odd_rows_and_small_chunks(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for _, t, *_ in rows:
        words = (t or "").encode().split()
        if len(words) < 1000:
            found = brute_runs(words, 12)
            want[t] = ([tuple(r) for r in found], b" ".join(brute_collapsed(words, found)).decode())
    by_id = {i: t for i, t, *_ in rows if i is not None}
    for chunk in (20, runs.CHUNK):
        got = runs.periodic_runs(docs, chunk=chunk).collect()
        assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 3
        for r in got:
            text = by_id[r.doc_id] if r.doc_id is not None else "la la " * 30 if r.n_words else None
            if text in want:
                assert ([tuple(x) for x in r.runs], r.collapsed) == want[text]
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    sha, some = lambda x: hashlib.sha256(x).hexdigest(), 0
    for doc_id, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        found, r = brute_runs(words, 12), got[doc_id]
        some += bool(found)
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode())
        assert r.collapsed_sha256 == sha(b" ".join(brute_collapsed(words, found)))
    assert some > 10


# fill in middle


def brute_infill(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = re.findall(infill.UNIT, text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    k = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((k[0] % (n + 1), k[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or k[2] % 100 >= rate:
        return n, "plain", None, None, text
    head, mid, tail = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if k[3] % 100 < spm:
        return n, "spm", len(head), len(mid), f"<S>{tail}<P>{head}<M>{mid}"
    return n, "psm", len(head), len(mid), f"<P>{head}<S>{tail}<M>{mid}"


def test_infill_of_odd_rows(spark):
    rows = [*odd_rows(), *[(100 + i, t, 0, "", 0, "", 0, "") for i, t in enumerate(random_texts(300))]]
    docs = spark.createDataFrame(rows, SCHEMA)
    for rate, spm in ((50, 80), (100, 0), (100, 100)):
        out = infill.fill_in_middle(docs, rate=rate, spm=spm)
        got = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
        order = lambda x: (x[0] is None, x[0] or 0, x[-2])
        assert sorted([tuple(r) for r in got], key=order) == sorted([(i, *brute_infill(i, t, rate, spm), t or "") for i, t, *_ in rows], key=order)
    assert infill.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0


def test_infill_reads_texts_from_one_exchange(spark, tmp_path):
    spark.range(3000).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 50) AS text").write.parquet(f"{tmp_path}/d")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = infill.fill_in_middle(spark.read.parquet(f"{tmp_path}/d"))
        assert out.count() == 3000
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plan.count("+- Exchange ") == 1 and plan.count("ReusedExchange") == 2
