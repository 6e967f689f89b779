"""Quality, licences, personal data, language, toxicity, mixing and search: brute force, fixtures, held-out figures."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelode.llm import ivfpq, langid, licenses, mixing, pii, quality, queries, toxicity
from tunelode.llm.tagger import Tagger

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (5, "É" * 50_000), (6, "a b\x1cc d"), (None, "no id")]
WORD = r"[^\x20\x09-\x0D]+"


def odd(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, size string")


def test_measures_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["ab", "c", "É", " ", "\n", "\x0b", "#", "&", "<", "D", " "]) for _ in range(rng.randrange(60)))
        words = re.findall(WORD, text)
        lines = [x for x in text.split("\n") if re.search(WORD, x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(windows)
        repeated = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(repeated))
        assert quality.measure(text)[:6] == want


def test_ledger_policies_and_ablation(spark):
    rows = quality.ledger(odd(spark)).collect()
    assert len(rows) == len(ODD) and rows[0].ledger.n_words == 0 and rows[0].ledger.failed & quality.BIT["few_words"]
    led = quality.ledger(spark.read.parquet(f"{SF}/documents.parquet")).cache()
    out = {(r.policy, r.rule): r for r in quality.ablation(led).collect()}
    bits = [r.ledger.failed for r in led.collect()]
    for p in (quality.STANDARD, quality.LENIENT):
        for rule in p.rules:
            rest = p.mask & ~quality.BIT[rule]
            assert out[p.name, rule].kept_without == sum(b & rest == 0 for b in bits)
            assert out[p.name, rule].failed_rows == sum(b & quality.BIT[rule] > 0 for b in bits)
    with pytest.raises(ValueError):
        quality.ledger(led)


def test_license_sequences(spark):
    mit = "\n".join(licenses.SENTENCES[i][0] for i in ("MITGrant", "MITNotice", "MITNoWarranty", "MITLiability"))
    texts = {
        1: "Some code.\nThe MIT License (MIT)\nCopyright (c) 2020 A. Person\n" + mit, 2: None, 3: "", 4: "No clue here. Nothing.", 5: "Licensed under a license nobody knows.",
        6: "Text. Licensed under CC BY-NC 4.0. More text.\nAll rights reserved.", 7: "released UNDER the mit license.\nReleased under the MIT License.",
    }
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(1, 8)] == ["[MIT]", "", "", "", "", "[CC-BY-NC-4.0][Proprietary]", "[MIT][MIT]"]
    assert (got[5].sentences, got[5].n_unmatched, got[1].n_unmatched) == ("<Unknown>", 1, 0)
    assert all(re.search(licenses.CLUE, s) for s in licenses.sentences_by_text())


def test_license_oracle_on_odd_texts(spark):
    duckdb = pytest.importorskip("duckdb")
    documents = odd(spark).toPandas()  # noqa: F841 - read by DuckDB
    want = duckdb.sql(licenses.oracle()).fetchall()
    got = licenses.scan(odd(spark)).select("doc_id", "sentences", "licenses", "n_licenses", "n_unmatched").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((None if r[0] != r[0] else r[0], *r[1:])).replace(".0,", ",") for r in want)


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card":
                total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    parts = ["a.b", "@", "x-1", ".", "..", "c", " ", "4539 1488 0343 6467", "4539148803436467", "12", "7", "+1 (555) 010-9999", "+", "-", "(", "256", "1.2.3.4", "01.002.3.4.5", "\n", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_schedule_is_optimal():
    rng = random.Random(6)
    for _ in range(200):
        spans = [(s := rng.randrange(20), s + rng.randrange(1, 8), 0, rng.randrange(1, 9)) for _ in range(rng.randrange(8))]
        chosen = pii.schedule(spans)
        fits = lambda c: all(a[1] <= b[0] or b[1] <= a[0] for i, a in enumerate(c) for b in c[:i])
        best = max(sum(s[3] for s in c) for n in range(256) if fits(c := [s for i, s in enumerate(spans) if n >> i & 1]))
        got = [next(s for s in sorted(spans, key=lambda s: -s[3]) if s[:3] == c) for c in chosen]
        assert fits(got) and sum(s[3] for s in got) == best


def test_gradients_equal_differences():
    t = Tagger(3, embed=3, hidden=2)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 98, (2, 5)), rng.integers(0, 3, (2, 5))
    _, grad = t.gradients(x, y)
    for k, v in t.p.items():
        at = np.unravel_index(rng.integers(v.size) if k != "emb" else np.ravel_multi_index((x[0, 0], 1), v.shape), v.shape)
        keep = v[at]
        v[at] = keep + 1e-5
        up = t.gradients(x, y)[0]
        v[at] = keep - 1e-5
        down = t.gradients(x, y)[0]
        v[at] = keep
        assert abs((up - down) / 2e-5 - grad[k][at]) < 1e-3


def test_tagger_adds_spans_and_keeps_base_ones(spark):
    text = "call me on +1 (555) 010-9999 or at jane.doe @ mail.example.com and 4539 1488 0343 6467 from 10.0.0.1"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x" * 100_000 + " 10.0.0.7 ")], "doc_id long, text string")
    got = {r.doc_id: r.pii for r in pii.find(rows).collect()}
    assert [(s.start, s.end, pii.KINDS.index(s.kind)) for s in got[1] if s.base] == plain_spans(text)
    assert got[2] == got[3] == [] and [(s.kind, s.start) for s in got[4]] == [("ip", 100_001)]
    clean = {r.doc_id: r.text for r in pii.redact(rows).collect()}
    assert clean[2] is None and "[PHONE]" in clean[1] and "[IP]" in clean[1] and "6467" not in clean[1]


def test_tagger_on_unseen_windows():
    x, y = pii.training_windows(300, seed=99)
    tags, _ = pii.trained().decode(x)
    inside = (y > 0) | (tags > 0)
    assert (tags == y).mean() > 0.97 and ((tags == y) & inside).sum() / inside.sum() > 0.8


def test_language_held_out(spark):
    out = queries.op4_compression_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.93
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = langid.predict(odd(spark), model).collect()
    assert [r.lang_pred for r in rows if r.doc_id in (1, 2, 3)] == ["und"] * 3 and len(rows) == len(ODD)
    assert langid.decide("123 !?", model, 0.01)[0] == "und" and langid.decide("text", {}, 0.01)[0] == "und"
    tie = langid.decide("zzz", {"a": b"abcdefghij", "b": b"abcdefghij"}, 0.01)
    assert tie == ("a", 0.5, False)


def test_toxicity_held_out(spark):
    rows = queries.op5_boosted_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    pairs = s[y == 1][:, None] - s[y == 0][None]
    assert ((pairs > 0) + 0.5 * (pairs == 0)).mean() > 0.85  # some forty toxic texts to learn from
    assert ((0 <= s) & (s <= 1)).all()


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 0), (4, 0)], "doc_id long, toxic int")
    scores = [r.score for r in toxicity.score(odd(spark), toxicity.fit(odd(spark), labels)).collect()]
    assert len(scores) == len(ODD) and max(scores) < 0.01
    assert toxicity.score(odd(spark), toxicity.Model()).count() == len(ODD)


def test_isotonic_and_boost():
    knots, rate = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert rate.tolist() == [0.0, 0.5, 1.0] and knots.tolist() == [1.0, 2.5, 4.0]
    rng = np.random.default_rng(1)
    x = rng.random((800, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((toxicity.boost(x, y).margin(x) > 0) == (y > 0)).mean() > 0.95


def test_sainte_lague_equals_highest_quotients():
    rng = random.Random(8)
    for _ in range(300):
        votes = [rng.choice((0, 1, 5, rng.random() * 100)) for _ in range(rng.randrange(1, 7))]
        seats, got = rng.randrange(30), [0] * 7
        for _ in range(seats if sum(votes) else 0):
            i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
            got[i] += 1
        assert mixing.sainte_lague(votes, seats) == got[: len(votes)]


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 1.5, 2.0) == pytest.approx([200, 2 / 3 * 250, 1 / 3 * 250])
    assert mixing.targets([10, 100], [5, 2], 1.5, 2.0) == pytest.approx([20, 145])
    assert mixing.targets([0, 0], [5, 2], 1.5, 2.0) == [0.0, 0.0]


def test_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.union(spark.createDataFrame([(-1, None, None), (-2, "a b c", None), (None, "x y", "src1"), (-2, "a b c", None)], docs.schema)).cache()
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    by = {}
    for r in rows:
        assert r["size"] == len(re.findall(WORD, r.text or "")) and 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, []).append(r)
    goal = mixing.targets([sum(r["size"] for r in by[s]) for s in sorted(by, key=lambda s: (s is None, s or ""))], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(by))], 1.5, 2.0)
    for s, g in zip(sorted(by, key=lambda s: (s is None, s or "")), goal, strict=True):
        assert by[s][0].target == pytest.approx(g) and abs(sum(r.taken for r in by[s]) - g) <= max(64, 0.02 * g)
    out = mixing.apply_mix(docs).groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).collect()
    assert {r.source: r.n for r in out} == {s: n for s in by if (n := sum(r.taken for r in by[s]))}


def test_search(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((3000, 20))
    v[100:130] = v[5]  # copies: ties go to the smaller id
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9001, None), (9002, []), (9003, [0.0] * 20), (9004, [float("nan")] * 20), (9005, [None] * 20), (None, [1.0] * 20)]
    got = ivfpq.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 50 = 0").collect()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for q in range(0, 3000, 50):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        score = unit @ unit[q]
        score[q] = -2
        best = np.lexsort((np.arange(3000), -np.round(score, 12)))[:5]
        hits += len({m[1] for m in mine} & set(best.tolist()))
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(score[i] - s) < 1e-12 for _, i, s in mine)
        if q == 100:
            assert [m[1] for m in mine] == [5, 101, 102, 103, 104]
    assert hits / 300 >= 0.9
    few = ivfpq.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>"), "vec_id = 0").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1)]
    assert ivfpq.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), "true").count() == 0
