"""Language and toxicity against plain loops: one text, word, dictionary or tree at a time."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard

from tunelode.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.001"
ODD = [(9001, None, "en"), (9002, "", "en"), (9003, "12 ?!", "de"), (9004, "Ünïcode ÉÉ ñ " * 3000, "fr"), (9005, "naïve\x0bwörds", None)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return spark.createDataFrame(rows + ODD, "doc_id long, text string, lang string"), rows + ODD


def plain_language(text, model):
    if not text or not any(c.isalpha() for c in text):
        return "und"
    data = b" ".join(re.findall(rb"[a-z\x80-\xff]+", text.lower().encode()))
    cost = {}
    for lang, content in model.items():
        cost[lang] = 0
        for at in range(0, len(data), langid.PIECE):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)
            cost[lang] += len(coder.compress(data[at : at + langid.PIECE]))
    return min(sorted(cost), key=cost.get)


def test_language_equals_a_plain_loop(texts):
    docs, rows = texts
    model = langid.fit(docs)
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()} == {i: plain_language(t, model) for i, t, _ in rows}


def test_language_of_no_rows_and_of_too_many_languages(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.fit(none) == {} and langid.predict(none, {}).count() == 0
    many = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(langid.MAX_LANGS + 1)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.fit(many)


def plain_features(text, lexicon):
    """The features by their definitions, each word by itself."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return [0.0] * len(toxicity.FEATURES)
    plain = [re.sub(r"^[^\w@$]*_*|[\W_]+$", "", w).lower() for w in words]
    look = lambda w: max(lexicon.get(w, 0.0), *(lexicon.get(w[:k] + "*", 0.0) if len(w) >= k else 0.0 for k in (4, 5, 6)))
    weight, mixed, hidden = [], [], []
    for w in plain:
        some = len(w) > 3 and not w.isalpha() and any(c.isalpha() for c in w) and any(c in "013457@$!" for c in w)
        clear = look(w.translate(toxicity.SIGNS))
        hides = some and look(w) < toxicity.STRONG <= clear
        weight.append(clear if hides else look(w))
        mixed.append(some)
        hidden.append(hides)
    n, strong = len(words), [x >= toxicity.STRONG for x in weight]
    you = [w in toxicity.SECOND for w in plain]
    near = sum(s and any(you[max(0, k - toxicity.NEAR) : k + toxicity.NEAR + 1]) for k, s in enumerate(strong))
    capital = sum(len(p) > 1 and w == w.upper() != w.lower() for w, p in zip(words, plain, strict=True))
    signs = sum(not c.isalnum() for w in words for c in w)
    forms = len({w for w, s in zip(words, strong, strict=True) if s})
    return [
        sum(weight) / n, sum(strong) / n, math.log1p(sum(strong)), math.log1p(forms), sum(0 < x < toxicity.STRONG for x in weight) / n, sum(you) / n, near / n,
        capital / n, sum("!" in w for w in words) / n, sum("?" in w for w in words) / n, signs / n, sum(mixed) / n, sum(hidden) / n, math.log1p(n), max(weight),
    ]


def plain_margin(x, model):
    total = model.start
    for feature, threshold, value in model.trees:
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
        total += value[node - len(feature)]
    return total


def test_features_and_margins_equal_plain_loops(texts):
    _, rows = texts
    rng = random.Random(6)
    vocabulary = sorted({w.lower() for _, t, _ in rows for w in (t or "").split() if w.isalpha()})
    lexicon = {w: rng.uniform(1.5, 5) for w in rng.sample(vocabulary, 60)} | {w[:4] + "*": 2.0 for w in rng.sample(vocabulary, 20) if len(w) > 3}
    word = next(w for w in lexicon if len(w) > 3 and "e" in w and w.isalpha())
    lexicon[word] = 4.0
    made = [f"YOU {word.upper()}!! or {word.replace('e', '3')}, you? ok", f"({word}) far far far far you", "A B 1 a1b2", "!!! ... @$"]
    every = [t for _, t, _ in rows] + made
    make = toxicity.Featurizer(lexicon)
    got, want = make.many(every), np.array([plain_features(t, lexicon) for t in every])
    np.testing.assert_allclose(got, want, rtol=1e-5, atol=1e-6)
    y = (np.random.default_rng(1).random(len(got)) < 0.3).astype(float)
    model = toxicity.boost(got, y, rounds=10)
    np.testing.assert_allclose(model.margin(got), [plain_margin(x, model) for x in got], rtol=1e-9)


def test_isotonic_equals_the_minimax_form():
    rng = np.random.default_rng(3)
    margin, y = rng.permutation(40) / 7, (rng.random(40) < 0.4).astype(float)
    knots, rates = toxicity.isotonic(margin, y)
    y = y[np.argsort(margin)]
    want = [max(min(y[a:b].mean() for b in range(i + 1, 41)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(sorted(set(np.round(want, 12))), rates) and (np.diff(knots) > 0).all()


def test_toxicity_counts_and_no_labels(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["bad Words!", "bad bad", None, "words"])], "doc_id long, text string")
    got = {r.key: r.n for r in toxicity._counts(docs.select("text"), None).collect()}
    assert got == {"bad": 2, "words": 2, "word*": 2, "words*": 2}
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score < 0.1 for r in toxicity.score(docs, model).collect()} == {True} and model.trees == []


def test_dictionaries_are_shared_by_excerpts_from_hashed_places(spark):
    data = b" ".join(b"word%d" % i for i in range(3000))
    cut = langid.excerpt(data)
    assert len(cut) == langid.EXCERPT and cut in data and not data.startswith(cut) and data[data.index(cut) - 1 :][:1] == b" "
    assert langid.excerpt(b"few words") == b"few words" and langid.excerpt(b"x" * 9000) == b"x" * langid.EXCERPT
    texts = [b"a" * 2000] * 100 + [b"b" * 10] * 100
    got = langid._shared_out(texts)
    assert len(got) <= langid.DICT_BYTES and len(got) > langid.DICT_BYTES - 300 and got.split(b" ")[100:] == [b"b" * 10] * 100
    assert {len(x) for x in got.split(b" ")[:100]} <= {643, 644}
    rows = [(None, f"ein kurzer text mit {chr(97 + i % 26) * (1 + i // 26)}", "de") for i in range(30)] + [(1, "a short text", "en")] * 3 + [(2, "12", "xx")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(model) == ["de", "en"] and model["en"] == b"a short text" and model["de"].count(b"ein kurzer") == 30


def test_rows_without_an_id_are_learned_from(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,), (3,), (4,), (5,)], "doc_id long").select("doc_id", queries._held_out().alias("h")).collect()
    assert {r.doc_id: r.h for r in rows} == {None: False} | {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(1, 6)}
