"""Words hashed a text at once: equal words, A-Z like a-z, have equal hashes and others don't, wherever a text is cut."""

import random

import pytest

from tunelode.llm import jaccard

WORDS = ["a", "b", "ab", "ba", "B", "Foo", "foo", "é", "É", "日本", "x" * 4_096, "x" * 4_097, "X" * 5_000, "x" * 5_000, "\u00a0"]


@pytest.mark.parametrize("at_once", [40, 262_144])
def test_hashes_tell_words_apart(monkeypatch, at_once):
    monkeypatch.setattr(jaccard, "AT_ONCE", at_once)
    rng, seen = random.Random(4), {}
    for _ in range(200):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(30))]
        text = rng.choice(["", " ", "\n\t"]) + "".join(w + rng.choice([" ", "\r\n", "\x0b\x0c", " " * 5_000]) for w in words)
        data = jaccard.encoded(text if rng.random() < 0.5 else text.rstrip(" \r\n\x0b\x0c"))
        want, got = data.lower().split(), jaccard._word_hashes(data).tolist()
        assert len(want) == len(got)
        assert all(seen.setdefault(w, h) == h for w, h in zip(want, got, strict=True))
    assert set(seen) == {w.encode().lower() for w in WORDS}
    assert len(set(seen.values())) == len(seen)
