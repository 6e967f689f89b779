"""Spans that cuts of the text left out before."""

from tunelode.llm import pii

PLAIN = "some plain words stand here and there for a while " * 6


def test_long_spans_are_seen_whole_at_any_place():
    for span in ("anna.katharina.von.hohenstein @ mail.example.org", "jane.doe @ mail.department.university.example.org", ".".join(["name"] * 25) + " @ mail.example.com"):
        for at in range(0, 150, 10):
            text = f"{PLAIN[:at]} {span} and {PLAIN}"
            spans = pii.find_all([text], pii.trained())[0]
            assert [text[s:e] for s, e, _, _ in spans] == [span]
            assert pii.redacted(text, spans) == f"{PLAIN[:at]} [EMAIL] and {PLAIN}"


def test_windows_hold_all_that_the_whole_grid_finds(monkeypatch):
    texts = [f"{PLAIN[:at]} {s} {PLAIN}" for at in (0, 40, 77) for s in ("call (555) 010-9999 now", "4539.1488.0343.6467", "10 . 0 . 0 . 7", "jane @ example.org")]
    some = pii.find_all(texts, pii.trained())
    monkeypatch.setattr(pii, "windows", lambda t: list(range(0, len(t), pii.WINDOW // 2)))
    assert some == pii.find_all(texts, pii.trained()) and sum(map(len, some)) >= 9


def test_wider_windows_hold_their_span():
    for n in (97, 150, 1000):
        for length in (192, 384):
            for start in range(0, n - 1, 7):
                for end in range(start + 1, min(n, start + length // 2) + 1, 5):
                    lo = pii.wider(start, end, n, length)
                    left, right = start - lo, lo + length - end
                    assert lo >= 0 and (left >= length // 8 or lo == 0) and (right >= length // 8 or lo + length >= n)
