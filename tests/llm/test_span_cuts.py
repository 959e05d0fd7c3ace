"""Passages of 51 words in the middle of long sentences are found wherever they stand."""

import random

from docketry.llm import op5_spans


def found(a, b):
    first, second = ({h for _, _, h in op5_spans.runs(op5_spans.sentences(t))} for t in (a, b))
    return bool(first & second)


def test_every_51_word_passage_is_found():
    rng = random.Random(11)
    words = [f"word{n}" for n in range(900)]
    some = lambda n: rng.choices(words, k=n)
    lost = 0
    for n in range(600):
        passage = some(51)
        if n % 6 == 0:  # words that repeat: alone, in pairs, in threes
            passage = (rng.sample(words, 1 + n // 6 % 3) * 51)[:51]
        a, b = (" ".join([*some(rng.randrange(60)), *passage, *some(rng.randrange(60))]) for _ in range(2))
        lost += not found(a, b)
    assert lost == 0


def test_cuts_cover_all_words():
    rng = random.Random(2)
    for _ in range(200):
        text = " ".join(rng.choices(["a", "b", "c.", "dd", "e\n"], k=rng.randrange(120)))
        parts = op5_spans.sentences(text)
        assert [w for p in parts for w in p[2]] == text.split()
        assert all(text[a:b].split() == w for a, b, w in parts) and all(p[1] <= q[0] for p, q in zip(parts, parts[1:]))
