"""The near-copy stage against exact shingle similarities, on planted copies and on the sample."""

import numpy as np
import pytest

from docketry.llm import near_copies, stages
from docketry.llm.common import table
from test_copies import roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text, k=5):
    words = (text or "").encode().lower().split()
    k = min(k, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def alike(a, b):
    return a == b or len(a & b) / max(1, len(a | b)) >= 0.8


def brute(texts):
    sets = {n: shingle_set(t) for n, t in texts.items()}
    return roots(sets, [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])


def planted():
    rng = np.random.default_rng(5)
    words = [f"w{n}" for n in range(3000)]
    out = []
    for _ in range(12):
        base = [str(w) for w in rng.choice(words, 300)]
        out.append(base)
        for changes in (1, 4, 6, 12, 30):  # about 5 shingles each: from 0.97 down to 0.3
            some = list(base)
            for at in rng.integers(0, 300, changes):
                some[at] = "other"
            out.append(some)
    return [" ".join(w) for w in out] + ["a b c", "a b c", "A  b c", "a b d", "", None]


def test_near_copies_of_similarity_go(spark):
    texts = dict(enumerate(planted()))
    want = brute(texts)
    docs = spark.createDataFrame([(n, t, "en", "s", 1) for n, t in texts.items()], SCHEMA)
    got = {r.doc_id for r in stages.near_dedup(spark, docs, "").collect()}
    assert got == set(want.values()) and len(got) < len(texts) - 30


@pytest.mark.parametrize("crowd", [2, 8])
def test_crowded_keys_lose_no_link(spark, crowd):
    rng = np.random.default_rng(8)
    base = [f"v{n}" for n in range(200)]
    texts = {n: " ".join(w if rng.random() > p else f"x{n}" for w in base) for n, p in enumerate(rng.choice([0.005, 0.02, 0.04], 90).tolist())}
    frame = near_copies.keep(spark.createDataFrame(list(texts.items()), "row long, text string"))
    got = {r.row: r.root for r in near_copies.near_copies(frame, crowd=crowd).collect()}
    groups = lambda of: sorted(sorted(n for n in of if of[n] == r) for r in set(of.values()))
    assert groups(got) == groups(brute(texts))


def test_texts_that_share_a_passage_do_not_meet(spark, monkeypatch):
    """A third of the texts share half of their words: no link between them, none lost, and no pair of them is made."""
    rng = np.random.default_rng(2)
    passage = [f"p{n}" for n in range(60)]
    texts = {n: " ".join(passage + [f"u{n}_{i}" for i in range(rng.integers(35, 60))]) for n in range(150)}
    for n in range(20):
        texts[1000 + n] = texts[n].replace(f"u{n}_3 ", "")
    texts |= {2000 + n: " ".join(f"o{n}_{i}" for i in range(40)) for n in range(300)}
    frame = near_copies.keep(spark.createDataFrame(list(texts.items()), "row long, text string"))
    pairs = []
    keep = near_copies.keep
    monkeypatch.setattr(near_copies, "keep", lambda df, purpose="kept": (lambda out: (pairs.append(out.count()) if purpose == "pairs" else None, out)[1])(keep(df, purpose)))
    got = {r.row: r.root for r in near_copies.near_copies(frame).collect()}
    assert got[1003] == got[3] and sorted(sorted(n for n in got if got[n] == r) for r in set(got.values())) == sorted(sorted(n for n, x in brute(texts).items() if x == r) for r in set(brute(texts).values()))
    assert sum(pairs) < 600  # all pairs are 11,000


def test_variants_just_under_the_similarity_do_not_meet(spark, monkeypatch):
    """Variants of one text, most pairs of similarity 0.7: the links are all found, and of the 12,000 pairs few are compared."""
    rng = np.random.default_rng(4)
    base = [f"b{n}" for n in range(300)]
    texts = {}
    for n in range(160):
        some = list(base)
        for at in rng.choice(300, 3 if n < 8 else 10 + n % 3, replace=False):
            some[at] = f"c{n}_{at}"
        texts[n] = " ".join(some)
    frame = near_copies.keep(spark.createDataFrame(list(texts.items()), "row long, text string"))
    pairs, keep = [], near_copies.keep
    monkeypatch.setattr(near_copies, "keep", lambda df, purpose="kept": (lambda out: (pairs.append(out.count()) if purpose == "pairs" else None, out)[1])(keep(df, purpose)))
    got = {r.row: r.root for r in near_copies.near_copies(frame).collect()}
    want = brute(texts)
    groups = lambda of: sorted(sorted(n for n in of if of[n] == r) for r in set(of.values()))
    assert groups(got) == groups(want) and 20 < len(set(want.values())) < 160
    assert pairs[-1] < 1500  # the pairs of the prefixes


def test_recall_of_planted_similarities(spark):
    """Pairs of similarity 0.8 to 0.9, none of which SimHash links: all are found."""
    rng = np.random.default_rng(11)
    texts, want = {}, 0
    for n in range(250):
        base = [f"r{n}_{i}" for i in range(200)]
        some = list(base)
        for at in rng.choice(200, 1 + n % 4, replace=False):
            some[at] = "changed"
        texts[2 * n], texts[2 * n + 1] = " ".join(base), " ".join(some)
        want += alike(shingle_set(texts[2 * n]), shingle_set(texts[2 * n + 1]))
    frame = near_copies.keep(spark.createDataFrame(list(texts.items()), "row long, text string"))
    got = {r.row: r.root for r in near_copies.near_copies(frame).collect()}
    assert want > 200 and sum(got[2 * n] == got[2 * n + 1] for n in range(250)) == want


def test_near_copies_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in stages.near_dedup(spark, docs, "").collect()} == set(brute(texts).values())


def test_one_row_of_each_component_stays(spark):
    texts = planted()
    rows = [(1, texts[0]), (9, texts[6]), (9, texts[1]), (9, texts[12]), (9, texts[12]), (None, texts[18]), (None, texts[19]), (None, texts[24])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id or 0, r.text) for r in stages.near_dedup(spark, docs, "").collect()))
    named = [g for g in got if g[0]]
    assert named == sorted([(1, texts[0]), (9, texts[6]), (9, texts[12])])  # the near copy of 1 goes, the other texts of 9 stay
    assert [i for i, _ in got].count(0) == 2 and texts[24] in [t for i, t in got if not i]
