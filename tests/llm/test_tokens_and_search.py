"""Token files, packing and the multi-index against brute force and exact round trips."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import op3_multi_index, op4_rans, op7_packing
from docketry.llm.common import shared_folder, table
from docketry.llm.tokens import PieceEncoder, default_vocabulary

FOLDER = "/root/testdata/sf0.001"
ODD = ["", " ", "a  b", " a", "a ", "a\n b  c", "x\t y", "it's  don't <|endoftext|> foo <|endoftext|>bar", "\n\n a\n", "日本 語 ", "a \n", "  x", "a\x1c b \x85 c", "the the\n of", "the\n of the",
       "é ßon, être. x!! y", "no 12a, a1. ½ x", "mot\nÉté. là", "don't won''t 'x y'", "ab.\ncd.\n\nef", "​x y z w", "x" * 100_000, "a b " * 20_000]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(default_vocabulary())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_piece_encoder_equals_the_tokenizer(spark, plain):
    texts = ODD + [r.text for r in table(spark, FOLDER, "documents").collect()]
    encoder = PieceEncoder(default_vocabulary(), cache=500)
    for at in range(0, len(texts), 40):
        some = texts[at:at + 40]
        for text, ids in zip(some, encoder.encode(some)):
            assert ids.tolist() == plain(text), text[:80]
    assert encoder.encode([]) == []


def test_token_file_of_documents(spark, plain):
    want, start = {}, 0
    for r in table(spark, FOLDER, "documents").orderBy("doc_id").collect():
        ids = plain(r.text)
        want[r.doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op4_rans.op4_rans_tokens(spark, FOLDER).collect()}
    assert got == want


def test_token_file_edges(spark, plain):
    rows = [(5, "some words"), (None, "no id"), (3, None), (5, "some words"), (4, ""), (1, "long " * 3000), (2, "b" * 50), (9, "end " * 900)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    target = shared_folder(spark, "test")
    op4_rans.write(frame, target, default_vocabulary(), block_tokens=1000, lanes=16, step=8)
    got = op4_rans.file_digest(spark, target).collect()
    want, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(text)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    pieces = op4_rans.read(spark, target).where("doc_id = 1").orderBy("at").collect()
    assert len(pieces) > 1 and np.frombuffer(b"".join(bytes(p.ids) for p in pieces), "<u4").tolist() == plain(rows[5][1])
    empty = shared_folder(spark, "test")
    op4_rans.write(spark.createDataFrame([], "doc_id long, text string"), empty, default_vocabulary())
    assert op4_rans.file_digest(spark, empty).count() == 0


def test_coder_round_trip_checkpoints_and_damage():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (7, 3), (5000, 400), (20_001, 50_000)):
        ids = np.minimum(rng.geometric(0.01, n) - 1, k - 1).astype(np.int64)
        symbols, freq = op4_rans.scaled(dict(Counter(ids.tolist())))
        assert freq.sum() == 1 << op4_rans.BITS and freq.min() >= 1
        coder = op4_rans.Coder(symbols, freq)
        states, words, notes = coder.encode(ids, lanes=32, step=16)
        assert coder.decode(n, 32, states, words).tolist() == ids.tolist()
        for a, b in ((0, n), (n // 2, n), (n // 3, n // 2), (n - 1, n)):
            assert coder.decode(n, 32, states, words, notes, 16, a, b).tolist() == ids[a:b].tolist()
    share = np.bincount(ids) / n
    bits = -(share[share > 0] * np.log2(share[share > 0])).sum() * n
    assert 8 * len(words) < 1.02 * bits + 2048


def test_sweeps_fill_gaps_best_first():
    rng = np.random.default_rng(4)
    for n in (1, 5, 80, 3000):
        lengths = rng.integers(1, 1025, n).tolist()
        plan = op7_packing.sweeps(dict(Counter(lengths)))
        fill, seen = {}, Counter()
        for length, rank, each, first, offset in plan:
            count = min(step[1] for step in plan if step[0] == length and step[1] > rank) - rank if any(s[0] == length and s[1] > rank for s in plan) else lengths.count(length) - rank
            for r in range(count):
                fill.setdefault(first + r // each, []).append((offset + r % each * length, length))
            seen[length] += count
        assert seen == Counter(lengths)
        for parts in fill.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
        # Plain best-fit decreasing for comparison.
        gaps = []
        for length in sorted(lengths, reverse=True):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - length)
            else:
                gaps.append(1024 - length)
        assert len(fill) == len(gaps)


def check_packing(rows, got, plain):
    want = Counter()
    for i, text in rows:
        ids = plain(text)
        first = (len(ids) - 1) % 1024 + 1
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[a:(first if k == 0 else a + 1024)]
            want[i, k, a, len(part), crc(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(places)


def test_packing(spark, plain):
    rows = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    got = op7_packing.op7_best_fit_packing(spark, FOLDER).collect()
    used = check_packing(rows, got, plain)
    assert used <= math.ceil(sum(r.length for r in got) / 1024) + 2
    odd = [(1, None), (1, None), (None, "x"), (2, ""), (3, "word " * 5000), (3, "word " * 5000)]
    check_packing(odd, op7_packing.packed_digest(spark.createDataFrame([(*r, 7) for r in odd], "doc_id long, text string, length int")).collect(), plain)
    assert op7_packing.packed_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def nearest(rows, queries, k=5):
    out = {}
    good = [(i, np.array(v) / np.abs(v).max()) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = np.array([v / np.sqrt(v @ v) for _, v in good])
    for n, (i, _) in enumerate(good):
        if i in queries:
            near = sorted((-round(float(s), 12), j) for s, (j, _) in zip(unit @ unit[n], good) if j != i)[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def test_search_of_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, FOLDER, "embeddings").collect()]
    want = nearest(rows, {i for i, _ in rows if i % 50 == 0})
    got = {}
    for r in op3_multi_index.op3_multi_index(spark, FOLDER).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    found = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert found >= 0.9 * 5 * len(want)


@pytest.mark.parametrize("blocks", [{}, {"entry_block": 16, "query_block": 3, "centroids": 4, "pilots": 5}])
def test_search_edges(spark, blocks):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 6))
    rows = [(n, base[n % 40].tolist()) for n in range(200)]  # every vector five times: ties
    rows += [(300, None), (350, [0.0] * 6), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (450, [float("nan")] * 6), (500, [float("inf")] * 6), (550, []), (600, [2 * x for x in rows[3][1]]), (650, [1e-200] * 6)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in op3_multi_index.search(frame, F.col("vec_id") % 50 == 0, **blocks).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = nearest(rows, {i for i, _ in rows if i % 50 == 0})
    assert {i: [j for j, _ in v] for i, v in got.items() if i < 650} == {i: [j for j, _ in v] for i, v in want.items() if i < 650}
    assert max(abs(a[1] - b[1]) for i in want for a, b in zip(got[i], want[i])) < 1e-9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in op3_multi_index.search(few, F.col("vec_id") % 50 == 0).collect()) == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert op3_multi_index.search(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_known_words_with_a_mark_are_looked_up_only():
    """Ids equal the library's, and pieces of known words (one common mark behind them or none) are not taken apart again."""
    from tokenizers import Tokenizer

    from docketry.llm import tokens

    path = tokens.default_vocabulary()
    whole, encoder = Tokenizer.from_file(path), tokens.PieceEncoder(path)
    texts = ["alpha beta alpha, beta. gamma! , it's it's, café café; x  beta  y  z, ., a.b, ", "beta, alpha. gamma? café!", ""]
    for _ in range(2):
        assert [i.tolist() for i in encoder.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    taken, make = [], encoder._piece
    encoder._piece = lambda piece, lead="Ġ": (taken.append(piece), make(piece, lead))[1]
    encoder.encode(["alpha beta, gamma! café; beta"])
    assert taken == ["alpha"]  # the first piece has no blank before it
