import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.operators import drafts as D, privacy as P, retrieval as R
from docketry.sources import loaders

WORDS = ("yol", "su", "gaz", "imar", "vergi", "park", "okul", "çöp")


def corpus(frame, seed=3, size=20, docs=40):
    rng = np.random.default_rng(seed)
    unit = lambda: (lambda v: [float(x) for x in v / np.linalg.norm(v)])(rng.normal(size=8))
    text = lambda n: " ".join(rng.choice(WORDS, size=n))
    chunks = [(f"c{n:02d}", text(int(rng.integers(3, 30))), unit()) for n in range(size)]
    chunks.append(("c99", chunks[0][1], chunks[0][2]))  # an exact copy ties with its original
    cases = [(n, text(int(rng.integers(1, 12))) if n % 5 else "none", unit()) for n in range(docs)]
    return frame(cases, "query_id int, text string, embedding array<double>"), frame(chunks, "chunk_id string, text string, embedding array<double>"), cases, chunks


def expected_bm25(cases, chunks):
    """Textbook BM25 over token lists, normalised per query."""
    tokens = {c: t.split() for c, t, _v in chunks}
    mean = sum(map(len, tokens.values())) / len(tokens)
    out = {}
    for q, text, _v in cases:
        raw = {}
        for c, listed in tokens.items():
            for term in text.split():
                df = sum(term in other for other in tokens.values())
                tf = listed.count(term)
                if tf:
                    idf = np.log(1 + (len(tokens) - df + .5) / (df + .5))
                    raw[c] = raw.get(c, 0) + idf * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(listed) / mean))
        for c, value in raw.items():
            out[q, c] = value / max(raw.values())
    return out


def test_bm25_matches_textbook(frame):
    q, c, cases, chunks = corpus(frame)
    want = expected_bm25(cases, chunks)
    got = {(r.query_id, r.chunk_id): r.lexical_score for r in R.bm25(q, c).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    top = {(r.query_id, r.rank): r.chunk_id for r in R.bm25_top_k(q, c, 3).collect()}
    for query in {k[0] for k in want}:
        best = sorted(((-round(s, 9), cid) for (qq, cid), s in want.items() if qq == query))[:3]
        assert [top[query, n + 1] for n in range(len(best))] == [cid for _s, cid in best]


def test_dense_blocks_equal_shipped(frame):
    q, c, _cases, _chunks = corpus(frame)
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id) for r in df.collect())
    assert key(R.dense_top_k(q, c, 4)) == key(R.dense_top_k(q, c, 4, shipped_cells=64))


def test_hybrid_ways_agree(frame):
    q, c, _cases, _chunks = corpus(frame)
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.rank_score, 9), r.evident, r.source_status) for r in df.collect())
    shipped = key(R.hybrid_retrieve(q, c))
    assert shipped == key(R.hybrid_retrieve(q, c, pinned_cells=1))
    context = {r.query_id: (r.source_status, [x.chunk_id for x in r.chunks]) for r in R.retrieval_context(R.fuse(R.dense_scores(q, c), R.bm25(q, c))).collect()}
    for query in {row[0] for row in shipped}:
        rows = [row for row in shipped if row[0] == query]
        assert context[query] == (rows[0][5], [row[2] for row in rows if row[4]])


def test_threshold_fusion_equals_all_pairs(frame):
    """Cases and chunks without a vector or words, more chunks than the lists are deep, ties by copies."""
    rng = np.random.default_rng(9)
    unit = lambda: [float(x) for x in (lambda v: v / np.linalg.norm(v))(rng.normal(size=4))]
    words = [f"w{n}" for n in range(40)]
    text = lambda: " ".join(rng.choice(words, size=int(rng.integers(0, 9))))
    chunks = [(n, text(), unit() if n % 7 else None) for n in range(400)]
    chunks += [(400 + n, chunks[n][1], chunks[n][2]) for n in range(60)]
    cases = [(n, text() if n % 6 else None, unit() if n % 4 else None) for n in range(25)]
    q, c = frame(cases, "query_id int, text string, embedding array<double>"), frame(chunks, "chunk_id int, text string, embedding array<double>")
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9), round(r.lexical_score, 9), round(r.rank_score, 12), r.evident) for r in df.collect())
    pinned = key(R.hybrid_retrieve(q, c, top=2, k=5))
    assert len(pinned) == 50 and pinned == key(R.hybrid_retrieve(q, c, top=2, k=5, pinned_cells=900))
    lexical = {k: v for k, v in expected_bm25([(i, t or "", None) for i, t, _ in cases], [(i, t, None) for i, t, _ in chunks]).items()}
    for query, _, vector in cases:
        near = {i: round(float(np.dot(vector, v)), 9) for i, _, v in chunks if vector and v}
        said = {i: round(lexical[query, i], 9) for i, *_ in chunks if (query, i) in lexical}
        place = lambda d: {i: n + 1 for n, i in enumerate(sorted(d, key=lambda i: (-d[i], i)))}
        rd, rl = place(near), place(said)
        fused = {i: (1 / (5 + rd[i]) if i in rd else 0) + (1 / (5 + rl[i]) if i in rl else 0) for i, *_ in chunks}
        assert [r[2] for r in pinned if r[0] == query] == sorted(fused, key=lambda i: (-round(fused[i], 12), i))[:2]


def test_gate_applies_after_the_cut(frame):
    rows = [(1, f"c{n}", score, lexical, rank) for n, (score, lexical, rank) in enumerate([(.1, .0, .9), (.2, .0, .8), (.60, .0, .7), (.599999, .0, .6), (.3, .6, .5), (.99, .99, .1)])]
    got = R.retrieval_context(frame(rows, "query_id int, chunk_id string, score double, lexical_score double, rank_score double")).first()
    assert ([x.chunk_id for x in got.chunks], got.source_status) == (["c2", "c4"], "relevant_source_found")


def test_greedy_match(frame):
    pairs = frame([(1, "a", "x", .9), (1, "b", "x", .95), (1, "a", "y", .7), (1, "b", "y", .8), (1, "c", "z", .59), (2, "a", "k", .6), (2, "a", "l", .6)], "payload_id int, target string, key string, score double")
    assert sorted((r.payload_id, r.target, r.key) for r in R.greedy_match(pairs).collect()) == [(1, "a", "y"), (1, "b", "x"), (2, "a", "l")]


def test_query_composition(frame):
    row = frame([("Birim ", "gurultu-sikayeti", ["Sokak 1", " "], " metin ")], "u string, t string, v array<string>, d string")
    assert row.select(R.retrieval_query(F.col("u"), F.col("t"), F.col("v"), F.col("d")).alias("q")).first().q == "Birim gurultu sikayeti Sokak 1 metin"


def test_redaction(frame):
    text = "Call 05321234567 or 5321234568, a@b.com; Ali  VELI, ali-veli, 10000000146 TR12 3456 7890 1234 5678 9012 34"
    row = frame([(text, {"applicant-name": "Ali Veli", "incident-address": "Call"})], "t string, k map<string,string>")
    got = row.select(P.sanitize_text(F.col("t"), F.col("k")).alias("v")).first().v
    assert got == ("Call {{REDACTED_PHONE_1}} or {{REDACTED_PHONE_2}}, {{REDACTED_EMAIL_1}}; {{APPLICANT_NAME}}, {{APPLICANT_NAME}}, "
                   "{{REDACTED_TCKN_1}} {{REDACTED_IBAN_1}}")


def test_sentences_and_chunks(frame):
    one = lambda text, expr: frame([(text,)], "t string").select(expr(F.col("t")).alias("v")).first().v
    assert one("A b. C d! Eee.", lambda c: D.sentence_prefix(c, 9)) == "A b. C d!"
    assert one("A b. C d! Eee.", lambda c: D.sentence_prefix(c, 8)) == "A b."
    assert [len(one("x" * n, D.chunk_text)) for n in (899, 900, 901)] == [1, 1, 2]
    assert one("One. Two.\n\nThree four. " + "y" * 25, lambda c: D.chunk_text(c, 12)) == ["One. Two.", "Three four.", "y" * 12, "y" * 12, "y"]
    assert one("  ", D.chunk_text) == ["  "]
    long = "One two. " * 2000 + "z" * 50
    assert one(long, lambda c: D.chunk_text(c, 40, block=7)) == one(long, lambda c: D.chunk_text(c, 40)) == ["One two. One two. One two. One two."] * 500 + ["z" * 40, "z" * 10]


def test_legal_claims(frame):
    one = lambda text: frame([(text,)], "t string").select(D.legal_claim(F.col("t")).alias("v")).first().v
    assert one("3071 sayılı kanun") and one("İlgili yönetmelik hükümleri uyarınca") and one("Bu işlem zorunludur.")
    assert not one("Başvurunuz incelenmektedir.")


def test_corpus_chunks(frame):
    rows = frame([("REG-001", "Law", [("Art 1", "t" * 600), ("Art 2", "u")])], "source_id string, title string, items array<struct<locator:string,text:string>>")
    got = loaders.build_chunks(rows).orderBy("chunk_id").collect()
    assert [(r.chunk_id, len(r.excerpt), r.content[:12]) for r in got] == [("REG-001-chunk-001", 500, "Law Art 1. t"), ("REG-001-chunk-002", 1, "Law Art 2. u")]


@pytest.mark.parametrize("name", [lambda n: n, lambda n: f"c{n:03d}"])
def test_running_top_of_slices_is_the_top_of_all(name):
    """Slices of chunks in any order keep what one sort of everything keeps; ties fall to the smaller id."""
    rng = np.random.default_rng(3)
    scores = np.round(rng.random((300, 7)), 1) * (rng.random((300, 7)) < .5)
    scores[:, 6] = 0
    ids = np.array([name(int(n)) for n in rng.permutation(300)], dtype=object)
    best = None
    for at in range(0, 300, 40):
        best = R._running_top(best, scores[at:at + 40], ids[at:at + 40], 10)
    want = [(q, i, s) for q in range(7) for s, i in sorted(((s, i) for s, i in zip(scores[:, q], ids) if s > 0), key=lambda e: (-e[0], e[1]))[:10]]
    assert list(zip(*(part.tolist() for part in best))) == want


def test_rows_of_a_large_batch_become_objects_in_slices():
    """A batch of 10,000 rows is scored 256 rows or 1,000,000 pairs at a time."""
    batch = pa.RecordBatch.from_pydict({"n": list(range(10_000)), "words": [[f"w{n}"] for n in range(10_000)]})
    parts = list(R._slices(iter([batch]), R._slice_rows(200)))
    assert max(len(p) for p in parts) == 256 and [w for p in parts for words in p["words"] for w in words] == [f"w{n}" for n in range(10_000)]
    assert R._slice_rows(50_000) == 20 and R._slice_rows(2_000_000) == 1
