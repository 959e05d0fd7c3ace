"""SimHash blocks and the metric range join against brute force."""

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from docketry.llm import op8_simhash, op9_range_join
from docketry.llm.common import components, table

FOLDER = "/root/testdata/sf0.001"


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(k, len(words))
    hashes = [xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)]
    found = components(spark.createDataFrame(pairs, "a long, b long"))
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    assert {r.node: r.root for r in found.collect()} == roots(nodes, [p for p in pairs if p[0] != p[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_of_documents(spark):
    docs = table(spark, FOLDER, "documents")
    prints = {r.doc_id: simhash(r.text) for r in docs.collect()}
    got = {r.doc_id: r for r in op8_simhash.op8_simhash(spark, FOLDER).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {i: r.component_id for i, r in got.items()} == roots(prints, pairs)


def test_simhash_edges(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \t", None), (4, "Ab c", "z"), (5, "aB\x0bC", "z"), (None, "ab c", "z"), (5, "aB\x0bC", "z"), (7, "Ä b c d", "z"), (8, "ä b c d", "z"), (9, "w " * 50_000, "z")]
    got = op8_simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    assert len(got) == len(rows) and by[1, 0] == by[2, 0] == by[3, 0] == 1
    same = {r.fp for r in got if r.doc_id in (4, 5, None)}
    assert len(same) == 1 and [r.component_id for r in got if r.doc_id is None] == [4]
    assert {r.fp for r in got if r.doc_id == 7} != {r.fp for r in got if r.doc_id == 8}
    assert op8_simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("crowd", [2, 6, 1000])
def test_crowded_blocks_lose_no_link(spark, crowd):
    rng = np.random.default_rng(crowd)
    prints = set()
    for centre in rng.integers(0, 1 << 63, 3):
        for _ in range(90):
            x = int(centre)
            for b in rng.integers(0, 64, int(rng.integers(0, 4))):
                x ^= 1 << int(b)
            prints.add(x - (1 << 64) if x >= 1 << 63 else x)
    prints = sorted(prints)
    found = op8_simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), crowd)
    edges = [(r.a, r.b) for r in found.distinct().collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 2 for a, b in edges)
    pairs = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & mask).bit_count() <= 2]
    assert roots(prints, edges) == roots(prints, pairs)


def brute(rows, cosine=0.98):
    good = {}
    for n, (i, v, lab) in enumerate(rows):
        if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[n] = np.array(v + [0.0] * (70 - len(v)), dtype=np.float64) / max(map(abs, v))
    pairs = [(a, b) for a in good for b in good if a < b and rows[a][2] == rows[b][2] and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= cosine]
    return pairs


@pytest.mark.parametrize("sizes", [{}, {"cell": 16, "block": 10}, {"cell": 40, "block": 7, "max_pivots": 5}])
def test_range_join(spark, sizes):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 6))
    rows = [(n, (base[n % 12] + rng.normal(size=6) * rng.choice([0, 0.05, 0.15])).tolist(), n % 2) for n in range(230)]
    rows += [(300, None, 1), (301, [0.0] * 6, 1), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (303, [float("nan")] + [1.0] * 5, 1), (304, [float("inf")] + [1.0] * 5, 1), (305, rows[0][1], None),
             (306, [2 * x for x in rows[0][1]], 0), (307, [1e200, 1e200], 1), (308, [1e-200, 1e-200, 0.0], 1), (309, [], 1)]
    frame = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, rep string")
    got = {r.vec_id: r for r in op9_range_join.near_duplicates(frame, **sizes).collect()}
    pairs = brute(rows)
    ids = [r[0] for r in rows]
    count = {i: 0 for i in ids}
    for a, b in pairs:
        count[ids[a]] += 1
        count[ids[b]] += 1
    assert {i: r.n_links for i, r in got.items()} == count
    want = roots(ids, [(ids[a], ids[b]) for a, b in pairs])
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_range_join_repeated_and_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in op9_range_join.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert op9_range_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0
