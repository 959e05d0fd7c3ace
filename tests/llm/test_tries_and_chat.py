"""Prefix tries, spelling variants and chat formatting against SQL and brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import op11_prefix_trie as trie, op12_spelling as spell, op13_chat as chat
from docketry.llm.queries import QUERIES, SQL
from docketry.llm.sql import crc32_sql

FOLDER = "/root/testdata/sf0.001"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
order = lambda rows: sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    assert order(map(tuple, df.collect())) == order(con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall())


def test_crc32_in_sql():
    for text in ("", "7", "12:é", "x" * 300):
        assert duckdb.execute(f"SELECT {crc32_sql('$1')}", [text]).fetchone()[0] == zlib.crc32(text.encode())


# --- prefix tries -----------------------------------------------------------

@pytest.mark.parametrize("seed,alphabet,longest", [(1, 3, 7), (2, 40, 4), (3, 500, 3), (4, 1, 30)])
def test_double_array_holds_exactly_its_prefixes(seed, alphabet, longest):
    rng = np.random.default_rng(seed)
    rows = sorted({tuple(rng.integers(0, alphabet, rng.integers(0, longest + 1)).tolist()) for _ in range(300)})
    starts = np.cumsum([0, *map(len, rows)])
    ids = np.array([i for r in rows for i in r], dtype=np.int64)
    codes = trie.codes_of(ids, starts)
    base, check = trie.pack(codes, starts)
    states = trie.walk(base, check, codes, starts)
    seen = {}
    for n, row in enumerate(rows):
        for d in range(len(row) + 1):
            assert seen.setdefault(row[:d], states[starts[n] + n + d]) == states[starts[n] + n + d]
    assert len(set(seen.values())) == len(seen) == 1 + (check[1:] >= 0).sum()
    code = dict(zip(ids.tolist(), codes.tolist()))
    for _ in range(200):
        row = rng.integers(0, alphabet, longest).tolist()
        known = [code.get(i, 10_000) for i in row]
        reached = trie.walk(base, check, np.array(known), np.array([0, longest]))
        for d in range(longest + 1):
            assert (reached[d] >= 0) == (tuple(row[:d]) in seen)


def brute_nodes(sequences):
    """NODE rows of {conv_id: [(turn, bytes), ...]}."""
    members = defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    out = []
    for node, held in members.items():
        under = [n for n in members if n[:len(node)] == node]
        kids = {n: sum(m[:-1] == n for m in members if m) for n in under}
        ends = ",".join(map(str, sorted(c for c in held if len(sequences[c]) == len(node))))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), kids[node], sum(k == 0 for k in kids.values()),
                    sum((len(members[n]) - 1) * n[-1][1] for n in under if n), hashlib.sha256(ends.encode()).hexdigest()))
    return order(out)


@pytest.mark.parametrize("turns,fan", [(4, 2), (9, 3), (10_000, 64)])
def test_shards_merge_to_the_whole_trie(spark, turns, fan):
    rng = np.random.default_rng(turns)
    sequences = {i: [(int(t), int(t) % 5) for t in rng.integers(0, 3, rng.integers(0, 6))] for i in range(120)}
    sequences |= {1000 + i: [(0, 0)] * 8 + [(i, i % 5)] for i in range(40)} | {2000 + i: [(1, 1)] * 12 for i in range(30)}
    rows = [(c, [t for t, _ in s], [b for _, b in s]) for c, s in sequences.items()]
    df = spark.createDataFrame(rows, "conv_id long, ids array<long>, sizes array<long>")
    assert order(map(tuple, trie.conversation_nodes(df, turns, fan).select(*NODE).collect())) == brute_nodes(sequences)


def test_long_lists_of_ids(spark, monkeypatch):
    monkeypatch.setattr(trie, "LIST_IDS", 7)
    rows = [(c, bytes([c % 3])) for c in range(0, 900, 4)]
    got = {bytes(r.seq): r.digest for r in trie.id_lists(spark.createDataFrame(rows, "conv_id long, seq binary")).collect()}
    assert got == {bytes([k]): hashlib.sha256(",".join(str(c) for c, s in rows if s[0] == k).encode()).hexdigest() for k in range(3)}


def test_conversations_of_odd_rows(spark):
    """Null turns come first, null role and text are empty, repeated rows are repeated turns,
    equal turns have one order, rows without conv_id belong to no conversation."""
    rows = [(1, 2, "user", "b", 9), (1, None, None, None, 9), (1, 1, "user", "é", 8), (1, 1, "user", "é", 7), (2, None, "", "", 1), (2, 0, "user", "é", 1), (2, 1, "user", "é", 2),
            (2, 5, "user", "b", 3), (3, 0, "x", "w " * 200_000, 3), (None, 0, "user", "é", 4), (4, 7, "p", "q", 0), (4, 7, "q", "p", 0), (5, 7, "q", "p", 0), (5, 7, "p", "q", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: (r.ids, r.sizes) for r in trie.turn_sequences(df.withColumnRenamed("ids", "shard").withColumn("level", F.lit(1))).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1] == got[2] and got[4] == got[5] and got[1][1] == [0, 2, 2, 1] and got[3][1] == [400_000]
    nodes = trie.conversation_nodes(trie.turn_sequences(df)).collect()
    assert order(tuple(r[c] for c in NODE) for r in nodes) == brute_nodes({c: list(zip(*s)) for c, s in got.items()})
    assert trie.conversation_nodes(trie.grouped_heads(trie.turn_sequences(df.limit(0)))).count() == 0


def test_heads_come_from_the_group(spark):
    own = {c: [c * 100 + i for i in range(n)] for c, n in ((0, 3), (1, 8), (4, 1), (6, 9), (10, 12), (13, 2), (14, 9))}
    df = spark.createDataFrame([(c, t, t) for c, t in own.items()], "conv_id long, ids array<long>, sizes array<long>")
    for r in trie.grouped_heads(df).collect():
        h = zlib.crc32(str(r.conv_id).encode()) % 9
        assert r.ids == r.sizes == own.get(r.conv_id - r.conv_id % 5, [])[:h] + own[r.conv_id][h:]


# --- spelling variants ------------------------------------------------------

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(counts, ratio):
    out = {}
    for w, n in counts.items():
        others = sorted((-counts[o], o) for o in counts if o != w and near(w, o))
        best = others[0] if others and -others[0][0] >= ratio * n else None
        out[w] = [best and best[1], w, n, len(others), best and -best[0]]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return order((w, *v) for w, v in out.items())


@pytest.mark.parametrize("alphabet,longest", [("ab", 9), ("abé", 6), ("aaab×", 8)])
def test_variants_match_brute_force(spark, alphabet, longest):
    rng = np.random.default_rng(len(alphabet))
    words = {"".join(rng.choice(list(alphabet), rng.integers(1, longest + 1))) for _ in range(350)}
    counts = {w: int(rng.integers(1, 5) ** rng.integers(1, 6)) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    got = spell.variants(df, 2).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert order(map(tuple, got)) == brute_variants(counts, 2)


def test_scan_joins_ranges_across_batches(spark):
    words = ["aaaaaa" + c for c in "abcdefghijklmnop"] + ["aaaaaa"]
    df = spark.createDataFrame([(w, 1 + i) for i, w in enumerate(words)], "word string, n long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        got = spell.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert order(map(tuple, got)) == brute_variants({w: 1 + i for i, w in enumerate(words)}, 5)


def test_words_of_texts(spark):
    """Null and empty texts have no word, very long ones are read whole, repeated rows count
    again, a null id counts as empty; clashing names (word, n) are ignored."""
    texts = ["Straßen STRASSEN straßen, naïveté! ÉTÉétéÉté 12abcdefg34", None, "", "wörter " * 60_000, "abcdef abcde abcdefg", "x" * 20_000]
    rows = [(i, t, "w", 1) for i, t in enumerate(texts)] + [(None, "abcdefgh", "w", 1), (4, texts[4], "w", 1), *[(i, "abcdefghij klmnopqrst", "w", 1) for i in range(100, 800)]]
    want = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            want[run] += len(run) >= 6
    got = {r.word: r.n for r in spell.words(spark.createDataFrame(rows, "doc_id long, text string, word string, n long")).collect()}
    assert got == {w: n for w, n in want.items() if n} and any(len(w) == 9 for w in got)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spell.variants(spell.words(none)).count() == 0
    odd = spark.createDataFrame([("abcdef", 3), ("abcdef", 4), (None, 2), ("zzz", None), ("abcdeg", 50)], "word string, n long")
    assert order(map(tuple, spell.variants(odd).select("word", "form", "n").collect())) == [("abcdef", "abcdeg", 7), ("abcdeg", None, 50)]


# --- chat formatting --------------------------------------------------------

MESSAGES = "tree string, id long, parent long, role string, text string, score double"
NASTY = ["", "plain", chat.PROBE, "<\\|im_end|>", "<\\\\|x<|", "<|<|<|\\", "a<\n|b", "<|im_start|>user\nhi<|im_end|>\n", "<\\", "|>", "<n>", "é€😀<|"]


def texts(df):
    line = chat.formatted_text(F.col("segments"))
    return df.select("tree", "leaf", "rank", "score", line.alias("line"), chat.read_turns(line).alias("turns"), chat.loss_texts(F.col("segments")).alias("loss")).collect()


def test_chat_round_trip(spark):
    roles = ["user", "assistant", "", "a\nb", "<n>", "<\\n>", "<|im_end|>", "assistant\n"]
    rows = [("t", i, i - 1 if i else None, roles[i % len(roles)], NASTY[i % len(NASTY)], 1.0) for i in range(97)]
    (got,) = texts(chat.format_trees(spark.createDataFrame(rows, MESSAGES).repartition(6)))
    assert [(t.role, t.text) for t in got.turns] == [r[3:5] for r in rows] and got.score == 97
    assert got.loss == [r[4] for r in rows if r[3] == "assistant"]
    assert got.line.count("<|im_start|>") == got.line.count("<|im_end|>") == 97 and got.line.count("<|") == 194


def test_branches_are_ranked(spark):
    rows = [("t", 1, None, "user", "root", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 2.0), ("t", 4, 2, "user", "c", 1.0), ("t", 5, 3, "user", "d", None),
            ("t", 6, 77, None, None, -1.0), ("u", 1, None, "user", "alone", 0.0), (None, 1, None, "assistant", "no tree", 0.0), ("v", 1, 1, "user", "own parent", 0.0),
            ("c", 1, 2, "user", "x", 1.0), ("c", 2, 1, "user", "y", 1.0), ("c", 3, 2, "user", "hangs on a circle", 1.0), ("t", None, 1, "user", "no id", 1.0),
            ("t", 4, 2, "user", "c", 1.0), ("t", 4, 2, "user", "later copy", 1.0)]
    df = spark.createDataFrame(rows, MESSAGES).withColumns({c: F.lit("x") for c in ("leaf", "up", "rank")})
    got = {(r.tree, r.leaf): (r["rank"], r.score, [t.text for t in r.turns]) for r in texts(chat.format_trees(df))}
    assert got == {("t", 4): (1, 2.0, ["root", "a", "c"]), ("t", 5): (2, 2.0, ["root", "b", "d"]), ("t", 6): (3, -1.0, [""]), ("u", 1): (1, 0.0, ["alone"]), (None, 1): (1, 0.0, ["no tree"])}
    assert {(r.tree, r.leaf) for r in texts(chat.format_trees(df, best=1))} == {("t", 4), ("u", 1), (None, 1)}
    assert chat.format_trees(df.limit(0)).count() == 0


def test_paths_of_a_random_forest(spark):
    rng = np.random.default_rng(5)
    parent = {i: (int(rng.integers(max(0, i - 4), i)) if i and rng.random() > 0.03 else None) for i in range(400)}
    df = spark.createDataFrame([(0, i, p) for i, p in parent.items()], "tree int, id long, parent long")
    leaves = set(parent) - set(parent.values())
    want = set()
    for leaf in leaves:
        at, up = leaf, 0
        while at is not None:
            want.add((leaf, at, up))
            at, up = parent[at], up + 1
    assert {(r.leaf, r.id, r.up) for r in chat.paths(df).collect()} == want


def test_chat_formatting_is_native(spark):
    plan = QUERIES["op13_reply_trees"](spark, FOLDER)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_conversations_as_chains(spark):
    rows = [(1, 2, "assistant", "two"), (1, None, None, None), (1, 1, "user", "one"), (1, 1, "user", "one"), (None, 0, "user", "no conversation id"), (3, 0, "assistant", "w " * 300_000)]
    got = {r.tree: [(t.role, t.text) for t in r.turns] for r in texts(chat.format_trees(chat.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))}
    assert got == {1: [("", ""), ("user", "one"), ("user", "one"), ("assistant", "two")], None: [("user", "no conversation id")], 3: [("assistant", "w " * 300_000)]}
