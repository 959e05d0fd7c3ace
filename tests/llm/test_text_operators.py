"""Language profiles, licences, sentence spans, personal data and mixing on small fixtures and against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

from docketry.llm import op1_licenses, op2_language, op5_spans, op6_pii, op10_mixing
from docketry.llm.common import table

FOLDER = "/root/testdata/sf0.001"


# --- language -------------------------------------------------------------------------------

def grams(text):
    letters = "".join(c.lower() if c.isalpha() else " " for c in text)
    words = " " + " ".join(letters.split()) + " "
    if not words.strip():
        return Counter()
    return Counter(g for n in (1, 2, 3) for g in (words[i:i + n] for i in range(len(words) - n + 1)) if g != " ")


def code(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value


def top(counter):
    return [g for g, _ in sorted(counter.items(), key=lambda x: (-x[1], code(x[0])))[:300]]


def test_language_profiles(spark):
    docs = table(spark, FOLDER, "documents").collect()
    out = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in docs}
    learned = {}
    for r in docs:
        if not out[r.doc_id] and r.lang is not None:
            learned.setdefault(r.lang, Counter()).update(grams(r.text))
    profiles = {lang: {g: n for n, g in enumerate(top(c))} for lang, c in sorted(learned.items())}
    got = {r.doc_id: r for r in op2_language.op2_language_profiles(spark, FOLDER).collect()}
    assert {i: r.held_out for i, r in got.items()} == out
    hits = 0
    for r in docs:
        mine = top(grams(r.text))
        far = {lang: sum(abs(n - p[g]) if g in p else 300 for n, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k))
        assert got[r.doc_id].lang_pred == best
        assert abs(got[r.doc_id].score - (1 - far[best] / (300 * len(mine)))) < 1e-9
        hits += out[r.doc_id] and best == r.lang
    assert hits >= 0.9 * sum(out.values())


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "12 34 !!", "de"), (5, "", None), (6, "und die der", None), (7, "the and", "en"),
            (None, "the dog and", None), (2, "der hund und die katze", "de"), (9, "the " * 100_000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score")
    got = op2_language.predict(frame.drop("score"), op2_language.train(frame)).collect()
    by = {(r.doc_id, r.text): r for r in got}
    assert len(got) == len(rows)
    assert [by[3, None].lang_pred, by[4, "12 34 !!"].lang_pred, by[5, ""].lang_pred] == ["und"] * 3
    assert by[6, "und die der"].lang_pred == "de" and by[7, "the and"].lang_pred == "en" and by[None, "the dog and"].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert op2_language.identify(empty).count() == 0
    assert op2_language.predict(frame.drop("score"), op2_language.train(empty)).where("lang_pred <> 'und'").count() == 0


# --- licences -------------------------------------------------------------------------------

def test_licenses(spark):
    docs = table(spark, FOLDER, "documents")
    model = op1_licenses.train(op1_licenses.corpus_paragraphs(docs))
    rows = [(1, "Some prose here.\nLicensed under the Apache License, Version 2.0.\nMore."), (2, None), (3, ""), (4, "the and of for with this"), (5, "Released under the MIT License."),
            (6, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
            (7, "x " * 50_000 + "\nAll rights reserved."), (5, "Released under the MIT License."), (None, "He renewed his driving license in the city.")]
    got = op1_licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    found = [(r.doc_id, [(h.family, h.confirmed) for h in r.hits]) for r in got]
    want = {1: ["apache"], 5: ["mit"], 6: ["mit"], 7: ["proprietary"]}
    assert len(got) == len(rows)
    for doc_id, hits in found:
        assert [f for f, sure in hits if sure] == want.get(doc_id, [])
    line = next(h for r in got if r.doc_id == 1 for h in r.hits)
    assert rows[0][1][line.start:line.end] == "Licensed under the Apache License, Version 2.0."
    assert op1_licenses.scan(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    # Every planted notice of the sample is found, and nothing else.
    marked = {r.doc_id for r in docs.collect() if re.search(r"(?i)licen[sc]e|rights reserved", r.text)}
    assert {r.doc_id for r in op1_licenses.op1_license_scan(spark, FOLDER).where("n_confirmed > 0").collect()} == marked


# --- sentence spans -------------------------------------------------------------------------

def brute_spans(rows, run=3, words=20):
    texts = [(i, n, op5_spans.sentences(t) if t else []) for n, (i, t) in enumerate(rows)]
    order = sorted(texts, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    seen, gone = set(), {}
    for i, n, parts in order:
        spans = []
        for a in range(len(parts)):
            b = a
            while b < len(parts) and (b - a < run or sum(len(p[2]) for p in parts[a:b]) < words):
                b += 1
            if b - a >= run and sum(len(p[2]) for p in parts[a:b]) >= words:
                spans.append((a, b))
        if parts and (not spans or spans[-1][1] < len(parts)):
            a = len(parts)
            while a > 0 and (len(parts) - a < run or sum(len(p[2]) for p in parts[a:]) < words):
                a -= 1
            spans.append((a, len(parts)))
        drop = set()
        for a, b in spans:
            key = tuple(tuple(p[2]) for p in parts[a:b])
            if key in seen:
                drop |= set(range(a, b))
            seen.add(key)
        gone[n] = drop
    return [len(gone[n]) for n in range(len(rows))]


def test_sentence_spans(spark):
    passage = " ".join(f"Word{n} alpha beta gamma delta epsilon zeta eta." for n in range(8))
    rows = [(3, f"Intro one two. {passage} End of this."), (1, f"Other start here. {passage} Tail words."), (2, "Nothing shared at all. Just words. And more of them in here, quite a few of them to be sure."),
            (4, None), (5, ""), (6, "  \n "), (1, f"Other start here. {passage} Tail words."), (None, passage), (7, "Short."), (8, "Short."), (9, "go " * 30_000)]
    got = op5_spans.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows)
    assert sorted(r.n_removed for r in by[1])[0] == 0 and by[2][0].n_removed == 0
    assert "Word5" not in by[3][0].text and "Intro one two." in by[3][0].text and "Word5" in max(by[1], key=lambda r: len(r.text)).text
    assert by[None][0].text == "" and by[4][0].text is None and by[5][0].text == "" and by[6][0].text == "  \n "
    want = Counter(zip([i for i, _ in rows], brute_spans(rows)))
    assert Counter((r.doc_id, r.n_removed) for r in got) == want
    assert op5_spans.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sentence_spans_of_documents(spark):
    docs = table(spark, FOLDER, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r.n_removed for r in op5_spans.op5_sentence_spans(spark, FOLDER).collect()}
    assert got == dict(zip([r.doc_id for r in docs], brute_spans([(r.doc_id, r.text) for r in docs])))


# --- personal data --------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                  "card": 13 <= len(digits) <= 19 and op6_pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns(spark):
    rng = np.random.default_rng(5)
    alphabet = list("ab.@@-+0123456789 ()_%é,")
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, int(rng.integers(0, 60))))
        assert op6_pii.base_spans(text) == plain_spans(text), text
    for text in ("1.2.3.4.5.6.7.8", "a@b.c_x@d.e", "4111 1111-1111 1111", "999.1.1.1 1.1.1.1", "a@b..c", "x@y.z@w.v", "+1 (408) 555-7800.", "00001.2.3.0004"):
        assert op6_pii.base_spans(text) == plain_spans(text)
    for r in table(spark, FOLDER, "documents").collect():
        assert op6_pii.base_spans(r.text) == plain_spans(r.text)
    for text in ("9" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1" * 100_000):
        op6_pii.base_spans(text)  # in linear time


def test_personal_data_query(spark):
    got = {r.doc_id: r for r in op6_pii.op6_pii_field(spark, FOLDER).collect()}
    for r in table(spark, FOLDER, "documents").collect():
        spans, mine = plain_spans(r.text), got[r.doc_id]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert mine.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [mine[f"n_{k}"] for k in op6_pii.KINDS] == [sum(s[0] == k for s in spans) for k in op6_pii.KINDS]
        assert set(text.split(",")) - {""} <= set(mine.spans.split(","))
        assert spans or not mine.spans


def test_field_carries_labels_to_repeats(spark):
    docs = table(spark, FOLDER, "documents")
    model = op6_pii.train(docs)
    far = "la la " * 200
    rows = [(1, f"call +1 (512) 555-4564 now. {far} again (512) 555-4564 or 5551234 and 77"), (2, f"write kpbelhe.03@mail8.example.com {far} as kpbelhe.03 said"), (3, "the year 2024 and 12 eggs"),
            (4, None), (5, ""), (6, "kpbelhe.03 alone (512) 555-4564"), (1, "9" * 100_000)]
    got = op6_pii.find(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model)
    marked = got.withColumn("clean", op6_pii.redact(got.text, got.entities)).collect()
    added = {r.doc_id: [r.text[e.start:e.end] for e in r.entities if not e.base] for r in marked[:6]}
    assert added[1] == ["(512) 555-4564"] and added[2] == ["kpbelhe.03"]
    assert not added[3] and not added[4] and not added[5] and not added[6]
    assert "[PHONE]" in marked[0].clean and "4564" not in marked[0].clean and marked[3].clean is None
    assert op6_pii.find(spark.createDataFrame([], "doc_id long, text string"), op6_pii.train(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


# --- mixing ---------------------------------------------------------------------------------

def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[n % 3] for n, s in enumerate(names)}
    goal, fixed = {}, set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in fixed)
        free = [s for s in names if s not in fixed]
        for s in free:
            goal[s] = rest * weight[s] / sum(weight[f] for f in free)
        over = {s for s in free if goal[s] > 2 * sizes[s]}
        for s in over:
            goal[s] = 2.0 * sizes[s]
        if not over:
            return goal
        fixed |= over


def check_mix(rows, got):
    sizes, mine = Counter(), {}
    for r in rows:
        sizes[r[1]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[2] or ""))
    goal = plain_targets(sizes)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - goal[r["source"]]) <= 1e-6 * max(1, goal[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["copies"] in (0, 1, 2)
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    return {s: (taken[s] - goal[s], largest[s], goal[s]) for s in sizes}


def test_mixing(spark):
    docs = table(spark, FOLDER, "documents")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    first = op10_mixing.mix(docs).collect()
    for gap, largest, goal in check_mix(rows, first).values():
        assert abs(gap) <= max(0.03 * goal, 60)
    again = op10_mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in first) == sorted((r.doc_id, r.taken) for r in again)


def test_mixing_rates_tilt_and_meet_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(n, "ab"[n % 3 == 0], "w " * int(rng.integers(1, 300))) for n in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = op10_mixing.mix(frame, tail=20).collect()
    again = op10_mixing.mix(frame.repartition(5, "text"), tail=20).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    gaps = check_mix(rows, got)
    for s, (gap, largest, goal) in gaps.items():
        assert abs(gap) <= 0.01 * goal
        mine = [r for r in got if r.source == s]
        if goal < 2 * mine[0].source_size - 1:
            assert abs(sum(r.rate * r.size for r in mine) - goal) <= 1e-3 * goal
            odds = {round(np.log(r.rate / (2 - r.rate)) / r.size, 3) for r in mine if r.size > 20}
            assert len(odds) <= 2  # one multiplier for each source


def test_mixing_edges(spark):
    rows = [(1, "a", "one two three"), (1, "a", "one two three"), (2, None, "x y"), (3, "b", None), (4, "b", ""), (None, "c", "p q r s"), (5, "ü", "w " * 60_000)]
    got = op10_mixing.mix(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, source string, text string, size string")).collect()
    assert len(got) == len(rows)
    check_mix(rows, got)
    assert op10_mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
