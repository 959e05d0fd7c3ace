"""Substring dedup with sliding sentence spans.

Texts are cut into sentences (at . ! ? before white space, and at line ends; a
sentence of more than ``LONG`` words counts as several pieces, which end at words whose
checksum is smaller than those of the ``NEAR`` words on either side, about one in five,
so that equal passages are cut alike but for a few words at their ends; where there is
no such place within 3 * ``NEAR`` words, at the last of the words with the smallest).
Every run of consecutive sentences that has at least ``RUN`` sentences and ``WORDS``
words is hashed, from every starting sentence. Equal hashes meet once: a first pass
finds each repeated run's first place, a second marks all its other places. The
sentences that a non-first run covers are cut out of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.llm.common import by_bytes, keep, table

RUN = 3
WORDS = 20
LONG = 16
NEAR = 2


def sentences(text: str, long: int = LONG) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences of a text; together they cover all its words."""
    import re
    import zlib

    out, begin = [], 0
    for end in [*[m.end() for m in re.finditer(r"[.!?]+(?=\s)|\n", text)], len(text)]:
        words = text[begin:end].split()
        if len(words) > long:
            places = [m.span() for m in re.finditer(r"\S+", text[begin:end])]
            words = [text[begin + a:begin + b] for a, b in places]
            at, sums = 0, [zlib.crc32(word.encode("utf-8", "replace")) for word in words]
            for n, x in enumerate(sums):
                last = n
                if n + 1 < len(words) and not (x < min(sums[max(0, n - NEAR):n], default=1 << 32) and x <= min(sums[n + 1:n + 1 + NEAR])):
                    if n + 1 - at < 3 * NEAR + 1:
                        continue
                    last = n - sums[at:n + 1][::-1].index(min(sums[at:n + 1]))
                out.append((begin + places[at][0], begin + places[last][1], words[at:last + 1]))
                at = last + 1
        elif words:
            lead = len(text[begin:end]) - len(text[begin:end].lstrip())
            out.append((begin + lead, end, words))
        begin = end
    return out


def runs(parts, run: int = RUN, words: int = WORDS):
    """(first, after, hash) of every shortest run that is long enough, and of the last
    one counted from the end; a text with fewer sentences or words is one run."""
    from hashlib import blake2b

    size = [len(p[2]) for p in parts]
    lines = [" ".join(p[2]).encode() for p in parts]
    out, end, held = [], 0, 0
    for first in range(len(parts)):
        while end < len(parts) and (end - first < run or held < words):
            held += size[end]
            end += 1
        if end - first < run or held < words:
            break
        out.append((first, end))
        held -= size[first]
    if parts and (not out or out[-1][1] < len(parts)):
        first, held = len(parts), 0
        while first > 0 and (len(parts) - first < run or held < words):
            first -= 1
            held += size[first]
        out.append((first, len(parts)))
    return [(a, b, int.from_bytes(blake2b(b"\x00".join(lines[a:b]), digest_size=8).digest(), "little", signed=True)) for a, b in out]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int = WORDS, long: int = LONG) -> DataFrame:
    """One row per document: doc_id, n_removed (sentences), removed_words, text.

    The first place of a run is the one with the smallest doc_id (null last), then the
    smallest sentence number; a repeated row of a document comes after it. A run
    repeated inside one document is removed as well. Null texts stay null and
    blank ones unchanged. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    # Rows are numbered by partition and place; a written copy of the texts keeps that fixed.
    numbered = keep(base.withColumn("row", F.monotonically_increasing_id()), "texts")
    kind = base.schema["doc_id"].dataType.simpleString()

    def hashed(batches):
        import pyarrow as pa

        for batch in by_bytes(batches, "text", 4 << 20):
            found = [runs(sentences(t, long), run, words) if t else [] for t in batch.column("text").to_pylist()]
            owner = pa.array([n for n, f in enumerate(found) for _ in f], pa.int64())
            flat = [r for f in found for r in f]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(owner), pa.array([r[0] for r in flat], pa.int32()), pa.array([r[1] for r in flat], pa.int32()), pa.array([r[2] for r in flat], pa.int64())],
                names=["row", "first", "after", "hash"])

    spans = keep(numbered.select("row", "text").mapInArrow(hashed, "row long, first int, after int, hash long"), "spans")
    # Only hashes travel to be counted; the places of the repeated ones follow.
    again = spans.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    placed = keep(spans.join(again, "hash").join(numbered.select("row", "doc_id"), "row"), "placed")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "first")
    homes = keep(placed.groupBy("hash").agg(F.min(place).alias("home")).select("hash", F.col("home.row").alias("home_row"), F.col("home.first").alias("home_first")), "homes")
    copies = placed.select("row", "first", "after", "hash").join(homes, "hash").where("row <> home_row OR first <> home_first")
    cut = copies.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("first", "after"))).alias("covered"))

    def cleaned(batches):
        import numpy as np
        import pyarrow as pa

        for batch in by_bytes(batches, "text", 4 << 20):
            gone, lost, out = [], [], []
            for text, covered in zip(batch.column("text").to_pylist(), batch.column("covered").to_pylist()):
                parts = sentences(text, long) if covered else []
                drop = np.zeros(len(parts) + 1, dtype=bool)
                for c in covered or ():
                    drop[c["first"]:c["after"]] = True
                gone.append(int(drop.sum()))
                lost.append(sum(len(p[2]) for p, d in zip(parts, drop) if d))
                if not gone[-1]:
                    out.append(text)
                    continue
                kept = []
                for p, d, nxt in zip(parts, drop, [*parts[1:], (len(text),)]):
                    if not d:
                        kept.append(text[p[0]:nxt[0]])
                out.append("".join([text[:parts[0][0]], *kept]).rstrip() if kept else "")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(gone, pa.int64()), pa.array(lost, pa.int64()), pa.array(out, pa.string())],
                                             names=["doc_id", "n_removed", "removed_words", "text"])

    return numbered.join(cut, "row", "left").mapInArrow(cleaned, f"doc_id {kind}, n_removed long, removed_words long, text string")


def op5_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    return deduplicate(table(spark, folder, "documents"))
