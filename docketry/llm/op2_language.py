"""Language identification by rank-order profiles.

A profile lists the most frequent character n-grams (one to three characters over
letters, runs of anything else being one blank) by rank. Language profiles come
from the summed counts of all training documents; a document goes to the language
with the smallest out-of-place distance: the sum over the document's n-grams of the
difference of ranks, or the profile length where the language lacks the n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docketry.llm.common import by_bytes, table

ORDERS = (1, 2, 3)
PROFILE = 300
FOLDS = 5
UNKNOWN = "und"
FLUSH = 1 << 20  # distinct n-grams a task holds before it hands on its counts


class _Letters:
    """Lower-case letters by code point; everything else is a blank."""

    def __init__(self):
        import unicodedata

        import numpy as np

        self.map = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                self.map[c] = ord(low) if len(low) == 1 else c

    def grams(self, text: str):
        """Sorted distinct n-gram codes of a whole text with their counts; none without a letter."""
        import numpy as np

        chars = self.map[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        blank = chars == 32
        if blank.all():
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        chars = chars[~(blank & np.concatenate([[True], blank[:-1]]))]
        chars = np.concatenate([[32], chars, [32] if chars[-1] != 32 else []]).astype(np.uint64)
        codes = [chars[chars != 32]]
        shift = np.uint64(21)
        for n in ORDERS[1:]:
            code = chars[:len(chars) - n + 1]
            for k in range(1, n):
                code = (code << shift) | chars[k:len(chars) - n + 1 + k]
            codes.append(code)
        found = np.sort(np.concatenate(codes))
        starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        return found[starts], np.diff(np.append(starts, len(found)))


def letters() -> _Letters:
    """One table for each Python worker; task code arrives by value, so it hangs on a module of the worker."""
    import sys
    import types

    store = sys.modules.setdefault("letter_tables", types.ModuleType("letter_tables")).__dict__
    if "made" not in store:
        store["made"] = _Letters()
    return store["made"]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles (n-gram codes, most frequent first; ties by code) of every language
    that labels a text with a letter. All given documents count; rows without a label
    or text do not. The result holds at most ``size`` numbers for each language."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        tool, held, rows = letters(), {}, 0

        def merge(parts):
            codes = np.concatenate([p[0] for p in parts])
            order = np.argsort(codes, kind="stable")
            codes, n = codes[order], np.concatenate([p[1] for p in parts])[order]
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
            return codes[starts], np.add.reduceat(n, starts) if len(codes) else n

        def out():
            for lang, parts in held.items():
                codes, n = merge(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in by_bytes(batches, "text", 4 << 20):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                codes, n = tool.grams(text)
                held.setdefault(lang, []).append((codes, n))
            held = {lang: [merge(parts)] for lang, parts in held.items()}
            rows = sum(len(parts[0][0]) for parts in held.values())
            if rows > FLUSH:
                yield from out()
                held = {}
        yield from out()

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "rank").collect():  # `size` rows for each language
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def predict(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """Add lang_pred and score (0 to 1: 1 minus the distance as a share of the largest possible).

    Equal distances go to the language first by code point. ``und`` with score 0 if
    the text is null or has no letter, or nothing was learned.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({k: profiles[k] for k in sorted(profiles)})

    def judge(parts):
        import numpy as np
        import pandas as pd

        tool, names = letters(), list(shared.value)
        for texts in parts:
            if not names:
                yield pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": np.zeros(len(texts))})
                continue
            known = np.unique(np.concatenate([np.array(p, dtype=np.uint64) for p in shared.value.values()]))
            ranks = np.full((len(names), len(known) + 1), -size, dtype=np.int64)  # -size: not in the profile
            for n, p in enumerate(shared.value.values()):
                ranks[n, np.searchsorted(known, np.array(p, dtype=np.uint64))] = np.arange(len(p))
            langs, scores = [], np.zeros(len(texts))
            for n, text in enumerate(texts):
                codes, count = tool.grams(text) if text else ((), ())
                if not len(codes):
                    langs.append(UNKNOWN)
                    continue
                order = np.lexsort((codes, -count))[:size]
                codes = codes[order]
                at = np.searchsorted(known, codes)
                at[at < len(known)] = np.where(known[at[at < len(known)]] == codes[at < len(known)], at[at < len(known)], len(known))
                there = ranks[:, at]
                far = np.where(there < 0, size, np.abs(there - np.arange(len(codes)))).sum(axis=1)
                best = int(far.argmin())
                langs.append(names[best])
                scores[n] = 1 - far[best] / (size * len(codes))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    # Hints set here: postponed annotations of a nested function cannot be read.
    judge.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    judged = F.pandas_udf(judge, "lang_pred string, score double")(F.col(text_col))
    return docs.withColumn("_judged", judged).select("*", "_judged.lang_pred", "_judged.score").drop("_judged")


def held_out(doc_id: Column) -> Column:
    """Every fifth document by checksum of its id is left out of training; rows without an id are not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, then judge every document.

    Keeps all columns of ``docs`` but those named held_out, lang_pred and score.
    """
    docs = docs.drop("held_out", "lang_pred", "score")
    profiles = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.withColumn("held_out", held_out(F.col("doc_id"))), profiles)


def op2_language_profiles(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
