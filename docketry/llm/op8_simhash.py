"""SimHash near-duplicates found through pigeonhole blocks.

Fingerprints are computed once per document, then only distinct ones are compared.
With at most two differing bits, one of three blocks of bits is equal in both, so
candidates join on (block, value) and the join condition checks the Hamming
distance. A value shared by more than ``CROWD`` fingerprints is not compared all
against all: its remaining bits are cut into three blocks again, twice, and what is
still crowded meets at single-bit neighbours of the remaining bits, where everything
that meets is within two bits. Every link is therefore found or implied by a
path of links, no group emits all its pairs, and copies never multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry.llm.common import components, keep, table

WORDS = 3
BITS = 64
DISTANCE = 2
CROWD = 48
LEVELS = 3


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """64-bit SimHash of word shingles (a signed long with the same bits); 0 without words."""

    @F.pandas_udf("long")
    def simhash(texts):
        import numpy as np
        import pandas as pd
        from xxhash import xxh64_intdigest

        out = np.zeros(len(texts), dtype=np.uint64)
        weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
        for n, text in enumerate(texts):
            found = text.encode().lower().split() if text else ()  # bytes: A-Z only, ASCII white space only
            if not found:
                continue
            k = min(words, len(found))
            line = b" ".join(found)
            size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            ends = np.cumsum(size + 1) - 1
            begins = ends - size
            view = memoryview(line)
            hashes = np.array([xxh64_intdigest(view[a:b], 42) for a, b in zip(begins[:len(found) - k + 1].tolist(), ends[k - 1:].tolist())], dtype="<u8")
            ones = np.zeros(BITS, dtype=np.int64)
            for at in range(0, len(hashes), 1 << 16):
                ones += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[n] = (weights * (2 * ones > len(hashes))).sum(dtype=np.uint64)
        return pd.Series(out.view(np.int64))

    return simhash(text)


def _thirds(bits: list[int]) -> list[list[int]]:
    cut = [round(len(bits) * i / (DISTANCE + 1)) for i in range(DISTANCE + 2)]
    return [bits[a:b] for a, b in zip(cut, cut[1:])]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect exactly the
    same fingerprints as all pairs within two bits do."""
    paths = [(list(block), [b for b in range(BITS) if b not in block]) for block in _thirds(list(range(BITS)))]
    rows, found = prints.select("fp", F.lit(-1).alias("path")), None
    for level in range(LEVELS):
        blocks = F.array(*[F.struct(F.lit(n).alias("path"), F.lit(n // (DISTANCE + 1) if level else -1).alias("above"), F.col("fp").bitwiseAND(F.lit(_mask(used))).alias("key"))
                           for n, (used, _) in enumerate(paths)])
        cut = rows.select("fp", F.col("path").alias("_from"), F.inline(blocks)).where("above = _from").select("fp", "path", "key")
        sizes = cut.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = keep(cut.join(sizes, ["path", "key"]), "blocks")
        few = shared.where(F.col("n") <= crowd)
        left, right = few.select("path", "key", F.col("fp").alias("a")), few.select("path", "key", F.col("fp").alias("b"))
        near = left.join(right, ["path", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
        found = near if found is None else found.unionByName(near)
        rows = shared.where(F.col("n") > crowd).select("fp", "path")
        if not rows.limit(1).count():
            return found
        if level < LEVELS - 1:
            paths = [(used + block, [b for b in rest if b not in block]) for used, rest in paths for block in _thirds(rest)]
    # Bits outside a path's blocks: members of a crowded block meet at their neighbours.
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_mask([b])).cast("long") for b in rest]) for _, rest in paths])
    met = keep(rows.distinct().select("fp", "path", F.explode(flips[F.col("path")]).alias("flip"))
               .select("fp", "path", F.col("fp").bitwiseXOR(F.col("flip")).alias("key")), "neighbours")
    least = met.groupBy("path", "key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return found.unionByName(met.join(least, ["path", "key"]).where("fp <> a").select("a", F.col("fp").alias("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id of its component).

    Null and empty texts have fingerprint 0, which links like any other. Documents
    without an id keep their row; they take part, but never name a component (null
    if nothing else is in it). Repeated rows stay repeated. Other columns are ignored.
    """
    marked = keep(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), words).alias("fp")), "fingerprints")
    prints = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    parts = components(links(prints))
    rooted = keep(prints.join(parts, prints["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = keep(rooted.join(names, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp")  # both read from written tables: AQE can split a fingerprint with many copies


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
