"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from three sources, and exact shingle sets decide each:

1. the links of SimHash fingerprints (two differing bits at most), which find what is
   nearly equal and merge it first. Texts of similarity 0.8 differ in up to 11 of 64 bits,
   which pigeonhole blocks cannot cover, hence
2. ``BANDS`` keys of ``ROWS`` minima of the shingle hashes each. A pair of similarity 0.8
   shares none with probability 0.59 ** 25, two in a million. In every key all texts are
   compared with the smallest; a key whose texts are in one component then is done.
   Left-over keys of at most ``CROWD`` texts compare those of different components.
3. Texts in left-over crowded keys mostly share a frequent passage. Their shingles are
   ordered rarest first, by their number of such texts; a pair of the similarity shares
   one of the first n - ceil(0.8 n) + 1 shingles of both (prefix filter, exact). A
   frequent passage stands last in the order, so the texts that share it never meet.
   Variants of one text share its shingles first and last. Two of them meet only at a shingle
   that can be their first common one (behind it both have as many left as the similarity
   needs), and only if their marks (the parity of the shingles in each of ``MARKS``
   classes) differ in no more places than their sets may differ. Both are exact.

Before sets are made, pairs with fewer than ``LIKELY`` of their 100 minima in common go: a
pair of similarity 0.8 is among them with a probability of one in a million. Equal sets are compared once; sets
are made again from the texts, only of texts that are compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from docketry.llm import op8_simhash
from docketry.llm.common import by_bytes, components, keep

WORDS = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 4
CROWD = 8
LIKELY = 60
MARKS = 1024


def shingles(text, words: int):
    """Sorted distinct 64-bit hashes of the word shingles of a text; one of a shorter text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split() if text else ()  # bytes: A-Z only, ASCII white space only
    if not found:
        return np.zeros(0, dtype=np.uint64)
    k = min(words, len(found))
    line = b" ".join(found)
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(size + 1) - 1
    begins = ends - size
    view = memoryview(line)
    return np.unique(np.array([xxh64_intdigest(view[a:b], 42) for a, b in zip(begins[:len(found) - k + 1].tolist(), ends[k - 1:].tolist())], dtype=np.uint64))


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """row, fp, node (hash of the shingle set), n (its size), the keys of its bands and 16 bits of each minimum."""

    def sign(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        factors = np.random.default_rng(7).integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in by_bytes(batches, "text"):
            nodes, sizes, keys, minima = [], [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingles(text, words)
                nodes.append(xxh64_intdigest(hashes.tobytes(), 0))
                sizes.append(len(hashes))
                least = np.array([(hashes * f).min() for f in factors]) if len(hashes) else np.zeros(BANDS * ROWS, dtype=np.uint64)
                keys.append(np.array([xxh64_intdigest(least[i:i + ROWS].tobytes(), 0) for i in range(0, BANDS * ROWS, ROWS)], dtype=np.uint64).view(np.int64))
                minima.append((least >> np.uint64(20)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("fp"), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(minima, pa.binary())],
                names=["row", "fp", "node", "n", "keys", "minima"])

    kind = docs.schema["row"].dataType.simpleString()
    marked = docs.select("row", "text", op8_simhash.fingerprint(F.col("text")).alias("fp"))
    return marked.mapInArrow(sign, f"row {kind}, fp long, node long, n int, keys array<long>, minima binary")


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, hashes, marks) of ``nodes`` (node, row); marks: the parity of the hashes in each of ``MARKS`` classes, 64 to a long."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        parity = lambda s: np.packbits((np.bincount(s % np.uint64(MARKS), minlength=MARKS) & 1).astype(np.uint8)).view("int64")

        for batch in by_bytes(batches, "text", 4 << 20):
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.view("int64") for s in sets], long), pa.array([parity(s) for s in sets], long)], names=["node", "hashes", "marks"])

    return docs.select("row", "text").join(nodes, "row").select("node", "text").mapInArrow(cut, "node long, hashes array<long>, marks array<long>")


@F.pandas_udf(T.IntegerType())
def _equal_minima(x, y):
    import numpy as np
    import pandas as pd

    grid = lambda column: np.frombuffer(b"".join(column), dtype="<u2").reshape(len(column), -1)
    return pd.Series((grid(x) == grid(y)).sum(axis=1).astype(np.int32)) if len(x) else pd.Series([], dtype=np.int32)


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """(row, node, root) for every row of ``docs`` (row: unique, text; a table that can be read again).

    Rows with the same ``root`` are connected by pairs of the given similarity.
    Null and blank texts have the empty set and are alike.
    """
    marked = keep(_signed(docs, words), "signed")
    prints = keep(marked.groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("minima").alias("minima")), "distinct")
    signs, found = prints.select("node", "n", "minima"), []
    parts = docs.sparkSession.createDataFrame([], "node long, root long")

    def side(name: str, *columns: str) -> DataFrame:
        return signs.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    def check(pairs: DataFrame) -> DataFrame:
        """Add the similar ones of ``pairs`` (a, b: nodes) to what was found; components of all."""
        nonlocal parts
        told = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        likely = told.join(side("a", "n", "minima"), "a").join(side("b", "n", "minima"), "b").where(
            (F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b")) & (_equal_minima("minima_a", "minima_b") >= LIKELY))
        likely = keep(likely.select("a", "b"), "pairs")
        if likely.limit(1).count():
            ends = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
            sets = keep(_sets(docs, prints.join(ends, "node").select("node", "row"), words), "sets")
            both = likely.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
            common = both.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("common"))
            similar = keep(common.where(F.col("common") / (F.col("total") - F.col("common")) >= similarity).select("a", "b"), "similar")
            if similar.limit(1).count():
                found.append(similar)
                parts = keep(components(reduce(DataFrame.unionByName, found)), "parts")
        return parts

    def rooted(rows: DataFrame, parts: DataFrame, *key: str) -> DataFrame:
        """The rows (node and key) with their root, of keys that hold several roots."""
        named = keep(rows.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        several = named.groupBy(*key).agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count("*").alias("held"), F.min("node").alias("leader")).where("_low < _high")
        return keep(named.join(several.drop("_low", "_high"), list(key)), "open")

    def apart(rows: DataFrame, *key: str) -> DataFrame:
        """Pairs of the rows of one key that are in different components and may be similar by size."""
        one = lambda node, n, root: rows.select(*key, F.col("node").alias(node), F.col("n").alias(n), F.col("root").alias(root))
        met = one("a", "n", "r").join(one("b", "m", "s"), list(key)).where((F.col("r") < F.col("s")) & (F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m")))
        return met.select("a", "b")

    def first_met(rows: DataFrame, marks: DataFrame) -> DataFrame:
        """Of the pairs apart, those whose first common shingle this can be and whose marks allow the similarity."""
        marked = rows.join(marks, "node")
        one = lambda **names: marked.select("shingle", *[F.col(c).alias(a) for a, c in names.items()])
        need = F.ceil((F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - 1e-6)
        differ = reduce(lambda x, y: x + y, [F.bit_count(F.col("x")[k].bitwiseXOR(F.col("y")[k])) for k in range(MARKS // 64)])
        met = one(a="node", n="n", r="root", p="place", x="marks").join(one(b="node", m="n", s="root", q="place", y="marks"), "shingle")
        return met.where((F.col("r") < F.col("s")) & (F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m"))
                         & (F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) >= need) & (differ <= F.col("n") + F.col("m") - 2 * need)).select("a", "b")

    # 1. SimHash links: of a fingerprint's sets, all are compared with the smallest, and the smallest of linked ones.
    faces = keep(marked.where("n > 0").select("fp", "node").distinct(), "faces")
    firsts = keep(faces.groupBy("fp").agg(F.min("node").alias("leader")), "prints")
    linked = op8_simhash.links(firsts.select("fp")).join(firsts.select(F.col("fp").alias("a"), F.col("leader").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("leader").alias("y")), "b")
    parts = check(faces.join(firsts, "fp").select(F.col("node").alias("a"), F.col("leader").alias("b")).unionByName(linked.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    # 2. Keys of minima.
    cut = prints.where("n > 0").select("node", "n", F.posexplode("keys").alias("band", "key"))
    shared = keep(cut.join(cut.groupBy("band", "key").agg(F.count("*").alias("held")).where("held > 1").drop("held"), ["band", "key"]), "bands")
    left = rooted(shared, parts, "band", "key")
    if left.limit(1).count():
        parts = check(left.select(F.col("leader").alias("a"), F.col("node").alias("b")))
        left = rooted(left.select("band", "key", "node", "n"), parts, "band", "key")
    if left.where(F.col("held") <= crowd).limit(1).count():
        parts = check(apart(left.where(F.col("held") <= crowd), "band", "key"))
    # 3. Crowded keys that are still open: prefixes of rare shingles.
    left = left.where(F.col("held") > crowd).select("band", "key", "node", "n")
    if left.limit(1).count():
        crowds = keep(rooted(left, parts, "band", "key").select("node", "n").distinct(), "crowds")
        sets = keep(_sets(docs, prints.select("node", "row").join(crowds, "node").select("node", "row"), words), "sets")
        words_of = sets.select("node", F.explode("hashes").alias("shingle"))
        often = keep(words_of.groupBy("shingle").agg(F.count("*").alias("texts")).where("texts > 1"), "often")
        seen = words_of.join(often, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("texts", "shingle"))).alias("s"))  # a text's own shingles
        # Shingles of one text only come first; what is left of the prefix is taken from the others.
        first = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * similarity - 1e-6).cast("int") + 1 - (F.col("n") - F.size("s")))
        alone = F.col("n") - F.size("s")
        prefix = seen.join(crowds, "node").select("node", "n", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), first)).alias("place", "e"))
        prefix = prefix.select("node", "n", (F.col("alone") + F.col("place")).alias("place"), "e.shingle")  # place: shingles before it
        parts = check(first_met(rooted(prefix, parts, "shingle"), sets.select("node", "marks")))
    named = keep(prints.select("node").join(parts, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "named")
    return marked.select("row", "node").join(named, "node")  # both read from written tables: AQE can split a set with many copies
