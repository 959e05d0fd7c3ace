"""Approximate nearest neighbours: an inverted multi-index.

Unit vectors are cut into two halves, each quantised with its own centroids, fitted
on a bounded sample. A cell is a pair of centroids; all vectors are entries of the
cells. A query walks the cells by summed distance of its halves, with a heap, until
they hold enough entries, and reranks these exactly. How many are enough is measured:
pilot vectors (a bounded part of the sample) are compared with every entry once, and
the walk is made long enough to reach ``target`` of their true neighbours. Entries
and queries meet in blocks of bounded size by the first half's centroid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docketry.llm.common import keep, table
from docketry.llm.vectors import matrix, unit, valid_vectors, width

NEIGHBOURS = 5
CENTROIDS = 64
SAMPLE_ROWS = 16_384
SAMPLE_BYTES = 64 << 20
PILOTS = 96
TARGET = 0.96
ENTRY_BLOCK = 8192
QUERY_BLOCK = 2048


def fit(sample, k: int = CENTROIDS, rounds: int = 12):
    """Centroids of one half by Lloyd's iterations; seeded by evenly spaced rows of the sample."""
    import numpy as np

    k = max(1, min(k, len(sample) // 8))
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (sample @ centres.T - 0.5 * (centres ** 2).sum(axis=1)).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def squares(rows, centres):
    import numpy as np

    return np.maximum(0, (rows ** 2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres ** 2).sum(axis=1))


def walk(first, second, counts, enough: int):
    """Cells (i, j) by first[i] + second[j], nearest first, until they hold ``enough`` entries."""
    import heapq

    import numpy as np

    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    f, s = first[a].tolist(), second[b].tolist()
    heap, held, out = [(f[0] + s[0], 0, 0)], 0, []
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        n = int(counts[a[i], b[j]])
        if n:
            held += n
            out.append((a[i], b[j]))
        if j + 1 < len(s):
            heapq.heappush(heap, (f[i] + s[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(f):
            heapq.heappush(heap, (f[i + 1] + s[0], i + 1, 0))
    return out


def search(df: DataFrame, is_query, neighbours: int = NEIGHBOURS, centroids: int = CENTROIDS, target: float = TARGET, pilots: int = PILOTS,
           entry_block: int = ENTRY_BLOCK, query_block: int = QUERY_BLOCK, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): nearest rows by cosine of each row where ``is_query``.

    Candidates are all rows but the query's own id; ties go to the smaller id; with
    fewer candidates all are returned. Null, zero and non-finite vectors and rows
    without an id take no part. Equal vectors are one entry that lists its smallest
    ids (more than are ever needed), so copies cost nothing. ``is_query`` may use
    vec_id. An empty table gives no rows.
    """
    import numpy as np

    spark, keepers = df.sparkSession, neighbours + 1
    rows = valid_vectors(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v")), "v").where("vec IS NOT NULL AND vec_id IS NOT NULL")
    # One text for each vector, with -0.0 read as 0.0.
    rows = keep(rows.select("vec_id", "vec", F.sha2(F.concat_ws(",", F.transform("vec", lambda x: (x + F.lit(0.0)).cast("string"))), 256).alias("key")).distinct(), "vectors")
    columns = width(rows)
    half = -(-columns // 2)
    some = rows.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("_n") <= keepers)
    entries = keep(some.groupBy("key").agg(F.min_by("vec", "vec_id").alias("vec"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, columns))))
    every = max(1, entries.count() // most)  # thinned by hash first, so that tasks sort and send little
    sample = [r["vec"] for r in entries.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(every)) == 0).orderBy(F.xxhash64("key")).select("vec").limit(most).collect()]
    out = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], out)
    fitted = np.zeros((len(sample), columns))
    for n, v in enumerate(sample):
        fitted[n, :len(v)] = v
    fitted = unit(fitted)
    pilot = fitted[np.linspace(0, len(fitted) - 1, min(pilots, len(fitted))).astype(int)]
    shared = spark.sparkContext.broadcast((fit(fitted[:, :half], centroids), fit(fitted[:, half:], centroids) if columns > half else np.zeros((1, 0))))

    def assign(batches):
        import pyarrow as pa

        a, b = shared.value
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column("vec"), columns))
                yield pa.RecordBatch.from_arrays([batch.column("vec"), batch.column("ids"), pa.array(squares(x[:, :half], a).argmin(axis=1).astype(np.int32)), pa.array(squares(x[:, half:], b).argmin(axis=1).astype(np.int32))],
                                                 names=["vec", "ids", "c1", "c2"])

    cells = keep(entries.select("vec", "ids").mapInArrow(assign, "vec array<double>, ids array<long>, c1 int, c2 int"), "cells")
    counts = np.zeros((len(shared.value[0]), len(shared.value[1])), dtype=np.int64)
    for r in cells.groupBy("c1", "c2").count().collect():  # centroids squared rows at most
        counts[r["c1"], r["c2"]] = r["count"]
    pilot_shared = spark.sparkContext.broadcast(pilot)

    def near_pilots(batches):
        import pyarrow as pa

        p = pilot_shared.value
        held = np.zeros((len(p), 0)), np.zeros((len(p), 0), np.int32), np.zeros((len(p), 0), np.int32)
        for batch in batches:
            if batch.num_rows:
                score = p @ unit(matrix(batch.column("vec"), columns)).T
                tags = [np.broadcast_to(batch.column(c).to_numpy(zero_copy_only=False), score.shape) for c in ("c1", "c2")]
                score, c1, c2 = (np.concatenate(x, axis=1) for x in zip(held, (score, *tags)))
                best = np.argsort(-score, axis=1, kind="stable")[:, :keepers]
                held = tuple(np.take_along_axis(x, best, axis=1) for x in (score, c1, c2))
        score, c1, c2 = held
        q = np.repeat(np.arange(len(p), dtype=np.int32), score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(score.ravel()), pa.array(c1.ravel()), pa.array(c2.ravel())], names=["q", "score", "c1", "c2"])

    found = cells.select("vec", "c1", "c2").mapInArrow(near_pilots, "q int, score double, c1 int, c2 int")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c1", "c2"))).where(F.col("n") <= keepers)
    d1, d2 = squares(pilot[:, :half], shared.value[0]), squares(pilot[:, half:], shared.value[1])
    needs = []
    for r in best.where("n > 1").collect():  # the pilots' neighbours; the first is the pilot itself
        far = d1[r["q"]][:, None] + d2[r["q"]]
        needs.append(int(counts[far <= far[r["c1"], r["c2"]]].sum()))
    needs.sort()
    enough = max(needs[min(len(needs) - 1, int(target * len(needs)))] if needs else 0, 200 * neighbours)

    queries = keep(rows.where(is_query).groupBy("key").agg(F.min_by("vec", "vec_id").alias("vec")).withColumn("q", F.monotonically_increasing_id()), "queries")

    def plan(batches):
        import pyarrow as pa

        a, b = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column("vec"), columns))
            first, second = squares(x[:, :half], a), squares(x[:, half:], b)
            q, c1, visits = [], [], []
            for n in range(len(x)):
                by = {}
                for i, j in walk(first[n], second[n], counts, enough):
                    by.setdefault(i, []).append(j)
                q += [n] * len(by)
                c1 += by
                visits += by.values()
            take = pa.array(q, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("q").take(take), batch.column("vec").take(take), pa.array(c1, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], names=["q", "vec", "c1", "visits"])

    visits = keep(queries.select("q", "vec").mapInArrow(plan, "q long, vec array<double>, c1 int, visits array<int>"), "visits")
    blocks = (cells.groupBy("c1").agg(F.ceil(F.count("*") / F.lit(entry_block)).cast("int").alias("eb"))
              .join(visits.groupBy("c1").agg(F.ceil(F.count("*") / F.lit(query_block)).cast("int").alias("qb")), "c1"))
    sides = F.broadcast(blocks)  # a row for each centroid of the first half
    left = visits.join(sides, "c1").withColumn("b", F.pmod(F.xxhash64("q"), F.col("qb")).cast("int")).withColumn("e", F.explode(F.sequence(F.lit(0), F.col("eb") - 1))).drop("eb", "qb")
    right = cells.join(sides, "c1").withColumn("e", F.pmod(F.xxhash64("ids"), F.col("eb")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("qb") - 1))).drop("eb", "qb")

    def rerank(asked, held):
        import pandas as pd

        def full(frame):
            x = np.zeros((len(frame), columns))
            for n, v in enumerate(frame["vec"]):
                x[n, :len(v)] = v
            return x / np.abs(x).max(axis=1, keepdims=True) if len(frame) else x

        x, y = full(asked), full(held)
        nx, ny = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
        c2, ids, least = held["c2"].to_numpy(), held["ids"].to_list(), np.array([i[0] for i in held["ids"]], dtype=np.int64)
        member = np.zeros((len(asked), counts.shape[1]), dtype=bool)
        for n, v in enumerate(asked["visits"]):
            member[n, v] = True
        q, vec_id, score = [], [], []
        for at in range(0, len(asked), 256):
            rough = x[at:at + 256] @ y.T / ny / nx[at:at + 256, None]
            rough[~member[at:at + 256][:, c2]] = -9
            for n, line in enumerate(rough):
                limit = np.partition(line, -keepers)[-keepers] if len(line) > keepers else -8
                near = np.flatnonzero((line >= limit - 1e-9) & (line > -8))
                exact = np.einsum("ij,j->i", y[near], x[at + n]) / (ny[near] * nx[at + n])
                order = np.lexsort((least[near], -exact))[:keepers]
                got = sorted((-exact[k], int(i)) for k in order for i in ids[near[k]])[:keepers]
                q += [int(asked["q"].iloc[at + n])] * len(got)
                vec_id += [i for _, i in got]
                score += [-s for s, _ in got]
        return pd.DataFrame({"q": np.array(q, np.int64), "vec_id": np.array(vec_id, np.int64), "score": np.array(score, float)})

    met = left.groupBy("c1", "b", "e").cogroup(right.groupBy("c1", "b", "e")).applyInPandas(rerank, "q long, vec_id long, score double")
    top = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = keep(met.withColumn("n", F.row_number().over(top)).where(F.col("n") <= keepers).drop("n"), "near")
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "key").distinct().join(queries.select("key", "q"), "key").select("query_id", "q")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asked.join(near, "q").where("query_id <> vec_id").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= neighbours)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op3_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0)
