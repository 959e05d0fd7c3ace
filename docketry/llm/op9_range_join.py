"""Embedding near-duplicates: an exact metric range join.

On unit vectors cosine >= c is Euclidean distance <= r = sqrt(2 - 2c). Pivots, a
bounded sample of each label's vectors, cut space into cells; a vector lives in the
cell of its nearest pivot. By the triangle inequality a partner in cell j can only
lie within r if d(x, p_j) <= d(x, p_home) + 2r, and if x is within r of the cell's
radius; such vectors also visit cell j. Visits go to lower cells only, so each pair
meets in one cell. Cells join independently; a cell with many members is cut into
blocks that meet pair by pair, so no task holds more than two blocks. Equal vectors
are joined once, with their number as a weight. A task returns sums and a spanning
forest of its links, never the pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.llm.common import components, keep, table
from docketry.llm.vectors import matrix, unit, valid_vectors, width

COSINE = 0.98
CELL = 2048
BLOCK = 2048
MAX_PIVOTS = 8192  # bounds the broadcast: beyond it cells grow and are cut into more blocks


def _forest(a, b):
    """(nodes, roots) of the graph of index pairs a[i]-b[i]."""
    import numpy as np

    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[:len(a)], inverse[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def linked(rows: DataFrame, cosine: float = COSINE, cell: int = CELL, block: int = BLOCK, max_pivots: int = MAX_PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(sums, edges) of distinct vectors ``rows`` (rep long, label, weight long, vec):
    how many vectors each is linked to by its weights, and edges that connect them."""
    import numpy as np

    spark, columns = rows.sparkSession, width(rows)
    r = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    label_kind = rows.schema["label"].dataType.simpleString()
    total = rows.count()
    size = max(cell, -(-total // max_pivots))
    wanted = rows.groupBy("label").agg(F.ceil(F.count("*") / F.lit(size)).alias("k")).where("k > 1")
    # A pivot for each `size` vectors of a label, chosen by hash; a label with fewer
    # vectors is one cell without a pivot. So there are at most 2 * max_pivots.
    slot = F.pmod(F.xxhash64("vec"), F.col("k")).alias("slot")
    picked = rows.join(wanted, "label").groupBy("label", slot).agg(F.min(F.struct(F.xxhash64("vec", F.lit(7)).alias("h"), "vec")).alias("p")).select("label", "slot", "p.vec")
    pivots: dict = {}
    for p in picked.orderBy("label", "slot").collect():
        full = np.zeros(columns)
        full[:len(p["vec"])] = p["vec"]
        pivots.setdefault(p["label"], []).append(full)
    shared = spark.sparkContext.broadcast({k: unit(np.array(v)) for k, v in pivots.items()})

    def distances(batch):
        """Rows of a batch by label, with their distances to the pivots of the label."""
        labels = np.array(batch.column("label").to_pylist(), dtype=object)
        x = unit(matrix(batch.column("vec"), columns))
        plain = np.flatnonzero([label not in shared.value for label in labels.tolist()])
        if len(plain):
            yield None, plain, np.zeros((len(plain), 1))
        for label in dict.fromkeys(labels.tolist()):
            if label in shared.value:
                at = np.flatnonzero(labels == label)
                yield label, at, np.sqrt(np.maximum(0, 2 - 2 * x[at] @ shared.value[label].T))

    def reach(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                for label, at, d in distances(batch):
                    home = d.argmin(axis=1)
                    for j in () if label is None else np.unique(home).tolist():
                        yield pa.RecordBatch.from_arrays([pa.array([label], batch.schema.field("label").type), pa.array([j], pa.int32()), pa.array([float(d[home == j, j].max())])], names=["label", "cell", "radius"])

    radii: dict = {}
    for c in rows.select("label", "vec").mapInArrow(reach, f"label {label_kind}, cell int, radius double").groupBy("label", "cell").agg(F.max("radius").alias("radius")).collect():
        radii[c["label"], c["cell"]] = c["radius"]  # one for each pivot
    slack = 1e-6  # rounding of distances; every candidate is verified
    spread_schema = f"rep long, label {label_kind}, weight long, vec array<double>, cell int, home boolean"

    def visit(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            for label, at, d in distances(batch):
                home = d.argmin(axis=1)
                nearest = d[np.arange(len(at)), home]
                radius = np.array([radii.get((label, j), -9.0) for j in range(d.shape[1])])
                go = (d <= (nearest + 2 * r + slack)[:, None]) & (d <= radius + r + slack)
                go &= np.arange(d.shape[1]) < home[:, None]
                go[np.arange(len(at)), home] = True
                n, j = np.nonzero(go)
                some = batch.select(["rep", "label", "weight", "vec"]).take(pa.array(at[n]))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(j.astype(np.int32)), pa.array(home[n] == j)], names=["rep", "label", "weight", "vec", "cell", "home"])

    spread = keep(rows.select("rep", "label", "weight", "vec").mapInArrow(visit, spread_schema), "cells")
    sizes = spread.groupBy("label", "cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int")
    tasks = (spread.join(sizes, ["label", "cell"]).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")))

    def join(frame):
        import numpy as np
        import pandas as pd

        x = np.zeros((len(frame), columns))
        for n, v in enumerate(frame["vec"]):
            x[n, :len(v)] = v
        x = unit(x)
        weight, rep, home = (frame[c].to_numpy() for c in ("weight", "rep", "home"))
        side = frame["own"].to_numpy()
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        left, right = (np.flatnonzero(side == i), np.flatnonzero(side == j))
        firsts, seconds = [], []
        for at in range(0, len(left), 256):
            some = left[at:at + 256]
            a, b = np.nonzero(x[some] @ x[right].T >= cosine - 1e-9)
            a, b = some[a], right[b]
            ok = home[a] | home[b]
            ok &= (a < b) if i == j else True
            a, b = a[ok], b[ok]
            ok = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            firsts.append(a[ok])
            seconds.append(b[ok])
        a, b = np.concatenate(firsts) if firsts else np.zeros(0, int), np.concatenate(seconds) if seconds else np.zeros(0, int)
        if not len(a):
            return pd.DataFrame({"rep": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        nodes, roots = _forest(a, b)
        n = np.zeros(len(frame), dtype=np.int64)
        np.add.at(n, a, weight[b])
        np.add.at(n, b, weight[a])
        return pd.DataFrame({"rep": rep[nodes], "n": n[nodes], "root": rep[roots]})

    found = keep(tasks.groupBy("label", "cell", "i", "j").applyInPandas(join, "rep long, n long, root long"), "links")
    return found.groupBy("rep").agg(F.sum("n").alias("n")), found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))


def near_duplicates(df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", **sizes) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Only vectors with equal, non-null labels are compared. Null, zero and non-finite
    vectors, and such without an id or a label, are linked with nothing. Rows that
    repeat an id count as separate vectors. Other columns are ignored; an empty
    table gives no rows.
    """
    base = valid_vectors(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label")), "v").drop("v")
    base = keep(base, "vectors")
    alone = F.col("vec").isNull() | F.col("label").isNull() | F.col("vec_id").isNull()
    rows = base.where(~alone)
    rows = rows.withColumn("key", F.sha2(F.concat_ws(",", F.transform("vec", lambda x: (x + F.lit(0.0)).cast("string"))), 256))
    rows = keep(rows, "keyed")
    distinct = rows.groupBy("label", "key").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    distinct = keep(distinct.withColumn("rep", F.monotonically_increasing_id()), "distinct")
    sums, edges = linked(distinct, cosine, **sizes)
    parts = components(edges)
    rooted = keep(distinct.drop("vec").join(sums, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
                  .select("label", "key", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = keep(rooted.join(names, "root").drop("root", "least"), "named")
    joined = rows.select("vec_id", "label", "key").join(named, ["label", "key"]).select("vec_id", "n_links", "component_id")
    rest = base.where(alone).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embedding_range_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))
