"""Best-fit packing of documents into sequences of a fixed number of tokens.

Method: bulk-synchronous best fit. Documents (their pieces) are range-sorted by
length. Lengths are whole numbers up to the capacity, so the sorted order consists
of at most ``capacity`` runs of equal length, and the open gaps likewise; a sweep
works on runs and rank intervals, whatever the number of rows in them. In the sweep
for a length every run of pieces takes its successor, the smallest gap that holds
it; ranks inside the run decide which piece goes to which gap; the gaps shrink, and
the next sweep follows, until no piece is left. Each task then places its own rows
by length and rank. Rows are never compared with each other in one task.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from docketry.llm.common import by_bytes, keep, ranked, table
from docketry.llm.tokens import END_ID, crc_of, default_vocabulary, encoder_of, id_type

CAPACITY = 1024


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every whole text, each at most ``capacity`` long.

    Longer documents are cut from their end, so only the first piece may be
    shorter. ``row`` is unique for each piece, also among repeated documents.
    """
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, row = encoder_of(path), TaskContext.get().partitionId() << 36
        for batch in by_bytes(batches, "_text"):
            owner, number, start, length, ids = [], [], [], [], []
            for n, doc in enumerate(encoder.encode(batch.column("_text").fill_null(""), end_id)):
                borders = [0, *range((len(doc) - 1) % capacity + 1, len(doc) + 1, capacity)]
                for k, (a, b) in enumerate(zip(borders, borders[1:])):
                    owner.append(n)
                    number.append(k)
                    start.append(a)
                    length.append(b - a)
                    ids.append(doc[a:b].tobytes())
            rows = pa.array(range(row, row + len(owner)), pa.int64())
            row += len(owner)
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column("_id").take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                names=schema.names)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(cut, schema)


def sweeps(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Successor sweeps over runs, longest pieces first.

    ``counts``: pieces of each length. Returns rank intervals (length, first rank,
    pieces for each gap, first sequence, offset): the piece of rank r in an
    interval goes to sequence first + (r - first rank) // pieces for each gap.
    Sequences with the same gap are alike, so a run of gaps is (first, count); its
    offset is what the gap lacks of the capacity. There are at most ``capacity``
    lengths and a few new runs for each, independent of the number of pieces.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # gap sizes with open runs, ascending
    out, opened = [], 0

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, count))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(at)
            else:
                each = capacity // length
                gap, first, count = capacity, opened, -(-left // each)
                opened += count
            each = gap // length
            full = min(count, left // each)
            if full:
                out.append((length, rank, each, first, capacity - gap))
                leave(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:  # fewer pieces than one more gap holds
                out.append((length, rank, left, first + full, capacity - gap))
                leave(gap - left * length, first + full, 1)
                left, full = 0, full + 1
            leave(gap, first + full, count - full)
    return out


def place(lean: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset for rows (row, length, ...); ``lean`` is a kept table."""
    order = ["length", "doc_id", "piece", "row"]
    spark = lean.sparkSession
    counts = {r["length"]: r["count"] for r in lean.groupBy("length").count().collect()}  # one row for each length, capacity at most
    plan = spark.sparkContext.broadcast(sweeps(counts, capacity))
    firsts, before = {}, 0
    for length in sorted(counts):
        firsts[length], before = before, before + counts[length]
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def settle(batches):
        import numpy as np
        import pyarrow as pa

        steps = np.array(plan.value, dtype=np.int64).reshape(-1, 5)
        # Global ranks of the intervals' first pieces; rows are ranked in the same order.
        begin = steps[:, 1] + np.array([firsts[x] for x in steps[:, 0].tolist()], dtype=np.int64)
        order = np.argsort(begin)
        steps, begin = steps[order], begin[order]
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(begin, rank, side="right") - 1
            length, _, each, first, offset = steps[at].T
            inside = rank - begin[at]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(first + inside // each), pa.array(offset + inside % each * length)], names=schema.names)

    return ranked(lean.select(*order), order).select("row", "rank").mapInArrow(settle, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids (little-endian
    bytes), sequence_id, offset. The pieces of a sequence follow each other without
    gaps from offset 0. Null texts are empty documents (the end id alone); repeated
    documents, and such without an id, are packed one by one; other columns are
    ignored; an empty table gives no rows.
    """
    cut = keep(pieces(docs, path or default_vocabulary(), capacity, end_id, id_col, text_col), "pieces")
    return cut.join(place(cut.drop("ids", "start"), capacity), "row").drop("row")


def packed_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The packed pieces with a checksum of their ids in place of the ids."""
    path = path or default_vocabulary()
    dtype = id_type(path)

    @F.pandas_udf("long")
    def crc(ids):
        import numpy as np
        return ids.map(lambda b: crc_of(np.frombuffer(b, dtype=dtype))).astype("int64")

    return pack(docs, path).select("doc_id", "piece", "start", "length", crc("ids").alias("ids_crc32"), "sequence_id", "offset")


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_digest(table(spark, folder, "documents"))
