"""Token ids in files: static range asymmetric numeral system (rANS) blocks.

A first pass writes the ids of all documents to the shared folder and counts every
id. The counts become one frequency table that all blocks share. Documents are then
range-sorted, and every sorted partition (a shard) is cut into blocks that decode
on their own: ``lanes`` interleaved coder states take turns over the ids, every
``step`` rounds a checkpoint notes the states and the place in the word stream, and
checksums cover the words and the decoded ids. The files are Parquet (any store that
Spark writes to): ``frequencies`` holds the table, ``blocks`` one row per block. Blocks
end where documents end; only a document longer than a block spans several.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.llm.common import by_bytes, keep, shared_folder, table
from docketry.llm.tokens import END_ID, default_vocabulary, id_type, tokenized

BLOCK_TOKENS = 1 << 18
LANES = 1024
STEP = 128
BITS = 20
LOW = 1 << 31  # a state stays in [LOW, LOW << 32); words have 32 bits
BLOCKS = ("part int, block int, local_start long, n_tokens long, lanes int, doc_ids array<{id}>, numbers array<long>, starts array<long>, lengths array<long>,"
          " states binary, words binary, checkpoints binary, words_crc32 long, ids_crc32 long")


def scaled(counts: dict[int, int], bits: int = BITS):
    """Counts as frequencies that add up to 2**bits, at least 1 for each id that occurs."""
    import numpy as np

    ids = np.array(sorted(counts), dtype=np.int64)
    if len(ids) > 1 << bits:
        raise ValueError("more distinct ids than slots; raise bits")
    seen = np.array([counts[i] for i in ids.tolist()], dtype=np.float64)
    freq = np.maximum(1, np.floor(seen / seen.sum() * (1 << bits)).astype(np.int64)) if len(ids) else seen.astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    excess = int(freq.sum()) - (1 << bits) if len(ids) else 0
    while excess > 0:  # the most frequent ids give what the minimum of 1 took
        room = np.minimum(freq[order] - 1, max(1, excess // len(ids)))
        cut = np.minimum(room, np.maximum(0, excess - (np.cumsum(room) - room)))
        freq[order] -= cut
        excess -= int(cut.sum())
    if excess < 0:
        freq[order[0]] -= excess
    return ids, freq


class Coder:
    """Codes arrays of ids by one frequency table."""

    def __init__(self, ids, freq, bits: int = BITS):
        import numpy as np

        size = int(ids.max()) + 1 if len(ids) else 1
        self.bits, self.freq, self.low = bits, np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64)
        self.freq[ids] = freq
        self.low[ids] = np.cumsum(freq) - freq
        self.slots = np.repeat(ids, freq).astype(np.uint32)

    def encode(self, ids, lanes: int = LANES, step: int = STEP):
        """(states, words, checkpoints) as bytes. A checkpoint before round t holds the
        number of words read so far and the states of all lanes, as 64-bit numbers."""
        import numpy as np

        f, c = self.freq[ids], self.low[ids]
        limit = f << np.uint64(63 - self.bits)
        x = np.full(lanes, LOW, dtype=np.uint64)
        words, marks, sent = [], [], 0
        half, bits = np.uint64(32), np.uint64(self.bits)
        for t in range(-(-len(ids) // lanes) - 1, -1, -1):
            at = slice(t * lanes, min((t + 1) * lanes, len(ids)))
            fs = f[at]
            xs = x[:len(fs)]
            full = xs >= limit[at]
            out = xs[full]
            words.append(out.astype(np.uint32))
            sent += len(out)
            xs[full] = out >> half
            q = xs // fs
            x[:len(fs)] = (q << bits) + (xs - q * fs) + c[at]
            if t and t % step == 0:
                marks.append((sent, x.copy()))
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        notes = [np.concatenate([np.array([sent - n], dtype=np.uint64), state]) for n, state in marks[::-1]]
        return x.astype("<u8").tobytes(), stream.astype("<u4").tobytes(), (np.concatenate(notes).astype("<u8").tobytes() if notes else b"")

    def decode(self, n: int, lanes: int, states: bytes, words: bytes, checkpoints: bytes = b"", step: int = STEP, first: int = 0, last: int | None = None):
        """Ids ``first`` to ``last`` of a block of ``n``, from the nearest checkpoint on."""
        import numpy as np

        last = n if last is None else min(last, n)
        begin = min(first // lanes // step, len(checkpoints) // 8 // (lanes + 1))
        x, at = np.frombuffer(states, dtype="<u8").copy(), 0
        if begin:
            note = np.frombuffer(checkpoints, dtype="<u8").reshape(-1, lanes + 1)[begin - 1]
            at, x = int(note[0]), note[1:].copy()
        stream = np.frombuffer(words, dtype="<u4").astype(np.uint64)
        low_bits, bits, half = np.uint64((1 << self.bits) - 1), np.uint64(self.bits), np.uint64(32)
        out = []
        for t in range(begin * step, -(-last // lanes)):
            k = min(lanes, n - t * lanes)
            xs = x[:k]
            slot = xs & low_bits
            ids = self.slots[slot]
            y = self.freq[ids] * (xs >> bits) + slot - self.low[ids]
            short = np.flatnonzero(y < LOW)
            y[short] = (y[short] << half) | stream[at:at + len(short)]
            at += len(short)
            x[:k] = y
            out.append(ids)
        found = np.concatenate(out) if out else np.zeros(0, np.uint32)
        return found[first - begin * step * lanes:last - begin * step * lanes]


def write(docs: DataFrame, folder: str, path: str, block_tokens: int = BLOCK_TOKENS, lanes: int = LANES, step: int = STEP, end_id: int = END_ID,
          id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents to ``folder`` in ascending id order (nulls first).

    Null texts are empty documents (the end id alone). Rows with equal ids follow
    each other. An empty table gives an empty file set. Other columns are ignored.
    """
    spark = docs.sparkSession
    ids = keep(tokenized(docs, path, end_id, id_col, text_col).withColumnRenamed(id_col, "doc_id"), "tokens")
    dtype = id_type(path)

    def count(batches):
        import numpy as np
        import pyarrow as pa

        seen = np.zeros(1, dtype=np.int64)
        for batch in by_bytes(batches, "ids"):  # a count is as long as the vocabulary: one for each batch, not for each document
            found = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=dtype))
            if len(found) > len(seen):
                found, seen = seen, found
            seen[:len(found)] += found
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["id", "n"])

    counts = {r["id"]: r["n"] for r in ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}  # one row for each id of the vocabulary
    symbols, freq = scaled(counts)
    spark.createDataFrame(list(zip(symbols.tolist(), freq.tolist())), "id long, frequency long").coalesce(1).write.parquet(f"{folder}/frequencies")
    shared = spark.sparkContext.broadcast((symbols, freq))

    def encode(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        coder, part, block, done, number = Coder(*shared.value), TaskContext.get().partitionId(), 0, 0, 0
        held, size = [], 0

        def flush():
            nonlocal block, done, held, size
            whole = np.concatenate([h[3] for h in held]).astype(np.uint32)
            states, words, notes = coder.encode(whole, lanes, step)
            row = {"part": part, "block": block, "local_start": done, "n_tokens": len(whole), "lanes": lanes, "doc_ids": [h[0] for h in held], "numbers": [h[1] for h in held],
                   "starts": [h[2] for h in held], "lengths": [len(h[3]) for h in held], "states": states, "words": words, "checkpoints": notes,
                   "words_crc32": zlib.crc32(words), "ids_crc32": zlib.crc32(whole.astype("<u4").tobytes())}
            block, done, held, size = block + 1, done + len(whole), [], 0
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                doc = np.frombuffer(raw.as_buffer(), dtype=dtype)
                if held and size + len(doc) > block_tokens:
                    yield flush()
                begin = done + size
                for at in range(0, len(doc), block_tokens):
                    cut = doc[at:at + block_tokens]
                    if held and size + len(cut) > block_tokens:
                        yield flush()
                    held.append((doc_id, number, begin, cut))
                    size += len(cut)
                number += 1
        if held:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(BLOCKS.format(id=ids.schema["doc_id"].dataType.simpleString()))
    arrow = to_arrow_schema(schema)
    ordered = ids.select("doc_id", "ids").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(encode, schema).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a file set, decoded block by block in parallel: doc_id, start
    (ids of all documents before), n_tokens, piece (0 for the first block that holds
    the document), ids (bytes of unsigned 32-bit numbers). Checksums are verified."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    table_rows = spark.read.parquet(f"{folder}/frequencies").orderBy("id").collect()  # the vocabulary at most
    import numpy as np
    shared = spark.sparkContext.broadcast((np.array([r["id"] for r in table_rows], dtype=np.int64), np.array([r["frequency"] for r in table_rows], dtype=np.int64)))
    shards, before = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # one row for each shard
        shards[r["part"]], before = before, before + r["n"]
    id_kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches):
        import zlib

        import pyarrow as pa

        coder = Coder(*shared.value)
        for batch in batches:
            for row in (batch.slice(n, 1).to_pylist()[0] for n in range(batch.num_rows)):
                if zlib.crc32(row["words"]) != row["words_crc32"]:
                    raise ValueError(f"block {row['part']}/{row['block']}: damaged words")
                ids = coder.decode(row["n_tokens"], row["lanes"], row["states"], row["words"]).astype("<u4")
                if zlib.crc32(ids.tobytes()) != row["ids_crc32"]:
                    raise ValueError(f"block {row['part']}/{row['block']}: damaged ids")
                out, at = [], 0
                for doc_id, number, start, n in zip(row["doc_ids"], row["numbers"], row["starts"], row["lengths"]):
                    out.append({"doc_id": doc_id, "part": row["part"], "number": number, "start": shards[row["part"]] + start,
                                "at": row["local_start"] + at - start, "n": n, "ids": ids[at:at + n].tobytes()})
                    at += n
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"doc_id {id_kind}, part int, number long, start long, at long, n long, ids binary")
    arrow = to_arrow_schema(schema)
    return blocks.mapInArrow(decode, schema)


def file_digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents in a file set.

    Only documents that span blocks are put together again, by their pieces'
    checksums: crc(a + b) = crc(b) xor the crc of a carried over len(b) zero bytes.
    """
    pieces = read(spark, folder).select("doc_id", "part", "number", "start", "at", "n", F.crc32("ids").alias("crc"))

    @F.pandas_udf("long")
    def joined(parts):
        import zlib

        def one(rows):
            total = rows[0]["crc"]
            for r in rows[1:]:
                zeros = bytes(4 * r["n"])
                total = zlib.crc32(zeros, total) ^ zlib.crc32(zeros) ^ r["crc"]
            return total

        return parts.map(one)

    gathered = (pieces.groupBy("part", "number").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.sum("n").alias("n_tokens"),
                                                     F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("parts")))
    return gathered.select("doc_id", "start", "n_tokens", F.when(F.size("parts") == 1, F.col("parts")[0]["crc"]).otherwise(joined("parts")).alias("ids_crc32"))


def op4_rans_tokens(spark: SparkSession, folder: str) -> DataFrame:
    target = shared_folder(spark, "rans")
    write(table(spark, folder, "documents"), target, default_vocabulary())
    return file_digest(spark, target)
