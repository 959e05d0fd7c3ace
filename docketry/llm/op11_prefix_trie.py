"""Prefix trie of conversations in double arrays.

Distinct turns (role, text) get dense ids, so that texts are hashed once and never travel.
Equal conversations are collapsed, the others range-sorted by their ids and cut into
shards of about ``TURNS`` turns. A prefix shared by a third of all conversations only
spans many shards: shards are even whatever the data. In a shard the sequences are packed
into BASE and CHECK arrays over shard-local codes, walked all at once, depth by depth,
and summed up from the deepest nodes to the root.

Neighbouring shards share exactly nodes on the first and the last sequence of a shard.
These upper nodes leave it as two paths with what is known below them; groups of ``FAN``
shards merge theirs in double arrays again, until one is left. A node whose parent became
complete later gets the parent's name by a join inside its own shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry.llm.common import keep, ranked, table
from docketry.llm.sql import crc32_sql

TURNS = 50_000
FAN = 64
GROUP, HEADS = 5, 9  # op11: conversations of one group share the first crc32 % HEADS turns
LIST_IDS = 4096
NODES = "shard long, conv_id long, depth int, parent_conv_id long, parent_key binary, key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
PATHS = ("shard long, side int, ids array<long>, sizes array<long>, n array<long>, least array<long>, children array<long>, leaves array<long>, "
         "saved array<long>, ends array<string>, keys array<binary>")
MOST = (1 << 63) - 1


# --- double arrays ----------------------------------------------------------

def codes_of(ids, starts):
    """Shard-local dense codes of turn ids, numbered where they appear first, upper turns
    first, so that children of one node mostly have neighbouring codes."""
    import numpy as np

    depth = np.arange(len(ids)) - np.repeat(starts[:-1], np.diff(starts))
    order = np.argsort(depth, kind="stable")
    found, first, codes = np.unique(ids[order], return_index=True, return_inverse=True)
    rank = np.empty(len(found), dtype=np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(len(found))
    out = np.empty(len(ids), dtype=np.int64)
    out[order] = rank[codes]
    return out


def pack(codes, starts):
    """(BASE, CHECK) of the trie of the sequences codes[starts[i]:starts[i + 1]].

    State 0 is the root. The child of state s by code c is t = BASE[s] + c if CHECK[t] = s;
    free slots have CHECK -1. Nodes of several children are placed where all fit, nodes of
    one child fill the holes."""
    import numpy as np

    size = np.diff(starts)
    base, check = np.zeros(1024, dtype=np.int64), np.full(1024, -1, dtype=np.int64)
    check[0], end, low = 0, 1, 1  # end: behind the last slot in use; low: no free slot before it

    def grow(least):
        nonlocal base, check
        if least > len(check):
            more = max(least, 2 * len(check)) - len(check)
            base, check = np.concatenate([base, np.zeros(more, dtype=np.int64)]), np.concatenate([check, np.full(more, -1, dtype=np.int64)])

    rows, states, depth = np.flatnonzero(size > 0), None, 0
    states = np.zeros(len(rows), dtype=np.int64)
    while len(rows):
        c = codes[starts[rows] + depth]
        by = np.lexsort((c, states))
        s_sorted, c_sorted = states[by], c[by]
        new = np.concatenate([[True], (np.diff(s_sorted) != 0) | (np.diff(c_sorted) != 0)])
        parents, children = s_sorted[new], c_sorted[new]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(parents)) + 1, [len(parents)]])
        many = np.diff(cuts) > 1
        for a, b in zip(cuts[:-1][many].tolist(), cuts[1:][many].tolist()):
            steps = children[a:b] - children[a]
            free = low + np.flatnonzero(check[low:end] < 0)
            place = end
            grow(end + int(steps[-1]) + 1)
            for at in range(0, min(len(free), 4096), 256):
                tried = free[at:at + 256]
                fits = (check[tried[:, None] + steps[None, :]] < 0).all(axis=1)
                if fits.any():
                    place = int(tried[fits.argmax()])
                    break
            slots = place + steps
            base[parents[a]], check[slots] = place - children[a], parents[a]
            end = max(end, int(slots[-1]) + 1)
        alone = cuts[:-1][~many]
        if len(alone):
            grow(end + len(alone))
            slots = (low + np.flatnonzero(check[low:end + len(alone)] < 0))[:len(alone)]
            base[parents[alone]], check[slots] = slots - children[alone], parents[alone]
            end = max(end, int(slots[-1]) + 1)
        free = np.flatnonzero(check[low:end] < 0)
        low = low + int(free[0]) if len(free) else end
        states = base[states] + c
        on = size[rows] > depth + 1
        rows, states, depth = rows[on], states[on], depth + 1
    return base[:end], check[:end]


def walk(base, check, codes, starts):
    """The state of every prefix of every sequence: one more per sequence than it has turns
    (the root first); -1 from the first turn on that the trie does not hold."""
    import numpy as np

    size = np.diff(starts)
    begins = starts[:-1] + np.arange(len(size))
    out = np.zeros(len(codes) + len(size), dtype=np.int64)
    rows, depth = np.flatnonzero(size > 0), 0
    while len(rows):
        held = out[begins[rows] + depth]
        to = base[np.maximum(held, 0)] + codes[starts[rows] + depth]
        inside = (held >= 0) & (to > 0) & (to < len(check))
        to = np.where(inside & (check[np.where(inside, to, 0)] == held), to, -1)
        out[begins[rows] + depth + 1] = to
        rows, depth = rows[size[rows] > depth + 1], depth + 1
    return out


# --- shards -----------------------------------------------------------------

def _fold(shard, ids, sizes, starts, values, ends, whole, keyed):
    """Pack, walk and sum up sorted sequences: (complete nodes, paths of shared nodes).

    values: n, least, children, leaves, saved of each prefix (one more per sequence than
    turns), as far as known below the nodes of these sequences; ends: digests or None.
    whole: nothing is shared with others. keyed: complete nodes get their key.
    """
    import numpy as np
    from xxhash import xxh3_128_digest

    codes = codes_of(ids, starts)
    base, check = pack(codes, starts)
    states = walk(base, check, codes, starts)
    slots, length = len(check), np.diff(starts)
    begins = starts[:-1] + np.arange(len(length))
    depths = np.arange(len(states)) - np.repeat(begins, length + 1)
    n, least, children, leaves, saved = (np.zeros(slots, dtype=np.int64) for _ in range(5))
    least[:] = MOST
    for total, one in zip((n, children, leaves, saved), (values[0], *values[2:])):
        np.add.at(total, states, one)
    np.minimum.at(least, states, values[1])
    depth, size, end = np.full(slots, -1, dtype=np.int64), np.zeros(slots, dtype=np.int64), np.full(slots, -1, dtype=np.int64)
    depth[states] = depths
    turn = depths > 0
    size[states[turn]] = sizes
    told = np.flatnonzero([e is not None for e in ends])
    end[states[told]] = told
    edge = np.zeros(slots, dtype=bool)
    outer = [] if whole else [0] if len(length) == 1 else [0, len(length) - 1]
    for i in outer:
        edge[states[begins[i]:begins[i] + length[i] + 1]] = True
    by_depth = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[by_depth], np.arange(int(depth.max()) + 2))
    for d in range(int(depth.max()), -1, -1):
        at = by_depth[bounds[d]:bounds[d + 1]]
        at = at[~edge[at]]
        leaves[at] += children[at] == 0
        saved[at] += (n[at] - 1) * size[at]
        if d:
            np.add.at(children, check[at], 1)
            np.add.at(leaves, check[at], leaves[at])
            np.add.at(saved, check[at], saved[at])

    def keys(row):
        out = [xxh3_128_digest(b"")]
        for one in ids[starts[row]:starts[row + 1]].tolist():
            out.append(xxh3_128_digest(out[-1] + one.to_bytes(8, "little")))
        return out

    key: dict[int, bytes] = {}
    for row in range(len(length)) if keyed else outer:
        key.update(zip(states[begins[row]:begins[row] + length[row] + 1].tolist(), keys(row)))
    full = np.flatnonzero((depth >= 0) & ~edge)
    above = check[full]
    known = (depth[full] > 0) & ~edge[above]
    nodes = {
        "shard": np.full(len(full), shard, dtype=np.int64), "conv_id": least[full], "depth": depth[full].astype(np.int32),
        "parent_conv_id": [int(v) if k else None for v, k in zip(least[above], known)],
        "parent_key": [key[int(s)] if edge[s] and d else None for s, d in zip(above, depth[full])],
        "key": [key.get(int(s)) if keyed else None for s in full], "n_convs": n[full], "n_children": children[full], "n_leaves": leaves[full], "saved_tokens": saved[full],
        "ends": [ends[i] if i >= 0 else None for i in end[full]]}
    shared, seen = [], np.zeros(slots, dtype=bool)
    for side, row in enumerate(outer):
        at = states[begins[row]:begins[row] + length[row] + 1]
        own = ~seen[at]  # the first path has told what both begin with
        seen[at] = True
        pick = lambda v, none=0: np.where(own, v[at], none).tolist()
        shared.append({"shard": shard, "side": side, "ids": ids[starts[row]:starts[row + 1]].tolist(), "sizes": sizes[starts[row]:starts[row + 1]].tolist(),
                       "n": pick(n), "least": pick(least, MOST), "children": pick(children), "leaves": pick(leaves), "saved": pick(saved),
                       "ends": [ends[i] if i >= 0 and o else None for i, o in zip(end[at], own)], "keys": [key[int(s)] for s in at]})
    return nodes, shared


def _arrow_schema(nodes: bool):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in kinds.items()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in (NODES if nodes else PATHS).split(", "))])


def _told(nodes, shared):
    """Both kinds of rows as one table: a list of nodes or of paths in each row."""
    import pyarrow as pa

    made = pa.table(nodes, schema=_arrow_schema(True)), pa.Table.from_pylist(shared, schema=_arrow_schema(False))
    return pa.concat_tables([pa.table({"node": made[0].to_struct_array(), "path": pa.nulls(len(made[0]), pa.struct(list(made[1].schema)))}),
                             pa.table({"node": pa.nulls(len(made[1]), pa.struct(list(made[0].schema))), "path": made[1].to_struct_array()})])


def _lists(column):
    """Values and starts of a list column without nulls in its lists."""
    import numpy as np

    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py()


def _split(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    told = keep(told, "shards")
    return told.where("node is not null").select("node.*"), told.where("path is not null").select("path.*")


OUT = f"node struct<{NODES.replace(' ', ':').replace(',:', ',')}>, path struct<{PATHS.replace(' ', ':').replace(',:', ',')}>"


def prefix_nodes(sequences: DataFrame, turns: int = TURNS, fan: int = FAN) -> DataFrame:
    """One row per node of the trie of ``sequences`` (ids, sizes: array<long> of equal
    length; n, least: long; ends: string), which are distinct and a kept table: conv_id
    (smallest least), depth, parent_conv_id, n_convs (sum of n), n_children, n_leaves,
    saved_tokens (n_convs - 1 times the size of the last turn, over the subtree), ends (of
    the sequence that ends there, else null). No sequences give no nodes."""
    placed = ranked(sequences.withColumn("turns", F.size("ids").cast("long") + 1), ["ids"], "before", weight="turns")
    placed = keep(placed.withColumn("shard", F.floor(F.col("before") / turns)), "placed")
    top = placed.agg(F.max("shard")).first()[0] or 0
    last = top == 0

    def first(rows):
        import numpy as np
        import pyarrow.compute as pc

        rows = rows.take(pc.sort_indices(rows.column("before")))
        ids, starts = _lists(rows.column("ids"))
        sizes, _ = _lists(rows.column("sizes"))
        times = np.diff(starts) + 1
        column = lambda name: np.repeat(rows.column(name).to_numpy().astype(np.int64), times)
        none = np.zeros(int(times.sum()), dtype=np.int64)
        ends = [None] * len(none)
        for at, value in zip((np.cumsum(times) - 1).tolist(), rows.column("ends").to_pylist()):
            ends[at] = value
        return _told(*_fold(rows.column("shard")[0].as_py(), ids, sizes, starts, (column("n"), column("least"), none, none, none), ends, last, False))

    nodes, paths = _split(placed.select("shard", "before", "ids", "sizes", "n", "least", "ends").groupBy("shard").applyInArrow(first, OUT))
    levels, shared, level = [nodes.withColumn("level", F.lit(0))], [paths.withColumn("level", F.lit(0))], 0
    while top:
        top, level = top // fan, level + 1
        last = top == 0

        def merge(rows):
            import pyarrow.compute as pc

            rows = rows.take(pc.sort_indices(rows, sort_keys=[("shard", "ascending"), ("side", "ascending")]))
            ids, starts = _lists(rows.column("ids"))
            values = [_lists(rows.column(c))[0] for c in ("sizes", "n", "least", "children", "leaves", "saved")]
            return _told(*_fold(rows.column("group")[0].as_py(), ids, values[0], starts, values[1:], [e for row in rows.column("ends").to_pylist() for e in row], last, True))

        nodes, paths = _split(paths.withColumn("group", F.floor(F.col("shard") / fan)).groupBy("group").applyInArrow(merge, OUT))
        levels.append(nodes.withColumn("level", F.lit(level)))
        shared.append(paths.withColumn("level", F.lit(level)))
    every, upper = levels[0], shared[0]
    for more, paths in zip(levels[1:], shared[1:]):
        every, upper = every.unionByName(more), upper.unionByName(paths)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    # What a shard shared was completed once, by its key; the names return to the shard, so that no key is hot.
    found = every.where("key is not null").select("key", F.col("conv_id").alias("found"))
    named = keep(upper.select("level", "shard", F.explode("keys").alias("key")).distinct().join(found, "key").withColumnRenamed("key", "parent_key"), "names")
    waiting = every.where("parent_key is not null").join(named, ["level", "shard", "parent_key"]).withColumn("parent_conv_id", F.col("found"))
    return every.where("parent_key is null").select(*columns).unionByName(waiting.select(*columns))


# --- conversations ----------------------------------------------------------

def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): the dense turn ids of every conversation in the order of its
    turns (null first; equal turns by the digest of role and text) and the UTF-8 bytes of
    their texts. Null role and text are empty. Rows without conv_id belong to no
    conversation. A conversation is one row. Other columns are ignored."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    said = keep(conversations.where("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size")), "turns")
    known = ranked(keep(said.select("digest").distinct(), "distinct"), ["digest"], "id")
    rows = said.join(keep(known, "ids"), "digest")  # both read from written tables: AQE can split a turn that many share
    turns = F.sort_array(F.collect_list(F.struct("turn", "id", "size")))
    return rows.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def id_lists(members: DataFrame) -> DataFrame:
    """(seq, digest): SHA-256 of the decimal conv_ids of each ``seq``, ascending, comma-joined.

    members(conv_id, seq) is a kept table. Sorted ranges join their ids to lines of up to
    ``LIST_IDS`` first, so that a hot seq reaches its task as few rows, which are hashed
    as a stream."""

    def lines(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()
            cuts = np.unique([0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], *range(0, len(keys), LIST_IDS), len(keys)]).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[a] for a in cuts[:-1]], pa.binary()), pa.array([ids[a] for a in cuts[:-1]], pa.int64()),
                 pa.array([",".join(map(str, ids[a:b])) for a, b in zip(cuts, cuts[1:])])], names=["seq", "first", "line"])

    def digest(batches):
        import hashlib

        import pyarrow as pa

        seq = state = None
        for batch in batches:
            done = []
            for key, line in zip(batch.column("seq").to_pylist(), batch.column("line").to_pylist()):
                if key == seq:
                    state.update(b",")
                else:
                    if seq is not None:
                        done.append((seq, state.hexdigest()))
                    seq, state = key, hashlib.sha256()
                state.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["seq", "digest"])
        if seq is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.binary()), pa.array([state.hexdigest()])], names=["seq", "digest"])

    joined = members.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(lines, "seq binary, first long, line string")
    return joined.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(digest, "seq binary, digest string")


def conversation_nodes(sequences: DataFrame, turns: int = TURNS, fan: int = FAN) -> DataFrame:
    """The nodes of ``sequences`` (conv_id: unique long, ids, sizes): as ``prefix_nodes``,
    with ends_sha256 of the conversations that end in the node."""
    seq = F.substring(F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)), 1, 16)
    rows = keep(sequences.withColumn("seq", seq), "sequences")
    least = keep(rows.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("least")), "collapsed")
    copies = keep(rows.select("conv_id", "seq").join(least.where("n > 1").select("seq"), "seq"), "copies")
    told = least.join(keep(id_lists(copies), "lists"), "seq", "left").withColumn("ends", F.coalesce("digest", F.sha2(F.col("least").cast("string"), 256)))
    distinct = keep(rows.select(F.col("conv_id").alias("least"), "ids", "sizes").join(told.select("least", "n", "ends"), "least"), "distinct")
    return prefix_nodes(distinct, turns, fan).withColumn("ends_sha256", F.coalesce("ends", F.sha2(F.lit(""), 256))).drop("ends")


def grouped_heads(sequences: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """Every conversation c begins with the first h turns of conversation c - c % group
    (none if absent), h = crc32(decimal c) % heads, and goes on with its own after h."""
    own = keep(sequences, "own")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = own.select(F.col("conv_id").alias("first"), F.col("ids").alias("first_ids"), F.col("sizes").alias("first_sizes"))

    def mixed(name: str) -> Column:
        head = F.coalesce(F.slice(f"first_{name}", F.lit(1), F.col("h")), F.array().cast("array<long>"))
        return F.concat(head, F.slice(name, F.col("h") + 1, F.greatest(F.size(name) - F.col("h"), F.lit(0)))).alias(name)

    whole = own.withColumn("h", h).withColumn("first", F.col("conv_id") - F.pmod("conv_id", F.lit(group)))
    return whole.join(first, "first", "left").select("conv_id", mixed("ids"), mixed("sizes"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    nodes = conversation_nodes(grouped_heads(turn_sequences(table(spark, folder, "conversations"))))
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL = f"""
WITH said AS (SELECT conv_id, turn, struct_pack(role := coalesce(role, ''), body := coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST, t) AS ts, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {HEADS} AS h FROM said GROUP BY conv_id),
rebuilt AS (SELECT o.conv_id, list_concat(coalesce(f.ts[1:o.h], []), o.ts[o.h + 1:]) AS ts
  FROM own o LEFT JOIN own f ON f.conv_id = o.conv_id - ((o.conv_id % {GROUP}) + {GROUP}) % {GROUP}),
prefixes AS (SELECT conv_id, len(ts) AS n, d, ts[1:d] AS p FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends
  FROM prefixes GROUP BY d, p),
kids AS (SELECT a.d, a.p, a.conv_id, a.n_convs, a.ends, u.conv_id AS parent, (SELECT count(*) FROM nodes k WHERE k.d = a.d + 1 AND k.p[1:a.d] = a.p) AS n_children,
  CASE WHEN a.d = 0 THEN 0 ELSE (a.n_convs - 1) * octet_length(encode(a.p[a.d].body)) END AS own FROM nodes a LEFT JOIN nodes u ON u.d = a.d - 1 AND u.p = a.p[1:a.d - 1]),
below AS (SELECT p[1:e] AS p, e AS d, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM kids) GROUP BY 1, 2)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, k.parent AS parent_conv_id, k.n_convs, k.n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, k.ends AS ends_sha256
FROM kids k JOIN below b ON b.d = k.d AND b.p = k.p"""
