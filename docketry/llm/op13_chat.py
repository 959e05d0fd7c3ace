"""Chat formatting of reply trees, with DataFrame functions only.

Messages name their parent. Iterative self-joins by doubling enumerate the paths from
each leaf to its root: round k joins every (leaf, message) found so far with the messages
2^k steps above, so a thread of a million messages takes 20 rounds, and only ids travel.
Branches of a tree are ranked by the sum of their messages' scores. Each chosen branch
becomes one conversation: a list of segments, each marked as under the loss or not, whose
texts put together are the formatted text

    <|im_start|>role\\ntext<|im_end|>\\n ...

Control strings inside texts are escaped reversibly: every ``<`` that is followed by k
backslashes and ``|`` gets one backslash more, so that ``<|`` occurs in marks only. In
roles a line end is written ``<n>``, and ``<``, k backslashes, ``n>`` get one more too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from docketry.llm.common import keep, table

START, STOP = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
PROBE = f"{STOP}{START}{ASSISTANT} ok"
ESCAPE = r"<(\\*)\|", r"<\\$1|"
UNESCAPE = r"<\\(\\*)\|", "<$1|"
ROLE_ESCAPE = r"<(\\*)(\||n>)", r"<\\$1$2"
ROLE_UNESCAPE = r"<\\(\\*)(\||n>)", "<$1$2"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def escaped_role(role: Column) -> Column:
    return F.replace(F.regexp_replace(role, *ROLE_ESCAPE), F.lit("\n"), F.lit("<n>"))


def unescaped_role(role: Column) -> Column:
    return F.regexp_replace(F.replace(role, F.lit("<n>"), F.lit("\n")), *ROLE_UNESCAPE)


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, id, up): every message of every path, ``up`` steps above its leaf.

    messages(tree, id, parent): ids are unique in their tree and not null. A message
    without a parent in its tree is a root. Messages that hang on a circle of parents
    reach no root and are on no path. ``messages`` is a kept table.
    """
    ids = messages.select("tree", "id")
    tied = keep(messages.where("parent is not null").select("tree", "id", F.col("parent").alias("above"))
                .join(ids.withColumnRenamed("id", "above"), ["tree", "above"], "left_semi").select("tree", "id", "above"), "tied")
    leaves = ids.join(tied.select("tree", F.col("above").alias("id")).distinct(), ["tree", "id"], "left_anti")
    found = keep(leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up")), "paths")
    jumps, step, rounds = tied, 1, tied.count().bit_length() + 1
    for _ in range(rounds):
        more = keep(found.join(jumps, ["tree", "id"]).select("tree", "leaf", F.col("above").alias("id"), (F.col("up") + step).alias("up")), "paths")
        if not more.limit(1).count():
            return found
        found = found.unionByName(more)
        onward = jumps.select("tree", F.col("id").alias("above"), F.col("above").alias("far"))
        jumps, step = keep(jumps.join(onward, ["tree", "above"]).select("tree", "id", F.col("far").alias("above")), "jumps"), step * 2
        found = keep(found, "paths")
    ends = found.join(tied, ["tree", "id"], "left_anti").select("tree", "leaf").distinct()  # a circle never ends
    return found.join(ends, ["tree", "leaf"], "left_semi")


def branches(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, rank, score, id, up) of every path, or of the ``best`` of each tree.

    score: the sum of the scores of the path's messages (null: 0); ties go to the smaller leaf.
    """
    walked = paths(messages)
    scores = messages.select("tree", "id", F.coalesce("score", F.lit(0.0)).alias("score"))
    told = walked.join(scores, ["tree", "id"]).groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    ranked = told.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    return walked.join(ranked if best is None else ranked.where(F.col("rank") <= best), ["tree", "leaf"])


def format_trees(messages: DataFrame, best: int | None = None, assistant: str = ASSISTANT) -> DataFrame:
    """One conversation per chosen branch: (tree, leaf, rank, score, segments).

    messages(tree, id, parent, role, text, score): tree: a number or string (null: a tree of
    its own), id: orderable; other columns are ignored. Null role and text are empty, a
    message without an id is no message. Of repeated (tree, id) the row with the smallest
    (parent, role, text, score) stays. segments: array<struct<text, loss>> in order, loss
    true for exactly the texts of ``assistant``; a conversation is one row, so it is
    bounded by what one row can hold. No messages give no rows.
    """
    kind = messages.schema["tree"].dataType
    rows = messages.where("id is not null").groupBy("tree", "id").agg(F.min(F.struct(
        "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")).alias("m")).select("tree", "id", "m.*")
    # Trees are joined by a struct, so that the null tree equals itself.
    rows = keep(rows.withColumn("tree", F.struct(F.col("tree").isNull().alias("none"), F.coalesce("tree", F.lit(0).cast(kind)).alias("tree"))), "messages")
    chosen = keep(branches(rows.select("tree", "id", "parent", "score"), best), "branches")
    said = rows.select("tree", "id", F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n")).alias("head"),
                       escaped(F.col("text")).alias("body"), (F.col("role") == assistant).alias("loss"))
    turns = F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "head", "body", "loss")))
    grouped = chosen.join(said, ["tree", "id"]).groupBy("tree", "leaf", "rank", "score").agg(turns.alias("turns"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        part(t["head"], F.lit(False)), part(t["body"], t["loss"]), part(F.lit(STOP + "\n"), F.lit(False)))))
    return grouped.select(F.when(~F.col("tree.none"), F.col("tree.tree")).alias("tree"), "leaf", "rank", "score", segments.alias("segments"))


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_texts(segments: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"]))


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    parts = F.filter(F.split(text, r"<\|im_start\|>"), lambda _, n: n > 0)  # nothing stands before the first mark

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(role) + 2, F.length(part) - F.length(role) - 2 - len(STOP))
        return F.struct(unescaped_role(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(parts, turn)


def chains(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of conversations whose turns follow each other: each is the parent of the
    next one, by turn (null first), equal turns by role and text (null first). Repeated
    rows stay repeated turns."""
    at = F.row_number().over(W.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()))
    numbered = conversations.select(F.col(conv).alias("tree"), at.cast("long").alias("id"), "role", "text")
    return numbered.withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1)).withColumn("score", F.lit(0.0))


def op13_reply_trees(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, ASSISTANT, PROBE)], said.schema)
    made = keep(format_trees(chains(said.unionByName(probe)), best=1), "formatted")
    read = made.select("tree", "segments", formatted_text(F.col("segments")).alias("line")).select(
        F.col("tree").alias("conv_id"), read_turns(F.col("line")).alias("turns"), F.array_join(loss_texts(F.col("segments")), "").alias("loss"),
        F.length("line").cast("long").alias("formatted_chars"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


SQL = rf"""
WITH said AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '{PROBE}'),
numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM said),
shaped AS (SELECT *, replace(regexp_replace(role, '<(\\*)(\||n>)', '<\\\1\2', 'g'), chr(10), '<n>') AS r, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS t FROM numbered),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS turns,
  coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss,
  string_agg('{START}' || r || chr(10) || t || '{STOP}' || chr(10), '' ORDER BY pos) AS line FROM shaped GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, length(line) AS formatted_chars FROM whole"""
