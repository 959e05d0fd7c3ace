"""Mixing sources to target weights by entropy balancing.

Every document offers two copies. Among all rates between 0 and 2 that meet each
source's token target, the ones with the largest entropy are exponentially tilted:
a copy is taken with probability e^(l x) / (1 + e^(l x)), where x is the document's
size (in units of its source's mean) and l the source's multiplier. The dual is
convex; Newton iterations solve it for all sources at once on the table of distinct
(source, size) pairs. Rates become whole copies by systematic rounding along the
documents in order of size, whose error is at most about one document for each
source; a bounded number of documents of each source then takes up what is left.
All sums that decide something are whole numbers, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docketry.functions.scale import lookup
from docketry.llm.common import keep, ranked, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
ROUNDS = 40
UNIT = 1 << 20  # a rate of 1 as a whole number
TAIL = 256  # documents of each source that settle what rounding left over


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Add ``target`` to (rank, source_size, ...): ``share`` of all sizes by weight,
    no source above ``cap`` times its size, the excess shared again by weight."""
    weighted = keep(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))).cast("int") + 1)), "weights")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, F.col("source_size") * cap
    while True:  # each round fixes the sources that the level before filled; it only rises
        capped = full <= F.col("weight") * F.lit(level)
        state = weighted.agg(F.sum(F.when(capped, full).otherwise(0)).alias("held"), F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("open")).first()
        if not state.open:
            break
        new = max(0.0, share * total - state.held) / state.open
        if new <= level:
            break
        level = new
    return weighted.withColumn("target", F.least(full.cast("double"), F.col("weight") * F.lit(level)))


def multipliers(classes: DataFrame, sources: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(rank, scale, l) for sources below their cap, by Newton iterations on the dual.

    ``classes``: rank, size, n (documents of that size). Every round adds up each
    source's gradient and curvature over its classes; sums are decimals, so their
    order does not matter. A step that overshoots is halved by its source's bounds.
    """
    open_ = sources.where("source_size > 0 AND target < 2 * source_size AND target > 0")
    state = keep(open_.select("rank", "target", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0)).alias("scale"),
                              F.lit(0.0).alias("l"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done")), "duals")
    x = F.col("size") / F.col("scale")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(F.col("l") * x, F.lit(700.0)), F.lit(-700.0))))
    whole = lambda v: F.sum((F.col("n") * F.round(v, 9)).cast("decimal(38,9)")).cast("double")
    for _ in range(rounds):
        sums = classes.join(lookup(state), "rank").groupBy("rank").agg(whole(CAP * p * x).alias("taken"), whole(CAP * p * (1 - p) * x * x).alias("curve"))
        gap = F.col("target") / F.col("scale") - F.col("taken")
        low, high = F.when(gap > 0, F.col("l")).otherwise(F.col("low")), F.when(gap < 0, F.col("l")).otherwise(F.col("high"))
        step = F.col("l") + F.when(F.col("curve") > 0, gap / F.col("curve")).otherwise(F.signum(gap))
        middle = F.when((low > -1e6) & (high < 1e6), (low + high) / 2).otherwise(F.col("l") + F.signum(gap) * 8)
        state = keep(state.join(sums, "rank").select(
            "rank", "target", "scale", low.alias("low"), high.alias("high"), (F.abs(gap) * F.col("scale") <= 1e-7 * F.col("target")).alias("done"),
            F.when((step > low) & (step < high) & (F.abs(step - F.col("l")) < 50), step).otherwise(middle).alias("new"), F.col("l").alias("old"))
            .select("rank", "target", "scale", F.when(F.col("done"), F.col("old")).otherwise(F.col("new")).alias("l"), "low", "high", "done"), "duals")
        if not state.where("NOT done").limit(1).count():
            break
    return state.select("rank", "scale", "l")


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights=WEIGHTS, share: float = SHARE, tail: int = TAIL,
        row_col: str | None = None) -> DataFrame:
    """One row per document: row, doc_id, source, size, source_size, target, rate, copies, taken.

    Sources are ranked by code point, null (a source of its own) last, and weigh
    ``weights`` in turn. A null text has size 0; documents of size 0 are kept at one
    copy if their source takes any. Repeated rows are separate documents. An empty
    table gives no rows. Other columns are ignored. ``row_col`` names a column that
    numbers the rows, if there is one.
    """
    lean = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *([] if row_col is None else [F.col(row_col).alias("row")]))
    lean = keep(lean.withColumn("row", F.monotonically_increasing_id()) if row_col is None else lean, "sizes")
    grouped = keep(lean.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), "sources")
    sources = keep(targets(ranked(grouped, [F.col("source").asc_nulls_last()]), weights, share), "targets")
    named = sources.select(F.col("source").alias("_source"), "rank", "source_size", "target")
    tagged = keep(lean.join(lookup(named), F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "tagged")
    classes = keep(tagged.groupBy("rank", "size").agg(F.count("*").alias("n")), "classes")
    solved = multipliers(classes, sources)
    # Rates as whole numbers of 1/UNIT; a source at its cap takes everything twice.
    lift = F.greatest(F.least(F.col("l") * F.col("size") / F.col("scale"), F.lit(700.0)), F.lit(-700.0))
    rate = (F.when(F.col("target") >= CAP * F.col("source_size"), F.lit(float(CAP)))
            .when(F.col("target") <= 0, F.lit(0.0)).otherwise(CAP / (1 + F.exp(-lift))))
    rated = tagged.join(lookup(solved), "rank", "left").withColumn("rate", F.round(rate * UNIT).cast("long")).drop("scale", "l")
    # Ties are broken by what a document is, so reruns over other partitions agree;
    # ``row`` only tells repeated rows apart, which are alike.
    mixer = F.xxhash64("doc_id", "size")
    last = Window.partitionBy("rank").orderBy("_h", "row")
    rated = keep(rated.withColumn("_h", mixer), "rates")
    # The tail: the `tail` documents of each source that come first by hash.
    chosen = rated.select("rank", "_h", "row").withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= tail)
    bound = chosen.groupBy("rank").agg(F.max("_h").alias("_last"), F.max_by("row", F.struct("_h", "row")).alias("_row"))
    parted = keep(rated.join(lookup(bound), "rank").withColumn("in_tail", (F.col("_h") < F.col("_last")) | ((F.col("_h") == F.col("_last")) & (F.col("row") <= F.col("_row")))).drop("_last", "_row"), "parted")
    order = ["rank", "size", "_h", "row"]
    summed = ranked(parted.where("NOT in_tail"), order, "before", "rate")
    copies = (F.floor((F.col("before") + F.col("rate") + UNIT // 2) / F.lit(float(UNIT))) - F.floor((F.col("before") + UNIT // 2) / F.lit(float(UNIT)))).cast("int")
    main = keep(summed.withColumn("copies", copies).drop("before"), "rounded")
    left = (parted.groupBy("rank").agg(F.first("target").alias("target"))
            .join(main.groupBy("rank").agg(F.sum(F.col("copies") * F.col("size")).alias("got")), "rank", "left")
            .select("rank", (F.col("target") - F.coalesce("got", F.lit(0))).alias("want")))

    def settle(frame):
        """At most ``tail`` documents of one source: largest first, each as near its rate as the rest allows."""
        frame = frame.sort_values(["size", "_h", "row"], ascending=[False, True, True])
        want = float(frame["want"].iloc[0])
        plan = frame["size"].to_numpy() * frame["rate"].to_numpy() / UNIT
        carry, rest, taken = want - plan.sum(), plan.sum(), []
        for size, due in zip(frame["size"].tolist(), plan.tolist()):
            # What is left over is shared in proportion to what is still to come.
            goal = due + carry * (due / rest if rest > 0 else 1)
            n = 1 if size == 0 else min(CAP, max(0, int(goal / size + 0.5)))
            if frame["target"].iloc[0] <= 0:
                n = 0
            taken.append(n)
            carry, rest = carry + due - n * size, rest - due
        return frame.assign(copies=taken).drop(columns=["want"])

    names, columns = main.columns, [f"{f.name} {f.dataType.simpleString()}" for f in main.schema.fields]
    ends = parted.where("in_tail").join(left, "rank").groupBy("rank").applyInPandas(lambda frame: settle(frame)[names], ", ".join(columns))
    return main.unionByName(ends).select("row", "doc_id", "source", "size", "source_size", "target", (F.col("rate") / UNIT).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op10_entropy_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
