"""Hybrid retrieval: BM25, exhaustive dot product, reciprocal rank fusion.

Two shapes of work are supported:

* *ranking jobs* - a bounded set of queries against any number of chunks. Queries
  are collected behind a size check and shipped to the tasks; each Arrow batch of
  chunks is scored with one matrix product and reduced to the k best per query
  before anything is shuffled. Queries beyond the bound are cut into blocks and
  both sides are replicated block-wise (fragment-and-replicate), still exact.
* *scored pairs* - ``bm25`` and ``dense_scores`` return (query, chunk) rows for a
  pinned corpus; ``fuse`` and ``retrieval_context`` work on those.

Scores are compared after rounding to 9 decimals, so equal texts tie exactly and
the id decides, independent of batch and summation order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docketry.functions.scale import settle, spread_join
from docketry.functions.text import let, strip, tokenize_tr
from docketry.sources import fixed

# Values (queries x width) that may be shipped to every task.
SHIPPED_CELLS = 20_000_000
# Impacts (words x chunks) that are laid out as a table.
TABLE_CELLS = 4_000_000
# Pairs and rows (their words are Python objects) that a task scores at a time, whatever the size of its Arrow batches.
SCORED_CELLS, SCORED_ROWS = 1_000_000, 256
RANK_DIGITS = 9


# --- lexical ----------------------------------------------------------------

def term_counts(tokens: Column) -> Column:
    """array<struct<term, tf>> of a token array by run lengths of the sorted
    tokens: counted inside the row, without a shuffle."""
    def counted(ordered: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(ordered)), lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)))
        return let(starts, lambda at: F.transform(at, lambda i, n: F.struct(
            F.get(ordered, i - 1).alias("term"), (F.coalesce(F.get(at, n + 1), F.size(ordered) + 1) - i).cast("double").alias("tf"))))

    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), counted)).otherwise(F.array().cast("array<struct<term:string,tf:double>>"))


def query_terms(queries: DataFrame, stopwords, charset: str) -> DataFrame:
    """(query_id, term, qtf); a repeated query word counts every time."""
    counted = queries.select("query_id", F.explode(term_counts(tokenize_tr(F.col("text"), stopwords, charset))).alias("t"))
    return counted.select("query_id", "t.term", F.col("t.tf").alias("qtf"))


def bm25(queries: DataFrame, chunks: DataFrame, stopwords=fixed.STOPWORDS, charset: str = "a-zçğıöşü0-9",
         k1: float = fixed.BM25_K1, b: float = fixed.BM25_B) -> DataFrame:
    """(query_id, chunk_id, lexical_score) for every pair sharing a term.

    Scores are divided by the query's best; pairs that are absent score zero.
    queries(query_id, text), chunks(chunk_id, text). The posting side is cut to
    the queries' vocabulary before the join on the term.
    """
    wanted = query_terms(queries, stopwords, charset)
    tokens = chunks.select("chunk_id", tokenize_tr(F.col("text"), stopwords, charset).alias("tokens")).withColumn("len", F.size("tokens"))
    stats = tokens.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    postings = tokens.select("chunk_id", "len", F.explode(term_counts(F.col("tokens"))).alias("t")).select("chunk_id", "len", "t.term", "t.tf")
    # Sizes are left to AQE: it broadcasts whichever side turns out small, and
    # counting here would run the tokeniser once more per question.
    postings = postings.join(wanted.select("term").distinct(), "term", "left_semi")
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    n, average = stats.select("n").scalar(), stats.select("avg_len").scalar()
    weighted = wanted.join(frequency, "term").withColumn("w", F.col("qtf") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    pairs = postings.join(weighted.select("query_id", "term", "w"), "term")
    gain = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / average))
    raw = pairs.groupBy("query_id", "chunk_id").agg(F.sum(gain).alias("raw"))
    # One query's window is at most the pinned corpus.
    top = F.max("raw").over(W.partitionBy("query_id"))
    return raw.select("query_id", "chunk_id", (F.col("raw") / top).alias("lexical_score"))


def bm25_top_k(queries: DataFrame, chunks: DataFrame, k: int = fixed.TOP_K, stopwords=fixed.STOPWORDS, charset: str = "a-zçğıöşü0-9",
               k1: float = fixed.BM25_K1, b: float = fixed.BM25_B) -> DataFrame:
    """Best k chunks per query: (query_id, chunk_id, lexical_score, rank).

    Only per-batch winners leave a task, so the shuffle carries k rows per query
    and batch instead of every matching pair. Vocabularies beyond the shipping
    bound use the term join of ``bm25``.
    """
    wanted = query_terms(queries, stopwords, charset)
    size = wanted.agg(F.countDistinct("query_id").alias("q"), F.countDistinct("term").alias("v")).first()
    if size.q * size.v > SHIPPED_CELLS:
        return top_k(bm25(queries, chunks, stopwords, charset, k1, b), "lexical_score", k)
    tokens = chunks.select("chunk_id", tokenize_tr(F.col("text"), stopwords, charset).alias("tokens")).withColumn("len", F.size("tokens"))
    # Document frequency of the query vocabulary and the corpus shape in one pass:
    # the empty term stands for "every chunk". One row per term leaves a task.
    listed = wanted.toPandas()
    every = F.array(F.lit(""))
    vocabulary = F.broadcast(wanted.select("term").distinct().union(wanted.sparkSession.range(1).select(F.lit("").alias("term"))))
    frequency = (tokens.select("len", F.explode(F.concat(F.array_distinct("tokens"), every)).alias("term")).join(vocabulary, "term", "left_semi")
                 .groupBy("term").agg(F.count("*").alias("df"), F.sum("len").alias("length")).toPandas().set_index("term"))
    n = int(frequency["df"].get("", 0))
    average = float(frequency["length"].get("", 0)) / max(n, 1) or 1.0
    weights = listed.merge(frequency.drop(index="", errors="ignore"), left_on="term", right_index=True)
    weights["w"] = weights["qtf"] * np.log(1 + (n - weights["df"] + 0.5) / (weights["df"] + 0.5))
    if weights.empty:
        return queries.select("query_id", F.lit(None).cast(chunks.schema["chunk_id"].dataType).alias("chunk_id"), F.lit(0.0).alias("lexical_score"), F.lit(0).alias("rank")).limit(0)
    query_ids, terms = pd.Index(sorted(weights["query_id"].unique())), pd.Index(sorted(weights["term"].unique()))
    matrix = np.zeros((len(terms), len(query_ids)))
    matrix[terms.get_indexer(weights["term"]), query_ids.get_indexer(weights["query_id"])] = weights["w"]

    rows = _slice_rows(len(query_ids))
    kinds = [df.select(c).limit(0).toArrow().schema.field(c).type for df, c in ((queries, "query_id"), (chunks, "chunk_id"))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None  # 2 k per query of all slices so far
        for part in _slices(batches, rows):
            scores = np.zeros((len(part), len(query_ids)))
            for row, known in enumerate(_term_codes(terms, part["tokens"])):
                found, counts = np.unique(known, return_counts=True)
                damp = k1 * (1 - b + b * part["len"].iat[row] / average)
                scores[row] = (counts * (k1 + 1) / (counts + damp)) @ matrix[found]
            best = _running_top(best, scores, part["chunk_id"].to_numpy(), 2 * k)
        if best is not None:
            places, ids, values = best
            told = [pa.array(query_ids.to_numpy()[places].tolist(), kinds[0]), pa.array(ids.tolist(), kinds[1]), pa.array(values, pa.float64())]
            yield pa.RecordBatch.from_arrays(told, ["query_id", "chunk_id", "score"])

    # Every chunk is scored once: 2 k per query by raw score, then shares of the best.
    partial = top_k(tokens.mapInArrow(score, _pair_schema(queries, chunks)), "score", 2 * k)
    share = F.col("score") / F.max("score").over(W.partitionBy("query_id"))
    return top_k(partial.select("query_id", "chunk_id", share.alias("lexical_score")), "lexical_score", k)


# --- dense ------------------------------------------------------------------

def _pair_schema(queries: DataFrame, chunks: DataFrame) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return f"query_id {kind(queries, 'query_id')}, chunk_id {kind(chunks, 'chunk_id')}, score double"


def _term_codes(terms: pd.Index, tokens: pd.Series) -> list[np.ndarray]:
    """Per row the vocabulary positions of its known tokens, looked up in one go."""
    ends = np.cumsum(tokens.map(len).to_numpy())
    flat = np.concatenate(tokens.to_list()) if len(ends) and ends[-1] else np.array([], dtype=object)
    return [part[part >= 0] for part in np.split(terms.get_indexer(flat), ends[:-1])]


def _slice_rows(others: int) -> int:
    return max(1, min(SCORED_ROWS, SCORED_CELLS // max(1, others)))


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pd.DataFrame]:
    """At most ``rows`` rows at a time: only these become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pandas()


def _running_top(best: tuple[np.ndarray, ...] | None, scores: np.ndarray, chunk_ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query places, chunk ids, scores): the k best positive scores of every query among ``best`` and the new
    ``scores`` (chunks x queries); ties go to the smaller id. Scores below a query's k-th best are left out unsorted."""
    rounded = np.round(scores, RANK_DIGITS)
    least = np.zeros(scores.shape[1])
    if best is not None:
        places, _, values = best
        full = np.flatnonzero(np.bincount(places, minlength=len(least)) == k)
        least[full] = np.round(values[np.searchsorted(places, full, "right") - 1], RANK_DIGITS)
    rows, columns = np.nonzero((rounded > 0) & (rounded >= least))
    told = [columns, chunk_ids[rows], scores[rows, columns]]
    if best is not None:
        told = [np.concatenate(pair) for pair in zip(best, told)]
    order = np.lexsort((pd.factorize(told[1], sort=True)[0], -np.round(told[2], RANK_DIGITS), told[0]))
    places = told[0][order]
    order = order[np.arange(len(places)) - np.searchsorted(places, places, "left") < k]
    return tuple(part[order] for part in told)


def _batch_top(scores: np.ndarray, chunk_ids: np.ndarray, query_ids, k: int, positive: bool = False) -> pd.DataFrame:
    """k best rows of every column; ties go to the smaller id."""
    frames = []
    rounded = np.round(scores, RANK_DIGITS)
    order = np.argsort(chunk_ids, kind="stable")
    for q, query_id in enumerate(query_ids):
        column = rounded[order, q]
        top = order[np.argsort(-column, kind="stable")[:k]]  # k None keeps every row
        if positive:
            top = top[rounded[top, q] > 0]
        frames.append(pd.DataFrame({"query_id": query_id, "chunk_id": chunk_ids[top], "score": scores[top, q]}))
    return pd.concat(frames, ignore_index=True)


def top_k(pairs: DataFrame, score: str, k: int) -> DataFrame:
    """Rank within the query; Spark keeps k rows per query and map task before the exchange."""
    order = W.partitionBy("query_id").orderBy(F.round(score, RANK_DIGITS).desc(), "chunk_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_scores(queries: DataFrame, chunks: DataFrame, pinned_rows: int = 10_000) -> DataFrame:
    """Every pair's dot product: (query_id, chunk_id, dense_score).

    A pinned corpus is measured and rides along as one bounded array, so the
    cases stream through a single projection. A larger one is paired block-wise.
    """
    if chunks.limit(pinned_rows + 1).count() > pinned_rows:
        stats = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
        pairs = _blocked_dense(queries, chunks, None, stats.n, stats.width, SHIPPED_CELLS, _pair_schema(queries, chunks))
        return pairs.withColumnRenamed("score", "dense_score")
    corpus = chunks.agg(F.array_sort(F.collect_list(F.struct("chunk_id", F.col("embedding").cast("array<double>").alias("v"))))).scalar()
    dot = lambda v: F.aggregate(F.zip_with(F.col("_q"), v, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return (queries.withColumn("_q", F.col("embedding").cast("array<double>")).withColumn("_c", F.explode(corpus))
            .select("query_id", F.col("_c.chunk_id").alias("chunk_id"), dot(F.col("_c.v")).alias("dense_score")))


def dense_top_k(queries: DataFrame, chunks: DataFrame, k: int = fixed.TOP_K, shipped_cells: int = SHIPPED_CELLS) -> DataFrame:
    """Exact k nearest chunks per query by dot product of unit vectors."""
    schema = _pair_schema(queries, chunks)
    stats = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    if stats.n * (stats.width or 1) <= shipped_cells:
        shipped = queries.select("query_id", F.col("embedding").cast("array<double>").alias("v")).toPandas().sort_values("query_id")
        query_ids = shipped["query_id"].to_numpy()
        matrix = np.vstack(shipped["v"].to_list()).T if len(shipped) else np.zeros((stats.width or 1, 0))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                vectors = np.vstack(batch["embedding"].to_list()).astype(float)
                yield _batch_top(vectors @ matrix, batch["chunk_id"].to_numpy(), query_ids, k)

        pairs = chunks.select("chunk_id", "embedding").mapInPandas(score, schema)
    else:
        pairs = _blocked_dense(queries, chunks, k, stats.n, stats.width, shipped_cells, schema)
    return top_k(pairs.withColumnRenamed("score", "dense_score"), "dense_score", k)


def _blocked_dense(queries: DataFrame, chunks: DataFrame, k: int | None, n: int, width: int, cells: int, schema: str) -> DataFrame:
    """Fragment-and-replicate: every (query block, chunk block) meets in one bounded group."""
    query_blocks = 2 * -(-n * width // cells)
    chunk_blocks = 2 * -(-chunks.count() * width // cells)
    all_chunks, all_queries = (F.sequence(F.lit(0), F.lit(m - 1)) for m in (chunk_blocks, query_blocks))
    left = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("qb"), F.explode(all_chunks).alias("cb"))
    right = chunks.select("chunk_id", "embedding", F.explode(all_queries).alias("qb"), F.pmod(F.xxhash64("chunk_id"), F.lit(chunk_blocks)).cast("int").alias("cb"))

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        scores = np.vstack(c["embedding"].to_list()).astype(float) @ np.vstack(q["embedding"].to_list()).astype(float).T
        return _batch_top(scores, c["chunk_id"].to_numpy(), q["query_id"].to_numpy(), k)

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(score, schema)


# --- fusion -----------------------------------------------------------------

def rrf(rankings: DataFrame, k: int = fixed.RRF_K) -> DataFrame:
    """rankings(query_id, chunk_id, rank) of any number of rankers -> rank_score."""
    return rankings.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rank_score"))


def fuse(dense: DataFrame, lexical: DataFrame, k: int = fixed.RRF_K) -> DataFrame:
    """Dense, lexical and fused score of every dense pair of a pinned corpus.

    The dense list holds the whole corpus per query, so a ranking window is
    bounded by the corpus size, not by the number of cases. The lexical list
    ranks matching chunks only. ``score`` keeps its dense meaning.
    """
    pairs = dense.join(lexical, ["query_id", "chunk_id"], "left").withColumn("lexical_score", F.coalesce("lexical_score", F.lit(0.0)))
    by = lambda score: W.partitionBy("query_id").orderBy(F.round(score, RANK_DIGITS).desc(), "chunk_id")
    ranked = pairs.withColumn("_d", F.row_number().over(by("dense_score"))).withColumn("_l", F.row_number().over(by("lexical_score")))
    # Zero scores sort behind every match, so the position is the matching rank.
    lexical_part = F.when(F.col("lexical_score") > 0, 1.0 / (k + F.col("_l"))).otherwise(0.0)
    return ranked.select(*pairs.columns, (1.0 / (k + F.col("_d")) + lexical_part).alias("rank_score"), F.col("dense_score").alias("score"))


def retrieval_context(fused: DataFrame, top: int = fixed.TOP_K, gate: float = fixed.MIN_SIMILARITY) -> DataFrame:
    """Top chunks that also carry evidence; the gate applies after the cut.

    One row per query: source_status and the kept chunks in rank order.
    """
    order = W.partitionBy("query_id").orderBy(F.round("rank_score", 12).desc(), "chunk_id")
    best = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    evident = (F.col("score") >= gate) | (F.col("lexical_score") >= gate)
    kept = F.array_sort(F.collect_list(F.when(evident, F.struct("rank", "chunk_id", "score", "lexical_score", "rank_score"))))
    grouped = best.groupBy("query_id").agg(kept.alias("chunks"))
    return grouped.withColumn("source_status", F.when(F.size("chunks") > 0, "relevant_source_found").otherwise("no_relevant_source"))


def chunk_impacts(corpus: DataFrame, stopwords, charset: str, k1: float, b: float) -> DataFrame:
    """corpus with ``postings``: array<struct<term, impact>> of every chunk, the BM25 share
    of one occurrence in a query. Frequencies meet the postings in a salted join, so that a
    word of every chunk is spread over many tasks."""
    tokens = corpus.select("chunk_id", "embedding", tokenize_tr(F.col("text"), stopwords, charset).alias("tokens")).withColumn("len", F.size("tokens"))
    n, average = (tokens.select(e).scalar() for e in (F.count("*"), F.avg("len")))
    postings = tokens.select("chunk_id", "len", F.explode(term_counts(F.col("tokens"))).alias("t")).select("chunk_id", "len", "t.term", "t.tf")
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.when(average > 0, average).otherwise(1.0)))
    told = spread_join(postings, frequency, ["term"], spread_by="chunk_id", how="inner").select("chunk_id", F.struct("term", impact.alias("impact")).alias("p"))
    listed = told.groupBy("chunk_id").agg(F.sort_array(F.collect_list("p")).alias("postings"))
    return corpus.select("chunk_id", "embedding").join(listed, "chunk_id", "left")


class _Index:
    """Vectors and postings of some chunks in id order."""

    def __init__(self, frame: pd.DataFrame, width: int):
        frame = frame.sort_values("chunk_id")
        self.ids = frame["chunk_id"].to_numpy()
        self.known = np.array([v is not None for v in frame["embedding"]], dtype=bool)
        self.dense = np.zeros((width, len(frame)))
        for n, v in enumerate(frame["embedding"]):
            if v is not None:
                self.dense[:, n] = v
        lists = [p if p is not None else [] for p in frame["postings"]]
        rows = np.repeat(np.arange(len(lists)), [len(p) for p in lists])
        terms = np.array([e["term"] for p in lists for e in p], dtype=object)
        self.terms = pd.Index(pd.unique(terms))
        code = self.terms.get_indexer(terms)
        order = np.argsort(code, kind="stable")
        self.rows, self.impacts = rows[order], np.array([e["impact"] for p in lists for e in p], dtype=float)[order]
        self.starts = np.searchsorted(code[order], np.arange(len(self.terms) + 1))
        self.table = None  # of few words and chunks: all impacts, a row of chunks for each word
        if len(self.terms) * len(self.ids) <= TABLE_CELLS:
            self.table = np.zeros((len(self.terms), len(self.ids)))
            self.table[code[order], self.rows] = self.impacts

    def dense_of(self, vectors) -> np.ndarray:
        """Scores of every pair; nan where either has no vector."""
        out = np.full((len(vectors), len(self.ids)), np.nan)
        told = [n for n, v in enumerate(vectors) if v is not None]
        if told and len(self.ids):
            out[told] = np.where(self.known, np.vstack([vectors.iloc[n] for n in told]).astype(float) @ self.dense, np.nan)
        return out

    def lexical_of(self, queries) -> np.ndarray:
        """Unnormalised BM25 of every pair; a word's postings are added in the query's order."""
        out = np.zeros((len(queries), len(self.ids)))
        for n, words in enumerate(queries):
            words = words if words is not None else []
            codes = self.terms.get_indexer([w["term"] for w in words])
            if self.table is not None:
                known = codes >= 0
                out[n] = (self.table[codes[known]] * np.array([w["tf"] for w in words], dtype=float)[known, None]).sum(axis=0)
                continue
            for code, word in zip(codes.tolist(), words):
                if code >= 0:
                    held = slice(self.starts[code], self.starts[code + 1])
                    out[n, self.rows[held]] += word["tf"] * self.impacts[held]
        return out


def _before(scores: np.ndarray, ids: np.ndarray, wanted: np.ndarray, wanted_ids: np.ndarray) -> np.ndarray:
    """How many of ``scores`` (nan: absent) stand before each wanted (score, id); ids ascend."""
    there = ~np.isnan(scores)
    order = np.argsort(-scores[there], kind="stable")
    falling, names = -scores[there][order], ids[there][order]
    low, high = np.searchsorted(falling, -wanted, "left"), np.searchsorted(falling, -wanted, "right")
    ties = [int(np.searchsorted(names[a:b], i)) if b > a else 0 for a, b, i in zip(low.tolist(), high.tolist(), wanted_ids)]
    return low + np.array(ties, dtype=np.int64)


def hybrid_retrieve(cases: DataFrame, corpus: DataFrame, top: int = fixed.TOP_K, gate: float = fixed.MIN_SIMILARITY, k: int = fixed.RRF_K,
                    stopwords=fixed.STOPWORDS, charset: str = "a-zçğıöşü0-9", k1: float = fixed.BM25_K1, b: float = fixed.BM25_B,
                    lexical_weight: float = 1.0, pinned_cells: int = SHIPPED_CELLS) -> DataFrame:
    """The best ``top`` chunks of a corpus for every case.

    cases(query_id, text, embedding), corpus(chunk_id, text, embedding) ->
    (query_id, rank, chunk_id, score, lexical_score, rank_score, evident,
    source_status). A case or chunk without a vector has no dense rank: its dense
    score is 0 and its words alone count. A pinned corpus is measured and shipped as
    one index; each Arrow batch of cases is scored, fused and cut in place, in small
    slices, so that memory does not follow the batch. Beyond
    ``pinned_cells`` values the threshold way of ``_fused_by_threshold`` gives the
    same rows.
    """
    indexed = settle(chunk_impacts(corpus, stopwords, charset, k1, b))
    words = cases.select("query_id", "embedding", term_counts(tokenize_tr(F.col("text"), stopwords, charset)).alias("terms"))
    shape = indexed.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"), F.sum(F.coalesce(F.size("postings"), F.lit(0))).alias("p")).first()
    width = max(shape.d or 0, 1)
    if shape.n * width + (shape.p or 0) > pinned_cells:
        best = _fused_by_threshold(words, indexed, top, k, width, pinned_cells)
    else:
        listed = indexed.toArrow()
        index, kind, rows = _Index(listed.to_pandas(), width), listed.schema.field("chunk_id").type, _slice_rows(listed.num_rows)

        def positions(scores: np.ndarray) -> np.ndarray:
            """1-based rank of every column per row; columns are in id order, so ties are stable."""
            order = np.argsort(-np.nan_to_num(scores, nan=-np.inf), axis=1, kind="stable")
            ranks = np.empty_like(order)
            np.put_along_axis(ranks, order, np.arange(1, order.shape[1] + 1)[None, :], axis=1)
            return ranks

        def retrieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches, rows):
                dense, lexical = index.dense_of(batch["embedding"]), index.lexical_of(batch["terms"])
                most = lexical.max(axis=1, keepdims=True, initial=0.0)
                lexical = np.divide(lexical, most, out=np.zeros_like(lexical), where=most > 0)
                fused = np.where(np.isnan(dense), 0.0, 1.0 / (k + positions(np.round(dense, RANK_DIGITS)))) + np.where(
                    lexical > 0, 1.0 / (k + positions(np.round(lexical, RANK_DIGITS))), 0.0)
                picked = np.argsort(-np.round(fused, 12), axis=1, kind="stable")[:, :top]
                take = lambda m: pa.array(np.take_along_axis(m, picked, axis=1).ravel(), pa.float64())
                width = picked.shape[1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(batch["query_id"].to_numpy(), width).tolist(), asked), pa.array(np.tile(np.arange(1, width + 1), len(batch)), pa.int32()),
                    pa.array(index.ids[picked].ravel().tolist(), kind), take(np.nan_to_num(dense)), take(lexical), take(fused)],
                    ["query_id", "rank", "chunk_id", "score", "lexical_score", "rank_score"])

        asked = words.select("query_id").limit(0).toArrow().schema.field("query_id").type
        best = words.mapInArrow(retrieve, f"query_id {words.schema['query_id'].dataType.simpleString()}, rank int, chunk_id {indexed.schema['chunk_id'].dataType.simpleString()}, score double, lexical_score double, rank_score double")
    best = best.withColumn("lexical_score", F.col("lexical_score") * lexical_weight).withColumn("evident", (F.col("score") >= gate) | (F.col("lexical_score") >= gate))
    found = F.bool_or("evident").over(W.partitionBy("query_id"))  # ``top`` rows of each case
    status = F.when(found, "relevant_source_found").otherwise("no_relevant_source")
    return best.select("query_id", "rank", "chunk_id", "score", "lexical_score", "rank_score", "evident", status.alias("source_status"))


def _pair_rows(found: list[tuple], *values: str) -> pd.DataFrame:
    """(query, chunk ids, arrays of values) as rows; ids stay plain objects."""
    plain = lambda items: pd.Series([i.item() if isinstance(i, np.generic) else i for i in items], dtype=object)
    out = {"query_id": plain(q for q, ids, *_ in found for _ in ids), "chunk_id": plain(i for _, ids, *_ in found for i in ids)}
    return pd.DataFrame(out | {v: np.concatenate([f[n + 2] for f in found]) if found else np.zeros(0) for n, v in enumerate(values)})


def _ids(queries: DataFrame, chunks: DataFrame) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return f"query_id {kind(queries, 'query_id')}, chunk_id {kind(chunks, 'chunk_id')}"


def _fused_by_threshold(cases: DataFrame, indexed: DataFrame, top: int, k: int, width: int, cells: int) -> DataFrame:
    """Fusion over a corpus of any size without a table of pairs.

    The ``top``-th best chunk scores at least 1 / (k + top) where a list is that long, so
    a chunk behind rank k + 2 * top in both lists cannot enter. First pass: blocks of cases
    meet blocks of chunks, and each keeps its best of both lists (twice that depth, so that
    rounding of near ties cannot matter) and its ``top`` smallest ids, which fill up short
    lists. Second pass: the blocks count what stands before each case's few candidates,
    which gives the missing ranks exactly.
    """
    depth = 2 * (k + 2 * top)
    size = indexed.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("postings"), F.lit(0))).alias("p")).first()
    chunk_blocks = min(-(-(size.n * width + (size.p or 0)) // cells), size.n)
    rows = max(16, cells // max(1, -(-size.n // chunk_blocks)))  # cases of a block: rows x chunks scores at a time
    case_blocks = -(-cases.count() // min(rows, 2000)) or 1
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    chunks = settle(indexed.withColumn("cb", block("chunk_id", chunk_blocks)))
    queries = settle(cases.withColumn("qb", block("query_id", case_blocks)))
    shared = chunks.withColumn("qb", every(case_blocks)).groupBy("qb", "cb")
    kinds = _ids(cases, indexed)

    def best_of_block(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return _pair_rows([], "dense", "raw")
        index, frames = _Index(c, width), []
        for at in range(0, len(q), 256):
            some = q.iloc[at:at + 256]
            dense, raw = index.dense_of(some["embedding"]), index.lexical_of(some["terms"])
            for n, query in enumerate(some["query_id"]):
                near = np.argsort(-np.nan_to_num(np.round(dense[n], RANK_DIGITS), nan=-np.inf), kind="stable")[:depth]
                words = np.argsort(-raw[n], kind="stable")[:depth]
                picked = np.unique(np.concatenate([near[~np.isnan(dense[n][near])], words[raw[n][words] > 0], np.arange(min(top, len(index.ids)))]))
                frames.append((query, index.ids[picked], dense[n][picked], raw[n][picked]))
        return _pair_rows(frames, "dense", "raw")

    met = queries.withColumn("cb", every(chunk_blocks)).groupBy("qb", "cb").cogroup(shared).applyInPandas(best_of_block, f"{kinds}, dense double, raw double")
    met = met.withColumn("dense", F.when(~F.isnan("dense"), F.col("dense")))
    place = lambda *order: F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    met = (met.withColumn("_d", place(F.round("dense", RANK_DIGITS).desc_nulls_last(), "chunk_id")).withColumn("_l", place(F.desc("raw"), "chunk_id")).withColumn("_i", place("chunk_id"))
           .withColumn("most", F.max("raw").over(W.partitionBy("query_id"))))
    kept = met.where((F.col("dense").isNotNull() & (F.col("_d") <= depth)) | ((F.col("raw") > 0) & (F.col("_l") <= depth)) | (F.col("_i") <= top))
    lexical = F.when(F.col("most") > 0, F.col("raw") / F.col("most")).otherwise(0.0)
    kept = settle(kept.select("query_id", "chunk_id", "dense", lexical.alias("lexical"), "most"))
    asked = kept.groupBy("query_id").agg(F.first("most").alias("most"), F.collect_list(F.struct("chunk_id", "dense", "lexical")).alias("candidates"))

    def count_before(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return _pair_rows([], "nd", "nl")
        index, frames = _Index(c, width), []
        for at in range(0, len(q), 256):
            some = q.iloc[at:at + 256]
            dense, raw = np.round(index.dense_of(some["embedding"]), RANK_DIGITS), index.lexical_of(some["terms"])
            for n, (query, most, listed) in enumerate(zip(some["query_id"], some["most"], some["candidates"])):
                ids = np.array([e["chunk_id"] for e in listed], dtype=index.ids.dtype)
                told = lambda name: np.round(np.array([np.nan if e[name] is None else e[name] for e in listed], dtype=float), RANK_DIGITS)
                near, words = told("dense"), told("lexical")
                nd, nl = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
                has = ~np.isnan(near)
                nd[has] = _before(dense[n], index.ids, near[has], ids[has])
                if most > 0:
                    nl = _before(np.round(raw[n] / most, RANK_DIGITS), index.ids, words, ids)
                frames.append((query, ids, nd, nl))
        return _pair_rows(frames, "nd", "nl")

    ready = queries.join(asked, "query_id").withColumn("cb", every(chunk_blocks)).groupBy("qb", "cb")
    counted = ready.cogroup(shared).applyInPandas(count_before, f"{kinds}, nd long, nl long").groupBy("query_id", "chunk_id").agg(F.sum("nd").alias("nd"), F.sum("nl").alias("nl"))
    dense_part = F.when(F.col("dense").isNotNull(), 1.0 / (k + F.col("nd") + 1)).otherwise(0.0)
    lexical_part = F.when(F.col("lexical") > 0, 1.0 / (k + F.col("nl") + 1)).otherwise(0.0)
    fused = kept.join(counted, ["query_id", "chunk_id"]).withColumn("rank_score", dense_part + lexical_part)
    order = W.partitionBy("query_id").orderBy(F.round("rank_score", 12).desc(), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "query_id", "rank", "chunk_id", F.coalesce("dense", F.lit(0.0)).alias("score"), F.col("lexical").alias("lexical_score"), "rank_score")


def retrieval_query(unit_label: Column, request_type: Column, values: Column, document: Column, maximum: int | None = None) -> Column:
    """The case's own words as the query: unit, type words, task fields, sanitised text;
    at most ``maximum`` characters if given (``fixed.MAX_QUERY_CHARACTERS`` for a prompt)."""
    words = F.concat(F.array(unit_label, F.replace(request_type, F.lit("-"), F.lit(" "))), values, F.array(document))
    trimmed = F.transform(words, strip)
    query = F.array_join(F.filter(trimmed, lambda w: w.isNotNull() & (w != "")), " ")
    return query if maximum is None else F.substring(query, 1, maximum)


# --- relabelling ------------------------------------------------------------

def greedy_match(pairs: DataFrame, threshold: float = fixed.MIN_SIMILARITY, group: str = "payload_id") -> DataFrame:
    """Greedy one-to-one match of payload keys to targets.

    pairs(group, target, key, score). The best pair is taken first; ties fall to
    the larger target, then the larger key. A group holds one payload's keys
    times the few targets, so folding its sorted array is bounded.
    """
    entry = F.struct((-F.col("score")).alias("miss"), "score", "target", "key")
    descending = lambda a, b: (
        F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["target"] > b["target"], -1).when(a["target"] < b["target"], 1)
        .when(a["key"] > b["key"], -1).when(a["key"] < b["key"], 1).otherwise(0))
    ranked = (pairs.where(F.col("score") >= threshold).groupBy(group).agg(F.collect_list(entry).alias("p"))
              .withColumn("p", F.array_sort("p", descending)))
    start = F.array().cast("array<struct<score:double,target:string,key:string>>")
    taken = F.aggregate("p", start, lambda acc, e: F.when(
        F.exists(acc, lambda t: (t["target"] == e["target"]) | (t["key"] == e["key"])), acc).otherwise(
        F.concat(acc, F.array(F.struct(e["score"].cast("double").alias("score"), e["target"].cast("string").alias("target"), e["key"].cast("string").alias("key"))))))
    return ranked.select(group, F.explode(taken).alias("m")).select(group, "m.target", "m.key", "m.score")
