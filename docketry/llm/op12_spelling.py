"""Spelling variants by permuterm rotations.

Words are runs of Latin letters. Each word is closed by the terminator ``$`` and written
as all its rotations, range-sorted. The rotation that begins behind the letter c of
x c y is ``y$xc``: the words that replace that letter share the prefix ``y$x`` and differ
only in the last character, and the word that lacks it has the whole rotation ``y$x``. So
neighbours by one replacement, insertion or deletion stand side by side in the order, in
the range of one prefix that skips the edited character. A prefix has at most one row per
letter of the alphabet and one for the shorter word, so no range is hot. A scan of each
range gives one row per member, its number of neighbours and the best of them; pairs are
never written. A letter inside a row of equal letters is deleted to the same word, which
is counted at the first letter of the row only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.llm.common import by_bytes, keep, table
from docketry.llm.sql import crc32_sql

LETTERS = 6
OCCURRENCES = 5
RATIO = 5
SLIP = 199  # of the (document, run) checksums, one in so many loses a letter
FLUSH = 200_000
END = "$"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, slip: int | None = SLIP) -> DataFrame:
    """(word, n): how often each word of at least ``letters`` code points occurs in ``docs``.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z in lower case. With
    ``slip``, a run whose crc32 of ``<id>:<run>`` is a multiple of it loses the code point
    at crc32 modulo its length. Null texts have no word, a null id counts as empty. Tasks
    count for themselves and hold at most about ``FLUSH`` words; other columns are ignored.
    """

    def count(batches):
        import re
        import zlib
        from collections import Counter

        import pyarrow as pa

        run = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % letters)  # the UTF-8 bytes of the letters; a shorter run matches nowhere

        def rows(total):
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        total = Counter()
        for batch in by_bytes(batches, "text"):
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if text is None:
                    continue
                begin = zlib.crc32(b":" if doc is None else b"%s:" % doc.encode())
                for found, n in Counter(run.findall(text.lower())).items():  # bytes: A-Z only
                    if slip and (h := zlib.crc32(found, begin)) % slip == 0:
                        line = found.decode()
                        at = h % len(line)
                        if len(line) <= letters:
                            continue
                        found = (line[:at] + line[at + 1:]).encode()
                    total[found] += n
                if len(total) >= FLUSH:
                    yield rows(total)
                    total.clear()
        yield rows(total)

    counted = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def rotations(vocabulary: DataFrame) -> DataFrame:
    """(prefix, letter, n): every rotation of every word, cut before its last character
    (``letter``; null for the whole rotation). The word is the part of the prefix behind
    the terminator, the letter, and the part before it."""

    def turn(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                prefixes, last, ns = [], [], []
                for word, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist()):
                    size = len(word)
                    prefixes += [word[i:] + END + word[:i] for i in range(size + 1)]
                    prefixes += [word[i + 1:] + END + word[:i] for i in range(size)]
                    last += [None] * (size + 1)
                    last += word
                    ns += [n] * (2 * size + 1)
                yield pa.RecordBatch.from_arrays([pa.array(prefixes, pa.string()), pa.array(last, pa.string()), pa.array(ns, pa.int64())], names=["prefix", "letter", "n"])

    return vocabulary.select("word", "n").mapInArrow(turn, "prefix string, letter string, n long")


def _scan(batches):
    """One row per member of every range of at least two: its neighbours there and the best one."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def ranges(table):
        """Row numbers where the prefix changes."""
        column = table.column("prefix")
        same = pc.equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.flatnonzero(~same.astype(bool)) + 1, [len(column)]])

    def near(table, cuts):
        out = ([], [], [], [])
        several = np.flatnonzero(np.diff(cuts) > 1)
        for a, b in zip(cuts[several].tolist(), cuts[several + 1].tolist()):
            part = table.slice(a, b - a)
            tail, head = part.column("prefix")[0].as_py().split(END)
            letters, ns = part.column("letter").to_pylist(), part.column("n").to_pylist()
            members = [(-n, head + (c or "") + tail, c) for c, n in zip(letters, ns)]
            first, second = sorted(members, key=lambda m: m[:2])[:2]
            again = [c is not None and head.endswith(c) for c in letters]
            whole = any(c is None for c in letters)
            for m, twice in zip(members, again):
                if m[2] is None:
                    count = len(members) - 1 - sum(again)
                else:
                    count = len(members) - 1 - (whole and twice)
                best = second if m is first else first
                for column, value in zip(out, (m[1], count, best[0], best[1])):
                    column.append(value)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["word", "n_near", "less", "best"])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = (rows if rest is None else pa.concat_tables([rest, rows])).combine_chunks()
        cuts = ranges(rows.to_batches()[0])
        rest = rows.slice(cuts[-2])  # the last range may go on in the next batch
        yield near(rows.to_batches()[0], cuts[:-1])
    if rest is not None:
        yield near(rest.combine_chunks().to_batches()[0], np.array([0, rest.num_rows]))


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have neighbours; ``vocabulary``
    (word, n) has distinct words without ``$`` and is a kept table (it is read twice)."""
    ordered = rotations(vocabulary).repartitionByRange("prefix").sortWithinPartitions("prefix", "letter")
    found = ordered.mapInArrow(_scan, "word string, n_near long, less long, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "best")).alias("b"))
    return best.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Every word of ``vocabulary`` (word, n) with its form and root.

    A word's form is its neighbour with the largest n (ties: the smallest in code-point
    order), if that n is at least ``ratio`` (over 1) times the word's own; its root is
    where forms lead in the end, the word itself without a form. n grows along forms,
    so they never circle; roots are found by pointer doubling. Repeated words are added up, a null word or n goes
    nowhere and is left out. An empty vocabulary gives no rows.
    """
    vocabulary = keep(vocabulary.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    near = neighbours(vocabulary)
    judged = keep(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        *[F.when(F.col("best_n") >= F.col("n") * ratio, F.col(c)).alias(name) for c, name in (("best", "form"), ("best_n", "form_n"))]), "judged")
    ways = keep(judged.where("form is not null").select("word", F.col("form").alias("root")), "ways")
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = keep(ways.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        if not longer.where("moved").limit(1).count():
            break
        ways = longer.select("word", "root")
    return judged.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_permuterm_variants(spark: SparkSession, folder: str) -> DataFrame:
    counted = words(table(spark, folder, "documents"))
    return variants(counted.where(F.col("n") >= OCCURRENCES))


SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
held AS (SELECT doc, run, count(*) AS k FROM runs WHERE length(run) >= {LETTERS} GROUP BY 1, 2),
summed AS (SELECT run, k, {crc32_sql("doc || ':' || run")} AS h FROM held),
slipped AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM summed),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= {LETTERS} GROUP BY 1 HAVING sum(k) >= {OCCURRENCES}),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cut c JOIN v ON v.word = c.head || c.tail
  UNION SELECT v.word, c.word FROM cut c JOIN v ON v.word = c.head || c.tail),
best AS (SELECT p.word, o.word AS other, o.n AS other_n, count(*) OVER (PARTITION BY p.word) AS near,
         row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, o.word) AS r FROM pairs p JOIN v o ON o.word = p.other),
judged AS (SELECT v.word, v.n, coalesce(near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * n THEN other END AS form, CASE WHEN other_n >= {RATIO} * n THEN other_n END AS form_n
           FROM v LEFT JOIN best b ON b.word = v.word AND b.r = 1),
ways AS (SELECT word, word AS root, form AS next FROM judged UNION ALL SELECT w.word, j.word, j.form FROM ways w JOIN judged j ON j.word = w.next)
SELECT j.word, j.form, w.root, j.n, j.n_near, j.form_n FROM judged j JOIN ways w ON w.word = j.word AND w.next IS NULL"""
