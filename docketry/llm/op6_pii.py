"""Personal data: base patterns and a skip-chain conditional random field.

The base patterns find e-mail addresses, IP addresses, cards and phone numbers; they
always stay. Nodes of the field are the blank-separated tokens that hold a digit or
"@", or repeat the local part of an address found in the same document. Neighbouring
nodes share chain potentials; nodes with the same normal form (letters and digits,
digits alone, or local part), however far apart, share skip potentials. Weights are
trained here by pseudo-likelihood on a bounded sample, labelled by the base spans, with
the token's own features hidden half of the time so that context counts. Loopy
sum-product messages then settle the labels of all nodes of a batch at once; tokens of
base spans are held fixed. A span is added where a node that is tied to a base span by
edges of the graph has a clear label. Documents without a base span stay untouched.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry.llm.common import arrived, by_bytes, shipped, table

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 3_000
ROUNDS = 12
CLEAR = 0.9
AGREE = 7.0  # log odds that two tokens of the same form are entities of the same kind
ENTITIES = "array<struct<kind:string,start:int,end:int,base:boolean>>"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = int(d) * (1 + n % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start. Every pattern is matched in linear time:
    an address part can only begin where its run of characters begins or the last match ended."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in LOCAL:
            a -= 1
        found = DOMAIN.match(text, at + 1) if a < at else None
        if found:
            out.append(("email", a, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    if DIGIT.search(text):
        for m in ADDRESS.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m.group().split("."))):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return out


class Graph:
    """Nodes and edges of some documents; base labels where a base span covers a node."""

    def __init__(self):
        self.doc, self.start, self.end, self.label, self.features = [], [], [], [], []
        self.chain, self.skip = [], []

    def add(self, doc: int, text: str, base) -> None:
        if not SIGN.search(text):
            return
        names = {text[a:b].split("@")[0].lower() for kind, a, b in base if kind == "email"}
        names = {n for n in names if len(n) >= 4}
        spans, at = sorted((a, b, KINDS.index(kind) + 1) for kind, a, b in base), 0
        seen: dict[str, int] = {}
        before = None
        for m in re.finditer(r"\S+", text):
            word = m.group()
            bare = word.strip(".,;:!?()[]<>\"'").lower()
            if not SIGN.search(word) and bare not in names:
                continue
            a, b = m.span()
            while at < len(spans) and spans[at][1] <= a:
                at += 1
            inside = [k for s, e, k in spans[at:at + 4] if s < b and e > a]
            n = len(self.doc)
            self.doc.append(doc)
            self.start.append(a)
            self.end.append(b)
            self.label.append(inside[0] if inside else 0)
            self.features.append(self._features(word))
            if before is not None and self.end[before] + 1 == a:
                self.chain.append((before, n))
            before = n
            for key in self._keys(bare):
                if key in seen:
                    self.skip.append((seen[key], n))
                seen[key] = n

    @staticmethod
    def _keys(bare: str) -> list[str]:
        plain = "".join(c for c in bare if c.isalnum())
        digits = "".join(c for c in plain if c.isdigit())
        keys = {"w" + plain} if len(plain) >= 4 else set()
        if len(digits) >= 6:
            keys.add("d" + digits[-7:])
        name = bare.split("@")[0]
        if len(name) >= 4:
            keys.add("n" + name)
        return sorted(keys)

    @staticmethod
    def _features(word: str) -> list[float]:
        digits = sum(c.isdigit() for c in word)
        letters = sum(c.isalpha() for c in word)
        dots = word.count(".")
        return [1.0, "@" in word, word.startswith("+"), "(" in word, "-" in word, dots == 3, dots > 0, letters > 0, letters > digits,
                digits == 0, 0 < digits <= 3, 4 <= digits <= 6, 7 <= digits <= 9, 10 <= digits <= 12, 13 <= digits <= 19, digits > 19,
                digits == len(word.strip(".,;:!?")), len(word) > 24, "=" in word or "_" in word or "/" in word, letters > 0 and digits > 0]


N_FEATURES = len(Graph._features("0"))


class Field:
    """Unary, chain and skip weights."""

    def __init__(self, unary, chain, skip):
        self.unary, self.chain, self.skip = unary, chain, skip

    @staticmethod
    def fit(x, y, chain, skip, rounds: int = 400, seed: int = 1) -> "Field":
        """Pseudo-likelihood: each label given its features and the labels of its neighbours."""
        import numpy as np

        k = len(KINDS) + 1
        # Alike tokens agree unless the sample says otherwise: the prior mean of the skip weights.
        prior = AGREE * np.diag(np.arange(k) > 0).astype(float)
        model = Field(np.zeros((N_FEATURES, k)), np.zeros((k, k)), prior.copy())
        if not len(y):
            return model
        rng = np.random.default_rng(seed)
        one = np.eye(k)[y]
        earlier, later, alike = np.zeros_like(one), np.zeros_like(one), np.zeros_like(one)
        if len(chain):
            np.add.at(later, chain[:, 0], one[chain[:, 1]])
            np.add.at(earlier, chain[:, 1], one[chain[:, 0]])
        if len(skip):
            np.add.at(alike, skip[:, 0], one[skip[:, 1]])
            np.add.at(alike, skip[:, 1], one[skip[:, 0]])
        hidden = rng.random(len(x)) < 0.5
        seen = np.concatenate([x, np.where(hidden[:, None], x * (np.arange(N_FEATURES) == 0), x)])
        one, earlier, later, alike = (np.concatenate([m, m]) for m in (one, earlier, later, alike))
        speed = [np.zeros_like(m) for m in (model.unary, model.chain, model.skip)]
        for _ in range(rounds):
            z = seen @ model.unary + earlier @ model.chain + later @ model.chain.T + alike @ model.skip
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - one) / len(one)
            both = alike.T @ g
            grads = (seen.T @ g + 1e-4 * model.unary, earlier.T @ g + (later.T @ g).T + 1e-4 * model.chain, (both + both.T) / 2 + 1e-4 * (model.skip - prior))
            for n, (m, d) in enumerate(zip((model.unary, model.chain, model.skip), grads)):
                speed[n] = 0.9 * speed[n] - 0.5 * d
                m += speed[n]
        return model

    def beliefs(self, x, y, chain, skip, rounds: int = ROUNDS):
        """Label probabilities by damped loopy sum-product; nodes with a base label are fixed."""
        import numpy as np

        k = len(KINDS) + 1
        unary = x @ self.unary
        fixed = y > 0
        unary[fixed] = np.where(np.eye(k)[y[fixed]] > 0, 0, -60)
        edges = np.concatenate([chain, skip]) if len(chain) + len(skip) else np.zeros((0, 2), int)
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        table_ = np.concatenate([np.broadcast_to(m, (n, k, k)) for m, n in ((self.chain, len(chain)), (self.skip, len(skip)), (self.chain.T, len(chain)), (self.skip.T, len(skip)))])
        reverse = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        sent = np.zeros((len(source), k))
        total = unary.copy()
        for _ in range(rounds if len(source) else 0):
            rest = (total[source] - sent[reverse])[:, :, None] + table_
            top = rest.max(axis=1)
            new = top + np.log(np.exp(rest - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            sent = 0.5 * sent + 0.5 * new
            total = unary.copy()
            np.add.at(total, target, sent)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _arrays(graph: Graph):
    import numpy as np

    return (np.array(graph.features, dtype=np.float64).reshape(-1, N_FEATURES), np.array(graph.label, dtype=np.int64),
            np.array(graph.chain, dtype=np.int64).reshape(-1, 2), np.array(graph.skip, dtype=np.int64).reshape(-1, 2))


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", most: int = SAMPLE_DOCS) -> Field:
    """Fit on the nodes of about ``most`` documents with a digit or "@", chosen by hash of
    the id. The tasks send nodes, not texts."""
    some = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    n = some.count()
    chosen = some.where(F.pmod(F.xxhash64("i", F.lit(17)), F.lit(max(1, n // most))) == 0).select("text").limit(2 * most)

    def nodes(batches):
        import pyarrow as pa

        for batch in by_bytes(batches, "text", 4 << 20):
            graph = Graph()
            for k, text in enumerate(batch.column("text").to_pylist()):
                graph.add(k, text, base_spans(text))
            yield pa.RecordBatch.from_pylist([{"x": [float(v) for f in graph.features for v in f], "y": graph.label, "chain": [n for e in graph.chain for n in e], "skip": [n for e in graph.skip for n in e]}],
                                             schema=pa.schema([("x", pa.list_(pa.float32())), ("y", pa.list_(pa.int32())), ("chain", pa.list_(pa.int32())), ("skip", pa.list_(pa.int32()))]))

    import numpy as np

    parts, at = [[], [], [], []], 0
    for r in chosen.mapInArrow(nodes, "x array<float>, y array<int>, chain array<int>, skip array<int>").collect():
        parts[0].append(np.array(r["x"], dtype=np.float64).reshape(-1, N_FEATURES))
        parts[1].append(np.array(r["y"], dtype=np.int64))
        for k in ("chain", "skip"):
            parts[2 + (k == "skip")].append(np.array(r[k], dtype=np.int64).reshape(-1, 2) + at)
        at += len(r["y"])
    if not at:
        return Field.fit(*_arrays(Graph()))
    return Field.fit(*(np.concatenate(p) for p in parts))


def added_spans(graph: Graph, model: Field, texts) -> dict[int, list[tuple[str, int, int]]]:
    """Spans that the field adds, by document."""
    x, y, chain, skip = _arrays(graph)
    if not (y > 0).any():
        return {}
    p = model.beliefs(x, y, chain, skip)
    parent = list(range(len(y)))

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in [*graph.chain, *graph.skip]:
        parent[root(b)] = root(a)
    tied = {root(n) for n in (y > 0).nonzero()[0].tolist()}
    best, follows = p.argmax(axis=1), dict((b, a) for a, b in graph.chain)
    out: dict[int, list] = {}
    open_: dict[int, list] = {}
    for n in ((y == 0) & (best > 0) & (p.max(axis=1) >= CLEAR)).nonzero()[0].tolist():
        if root(n) not in tied:
            continue
        before = follows.get(n)
        if before in open_ and open_[before][0] == best[n]:
            span = open_[before]
            span[2] = graph.end[n]
        else:
            span = [int(best[n]), graph.start[n], graph.end[n]]
            out.setdefault(graph.doc[n], []).append(span)
        open_[n] = span
    found = {}
    for doc, spans in out.items():
        for kind, a, b in spans:
            word = texts[doc][a:b]
            a, b = a + len(word) - len(word.lstrip(".,;:!?[]<>\"'")), b - len(word) + len(word.rstrip(".,;:!?[]<>\"'"))
            if a < b:
                found.setdefault(doc, []).append((KINDS[kind - 1], a, b))
    return found


def find(docs: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """Add ``entities``: array of (kind, start, end, base) by kind, then start, in code
    points, ends exclusive. Null texts have none. All columns of ``docs`` stay."""
    shared = shipped(docs.sparkSession, model)

    @F.pandas_udf(ENTITIES)
    def entities(texts):
        import pandas as pd

        out, field = [], arrived(shared)
        for at in range(0, len(texts), 500):
            some = [t or "" for t in texts.iloc[at:at + 500]]
            base, graph = [base_spans(t) for t in some], Graph()
            for n, (text, spans) in enumerate(zip(some, base)):
                if spans:  # without a base span nothing can be added
                    graph.add(n, text, spans)
            more = added_spans(graph, field, some)
            for n, spans in enumerate(base):
                rows = [(KINDS.index(kind), a, b, True) for kind, a, b in spans] + [(KINDS.index(kind), a, b, False) for kind, a, b in more.get(n, ())]
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": is_base} for k, a, b, is_base in sorted(rows)])
        return pd.Series(out)

    return docs.withColumn("entities", entities(F.col(text_col)))


def redact(text: Column, entities: Column) -> Column:
    """Replace each entity by its kind in brackets; overlapping ones become one mark of the first kind."""

    @F.pandas_udf("string")
    def marked(texts, found):
        import pandas as pd

        def one(text, spans):
            if text is None or spans is None or not len(spans):
                return text
            out, at = [], 0
            for a, b, kind in sorted((s["start"], s["end"], s["kind"]) for s in spans):
                if a >= at:
                    out += [text[at:a], "[", kind.upper(), "]"]
                at = max(at, b)
            return "".join([*out, text[at:]])

        return pd.Series([one(t, s) for t, s in zip(texts, found)])

    return marked(text, entities)


def joined(entities: Column) -> Column:
    return F.array_join(F.transform(entities, lambda e: F.concat_ws(":", e["kind"], e["start"], e["end"])), ",")


def op6_pii_field(spark: SparkSession, folder: str) -> DataFrame:
    """The counts and the checksum are of base spans, ``spans`` of all."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    base = F.filter("entities", lambda e: e["base"])
    kinds = F.transform(base, lambda e: e["kind"])
    counts = [F.size(F.filter(kinds, lambda k: k == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return find(docs, train(docs)).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("entities")).alias("spans"))
