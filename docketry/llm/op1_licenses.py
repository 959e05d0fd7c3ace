"""License scan: a trained paragraph classifier.

A multinomial logistic regression over sparse word uni- and bigrams names the
licence family of every paragraph (line) of every text. It is trained here: on
notices of each family, cut, shortened and mixed with words at random, against a
bounded sample of the corpus's own paragraphs as the class ``unknown``. Probabilities
are calibrated by a temperature on held-out examples, and a family is reported only
above the threshold that no held-out unknown paragraph passes. A comparison with the
notices confirms the prediction: enough of the paragraph's word pairs must occur in a
notice of the predicted family. Where that finds nothing, the stretches of a paragraph
that hold word pairs of notices are judged by themselves, at the notices' own scale, and
must hold most of a notice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.llm.common import arrived, by_bytes, shipped, table
from docketry.llm.license_notices import NOTICES

SAMPLE_DOCS = 1_500  # corpus documents whose paragraphs teach the unknown class
SAMPLE_PARAGRAPHS = 4_000
COPIES = 60
ROUNDS = 250
CONFIRM = 0.5
UNKNOWN = "unknown"
MAX_WORDS = 400
WHOLE = 0.75  # share of a notice's word pairs that confirms it among other words
PASSAGE = 14
GAP = 3


def words_of(text: str) -> list[str]:
    import re

    return re.findall(r"[a-z0-9]+(?:[.\-+][a-z0-9]+)*", text.lower())


class Classifier:
    """Weights over n-grams of the notices, a temperature, and a threshold."""

    def __init__(self, classes, vocabulary, weights, bias, temperature=1.0, threshold=0.5):
        self.classes, self.vocabulary, self.weights, self.bias = classes, vocabulary, weights, bias
        self.temperature, self.threshold = temperature, threshold
        self.pairs = {family: [set(zip(w, w[1:])) for w in map(words_of, texts)] for family, texts in NOTICES.items()}
        self.singles = {k for k in vocabulary if isinstance(k, str)}

    def features(self, words):
        """(indices, values): counts of known n-grams over the paragraph's length, plus the share of unknown words."""
        get = self.vocabulary.get
        at = [i for w in words if (i := get(w)) is not None]
        known = len(at)
        at += [i for p in zip(words, words[1:]) if (i := get(p)) is not None]
        scale = 1 / max(1, len(words))
        return at, scale, 1 - known * scale

    def logits(self, words):
        at, scale, odd = self.features(words)
        return self.bias + self.weights[at].sum(axis=0) * scale * 4 + self.weights[-1] * odd

    def judge(self, paragraph: str):
        """(family or unknown, probability, share of word pairs found in a notice, confirmed)."""
        import numpy as np

        words = words_of(paragraph)
        if len(words) < 2 or len(self.singles.intersection(words)) < 2:
            return UNKNOWN, 1.0, 0.0, False
        best = (UNKNOWN, 1.0, 0.0, False)
        # A long paragraph is judged window by window.
        for begin in range(0, max(1, len(words) - MAX_WORDS // 2), MAX_WORDS // 2):
            some = words[begin:begin + MAX_WORDS]
            family, p = self.named(some)
            if family == UNKNOWN:
                continue
            pairs = set(zip(some, some[1:]))
            share = max(len(pairs & notice) / max(1, min(len(pairs), len(notice))) for notice in self.pairs[family])
            if best[0] == UNKNOWN or share > best[2]:
                best = (family, p, share, share >= CONFIRM)
        if best[3]:
            return best
        # A notice among other words is judged by itself, so that it is not diluted.
        for some in self.stretches(words):
            pairs = set(zip(some, some[1:]))
            if max(self.held(pairs, notice) for notices in self.pairs.values() for notice in notices) < WHOLE:
                continue
            family, p = self.named(some)
            share = max((self.held(pairs, notice) for notice in self.pairs.get(family, ())), default=0.0)
            if share >= WHOLE and (not best[3] or share > best[2]):
                best = (family, p, share, True)
        return best

    def named(self, words):
        """(family or unknown, probability) of some words."""
        import numpy as np

        z = self.logits(words) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return (UNKNOWN, 1.0) if self.classes[k] == UNKNOWN or p[k] < self.threshold else (self.classes[k], float(p[k]))

    def held(self, pairs, notice):
        """The share of a notice that ``pairs`` hold; of a long one ``PASSAGE`` pairs are enough."""
        return len(pairs & notice) / min(len(notice), PASSAGE)

    def stretches(self, words):
        """Parts of a paragraph with word pairs of notices, at most ``GAP`` other words apart;
        long ones also in windows of 16, 32 and 64 words, half of each shared with the next."""
        get = self.vocabulary.get
        at = [n for n, p in enumerate(zip(words, words[1:])) if get(p) is not None]
        begin = 0
        for n, place in enumerate(at):
            if n + 1 < len(at) and at[n + 1] - place <= GAP + 1:
                continue
            some = words[at[begin]:place + 2]
            begin = n + 1
            yield some[:MAX_WORDS]
            for size in (16, 32, 64):
                if len(some) > size:
                    yield from (some[a:a + size] for a in range(0, len(some) - size // 2, size // 2))


def train(paragraphs: list[str], copies: int = COPIES, rounds: int = ROUNDS, seed: int = 1) -> Classifier:
    """Fit on the notices and on ``paragraphs`` of unknown kind (those that mostly repeat a notice are left out)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    families = sorted(NOTICES)
    classes = [*families, UNKNOWN]
    notices = [(families.index(f), words_of(t)) for f in families for t in NOTICES[f]]
    grams = sorted({w for _, n in notices for w in n}) + sorted({p for _, n in notices for p in zip(n, n[1:])})
    vocabulary = {g: i for i, g in enumerate(grams)}
    told = [set(zip(n, n[1:])) for _, n in notices]
    others = []
    for text in paragraphs:
        w = words_of(text)[:MAX_WORDS]
        pairs = set(zip(w, w[1:]))
        if len(w) >= 2 and not any(len(pairs & t) > 0.3 * min(len(pairs), len(t)) for t in told):
            others.append(w)
    filler = [w for o in others[:500] for w in o[:40]] or ["text"]
    rows = []
    for label, notice in notices:
        rows.append((label, notice))
        for _ in range(copies):
            some = list(notice)
            if len(some) > 30 and rng.random() < 0.5:  # a passage of a long notice
                begin = int(rng.integers(0, len(some) - 12))
                some = some[begin:begin + int(rng.integers(12, 60))]
            some = [w if rng.random() > 0.05 else str(rng.choice(filler)) for w in some]
            extra = int(rng.integers(0, 1 + len(some) // 3))
            lead = [str(w) for w in rng.choice(filler, extra)]
            rows.append((label, lead + some if rng.random() < 0.5 else some + lead))
    unknown = len(classes) - 1
    rows += [(unknown, o) for o in others]
    for _ in range(600):  # loose words of notices among others are no licence
        some = [str(w) for w in rng.choice(filler, int(rng.integers(5, 60)))]
        source = notices[int(rng.integers(len(notices)))][1]
        for w in rng.choice(source, int(rng.integers(1, 4))):
            some[int(rng.integers(len(some)))] = str(w)
        rows.append((unknown, some))
    model = Classifier(classes, vocabulary, np.zeros((len(grams) + 1, len(classes))), np.zeros(len(classes)))
    x = np.zeros((len(rows), len(grams) + 1), dtype=np.float32)
    for n, (_, w) in enumerate(rows):
        at, scale, odd = model.features(w)
        np.add.at(x[n], at, 4 * scale)
        x[n, -1] = odd
    y = np.array([r[0] for r in rows])
    held = rng.random(len(rows)) < 0.2
    weight, bias = np.zeros((x.shape[1], len(classes)), dtype=np.float32), np.zeros(len(classes), dtype=np.float32)
    share = 1 / np.bincount(y[~held], minlength=len(classes)).clip(1)[y[~held]]
    share = (share / share.sum()).astype(np.float32)[:, None]
    xt, goal = x[~held], np.eye(len(classes), dtype=np.float32)[y[~held]]
    speed_w, speed_b = np.zeros_like(weight), np.zeros_like(bias)
    for _ in range(rounds):  # full-batch descent with momentum
        z = xt @ weight + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - goal) * share
        speed_w = 0.9 * speed_w - 8 * (xt.T @ g + 1e-5 * weight)
        speed_b = 0.9 * speed_b - 8 * g.sum(axis=0)
        weight, bias = weight + speed_w, bias + speed_b
    z, truth = x[held] @ weight + bias, y[held]

    def loss(t):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

    model.weights, model.bias = weight, bias
    model.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss) if len(truth) else 1.0
    p = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
    p /= p.sum(axis=1, keepdims=True)
    wrong = p[truth == unknown][:, :unknown].max(axis=1) if (truth == unknown).any() else np.zeros(1)
    model.threshold = float(min(0.95, max(0.5, wrong.max() + 0.01)))
    return model


def corpus_paragraphs(docs: DataFrame, text_col: str = "text", most_docs: int = SAMPLE_DOCS, most: int = SAMPLE_PARAGRAPHS) -> list[str]:
    """A bounded sample of paragraphs: of about ``most_docs`` documents chosen by hash, at
    most four of each and 2,000 characters of each (a limit of the training sample only)."""
    n = docs.count()
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(max(1, n // most_docs))) == 0)
    lines = F.slice(F.filter(F.split(text_col, "\n"), lambda p: F.length(p) > 0), 1, 4)
    return [r[0] for r in chosen.select(F.explode(lines).alias("p")).select(F.substring("p", 1, 2000)).limit(most).collect()]


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph with a licence: doc_id, row, paragraph (from 0), start, end
    (characters), family, probability, match, confirmed. ``row`` numbers the input rows
    and is only for joining; null texts have no paragraph; other columns are ignored."""
    shared = shipped(docs.sparkSession, model)
    kind = docs.schema[id_col].dataType.simpleString()

    def find(batches):
        import pyarrow as pa

        model = arrived(shared)
        for batch in by_bytes(batches, "_text"):
            owner, rows = [], []
            for n, text in enumerate(batch.column("_text").to_pylist()):
                at, k, hits = 0, 0, []
                for line in (text or "").split("\n"):
                    if line and not line.isspace():
                        family, p, match, sure = model.judge(line)
                        if family != UNKNOWN:
                            hits.append({"paragraph": k, "start": at, "end": at + len(line), "family": family, "probability": p, "match": match, "confirmed": sure})
                        k += 1
                    at += len(line) + 1
                rows.append({"n_paragraphs": k, "hits": hits})
            made = pa.array(rows, pa.struct([("n_paragraphs", pa.int64()), ("hits", pa.list_(pa.struct([
                ("paragraph", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("match", pa.float64()), ("confirmed", pa.bool_())])))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made.flatten()], names=["doc_id", "n_paragraphs", "hits"])

    schema = f"doc_id {kind}, n_paragraphs long, hits array<struct<paragraph:int,start:bigint,end:bigint,family:string,probability:double,match:double,confirmed:boolean>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(find, schema)


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: its paragraphs, those with a licence, and the confirmed families."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = scan(docs, train(corpus_paragraphs(docs)))
    sure = F.filter("hits", lambda h: h["confirmed"])
    return found.select(
        "doc_id", "n_paragraphs", F.size("hits").alias("n_predicted"), F.size(sure).alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda h: h["family"]))), ",").alias("families"),
        F.array_join(F.transform(sure, lambda h: F.concat_ws(":", h["family"], h["start"], h["end"])), ",").alias("spans"),
        F.coalesce(F.array_max(F.transform(sure, lambda h: h["probability"])), F.lit(0.0)).alias("probability"))
