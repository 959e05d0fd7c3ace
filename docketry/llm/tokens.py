"""Token ids of whole texts with a public byte-level BPE file, computed inside Spark tasks.

A byte-level BPE cuts a text before every single blank that stands between two
non-blank characters, so the ids of a text are the ids of its blank-separated
pieces one after another. Arrow splits a batch of texts and numbers its distinct
pieces; only those go to the tokenizers library, and each worker remembers the
words it met (two generations of bounded size). Texts with other white space at the edge of a
piece are cut where both neighbours of a blank are visible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from docketry.llm.common import by_bytes

END_ID = 2
CACHE_WORDS = 300_000
LONGEST = 100  # longer pieces are not remembered, which bounds the memory in bytes


class PieceEncoder:
    """Texts to id arrays, equal to ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        import os
        import re

        import numpy as np
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words, self.rest, self.cache = {"Ġ": {}, "": {}}, {}, cache
        self.older = dict.fromkeys(self.words, {})
        self.edge = re.compile(r"(?<=\S) (?=\S)")
        # The characters that stand for the bytes of a word in byte-level vocabularies.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.letters = str.maketrans({b: chr(256 + n) for n, b in enumerate(others)})
        self.odd = re.compile("[" + "".join(map(re.escape, map(chr, others))) + "]").search
        self.marks = {m: self._exact(m) for m in ",.;:!?"}
        self.shape = re.compile(r"([^\W\d_]+)([^\w\s]*)(?:\n(.+))?").fullmatch

    def _exact(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _other(self, text: str) -> bytes:
        if len(text) > LONGEST:
            return self._exact(text)
        return self.rest.get(text) or self.rest.setdefault(text, self._exact(text))

    def _word(self, word: str, lead: str) -> bytes:
        """Ids of one pre-token of letters; "Ġ" as ``lead`` stands for a blank before it."""
        import array

        known = self.words[lead]
        ids = known.get(word)
        if ids is None and (ids := self.older[lead].get(word)) is not None:
            known[word] = ids
        elif ids is None:
            form = word
            if not word.isascii():
                form = word.encode().decode("latin-1")
                form = form.translate(self.letters) if self.odd(form) else form
            ids = array.array(self.dtype.char, [t.id for t in self.tokenizer.model.tokenize(lead + form)]).tobytes()
            if len(word) <= LONGEST:
                known[word] = ids
        return ids

    def _piece(self, piece: str, lead: str = "Ġ") -> bytes:
        """Ids of a blank (with "Ġ") and a piece without blanks at its ends. Letters
        are one pre-token, the marks behind them the second, a line break the third;
        pieces of other shapes go whole to the tokenizer."""
        if piece.isascii() and piece.isalpha():
            return self._word(piece, lead)
        found = self.shape(piece) if "'" not in piece and max(piece) < "\u0250" else None
        if not found:
            return self._other(" " + piece if lead else piece)
        word, marks, after = found.groups()
        ids = self._word(word, lead) + (self._other(marks) if marks else b"")
        return ids + self._other("\n") + self._piece(after, "") if after else ids

    def _whole(self, text: str) -> bytes:
        head, *parts = self.edge.split(text)
        return (self._exact(head) if head else b"") + b"".join([self._piece(p) if not p[0].isspace() and not p[-1].isspace() else self._exact(" " + p) for p in parts])

    def encode(self, texts, end_id: int | None = END_ID) -> list:
        """One id array for each text of a list or an Arrow array without nulls; ``end_id`` closes each."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for lead, known in self.words.items():
            if len(known) > self.cache:
                self.words[lead], self.older[lead] = {}, known
        if len(self.rest) > self.cache // 10:
            self.rest = {}
        if not len(texts):
            return []
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        parts = pc.split_pattern(texts, " ")
        first = np.asarray(parts.offsets) - parts.offsets[0].as_py()
        codes = pc.dictionary_encode(parts.flatten())
        pieces, codes = codes.dictionary.to_pylist(), np.array(codes.indices, dtype=np.int32)
        heads, known = [], {}
        for c in codes[first[:-1]].tolist():
            heads.append(known.setdefault(c, len(pieces) + len(known)))
        unsafe = np.array([not p or p.strip() != p for p in pieces] + [False] * len(known))
        unsafe[[n for c, n in known.items() if unsafe[c]]] = True
        codes[first[:-1]] = heads
        make, met, mark = self._piece, self.words["Ġ"].get, self.marks.get
        found = []
        for p, bad in zip(pieces, unsafe.tolist()):
            if bad:
                ids = b""
            elif (ids := met(p)) is None:  # a known word, with one common mark behind it, or a piece to be made
                close = mark(p[-1])
                ids = make(p) if close is None or (word := met(p[:-1])) is None else word + close
            found.append(ids)
        found += [b"" if unsafe[n] else make(pieces[c], "") for c, n in known.items()]
        flat = pa.array(found, pa.large_binary()).take(pa.array(codes))
        ends = np.frombuffer(flat.buffers()[1], dtype=np.int64)[:len(flat) + 1]
        raw = flat.buffers()[2]
        raw = memoryview(raw) if raw is not None else b""
        odd = np.logical_or.reduceat(unsafe[codes], first[:-1])
        close = b"" if end_id is None else np.array([end_id], dtype=self.dtype).tobytes()
        borders = ends[first].tolist()
        out = []
        for n, bad in enumerate(odd.tolist()):
            ids = self._whole(texts[n].as_py()) if bad else raw[borders[n]:borders[n + 1]]
            out.append(np.frombuffer(b"".join((ids, close)), dtype=self.dtype))
        return out


def encoder_of(path: str) -> PieceEncoder:
    """The encoder of this Python worker. Task code arrives by value, so what shall
    outlast a task (the pieces met so far) hangs on a module of the worker."""
    import sys
    import types

    store = sys.modules.setdefault("piece_encoders", types.ModuleType("piece_encoders")).__dict__.setdefault("made", {})
    if path not in store:
        store[path] = PieceEncoder(path)
    return store[path]


def crc_of(ids) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): ids of every whole text as little-endian bytes, two for an
    id if the vocabulary has at most 65,536 entries, else four. Null texts count as empty."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def encode(batches):
        import pyarrow as pa

        encoder = encoder_of(path)
        for batch in by_bytes(batches, "_text"):
            ids = encoder.encode(batch.column("_text").fill_null(""), end_id)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())],
                names=[id_col, "n_tokens", "ids"])

    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(encode, schema)


def default_vocabulary() -> str:
    """Path of the public 50k byte-level BPE file; operators take any other as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def id_type(path: str) -> str:
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
    return "<u2" if size <= 1 << 16 else "<u4"
