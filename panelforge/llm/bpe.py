"""Byte-pair encoding and decoding with a given vocabulary file.

Every text is split into pieces as the vocabulary's normaliser and splitter
prescribe; each piece is merged with a **segment tree over its adjacent pair
ranks**: a leaf holds ``rank * length + position`` of the pair that starts
there, an inner node the smaller of its children, so the root names the
leftmost pair of lowest rank.  A merge changes three leaves, each in
O(log length); merging ends when the root is infinite.  A piece of n symbols
costs O(n log n), however long it is.

The work is one map over the documents: no shuffle, whole texts, bounded
memory (a word cache of fixed size per worker).  The vocabulary file is read
on the driver (its size is checked) and shipped with the task.

Defined results: NULL and empty text give no tokens and an empty decoding;
repeated rows give repeated results; every other column is ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase, Sequence
from tokenizers.pre_tokenizers import Split

from .common import release, worker_cache

MAX_MODEL_BYTES = 64 << 20      # a larger vocabulary file is refused
CACHE_WORDS = 500_000           # distinct words, and pieces, a worker remembers
LONG_WORD = 64                  # longer words are not remembered

# Fixed values of the file format: its split pattern, white space, and the
# printable stand-ins of the 256 bytes.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{L}{N}]+"
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
END = "</w>"


def byte_symbols() -> list[str]:
    """Printable bytes stand for themselves, the others for U+0100 onwards."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def character_class(name: str) -> str:
    """Ranges of the characters in a Unicode class, by the tables (and the
    Unicode version) of the tokenizers library."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    runs = Split(Regex(f"\\p{{{name}}}+"), "removed", invert=True).pre_tokenize_str(every)
    return "".join(f"{run[0]}-{run[-1]}" for run, _ in runs)


class PairTree:
    """Minimum segment tree over the pairs of one symbol list."""

    INF = 1 << 62

    def __init__(self, keys: list[int]):
        self.size = size = 1 << max(0, (len(keys) - 1).bit_length())
        self.node = [self.INF] * size + keys + [self.INF] * (size - len(keys))
        node = self.node
        for i in range(size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a <= b else b

    def root(self) -> int:
        return self.node[1]

    def put(self, i: int, key: int) -> None:
        node = self.node
        i += self.size
        node[i] = key
        while i > 1:
            other = node[i ^ 1]
            key = key if key <= other else other
            i >>= 1
            if node[i] == key:
                return
            node[i] = key


class BpeModel:
    """Vocabulary, merge ranks and the split rules of one tokenizer file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        if model.get("end_of_word_suffix") != END or spec.get("decoder") is not None:
            raise ValueError("this operator reads BPE files with word ends and no decoder")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ids = self.vocab[a], self.vocab[b]
            self.ranks.setdefault(ids, (rank, self.vocab[a + b]))
        symbols = byte_symbols()
        self.inner = [self.vocab.get(s) for s in symbols]
        self.final = [self.vocab.get(s + END) for s in symbols]
        self.splitter = re.compile(SPLIT.replace("{L}", character_class("L"))
                                   .replace("{N}", character_class("N")))
        self.white = re.compile(f"[{WHITE}]+")
        names = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, names))) if names else None
        self.fold = Sequence([NFC(), Lowercase()]).normalize_str
        self.words = RecentCache(self.encode_word)
        self.pieces = RecentCache(self.encode_piece)

    def merge(self, ids: list[int]) -> list[int]:
        """Merge one piece's symbols until no known pair is left."""
        n = len(ids)
        if n < 2:
            return ids
        ranks, inf = self.ranks, PairTree.INF
        merged = [0] * n
        keys = []
        for i in range(n - 1):
            r = ranks.get((ids[i], ids[i + 1]))
            if r is None:
                keys.append(inf)
            else:
                keys.append(r[0] * n + i)
                merged[i] = r[1]
        tree = PairTree(keys)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := tree.node[1]) < inf:
            i = top % n
            j = after[i]
            ids[i] = merged[i]
            ids[j] = -1
            after[i] = k = after[j]
            if j < n - 1:
                tree.put(j, inf)
            if k < n:
                before[k] = i
                r = ranks.get((ids[i], ids[k]))
            else:
                r = None
            if r is None:
                tree.put(i, inf)
            else:
                merged[i] = r[1]
                tree.put(i, r[0] * n + i)
            p = before[i]
            if p >= 0:
                r = ranks.get((ids[p], ids[i]))
                if r is None:
                    tree.put(p, inf)
                else:
                    merged[p] = r[1]
                    tree.put(p, r[0] * n + p)
        return [x for x in ids if x >= 0]

    def encode_piece(self, piece: str) -> bytes:
        """Token ids (little-endian 32-bit) of one split piece."""
        raw = piece.encode()
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.final[raw[-1]])
        return np.array(self.merge([x for x in ids if x is not None]), "<u4").tobytes()

    def encode_word(self, word: str) -> bytes:
        """Token ids of one run without white space."""
        return b"".join(map(self.pieces.__getitem__, self.splitter.findall(self.fold(word))))

    def encode_plain(self, text: str) -> bytes:
        parts = self.white.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return b"".join(map(self.words.__getitem__, parts))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.marks is None or "<" not in text:
            return self.encode_plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self.encode_plain(text[at:m.start()]),
                    self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self.encode_plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class RecentCache(dict):
    """Results for recent short strings, in two generations of bounded size."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.compute(key) if key else b""
        if len(key) <= LONG_WORD:
            if len(self) >= CACHE_WORDS // 2:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids


def model_of(raw: bytes) -> BpeModel:
    """The parsed model, once per Python worker."""
    key, kept = hashlib.sha256(raw).hexdigest(), worker_cache()
    if kept.get("bpe", ("",))[0] != key:
        kept["bpe"] = key, BpeModel(raw)
    return kept["bpe"][1]


def read_model(path: str) -> bytes:
    """The vocabulary file as bytes; refused beyond ``MAX_MODEL_BYTES``."""
    with open(path, "rb") as f:
        raw = f.read(MAX_MODEL_BYTES + 1)
    if len(raw) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    return raw


def bpe_encode(df: DataFrame, model: bytes, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` long, ``ids`` binary (little-endian unsigned
    32-bit), ``decoded`` string: the tokens' strings joined by one space, as
    the file prescribes no decoder."""
    def run(batches):
        m = model_of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids = [m.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array(ids, pa.binary()), pa.array([m.decode(x) for x in ids], pa.string())],
                    names=["id", "n_tokens", "ids", "decoded"])
            release()

    src = df.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS STRING) AS text")
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)
