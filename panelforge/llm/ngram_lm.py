"""Language-model scoring by deleted interpolation.

A bigram model over the words of all training texts:

    P(w|v) = a_b * c(v,w)/c(v) + u_b * c(w)/N + z_b / (V + 1)

The three weights depend on the bucket b of the context's frequency c(v)
(powers of two) and are learned by expectation-maximisation on held-out
counts: every occurrence in the training texts, all of them, is deleted from
the counts before they predict it.

How it runs.  Texts are encoded once into blocks of word hashes and stored in
the shared folder.  A block asks for the counts of its distinct words, then of
its distinct word pairs: keys go to buckets by hash, each bucket adds up what
the training texts of all blocks hold and answers every block in the order it
asked.  So a frequent word costs one entry per block, not one per occurrence;
no key, document or count passes through the driver.  The number of buckets
follows the number of keys (``KEYS_PER_BUCKET``), so a task's memory does not
grow with the corpus.  The driver sees N, V and the EM table, whose size is
fixed by its bins (frequency bucket by two quantised log probabilities).

Within its bucket a word pair is known by 40 bits of its hash, so one pair in
about a million shares its count with another one, at any corpus size.

Defined results: NULL counts as empty text, whose only token is the end;
repeated rows are separate texts; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, mix, pack, stored, text_blocks, unpack, word_hashes

BLOCK = 6 << 20                # text bytes in a block
KEYS_PER_BUCKET = 2_000_000
END, START = np.uint64(0x454E44), np.uint64(0x5354415254)
EM_ROUNDS = 60
FREQUENCIES = 40               # context-frequency buckets: 0, 1, 2-3, 4-7, ...
STEP = 4                       # EM bins per power of two of a probability
WEIGHT_FLOOR = 1e-4            # least weight of the uniform part
ADD = 0.1                      # of the base score


def _with_ends(words: np.ndarray, n: np.ndarray):
    """Insert the end token after every text."""
    ends = np.cumsum(n)
    return np.insert(words, ends, END), n + 1


def _contexts(idx: np.ndarray, n: np.ndarray, start: int) -> np.ndarray:
    prev = np.empty_like(idx)
    prev[1:] = idx[:-1]
    prev[np.cumsum(n) - n] = start
    return prev


def encode(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs(id, text, train)``: distinct word hashes (sorted) with
    their training counts, and the texts as positions among them."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column("id")
            train = np.asarray(batch.column("train")).astype(bool)
            for a, b, data, off in text_blocks(batch, "text", BLOCK):
                words, n = _with_ends(*word_hashes(data, off, SPACED))
                uniq, idx = np.unique(words, return_inverse=True)
                idx = idx.astype(np.uint32)
                seen = np.repeat(train[a:b], n)
                counts = np.bincount(idx[seen], minlength=len(uniq)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) | seq], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids.slice(a, b - a)),
                     pa.array([pack(train[a:b].astype(np.uint8))], pa.binary()),
                     pa.array([pack(n.astype(np.uint32))], pa.binary()),
                     pa.array([uniq.tobytes()], pa.binary()), pa.array([pack(counts)], pa.binary()),
                     pa.array([pack(uniq.astype(np.uint16))], pa.binary()), pa.array([pack(idx)], pa.binary()),
                     pa.array([len(uniq)], pa.int64()), pa.array([int(seen.sum())], pa.int64()),
                     pa.array([int(train[a:b].sum())], pa.int64())],
                    names=["block", "ids", "train", "n", "uniq", "counts", "code", "idx", "n_uniq",
                           "n_train", "n_texts"])
                seq += 1

    return docs.mapInArrow(run, f"block bigint, ids array<{kind}>, train binary, n binary, uniq binary, "
                                "counts binary, code binary, idx binary, n_uniq bigint, n_train bigint, n_texts bigint")


def _asked(block, buckets, keys, counts, order, n_buckets):
    """One row per bucket that a block asks, with the keys in asking order."""
    edges = np.searchsorted(buckets[order], np.arange(n_buckets + 1))
    full = [b for b in range(n_buckets) if edges[b] < edges[b + 1]]
    take = [order[edges[b]:edges[b + 1]] for b in full]
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * len(full), pa.int64()), pa.array(full, pa.int32()),
         pa.array([keys[t].tobytes() for t in take], pa.binary()),
         pa.array([pack(counts[t]) for t in take], pa.binary())],
        names=["block", "bucket", "keys", "counts"])


def _answer(width: int):
    """Adds up a bucket's counts and answers each block in asking order.
    Keys are unsigned integers of ``width`` bytes."""
    def run(group: pa.Table) -> pa.Table:
        raw = [np.frombuffer(b.as_buffer(), np.uint8).reshape(-1, width) for b in group.column("keys")]
        wide = np.zeros((sum(map(len, raw)), 8), np.uint8)
        wide[:, :width] = np.concatenate(raw)
        keys = wide.reshape(-1).view(np.uint64)
        counts = np.concatenate([unpack(b.as_py(), np.uint32) for b in group.column("counts")])
        uniq, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(uniq)).astype(np.uint64)
        back, at, replies = total[inverse], 0, []
        for r in raw:
            replies.append(pack(back[at:at + len(r)]))
            at += len(r)
        known = [0] * len(raw)
        known[0] = int((total > 0).sum())
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"),
                         "totals": pa.array(replies, pa.binary()), "known": pa.array(known, pa.int64())})

    return run


ANSWER = "block bigint, bucket int, totals binary, known bigint"


def _bits(n_keys: int) -> int:
    return max(4, (max(1, -(-n_keys // KEYS_PER_BUCKET)) - 1).bit_length())


def count_words(blocks: DataFrame, bits: int) -> DataFrame:
    """Training totals of every block's words, by leading bits of the hash."""
    def ask(batches):
        for batch in batches:
            for block, uniq, counts in zip(batch.column("block").to_pylist(), batch.column("uniq"),
                                           batch.column("counts")):
                uniq = np.frombuffer(uniq.as_buffer(), np.uint64)
                bucket = (uniq >> np.uint64(64 - bits)).astype(np.int64)
                yield _asked(block, bucket, uniq, unpack(counts.as_py(), np.uint32),
                             np.arange(len(uniq)), 1 << bits)

    asked = blocks.select("block", "uniq", "counts").mapInArrow(
        ask, "block bigint, bucket int, keys binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(_answer(8), ANSWER)


def _block_pairs(idx, n, code, bits):
    """Distinct (context, word) position pairs of a block, sorted; each
    occurrence's place among them; each pair's bucket."""
    m = np.uint64(len(code))
    code_of = np.append(code, np.uint16(0xABCD))          # the start context
    prev = _contexts(idx.astype(np.uint64), n, int(m))
    pairs, inverse = np.unique(prev * m + idx, return_inverse=True)
    v, w = (pairs // m).astype(np.int64), (pairs % m).astype(np.int64)
    route = mix((code_of[v].astype(np.uint64) << np.uint64(16)) | code[w].astype(np.uint64))
    bucket = (route >> np.uint64(64 - bits)).astype(np.int64)
    return prev, v, w, inverse, bucket, np.argsort(bucket, kind="stable")


def count_pairs(blocks: DataFrame, bits: int) -> DataFrame:
    """Training totals of every block's word pairs."""
    def ask(batches):
        for batch in batches:
            row = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                get = lambda c, t: unpack(row[c][i].as_py(), t)  # noqa: E731, B023
                n, idx, train = get("n", np.uint32).astype(np.int64), get("idx", np.uint32), get("train", np.uint8)
                uniq = np.append(np.frombuffer(row["uniq"][i].as_buffer(), np.uint64), START)
                _, v, w, inverse, bucket, order = _block_pairs(idx, n, get("code", np.uint16), bits)
                seen = np.repeat(train, n).astype(bool)
                counts = np.bincount(inverse[seen], minlength=len(v)).astype(np.uint32)
                with np.errstate(over="ignore"):
                    key = mix(uniq[v] * np.uint64(0x9E3779B97F4A7C15) + uniq[w])
                five = key.view(np.uint8).reshape(-1, 8)[:, :5]
                yield _asked(row["block"][i].as_py(), bucket, five, counts, order, 1 << bits)

    asked = blocks.select("block", "train", "n", "uniq", "code", "idx").mapInArrow(
        ask, "block bigint, bucket int, keys binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(_answer(5), ANSWER)


class Block:
    """One block's texts together with the counts it asked for."""

    def __init__(self, mine: pa.Table, theirs: pa.Table, bits: int, texts: int):
        get = lambda c, t: unpack(mine.column(c)[0].as_py(), t)
        self.ids = mine.column("ids").combine_chunks().flatten()
        self.train, self.n = get("train", np.uint8).astype(bool), get("n", np.uint32).astype(np.int64)
        idx, code = get("idx", np.uint32), get("code", np.uint16)
        replies = sorted(zip(theirs.column("kind").to_pylist(), theirs.column("bucket").to_pylist(),
                             range(theirs.num_rows)))
        join = lambda k: np.concatenate([np.zeros(0, np.uint64)] + [
            unpack(theirs.column("totals")[i].as_py(), np.uint64) for kind, _, i in replies if kind == k])
        words = join("word")
        prev, v, w, inverse, bucket, order = _block_pairs(idx, self.n, code, bits)
        pairs = np.empty(len(v), np.uint64)
        pairs[order] = join("pair")
        self.word = words[idx].astype(np.float64)                      # c(w)
        self.context = np.append(words, np.uint64(texts))[prev.astype(np.int64)].astype(np.float64)   # c(v)
        self.pair = pairs[inverse].astype(np.float64)                  # c(v, w)


def _frequency(c: np.ndarray) -> np.ndarray:
    """Bucket of a context frequency: 0, then powers of two."""
    return np.minimum(np.frexp(c)[1], FREQUENCIES - 1)


def _joined(blocks: DataFrame, words: DataFrame, pairs: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over each block together with its replies."""
    replies = (words.select("block", "bucket", "totals", F.lit("word").alias("kind"))
               .unionByName(pairs.select("block", "bucket", "totals", F.lit("pair").alias("kind"))))
    mine = blocks.select("block", "ids", "train", "n", "code", "idx")
    return mine.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def learn_weights(blocks, words, pairs, bits: int, n_tokens: int, n_types: int, texts: int) -> np.ndarray:
    """EM on the deleted counts of all blocks: weights (pair, word,
    uniform) of every context-frequency bucket."""
    def table(mine, theirs):
        k = Block(mine, theirs, bits, texts)
        seen = np.repeat(k.train, k.n)
        cv, cw, cvw = k.context[seen] - 1, k.word[seen] - 1, k.pair[seen] - 1
        f = _frequency(cv)
        with np.errstate(divide="ignore", invalid="ignore"):
            p2 = np.where(cv > 0, np.maximum(cvw, 0) / np.maximum(cv, 1), 0.0)
            b2 = np.where(p2 > 0, np.round(STEP * np.log2(p2)), 1).astype(np.int64)      # 1: zero
            b1 = np.where(cw > 0, np.round(STEP * np.log2(cw / max(n_tokens - 1, 1))), 1).astype(np.int64)
        key, n = np.unique(np.column_stack([f, b2, b1]), axis=0, return_counts=True) if len(f) else (
            np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
        return pa.table({"f": key[:, 0].astype(np.int64), "b2": key[:, 1].astype(np.int64),
                         "b1": key[:, 2].astype(np.int64), "n": n.astype(np.int64)})

    got = (_joined(blocks, words, pairs, table, "f bigint, b2 bigint, b1 bigint, n bigint")
           .groupBy("f", "b2", "b1").agg(F.sum("n").alias("n")).toArrow())
    f, b2, b1, n = (got.column(c).to_numpy() for c in ("f", "b2", "b1", "n"))
    p = np.column_stack([np.where(b2 > 0, 0.0, 2.0 ** (b2 / STEP)), np.where(b1 > 0, 0.0, 2.0 ** (b1 / STEP)),
                         np.full(len(n), 1.0 / (n_types + 1))])
    weights = np.tile([0.2, 0.7, 0.1], (FREQUENCIES, 1))
    for _ in range(EM_ROUNDS):
        part = weights[f] * p
        part *= (n / part.sum(axis=1))[:, None]
        for i in range(3):
            # one pseudo-count keeps buckets without held-out tokens defined
            weights[:, i] = np.bincount(f, weights=part[:, i], minlength=FREQUENCIES) + (0.2, 0.7, 0.1)[i]
        weights[0, 0] = 0.0
        weights /= weights.sum(axis=1, keepdims=True)
    weights[:, 2] = np.maximum(weights[:, 2], WEIGHT_FLOOR)
    return weights / weights.sum(axis=1, keepdims=True)


def score_texts(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (add-0.1 unigram) and ``score`` (the model), both log10 of
    the text's probability.  ``train`` is a condition on the id."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                      train(F.col(id_col)).alias("train"))
    blocks = stored(encode(src), "lm-blocks")
    size = blocks.agg(F.sum("n_uniq"), F.sum("n_train"), F.sum("n_texts"),
                      F.sum(F.octet_length("idx")), F.count(F.lit(1))).first()
    kind = src.schema["id"].dataType.simpleString()
    schema = (f"id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, "
              "base_score double, score double")
    if not size[4]:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    n_tokens, texts = int(size[1]), int(size[2])
    words = stored(count_words(blocks, _bits(int(size[0]))), "lm-words")
    n_types = int(words.agg(F.sum("known")).first()[0])
    # packed positions take about two bytes a token, an upper bound of pairs
    bits = _bits(int(size[3]) // 2)
    pairs = stored(count_pairs(blocks, bits), "lm-pairs")
    weights = learn_weights(blocks, words, pairs, bits, n_tokens, n_types, texts)

    def run(mine, theirs):
        k = Block(mine, theirs, bits, texts)
        first = np.cumsum(k.n) - k.n
        total = lambda x: np.add.reduceat(x, first)
        w = weights[_frequency(k.context)]
        p = (w[:, 0] * k.pair / np.maximum(k.context, 1) + w[:, 1] * k.word / max(n_tokens, 1)
             + w[:, 2] / (n_types + 1))
        base = np.log10((k.word + ADD) / (n_tokens + ADD * (n_types + 1)))
        return pa.table({"id": k.ids, "n_tokens": k.n, "n_known": total((k.word > 0).astype(np.int64)),
                         "train_tokens": np.full(len(k.n), n_tokens, np.int64),
                         "base_score": total(base), "score": total(np.log10(p))})

    return _joined(blocks, words, pairs, run, schema).withColumnRenamed("id", id_col)
