"""Alignment of two tokenizers over a corpus, in Arrow.

Every text, with a space in front, is encoded by A (byte-level BPE) and, as
it is, by B (sentencepiece BPE, which adds the space).  Where both tokenizers
end a token at the same byte the tokens are cut into groups, and every A token
is linked with every B token that shares a byte with it.  A link is weighed by
how often its id pair is linked in the whole corpus.

A batch is a pipeline over Arrow arrays, without a loop over tokens:

* the id lists are flattened, with the parent index of every token;
* token lengths, summed cumulatively and reset at each parent (segmented
  cumulative sum), are the byte ends; a text's key is its base, the bytes of
  all texts before it, so ``base + end`` is a **document-end key**;
* an Acero full outer hash join of the A and B tables on that key marks shared
  ends; between two successive ends of the joined table exactly one A and one
  B token overlap, so its rows, sorted, are the links, filled backwards;
* ``Table.group_by`` counts the pairs of each text (kept with the text) and of
  many texts together (partial counts, which Spark adds up).

Texts are encoded once: the groups' digest and the pair counts of each text are
written to the shared folder, and both the corpus-wide counts and the weights
are taken from there.  The most frequent pairs (at most ``HEAVY_PAIRS``, by a
threshold on the count) are broadcast; all other pairs of a text meet their
counts in a shuffle join by pair.  No pair of that join is frequent, so it has no
hot key, and both ways together cover every pair.

Defined results: a text that is NULL or empty, or whose bytes a tokenizer does
not give back (sentencepiece normalises some characters), has no tokens: zeros
and an empty digest.  Texts of any length are encoded whole.  Ties: all pairs
that share the highest count of a B id count as best.  Repeated rows are texts
of their own, in the counts and in the result; rows with a NULL id too.  An
empty table gives no rows.  Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols, read_model
from .common import release, short_batches, stored, text_blocks, worker_cache

HEAVY_PAIRS = 1_000_000        # rows of two numbers that are broadcast
FLUSH_PAIRS = 400_000          # distinct pairs a task holds before it hands them on
B_IDS = 1 << 31                # a pair is a_id * B_IDS + b_id

# Fixed value of the file format: how byte-level BPE splits a text.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokens:
    """A: byte-level BPE from a tokenizer file.  Merging by rank is done by
    tiktoken: in these files a merge's rank order is the order of the ids it
    makes, which is checked; special tokens are plain text."""

    def __init__(self, raw: bytes):
        import tiktoken
        spec = json.loads(raw)
        model = spec["model"]
        split = spec["pre_tokenizer"]
        if (model["type"], split["type"], split.get("add_prefix_space"), spec.get("normalizer")) != (
                "BPE", "ByteLevel", False, None):
            raise ValueError("A is a byte-level BPE file without prefix space or normaliser")
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError("the merges of A are not in the order of their ids")
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
        self.encoding = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class PieceTokens:
    """B: sentencepiece; a piece's bytes are its UTF-8 with U+2581 as space,
    or the byte it names."""

    def __init__(self, raw: bytes):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.bytes = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i)
                              else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Side:
    """One tokenizer with Arrow tables by token id: bytes, lengths, and the
    id's text with the mark that follows it inside and at the end of a group."""

    def __init__(self, tokens, end: str):
        self.encode = tokens.encode
        self.bytes = pa.array(tokens.bytes, pa.binary())
        self.lengths = pc.binary_length(self.bytes)
        names = [str(i) for i in range(len(tokens.bytes))]
        self.inner = pa.array([n + "," for n in names])
        self.final = pa.array([n + end for n in names])


def sides(model_a: bytes, model_b: bytes) -> tuple[Side, Side]:
    """Both tokenizers, once per Python worker."""
    key, kept = hashlib.sha256(model_a + model_b).hexdigest(), worker_cache()
    if kept.get("align", ("",))[0] != key:
        kept["align"] = key, (Side(ByteTokens(model_a), "|"), Side(PieceTokens(model_b), ";"))
    return kept["align"][1]


def segmented_ends(lists: pa.ListArray, lengths: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray]:
    """Of the tokens of all lists: ids, parent list, byte end within the
    parent; and the bytes of each list."""
    ids, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(pc.take(lengths, ids).cast(pa.int64()))
    bounds = np.concatenate([[0], total.to_numpy(zero_copy_only=False)])
    offsets = lists.offsets.to_numpy()
    before = bounds[offsets[:-1] - offsets[0]]
    size = bounds[offsets[1:] - offsets[0]] - before
    return ids, parent, pc.subtract(total, pc.take(pa.array(before), parent)), size


def same_bytes(side: Side, ids: pa.Array, size: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Texts that the joined bytes of their tokens give back.  The data buffer
    of the taken tokens is their concatenation."""
    data = pc.take(side.bytes, ids).buffers()[2]
    # as unsigned bytes: a view whose format is signed never equals a text's bytes above 127
    flat = memoryview(data).cast("B") if data is not None else b""
    at = np.concatenate([[0], np.cumsum(size)])
    return np.array([flat[at[i]:at[i + 1]] == t for i, t in enumerate(texts)], bool)


def link_table(a_end: pa.Table, b_end: pa.Table) -> pa.Table:
    """Every overlapping pair of tokens, in order: the ends of both sides
    (``key``, ``ia``, ``ib``: position of the token) joined in full; the tokens
    of a row without one of its own are the next ones of that side."""
    joined = a_end.join(b_end, "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    shared = pc.and_(pc.is_valid(joined["ia"]), pc.is_valid(joined["ib"]))
    return pa.table({"key": joined["key"], "ia": pc.fill_null_backward(joined["ia"]),
                     "ib": pc.fill_null_backward(joined["ib"]), "shared": shared})


def align_texts(texts: list[str], a: Side, b: Side) -> dict[str, pa.Array]:
    """Per text: numbers of tokens, groups and links, the groups as a string,
    and its id pairs with their counts (lists, one Arrow value per text)."""
    n = len(texts)
    want = [b" " + t.encode() for t in texts]
    lists = [pa.array(side.encode(texts), pa.list_(pa.int32())) for side in (a, b)]
    good = np.array([bool(t) for t in texts], bool)
    for side, ids in zip((a, b), lists):
        flat, _, _, size = segmented_ends(ids, side.lengths)
        good &= same_bytes(side, flat, size, want)
    # a text without tokens has empty lists from here on
    keep = pa.array(good)
    lists = [pc.if_else(keep, x, pa.scalar([], pa.list_(pa.int32()))) for x in lists]
    (ida, pa_, ea, size), (idb, pb, eb, _) = (segmented_ends(x, s.lengths) for x, s in zip(lists, (a, b)))
    base = pa.array(np.cumsum(size) - size)
    ends = [pa.table({"key": pc.add(e, pc.take(base, p)), name: pa.array(np.arange(len(e)))})
            for e, p, name in ((ea, pa_, "ia"), (eb, pb, "ib"))]
    links = link_table(*ends)
    parent = pc.take(pa_, links["ia"].combine_chunks())
    ia, ib = (links[c].combine_chunks() for c in ("ia", "ib"))
    shared = links["shared"].combine_chunks()
    la, lb = pc.take(ida, ia).cast(pa.int64()), pc.take(idb, ib).cast(pa.int64())
    counts = lambda p: np.bincount(p.to_numpy(), minlength=n)
    pairs = (pa.table({"doc": parent, "pair": pc.add(pc.multiply(la, B_IDS), lb)})
             .group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by([("doc", "ascending"), ("pair", "ascending")]))
    of_doc = np.bincount(pairs["doc"].to_numpy(), minlength=n)
    cuts = pa.array(np.concatenate([[0], np.cumsum(of_doc)]).astype(np.int32))
    flat = lambda c: pairs[c].combine_chunks()
    return {
        "n_a": counts(pa_), "n_b": counts(pb),
        "n_groups": np.bincount(parent.to_numpy()[shared.to_numpy(zero_copy_only=False)], minlength=n),
        "n_links": counts(parent),
        "groups": group_strings(n, a, b, ida, idb, pa_, pb, ia, ib, shared),
        "pairs": pa.ListArray.from_arrays(cuts, flat("pair")),
        "times": pa.ListArray.from_arrays(cuts, flat("count_all")),
    }


def group_strings(n, a, b, ida, idb, pa_, pb, ia, ib, shared) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` of every text: each token's text with the mark
    behind it, in the order group, side, token, joined per text."""
    cut = shared.to_numpy(zero_copy_only=False)
    # tokens that end a group, and the group of every token
    last = [np.zeros(len(x), bool) for x in (ida, idb)]
    last[0][ia.to_numpy()[cut]] = True
    last[1][ib.to_numpy()[cut]] = True
    group = [np.cumsum(x) - x for x in last]
    size = [np.bincount(g, minlength=int(cut.sum())) for g in group]
    # A tokens follow the B tokens of earlier groups, B tokens also the A tokens of their own
    place_a = np.arange(len(ida)) + (np.cumsum(size[1]) - size[1])[group[0]]
    place_b = np.arange(len(idb)) + np.cumsum(size[0])[group[1]]
    parts = [pc.if_else(pa.array(l), pc.take(side.final, i), pc.take(side.inner, i))
             for side, i, l in ((a, ida, last[0]), (b, idb, last[1]))]
    order = np.empty(len(ida) + len(idb), np.int64)
    order[place_a] = np.arange(len(ida))
    order[place_b] = np.arange(len(idb)) + len(ida)
    text = pc.take(pa.concat_arrays(parts), pa.array(order))
    tokens = np.bincount(pa_.to_numpy(), minlength=n) + np.bincount(pb.to_numpy(), minlength=n)
    offsets = pa.array(np.concatenate([[0], np.cumsum(tokens)]).astype(np.int32))
    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, text), "")
    return pc.utf8_rtrim(joined, ";")


class PairCounts:
    """Partial pair counts of a task, handed on when they grow."""

    def __init__(self):
        self.parts, self.rows = [], 0

    def add(self, pairs: pa.Array, times: pa.Array):
        self.parts.append(pa.table({"pair": pairs, "n": times}))
        self.rows += len(pairs)

    def merged(self) -> pa.Table:
        whole = pa.concat_tables(self.parts).group_by("pair", use_threads=False).aggregate([("n", "sum")])
        return whole.rename_columns(["pair", "n"])

    def flush(self, most: int):
        """Record batches to hand on, if more than ``most`` pairs are held."""
        if self.rows > 2 * most:
            whole = self.merged()
            self.parts, self.rows = [whole], len(whole)
        if self.rows > most:
            yield from self.merged().to_batches()
            self.parts, self.rows = [], 0


def _document_links(src: DataFrame, model_a: bytes, model_b: bytes) -> DataFrame:
    def run(batches):
        a, b = sides(model_a, model_b)
        for batch in batches:
            for first, stop, _, _ in text_blocks(batch, "text"):
                part = batch.slice(first, stop - first)
                texts = [t or "" for t in part.column(1).to_pylist()]
                got = align_texts(texts, a, b)
                digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in got["groups"].to_pylist()]
                numbers = [pa.array(got[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *numbers, pa.array(digest), got["pairs"], got["times"]],
                    names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
            release()

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
                               "groups_sha256 string, pairs array<bigint>, times array<bigint>")


def _flat_lists(batch) -> tuple[pa.Array, pa.Array, pa.Array]:
    return (pc.list_parent_indices(batch.column("pairs")), pc.list_flatten(batch.column("pairs")),
            pc.list_flatten(batch.column("times")))


def pair_counts(links: DataFrame) -> DataFrame:
    """``pair``, ``n``: links of every id pair in the corpus."""
    def run(batches):
        held = PairCounts()
        for batch in batches:
            _, pairs, times = _flat_lists(batch)
            held.add(pairs, times)
            yield from held.flush(FLUSH_PAIRS)
        if held.rows:
            yield from held.merged().to_batches()

    partial = links.select("pairs", "times").mapInArrow(run, "pair bigint, n bigint")
    return partial.groupBy("pair").agg(F.sum("n").alias("n"))


def _threshold(counts: DataFrame, most: int) -> int:
    """Smallest power of two such that at most ``most`` pairs have that count
    or more (a histogram of at most 63 rows)."""
    size = {r["e"]: r["m"] for r in counts.groupBy(F.floor(F.log2(F.col("n") + 0.5)).cast("int").alias("e"))
            .agg(F.count(F.lit(1)).alias("m")).collect()}
    held = 0
    for e in range(62, -1, -1):
        held += size.get(e, 0)
        if held > most:
            return 2 << e
    return 1


class Weights:
    """Counts of the frequent pairs, sorted, and the best count of every B id."""

    def __init__(self, pair: np.ndarray, n: np.ndarray, b: np.ndarray, top: np.ndarray):
        order = np.argsort(pair)
        self.pair, self.n = pair[order], n[order]
        self.best = np.zeros(int(b.max()) + 1 if len(b) else 0, np.int64)
        self.best[b] = top

    def look_up(self, pairs: np.ndarray) -> np.ndarray:
        """Count of each pair, 0 where it is not a frequent one."""
        if not len(self.pair):
            return np.zeros(len(pairs), np.int64)
        at = np.minimum(np.searchsorted(self.pair, pairs), len(self.pair) - 1)
        return np.where(self.pair[at] == pairs, self.n[at], 0)


def alignment(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
              heavy_pairs: int = HEAVY_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Two tables: per document ``id_col``, ``n_a``, ``n_b``, ``n_groups``,
    ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``; and the corpus's
    ``a_id``, ``b_id``, ``n`` of every linked id pair."""
    spark = df.sparkSession
    short_batches(spark)
    model_a, model_b = read_model(path_a), read_model(path_b)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # the row number is written with the row, so it stays the same in every later read
    links = stored(_document_links(src, model_a, model_b).withColumn("row", F.monotonically_increasing_id()), "align-links")
    counts = stored(pair_counts(links), "align-counts")
    b_of = F.pmod("pair", F.lit(B_IDS)).cast("int")
    best = counts.groupBy(b_of.alias("b")).agg(F.max("n").alias("n"))           # at most one row per B id
    least = _threshold(counts, heavy_pairs)
    # plain arrays: executors need no copy of this package
    heavy, top = (t.toArrow() for t in (counts.where(F.col("n") >= least), best))
    weights = spark.sparkContext.broadcast([t[c].to_numpy() for t, c in (
        (heavy, "pair"), (heavy, "n"), (top, "b"), (top, "n"))])

    out = _weighed(links, weights)
    if least > 1:
        out = _with_rest(stored(out, "align-weighed"), counts.where(F.col("n") < least), best, b_of)
    cols = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    pairs = counts.select(F.floor(F.col("pair") / B_IDS).cast("int").alias("a_id"), b_of.alias("b_id"), "n")
    return out.select(F.col("id").alias(id_col), *cols), pairs


def _weighed(links: DataFrame, weights) -> DataFrame:
    """The links' rows with the part of ``n_best`` and ``count_sum`` that the
    frequent pairs give, and the other pairs with their times."""
    kept = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches):
        w = Weights(*weights.value)
        for batch in batches:
            parent, pairs, times = (x.to_numpy(zero_copy_only=False) for x in _flat_lists(batch))
            n = w.look_up(pairs)
            best = n * (n == w.best[pairs % B_IDS]) > 0
            size = batch.num_rows
            # sums of whole numbers, exact
            total, hits = np.zeros(size, np.int64), np.zeros(size, np.int64)
            np.add.at(total, parent, n * times)
            np.add.at(hits, parent, best * times)
            rest = n == 0
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(parent[rest], minlength=size))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x[rest])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(hits), pa.array(total), *lists],
                names=[*kept, "n_best", "count_sum", "pairs", "times"])

    fields = ", ".join(f"{c} {links.schema[c].dataType.simpleString()}" for c in kept)
    return links.select(*kept, "pairs", "times").mapInArrow(
        run, f"{fields}, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>")


def _with_rest(out: DataFrame, counts: DataFrame, best: DataFrame, b_of) -> DataFrame:
    """Adds the part of the pairs that are not frequent: a shuffle join by
    pair (each in few texts), added up per text."""
    # at most one row per id of B's vocabulary, whose file is bounded
    marked = (counts.withColumn("b", b_of).join(F.broadcast(best.withColumnRenamed("n", "top")), "b")
              .select("pair", "n", (F.col("n") == F.col("top")).alias("is_best")))
    asked = (out.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e"))
             .select("row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times")))
    more = (asked.join(marked, "pair")
            .groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("sum"),
                                F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("hits")))
    return (out.join(more, "row", "left")
            .withColumn("n_best", F.col("n_best") + F.coalesce("hits", F.lit(0)))
            .withColumn("count_sum", F.col("count_sum") + F.coalesce("sum", F.lit(0))))
