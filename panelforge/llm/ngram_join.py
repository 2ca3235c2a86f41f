"""Similarity join on word n-grams: MinHash banding, exact verification.

Every text is its set of word n-grams (five words; a text of fewer words is
one n-gram).  Texts are first grouped into classes of equal texts; one sketch
stands for a class, so exact copies never multiply.  Bands and rows follow
from the threshold and the target recall (``choose_bands``): texts whose
MinHash rows agree in one band meet in that band's bucket.

Buckets are shuffled by band hash.  A bucket of more than ``BLOCK`` classes is
dealt into blocks, and each pair of blocks is one unit of work, so a group of
any size spreads over many tasks and none is held whole.  A pair of classes is
looked at in the first band that both share and nowhere else: a first pass over
the sketches alone finds which classes a unit really needs, a second one
brings their full n-gram sets and verifies the pairs.  Pairs exist only inside
a unit; out come each class's number of links and a spanning forest of the
similar pairs, from which connected components follow.

A large bucket mostly holds variants of one text, all similar to one another.
Their links are counted without comparing them in pairs: Jaccard distance is a
metric, so classes within half the allowed distance of one set, the pivot, are
all similar to each other.  The classes of a bucket of more than ``BLOCK`` are
compared once with a pivot, the n-grams that most of about ``PIVOT_SAMPLE`` of
them hold; those near it form a core, whose pairs enter no unit.  The pivot
decides only which pairs need no comparison, never which are links.  What lies
outside the core is still compared in pairs with the rest of its bucket.

The result has one row per document: its class of near-duplicates (component),
its class of equal texts, and its number of links (other documents with
Jaccard similarity at the threshold or above, copies included).

Defined results: NULL counts as empty text; equal texts are copies of each
other even without words, but different texts without words are not similar;
repeated rows are separate documents; other columns are ignored.  A class of
equal texts is known by a 64-bit hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, bounded, mix, stored, text_blocks, word_hashes
from .components import connected_components

N_WORDS = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
MAX_HASHES = 128
BLOCK = 512                    # classes in a block
PIVOT_SAMPLE = 64              # classes of a large bucket that vote on its pivot
DENSE = 16                     # units above this size are verified by matrix product


def choose_bands(threshold: float = THRESHOLD, recall: float = TARGET_RECALL,
                 max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band (fewest chance meetings) for
    which a pair at the threshold is found with the target probability
    within ``max_hashes`` hash functions."""
    for rows in range(max_hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows)) if threshold < 1 else 1
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("no banding reaches the target recall within max_hashes")


def shingles(data: np.ndarray, off: np.ndarray, n_words: int):
    """Hashes of the n-grams of a block of texts in text order, and their
    number per text."""
    h, n = word_hashes(data, off, ALNUM)
    count = np.where(n >= n_words, n - n_words + 1, np.minimum(n, 1))
    if len(h) == 0:
        return h, count
    first = np.cumsum(n) - n
    ends = np.repeat(first + n, n)
    at = np.arange(len(h))
    out = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n_words):
            inside = at + k < ends
            nxt = np.zeros(len(h), np.uint64)
            nxt[inside] = h[at[inside] + k]
            out = out * np.uint64(0x9E3779B97F4A7C15) + nxt
    keep = (ends - at >= n_words) | (at == np.repeat(first, n))
    return mix(out[keep]), count


def band_hashes(s: np.ndarray, count: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) band hashes; texts without n-grams get zeros."""
    rng = np.random.default_rng(20140801)
    a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    full = np.flatnonzero(count)
    out = np.zeros((len(count), bands), np.uint64)
    if len(full) == 0:
        return out
    first = (np.cumsum(count) - count)[full]
    with np.errstate(over="ignore"):
        for band in range(bands):
            key = np.full(len(full), np.uint64(band + 1))
            for r in range(band * rows, band * rows + rows):
                low = np.minimum.reduceat(s * a[r] + b[r], first)
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
            out[full, band] = key
    return out


def sketch(docs: DataFrame, n_words: int, bands: int, rows: int) -> DataFrame:
    """(c, id, bands): class, id and band hashes of ``docs(id, text, c)``."""
    def run(batches):
        for batch in batches:
            for a, b, data, off in text_blocks(batch, "text"):
                s, count = shingles(data, off, n_words)
                keys = band_hashes(s, count, bands, rows).view(np.int64)
                some = count > 0
                offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("c").slice(a, b - a), batch.column("id").slice(a, b - a),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].reshape(-1)))],
                    names=["c", "id", "bands"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("c", "id", "text").mapInArrow(run, f"c bigint, id {kind}, bands array<bigint>")


def shingle_sets(texts: DataFrame, n_words: int) -> DataFrame:
    """(c, grams): sorted distinct n-gram hashes (8 bytes each) of
    ``texts(c, text)``."""
    def run(batches):
        for batch in batches:
            for a, b, data, off in text_blocks(batch, "text"):
                s, count = shingles(data, off, n_words)
                ends = np.cumsum(count)
                blobs = [np.unique(s[e - k:e]).tobytes() for e, k in zip(ends, count)]
                yield pa.RecordBatch.from_arrays([batch.column("c").slice(a, b - a), pa.array(blobs, pa.binary())],
                                                 names=["c", "grams"])

    return texts.select("c", "text").mapInArrow(run, "c bigint, grams binary")


# --------------------------------------------------------------------------
# units of work: one pair of blocks of one bucket

UNIT = ["key", "lo", "hi"]


def units_of(batches):
    """Regroup sorted batches into tables that hold whole units."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        unit = np.column_stack([t.column(c).to_numpy() for c in UNIT])
        change = np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def unit_pairs(t: pa.Table):
    """For each unit of a table: (first row, stop row, i, j) with the pairs of
    rows to look at here: across blocks (or within one), in no band before
    this one, and not of one core."""
    unit = np.column_stack([t.column(c).to_numpy() for c in UNIT])
    edges = np.concatenate([[0], np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1, [len(unit)]])
    bands = t.column("bands").combine_chunks()
    bands = bands.flatten().to_numpy().reshape(len(unit), -1)
    block = t.column("block").to_numpy()
    core = t.column("core").combine_chunks()
    loose, core = core.is_null().to_numpy(zero_copy_only=False), core.fill_null(0).to_numpy()
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a < 2:
            continue
        key, lo, hi = unit[a]
        if lo == hi:
            i, j = np.triu_indices(b - a, 1)
        else:
            left, right = np.flatnonzero(block[a:b] == lo), np.flatnonzero(block[a:b] == hi)
            i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        mine = bands[a:b]
        band = int(np.flatnonzero(mine[0] == key)[0])
        own, free = core[a:b], loose[a:b]
        fresh = (own[i] != own[j]) | free[i] | free[j]
        for k in range(band):
            fresh &= mine[i, k] != mine[j, k]
        if fresh.any():
            yield int(a), int(b), i[fresh], j[fresh]


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of sets."""
    if len(sets) <= DENSE:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n > 1)
    place = np.full(len(n), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    both = np.zeros((len(sets), len(sets)), np.float64)
    step = 4096
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    cuts = np.searchsorted(column, np.arange(0, len(shared) + step, step))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        m = np.zeros((len(sets), step), np.float32)
        m[owner[a:b], column[a:b] - k * step] = 1
        both += m @ m.T                    # exact: sums of at most 4096 ones
    return both[i, j].astype(np.int64)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable row of each of ``n`` rows over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _needed(batches):
    for t in units_of(batches):
        keep = np.zeros(t.num_rows, bool)
        for a, _, i, j in unit_pairs(t):
            keep[a + i] = keep[a + j] = True
        if keep.any():
            yield from t.filter(pa.array(keep)).select(["c", "core", "block", *UNIT]).combine_chunks().to_batches()


def _verifier(threshold: float):
    def run(batches):
        for t in units_of(batches):
            c, n = t.column("c").to_numpy(), t.column("n").to_numpy()
            grams = t.column("grams").combine_chunks()
            for a, b, i, j in unit_pairs(t):
                sets = [np.frombuffer(grams[r].as_buffer(), np.uint64) for r in range(a, b)]
                size = np.array([len(x) for x in sets], np.int64)
                inter = overlaps(sets, i, j)
                ok = inter + 1e-9 >= threshold * (size[i] + size[j] - inter)
                i, j = i[ok], j[ok]
                if len(i) == 0:
                    continue
                weight = np.bincount(i, weights=n[a + j], minlength=b - a) + np.bincount(j, weights=n[a + i], minlength=b - a)
                root = _roots(b - a, i, j)
                rows = np.flatnonzero(weight > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[a + rows]), pa.array(c[a + root[rows]]), pa.array(weight[rows].astype(np.int64))],
                    names=["c", "root", "links"])

    return run


# --------------------------------------------------------------------------
# cores: classes of a large bucket that are all similar to one another

def _gram_rows(batches):
    """(g, gram) of every n-gram of the sets of a batch."""
    for batch in batches:
        for g, blob in zip(batch.column("g").to_numpy(), batch.column("grams")):
            grams = np.frombuffer(blob.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), g)), pa.array(grams)], names=["g", "gram"])


def _near_pivot(threshold: float):
    """Classes whose distance to the pivot is at most half of the allowed one."""
    half = (1 - threshold) / 2 - 1e-9

    def run(members: pa.Table, pivots: pa.Table) -> pa.Table:
        members = members.slice(0, members.num_rows if pivots.num_rows else 0)
        c, grams = members.column("c").combine_chunks(), members.column("grams").combine_chunks()
        pivot = pivots.column("pivot")[0].values.to_numpy() if len(c) else None
        core = pivots.column("core")[0].as_py() if len(c) else 0
        near = np.zeros(len(c), bool)
        for row in range(len(c)):
            own = np.frombuffer(grams[row].as_buffer(), np.int64)
            inter = len(np.intersect1d(own, pivot, assume_unique=True))
            union = len(own) + len(pivot) - inter
            near[row] = union - inter <= half * union
        c = c.filter(pa.array(near, pa.bool_()))
        return pa.table({"c": c, "core": pa.array(np.full(len(c), core), pa.int64())})

    return run


def find_cores(src: DataFrame, met: DataFrame, n_words: int, threshold: float) -> DataFrame | None:
    """(c, core): the core that a class of a large bucket belongs to (one at
    most), of ``met(key, c, m)``; None where no bucket is large.  A class is
    judged in its largest bucket only; buckets with the same pivot, as those of one
    text's variants have in most bands, share one core.  Members and copies of the
    pivot meet in blocks of about ``BLOCK``, so a bucket of any size spreads over
    tasks."""
    hot = met.where(F.col("m") > BLOCK).groupBy("c").agg(F.max(F.struct("m", "key")).alias("b"))
    hot = stored(hot.select("c", F.col("b.key").alias("g"), F.col("b.m").alias("m")), "join-hot")
    n = hot.count()
    if n == 0:
        return None
    texts = src.select("c", "text").join(bounded(hot.select("c"), n), "c", "left_semi").dropDuplicates(["c"])
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    sets = stored(shingle_sets(texts, n_words).join(hot, "c"), "join-hot-sets")
    asked = (met.where((F.col("m") > BLOCK) & (F.pmod(F.xxhash64("c", "key"), F.col("m")) < PIVOT_SAMPLE))
             .select("c", F.col("key").alias("g"), "m"))
    asked = stored(asked.join(sets.select("c", "grams"), "c"), "join-voters")
    voters = asked.groupBy("g").agg(F.count(F.lit(1)).alias("voters"), F.first("m").alias("m"))
    votes = asked.select("g", "grams").mapInArrow(_gram_rows, "g bigint, gram bigint").groupBy("g", "gram").count()
    pivots = (votes.join(voters, "g").where(2 * F.col("count") > F.col("voters"))
              .groupBy("g").agg(F.first("m").alias("m"), F.sort_array(F.collect_list("gram")).alias("pivot")))
    pivots = pivots.select("g", "pivot", F.xxhash64("pivot").alias("core"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    dealt = sets.select("c", "g", "grams", F.pmod(F.xxhash64("c", "g"), blocks).cast("int").alias("block"))
    return stored(dealt.groupBy("g", "block").cogroup(pivots.groupBy("g", "block")).applyInArrow(
        _near_pivot(threshold), "c bigint, core bigint"), "join-cores")


def deal(met: DataFrame, cores: DataFrame | None) -> DataFrame:
    """(key, c, core, block, lo, hi): the units of ``met(key, c, m)``.  A core
    with more than ``BLOCK`` classes in a bucket has blocks of its own there,
    and no unit joins two of them."""
    if cores is None:
        met = met.select("key", "c", F.lit(None).cast("bigint").alias("core"), F.lit(None).cast("bigint").alias("part"),
                         F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"), F.lit(0).alias("first"))
        met = met.withColumn("total", F.col("blocks"))
    else:
        met = met.join(cores, "c", "left")
        large = met.where("core is not null").groupBy("key", "core").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BLOCK)
        large = stored(large.select("key", "core", F.col("core").alias("part")), "join-parts")
        met = stored(met.join(bounded(large, large.count()), ["key", "core"], "left").select("key", "c", "core", "part"),
                     "join-met")
        parts = met.groupBy("key", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        of_key = Window.partitionBy("key")
        before = of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select(F.col("key").alias("of_key"), F.col("part").alias("of_part"), "blocks",
                             F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int").alias("first"),
                             F.sum("blocks").over(of_key).cast("int").alias("total"))
        met = met.join(parts, (F.col("key") == F.col("of_key")) & F.col("part").eqNullSafe(F.col("of_part")))
    block = (F.col("first") + F.pmod(F.xxhash64("c", "key"), F.col("blocks"))).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda o: F.col("part").isNull() | (o < F.col("first"))
                      | (o >= F.col("first") + F.col("blocks")))
    return (met.select("key", "c", "core", block.alias("block"), F.explode(others).alias("o"))
            .select("key", "c", "core", "block", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi")))


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS,
                    threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``class_id`` (smallest id of
    its component), ``copy_id`` (smallest id with an equal text), ``n_copies``
    (rows with an equal text) and ``n_links``."""
    bands, rows = choose_bands(threshold, recall)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("c"))
    members = stored(sketch(src, n_words, bands, rows), "join-sketches")
    classes = stored(members.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("copy_id"),
                                              F.first("bands").alias("bands")), "join-classes")
    met = classes.select("c", F.explode("bands").alias("key"))
    buckets = met.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = met.join(buckets, "key")
    cores = find_cores(src, met, n_words, threshold)
    units = deal(met, cores)
    sized = classes.select("c", "n", "bands")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(*UNIT).sortWithinPartitions(*UNIT, "c")

    needed = stored(dealt(units.join(sized.drop("n"), "c")).mapInArrow(
        _needed, "c bigint, core bigint, block int, key bigint, lo int, hi int"), "join-needed")
    # full n-gram sets of the classes that some unit needs, once each
    wanted = stored(needed.select("c").distinct(), "join-wanted")
    texts = src.select("c", "text").join(bounded(wanted, wanted.count()), "c", "left_semi").dropDuplicates(["c"])
    sets = stored(shingle_sets(texts, n_words), "join-sets")
    found = stored(dealt(needed.join(sized, "c").join(sets, "c")).mapInArrow(
        _verifier(threshold), "c bigint, root bigint, links bigint"), "join-links")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("c").alias("a"), F.col("root").alias("b"))
    told = classes.select("c", "n", "copy_id")
    if cores is None:
        told = told.withColumn("node", F.col("c")).withColumn("near", F.col("n"))
    else:       # a core is one node, its smallest class
        sizes = stored(told.join(cores, "c").groupBy("core").agg(F.sum("n").alias("near"), F.min("c").alias("node")),
                       "join-core-sizes")
        placed = stored(cores.join(bounded(sizes, sizes.count()), "core").select("c", "near", "node"), "join-placed")
        told = told.join(placed, "c", "left").withColumns({"node": F.coalesce("node", "c"), "near": F.coalesce("near", "n")})
        for end in ("a", "b"):
            at = placed.select(F.col("c").alias(end), "node")
            edges = edges.join(at, end, "left").withColumn(end, F.coalesce("node", end)).drop("node")
    roots = connected_components(edges.distinct())
    told = (told.join(roots, "node", "left").join(links, "c", "left").withColumn("root", F.coalesce("root", "node"))
            .withColumn("links", F.col("near") - F.col("n") + F.coalesce("links", F.lit(0))))
    told = stored(told, "join-classes")
    names = told.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    told = told.join(names, "root").select(
        "c", "class_id", "copy_id", F.col("n").alias("n_copies"),
        (F.col("n") - 1 + F.col("links")).alias("n_links"))
    return (members.select("id", "c").join(told, "c")
            .select(F.col("id").alias(id_col), "class_id", "copy_id", "n_copies", "n_links"))
