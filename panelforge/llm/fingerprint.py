"""Document fingerprints by winnowing, with DataFrame functions only.

Every ``K`` consecutive code points of a text are hashed as the text rolls by
(64-bit xxhash of their UTF-32 bytes, 44 bits of it kept).  Of every window of
``W`` consecutive hashes the smallest is chosen, the **rightmost** one of equal
hashes.  The chosen hashes and their positions are the fingerprint, so two
texts that share a passage of ``K + W - 1`` code points share a fingerprint
entry at the same place of the passage, and nothing shorter than ``K`` can match.

A hash is kept together with its position in one number, ``hash * 2^20 +
(2^20 - 1 - position)``: the smallest number of a window is its smallest hash,
rightmost among equals.  The windows are not scanned one by one.  From a chosen
place p the next one is the first smaller number among the ``W`` that follow
p, or, if none is smaller, the smallest of them; so the work per text is one
hash per code point and one look at ``W`` numbers per chosen place.  Texts are
worked off in pieces of ``PIECE`` windows, which bounds the arrays held; a
window never depends on the piece it is in.  The hash of a k-gram is taken
from its bytes and not carried on from its predecessor: a recurrence over
array elements costs five times as much in Spark's expressions.

``with_next`` gives every document its successor in ascending id order without
a global window: the range bounds of the keys (one per shuffle partition) deal
the documents into consecutive buckets, and the first document of each bucket
also goes, as an extra last row, to the bucket before (that of the first bucket to
the last).  Texts are shuffled once.

Defined results: NULL text counts as empty; an empty text has an empty
fingerprint; a text of fewer than ``K`` code points has one entry, the hash of
the whole text at position 0; one of fewer than ``W`` hashes has the smallest
of them.  Texts of any length are worked off whole.  Ties go to the right.
Documents of equal id follow each other by the hash of their text (NULL ids
first); repeated rows (equal id and text) count as one document and each of
them gets its result.  The successor of the last document is the first, of a
single document itself.  An empty table gives no rows.  Columns other than id
and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import short_batches

K = 20                # code points of a gram
W = 80                # hashes of a window
PIECE = 800           # windows of a piece
POS_BITS = 20         # of the number that holds hash and position in a piece
STEPS = 64            # chosen places per inner fold

_LAST = (1 << POS_BITS) - 1


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated a single time (expressions
    inside a lambda are not shared)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbers(piece: Column, k: int) -> Column:
    """Hash and position of every gram of a piece (UTF-32 bytes), as one
    number each; a piece of fewer than ``k`` code points is one gram."""
    grams = F.greatest((F.length(piece) / 4).cast("int") - (k - 1), F.lit(1))
    return F.transform(
        F.sequence(F.lit(0), grams - 1),
        lambda i: F.shiftleft(F.xxhash64(F.substring(piece, i * 4 + 1, F.lit(4 * k))), POS_BITS)
        .bitwiseOR((F.lit(_LAST) - i).cast("bigint")))


def _chosen(numbers: Column, w: int) -> Column:
    """The numbers chosen by the windows of an array, in order of position
    (``numbers`` is a lambda variable)."""
    def place(v):
        return F.lit(_LAST) - v.bitwiseAND(F.lit(_LAST)).cast("int")

    def step(state, _):
        def advance(v, ahead):
            def choose(least):
                # the first smaller one is not behind the smallest
                smaller = F.filter(F.slice(ahead, F.lit(1), place(least) - place(v)), lambda x: x < v)
                nxt = F.when(least < v, F.element_at(smaller, 1)).when(F.size(ahead) == w, least)
                return once(nxt, lambda n: F.struct(
                    n.isNull().alias("done"),
                    F.when(n.isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(n))).alias("out")))
            return once(F.array_min(ahead), choose)
        # place is zero-based, slices start at one
        return F.when(state["done"], state).otherwise(once(F.element_at(state["out"], -1), lambda v: once(
            F.slice(numbers, place(v) + 2, F.lit(w)), lambda ahead: advance(v, ahead))))

    def steps(state, _):
        return F.when(state["done"], state).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), state, step))

    start = F.struct(F.lit(False).alias("done"),
                     F.array(F.array_min(F.slice(numbers, F.lit(1), F.lit(w)))).alias("out"))
    rounds = F.sequence(F.lit(0), (F.size(numbers) / STEPS).cast("int"))
    return F.aggregate(rounds, start, steps)["out"]


def winnow(text: Column, k: int = K, w: int = W, piece: int = PIECE) -> Column:
    """array<struct<pos int, hash bigint>> of the text's fingerprint by
    position; empty for an empty or NULL text."""
    if k < 1 or w < 1 or piece + w > 1 << POS_BITS:
        raise ValueError("k and w start at 1 and a piece has under 2^20 hashes")

    def of_bytes(raw):
        # windows start at 0 .. n - k - w + 1; the last one also where it is short
        windows = F.greatest((F.length(raw) / 4).cast("int") - (k + w - 2), F.lit(1))

        def of_piece(at):
            cut = F.substring(raw, at * 4 + 1, F.least(F.lit(piece), windows - at) * 4 + 4 * (k + w - 2))
            return once(cut, lambda c: once(_numbers(c, k), lambda n: F.transform(_chosen(n, w), lambda v: F.struct(
                (at + F.lit(_LAST) - v.bitwiseAND(F.lit(_LAST)).cast("int")).alias("pos"),
                F.shiftrightunsigned(v, POS_BITS).alias("hash")))))

        pieces = F.transform(F.sequence(F.lit(0), windows - 1, F.lit(piece)), of_piece)
        # the first place of a piece may be the last one of the piece before
        return once(F.flatten(pieces), lambda all_: F.filter(all_, lambda x, i: F.when(i == 0, True).otherwise(
            x["pos"] > F.get(all_, i - 1)["pos"])))

    kind = "array<struct<pos:int,hash:bigint>>"
    return F.when(F.char_length(text) > 0, once(F.encode(text, "UTF-32"), of_bytes)).otherwise(
        F.array().cast(kind)).cast(kind)


def likeness(a: Column, b: Column) -> Column:
    """Share of the distinct hashes of two arrays that both have; 1 if both
    are empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def fingerprint_text(pos: Column, hash_: Column) -> Column:
    """``position:hash`` of every entry (hash in hex), comma-joined."""
    return F.array_join(F.zip_with(pos, hash_, lambda p, h: F.concat_ws(":", p.cast("string"), F.lower(F.hex(h)))), ",")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """``id``, ``text``, ``pos`` array<int>, ``hash`` array<bigint>."""
    src = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return (src.withColumn("_fp", winnow(F.col("text"), k, w))
            .select("id", "text", F.col("_fp.pos").alias("pos"), F.col("_fp.hash").alias("hash")))


def _bounds(keys: DataFrame, partitions: int) -> list:
    """First key of every range of the keys, in order (one row per range)."""
    ranged = keys.repartitionByRange(partitions, "id", "h").withColumn("_p", F.spark_partition_id())
    firsts = ranged.groupBy("_p").agg(F.min(F.struct("id", "h")).alias("key")).orderBy("_p").collect()
    return [r["key"] for r in firsts]


def with_next(df: DataFrame, extra: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` (``id``, ``text`` and others) with ``next_<c>`` of ``text`` and of
    every column of ``extra``: those of the next document by id."""
    spark = df.sparkSession
    kind = df.schema["id"].dataType
    h = F.xxhash64("text")
    keys = df.select("id", h.alias("h"))
    bounds = _bounds(keys, partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not bounds:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in ["text", *extra]])
    firsts = F.array(*[F.struct(F.lit(b["id"]).cast(kind).alias("id"), F.lit(b["h"]).alias("h")) for b in bounds])
    key = F.struct("id", "h")
    last = len(bounds) - 1
    bucket = F.greatest(F.size(F.filter(firsts, lambda b: b <= F.col("_k"))) - 1, F.lit(0))
    own = F.struct(F.col("_b").alias("bucket"), F.lit(0).alias("late"))
    before = F.struct(F.when(F.col("_b") == 0, F.lit(last)).otherwise(F.col("_b") - 1).alias("bucket"),
                      F.lit(1).alias("late"))
    dealt = (df.withColumn("h", h).withColumn("_k", key).withColumn("_b", bucket)
             .withColumn("_to", F.explode(F.when(F.get(firsts, F.col("_b")) == F.col("_k"), F.array(own, before))
                                          .otherwise(F.array(own))))
             .select(*df.columns, "h", "_to.bucket", "_to.late"))
    order = Window.partitionBy("bucket").orderBy("late", "id", "h")
    return (dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in ["text", *extra]])
            .where(F.col("late") == 0).drop("bucket", "late", "h"))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                        w: int = W) -> DataFrame:
    """``id_col``, ``text``, ``pos`` and ``hash`` of every document, the same
    of its edited text (``edited``, ``edited_pos``, ``edited_hash``: its last
    half replaced by the beginning of the next document), and the likenesses
    ``near_edited`` and ``near_next``."""
    short_batches(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    repeats = (src.groupBy("id", F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("n"))
               .where(F.col("n") > 1))
    repeated = not repeats.isEmpty()
    if repeated:
        # one row of each; their number comes back below
        src = src.withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"]).drop("h")
    found = with_next(fingerprints(src, "id", "text", k, w), ["hash"])
    half = F.floor(F.char_length("text") / 2).cast("int")
    out = (found.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half),
                                               F.substring(F.col("next_text"), F.lit(1), half)))
           .drop("next_text").withColumn("_fp", winnow(F.col("edited"), k, w))
           .select("id", "text", "pos", "hash", "edited", F.col("_fp.pos").alias("edited_pos"),
                   F.col("_fp.hash").alias("edited_hash"), "next_hash"))
    out = out.select("*", likeness(F.col("hash"), F.col("edited_hash")).alias("near_edited"),
                     likeness(F.col("hash"), F.col("next_hash")).alias("near_next")).drop("next_hash")
    if repeated:
        n = repeats.withColumnRenamed("id", "_id")
        out = (out.join(n, F.col("id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("h")), "left")
               .withColumn("_c", F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("n", F.lit(1)))))
               .drop("_id", "h", "n", "_c"))
    return out.withColumnRenamed("id", id_col)
