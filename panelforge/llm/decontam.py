"""Benchmark decontamination with a distributed positional inverted index.

All steps are DataFrame operations on the JVM.  Every document is split once
into words; the index keeps the postings (term, document, position) of the
terms that occur in the benchmark, the only ones a search can ask for, plus
each document's word count.  A phrase is found by intersecting offset-adjusted
postings lists, rarest term first: the rarest term of a window proposes start
positions, the second rarest must agree on them, and what is left is compared
word for word with the documents' own words.

Scale: the vocabulary of the benchmark is broadcast only if it has at most
``BROADCAST_ROWS`` terms, otherwise postings and terms meet in a shuffle join;
term frequencies are summed map-side first; a frequent term's list is read only
by windows that hold no rarer term.  Joins on (document, start) have one row
per candidate, so a passage that many documents share grows linearly with the
documents that hold it.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of non-ASCII
characters.  Defined results: NULL and empty texts have no words and no hits;
an item without words never occurs; an item
without id counts for ``n_hit`` and ``contaminated`` but is not listed; an item of fewer words than a window is
one window; repeated rows get the same result each; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, stored

WINDOW = 13
#: everything that separates words
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case, as an array."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    # lower() folds exactly A-Z where the text is pure ASCII, and is faster
    folded = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.filter(F.split(folded, SEPARATORS), lambda w: w != "")


class PositionalIndex:
    """Postings (term_id, doc, pos), document lengths and term frequencies.

    ``doc`` is a 64-bit key of (id, text): repeated rows share their postings.
    """

    def __init__(self, postings: DataFrame, terms: DataFrame, docs: DataFrame):
        self.postings, self.terms, self.docs = postings, terms, docs


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id",
                text_col: str = "text") -> PositionalIndex:
    """Index ``docs`` for searches over the terms of ``vocabulary(term)``."""
    terms = stored(vocabulary.select("term").distinct()
                   .select("term", F.xxhash64("term").alias("term_id")), "index-terms")
    n_terms = terms.count()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = src.select(F.xxhash64("id", "text").alias("doc"), words_of(F.col("text")).alias("words"))
    placed = keyed.select("doc", F.posexplode("words").alias("pos", "term"))
    postings = stored(placed.join(bounded(terms, n_terms), "term")
                      .select("term_id", "doc", "pos"), "index-postings")
    freq = stored(postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("df")), "index-df")
    return PositionalIndex(postings, terms.join(freq, "term_id", "left").fillna(0, ["df"]), src)


def item_windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(item, win, phrase): every window of ``size`` words of each item, or
    the whole item if it is shorter; distinct phrases per item (NULL: all items
    without id)."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    w = w.where(F.size("words") > 0)
    last = F.greatest(F.size("words") - size, F.lit(0))
    return (w.select("item", F.explode(F.transform(F.sequence(F.lit(0), last),
                                                   lambda i: F.slice(F.col("words"), i + 1, size))).alias("phrase"))
            .distinct())


def _leads(phrases: DataFrame, index: PositionalIndex) -> DataFrame:
    """(phrase_id, phrase, t1, o1, t2, o2, n): the two rarest terms of each
    phrase with their offsets; phrases with a term that never occurs go."""
    terms = phrases.select("phrase_id", F.posexplode("phrase").alias("off", "term"))
    n_terms = index.terms.count()
    known = terms.join(bounded(index.terms, n_terms), "term")
    by_rarity = Window.partitionBy("phrase_id").orderBy("df", "off")
    ranked = known.withColumn("r", F.row_number().over(by_rarity)).groupBy("phrase_id").agg(
        F.min("df").alias("least"),
        F.max(F.when(F.col("r") == 1, F.col("term_id"))).alias("t1"), F.max(F.when(F.col("r") == 1, F.col("off"))).alias("o1"),
        F.max(F.when(F.col("r") == 2, F.col("term_id"))).alias("t2"), F.max(F.when(F.col("r") == 2, F.col("off"))).alias("o2"))
    return phrases.join(ranked.where("least > 0").drop("least"), "phrase_id")


def exact_matches(index: PositionalIndex, phrases: DataFrame) -> DataFrame:
    """(phrase_id, doc, start) of every occurrence of ``phrases(phrase_id,
    phrase array)`` in the indexed documents."""
    leads = stored(_leads(phrases, index), "phrase-leads")
    n = leads.count()
    ids = leads.select("phrase_id", "t1", "o1", "t2", "o2")
    first = (index.postings.join(bounded(ids, n), F.col("term_id") == F.col("t1"))
             .select("phrase_id", "doc", (F.col("pos") - F.col("o1")).alias("start"), "t2", "o2")
             .where("start >= 0"))
    pair = first.where(F.col("t2").isNotNull())
    need = leads.where(F.col("t2").isNotNull()).select(F.col("t2").alias("term_id")).distinct()
    second = (index.postings.join(bounded(need, n), "term_id")
              .select(F.col("term_id").alias("t2"), "doc", F.col("pos").alias("at")))
    agreed = (pair.withColumn("at", F.col("start") + F.col("o2"))
              .join(second, ["t2", "doc", "at"], "left_semi").select("phrase_id", "doc", "start"))
    starts = stored(agreed.unionByName(first.where(F.col("t2").isNull()).select("phrase_id", "doc", "start")),
                    "phrase-starts")
    # what two terms agree on is compared word for word
    held = starts.groupBy("doc").agg(F.collect_set(F.struct("phrase_id", "start")).alias("found"))
    keyed = index.docs.select(F.xxhash64("id", "text").alias("doc"), "text").join(held, "doc")
    words = keyed.groupBy("doc").agg(F.first("text").alias("text"), F.first("found").alias("found"))
    placed = (words.select("doc", words_of(F.col("text")).alias("words"), "found")
              .select("doc", "words", F.explode("found").alias("f"))
              .select("doc", "words", "f.phrase_id", "f.start"))
    return (placed.join(bounded(leads.select("phrase_id", "phrase"), n), "phrase_id")
            .where(F.slice("words", F.col("start") + 1, F.size("phrase")) == F.col("phrase"))
            .select("phrase_id", "doc", "start"))


def proximity_matches(index: PositionalIndex, phrases: DataFrame, slop: int) -> DataFrame:
    """(phrase_id, doc, start, span): places that hold every word of a phrase,
    each at a word of its own and shifted against the others by at most
    ``slop`` words; of those with one smallest shift, the earliest words.

    Every occurrence of the rarest term is joined with the postings within
    ``slop`` of each other word's place only, found by buckets of positions,
    so a long document does not pair all positions of two frequent terms."""
    n = F.size("phrase")
    wide = F.lit(slop + 1)
    leads = _leads(phrases, index).select("phrase_id", "phrase", "t1", "o1")
    first = (index.postings.join(leads, F.col("term_id") == F.col("t1"))
             .select("phrase_id", "phrase", "doc", (F.col("pos") - F.col("o1")).alias("p1")))
    place = F.col("p1") + F.col("off")
    asked = (first.select("phrase_id", "doc", "p1", n.alias("n"), F.posexplode("phrase").alias("off", "term"))
             .select("phrase_id", "doc", "p1", "n", "off", F.xxhash64("term").alias("term_id"),
                     F.explode(F.sequence(F.floor((place - slop) / wide), F.floor((place + slop) / wide))).alias("b")))
    near = index.postings.withColumn("b", F.floor(F.col("pos") / wide))
    shift = F.col("pos") - F.col("off")
    found = (asked.join(near, ["term_id", "doc", "b"]).where(F.abs(shift - F.col("p1")) <= slop)
             .groupBy("phrase_id", "doc", "p1", "n")
             .agg(F.sort_array(F.collect_set(F.struct(F.col("pos"), F.col("off"), shift.alias("shift")))).alias("at"))
             .where(F.size(F.array_distinct("at.off")) == F.col("n"))
             .select("n", "phrase_id", "doc", "at", F.explode(F.array_distinct(
                 F.filter("at.shift", lambda x: x <= F.col("p1")))).alias("low")))

    def pick(taken: Column, off: Column) -> Column:
        """The earliest free place of a word; NULL from the first without one."""
        free = F.filter("at", lambda x: (x["off"] == off) & x["shift"].between(F.col("low"), F.col("low") + slop)
                        & ~F.array_contains(taken, x["pos"]))
        return F.when(F.size(free) > 0, F.concat(taken, F.array(F.get(free, F.lit(0))["pos"])))

    words = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.array().cast("array<int>"), pick)
    return (found.withColumn("words", words).where(F.col("words").isNotNull())
            .select("phrase_id", "doc", F.array_min("words").alias("start"),
                    (F.array_max("words") - F.array_min("words") + 1).alias("span")).distinct())


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``n_words``, ``n_hit`` (words inside an
    occurrence of a window), ``n_items`` and ``items`` (sorted ids, as strings,
    of the items with occurring windows) and ``contaminated``."""
    windows = stored(item_windows(items, size, item_id, item_text), "item-windows")
    phrases = windows.select("phrase").distinct().select(F.xxhash64("phrase").alias("phrase_id"), "phrase")
    index = build_index(docs, phrases.select(F.explode("phrase").alias("term")), id_col, text_col)
    hits = stored(exact_matches(index, phrases), "phrase-hits")
    # words inside an occurrence: each start adds only what the one before it
    # does not reach
    lens = stored(windows.select("item", F.xxhash64("phrase").alias("phrase_id"), F.size("phrase").alias("len")), "window-ids")
    n = lens.count()
    length = lens.groupBy("phrase_id").agg(F.first("len").alias("len"))
    runs = hits.join(bounded(length, n), "phrase_id").groupBy("doc", "start").agg(F.max("len").alias("len"))
    reach = F.max(F.col("start") + F.col("len")).over(
        Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    hit = (runs.withColumn("fresh", F.greatest(F.col("start"), F.coalesce(reach, F.lit(0))))
           .groupBy("doc").agg(F.sum(F.greatest(F.col("start") + F.col("len") - F.col("fresh"), F.lit(0))).alias("n_hit")))
    found = (hits.select("phrase_id", "doc").distinct()
             .join(bounded(lens.select("item", "phrase_id"), n), "phrase_id")
             .groupBy("doc").agg(F.sort_array(F.collect_set("item")).alias("items")))
    out = index.docs.select(F.col("id").alias(id_col), F.xxhash64("id", "text").alias("doc"),
                            F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    out = out.join(hit.join(found, "doc"), "doc", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(id_col, "n_words", n_hit.alias("n_hit"),
                      F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
