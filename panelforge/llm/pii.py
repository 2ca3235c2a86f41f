"""Personal data: high-recall generators, boosted trees, calibrated thresholds.

Generators propose spans, which may overlap: every match of the base patterns
(which always stay), and looser forms of the same kinds: spelled-out e-mail
addresses and, of every run of digit groups, each sequence of neighbouring
groups of fitting length, so a list of numbers proposes its items too.  Boosted
trees judge a looser span by its format (digits, groups, separators) and
context (neighbouring characters, digits and telling words nearby).  They learn
from spans of all documents, base matches against looser spans and pieces of
base matches of another kind, of which a hash of (row, span) keeps about
``FIT_SPANS`` per kind and label; the shares follow a count and are undone in
the score.  The validity rules of the base patterns (check digit, number
ranges) are no features, nor are the marks of the base forms (``@``, ``.`` and
``+`` count as their looser forms do), so the trees judge how a span is
written.  A looser span that only lacks the mark (a spelled-out address, a
phone number without ``+``) has no label: it is judged, not learned from.  On the
quarter of all spans that another hash keeps out of the fit, score histograms
summed over all documents give each kind the lowest threshold (``PRECISION`` of
the spans above it, and one more, are base matches, at least ``FLOOR``); looser
spans above it are added.

Counting, drawing, scoring and the result are one map over all documents each:
whole texts; only counts, drawn spans and histograms are shuffled.  All
patterns run in linear time on any text, and candidates are made one by one
and scored ``CHUNK_SPANS`` at a time: beside a text only its base and accepted
spans are held, however many numbers it lists.

Defined results: NULL counts as empty text without spans; offsets count code
points, end exclusive; equal scores are accepted or refused together; repeated rows get
the same result each; an empty table gives an empty result; columns of
``keep`` may have any names, others are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import release

KINDS = ("email", "ip", "card", "phone")
FIT_SPANS = 12_500             # drawn spans per kind and label the trees are fitted on
HELD_EVERY = 4                 # one span in so many is held out for the thresholds
CHUNK_SPANS = 4_096            # candidates scored at once
SCORE_STEP, SCORE_LIMIT = 0.02, 15.0    # histogram of the scores (log odds)
PRECISION, FLOOR = 0.98, 0.8

# The base patterns.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# looser forms
SPELLED = re.compile(r"[A-Za-z0-9_%+-]{1,64}\x20?(?:\(at\)|\[at\]|@)\x20?[A-Za-z0-9-]{1,64}"
                     r"(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]{1,64}){1,4}")
CLUSTER = re.compile(r"[+(]{0,2}[0-9](?:[\x20().,:/-]{0,2}[0-9])*")
GROUP = re.compile(r"[0-9]+")
AT, DOT = re.compile(r"\x20?(?:\(at\)|\[at\]|@)\x20?"), re.compile(r"\x20?(?:\(dot\)|\[dot\]|\.)\x20?")
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
TELLING = re.compile(r"(?i)mail|contact|phone|tel|call|fax|mobile|card|visa|credit|account|ip\b|host|server|addr")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches by kind in the listed order, then by start."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in NAME_CHARS:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    cards = []
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, a = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            b = a + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                out.append(("ip", a, b))
            a = b + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                cards.append(("card", m.start(), m.end()))
    out += cards
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _overlaps(base: list[tuple[str, int, int]]):
    """Whether a base match overlaps a place, as a function of its ends."""
    taken = sorted((a, b) for _, a, b in base)
    starts, reach, top = [a for a, _ in taken], [], 0
    for _, b in taken:
        top = max(top, b)
        reach.append(top)

    def overlaps(a: int, b: int) -> bool:
        k = bisect_left(starts, b) - 1
        return k >= 0 and reach[k] > a
    return overlaps


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Every looser form, one at a time: spelled-out addresses, and of each run of digit
    groups all sequences of neighbouring groups of fitting length (at most 19
    per group, as a sequence has at most 19 digits)."""
    if "at)" in text or "at]" in text or "@" in text:
        for m in SPELLED.finditer(text):
            yield "email", m.start(), m.end()
    for m in CLUSTER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        ahead: deque[tuple[int, int]] = deque()
        more = GROUP.finditer(text, m.start(), m.end())
        while True:
            # a sequence of at most 19 digits has at most 19 groups
            while len(ahead) < 20 and (g := next(more, None)):
                ahead.append(g.span())
            if not ahead:
                break
            first = ahead[0][0]
            a = first
            while a > m.start() and first - a < 2 and text[a - 1] in "+(":
                a -= 1
            n = 0
            for j, (start, b) in enumerate(ahead):
                n += b - start
                if n > 19:
                    break
                if 7 <= n <= 15:
                    yield "phone", a, b
                if 12 <= n:
                    yield "card", a, b
                if n <= 15 and j == 3:
                    yield "ip", a, b
            ahead.popleft()


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Looser candidates that no base match overlaps, one at a time."""
    overlaps = _overlaps(base)
    return (s for s in proposals(text) if not overlaps(s[1], s[2]))


def chunks(items: Iterable, n: int = CHUNK_SPANS) -> Iterator[list]:
    """Lists of at most ``n`` items, so no text is held as spans whole."""
    it = iter(items)
    while part := list(islice(it, n)):
        yield part


def written(kind: str, s: str) -> str:
    """The span without the marks that only its base form has."""
    if kind == "email":
        return DOT.sub(".", AT.sub("@", s))
    return s.lstrip("+") if kind == "phone" else s


def unmarked(text: str, kind: str, a: int, b: int) -> bool:
    """Whether a looser span fails its base pattern for want of a mark only."""
    s = written(kind, text[a:b])
    if kind == "email":
        return bool(MAIL.fullmatch(s))
    if kind != "phone" or text[max(0, a - 1):a].isalnum() or text[b:b + 1].isalnum():
        return False
    return bool(PHONE.fullmatch("+" + s.lstrip("("))) and 9 <= sum("0" <= c <= "9" for c in s) <= 15


def labelled(text: str) -> Iterator[tuple[float, tuple[str, int, int]]]:
    """Spans to learn from, one at a time: base matches (1), and as others (0) looser spans
    that lack more than a mark and pieces of base matches of other kinds."""
    base = base_spans(text)
    yield from ((1.0, s) for s in base)
    overlaps = _overlaps(base)
    own = {k: _overlaps([s for s in base if s[0] == k]) for k in {s[0] for s in base}}
    for s in proposals(text):
        if overlaps(s[1], s[2]):
            if s[0] not in own or not own[s[0]](s[1], s[2]):
                yield 0.0, s
        elif not unmarked(text, *s):
            yield 0.0, s


def _class(ch: str) -> int:
    return 0 if not ch else 1 if ch.isspace() else 2 if ch.isalpha() else 3 if ch.isdigit() else 4


def span_features(text: str, kind: str, a: int, b: int) -> list[float]:
    s = written(kind, text[a:b])
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    near = text[max(0, a - 24):a] + text[b:b + 24]
    return [KINDS.index(kind), sum(groups), len(s), len(groups), max(groups), min(groups),
            s.count(" "), s.count("-"), s.count("."), s.count("(") + s.count(")"),
            s.count(",") + s.count(":") + s.count("/"), _class(text[a - 1:a] if a else ""),
            _class(text[b:b + 1]), float(bool(TELLING.search(text, max(0, a - 24), a))),
            sum(map(str.isdigit, near)), sum(map(str.isalpha, s)), float(s[-1:].isalpha()), len(set(s))]


class SpanModel:
    """Boosted trees, each kind's correction for the drawn shares, and each
    kind's threshold on the log odds."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shift: np.ndarray):
        self.trees = BoostedTrees().fit(x, y)
        self.shift = shift
        self.threshold = np.full(len(KINDS), np.inf)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds as a step of the histograms."""
        p = np.clip(self.trees.predict(x), 1e-12, 1 - 1e-12)
        z = np.log(p / (1 - p)) + self.shift[x[:, 0].astype(int)]
        return np.floor(np.clip(z, -SCORE_LIMIT, SCORE_LIMIT) / SCORE_STEP).astype(np.int64)

    def set_thresholds(self, kind: np.ndarray, step: np.ndarray, label: np.ndarray, n: np.ndarray) -> None:
        """From histograms of held-out spans: ``n`` of each (kind, step, label)."""
        for k in range(len(KINDS)):
            mine = kind == k
            steps, at = np.unique(-step[mine], return_inverse=True)
            rows = np.cumsum(np.bincount(at, n[mine], len(steps)))
            hits = np.cumsum(np.bincount(at, n[mine] * label[mine], len(steps)))
            good = np.flatnonzero(hits >= PRECISION * (rows + 1))
            if len(good):
                self.threshold[k] = max(np.ceil(np.log(FLOOR / (1 - FLOOR)) / SCORE_STEP), -steps[good[-1]])

    def accept(self, x: np.ndarray) -> np.ndarray:
        return self.score(x) >= self.threshold[x[:, 0].astype(int)]


def _hashed(row: int, span: tuple[str, int, int]) -> int:
    """64 bits of (row, span)."""
    return int.from_bytes(blake2b(f"{row},{span}".encode(), digest_size=8).digest(), "little")


def fit_spans(docs: DataFrame) -> SpanModel | None:
    """Fit on the spans of ``docs(row, text)``, ``row`` a 64-bit hash; None
    without both labels."""
    cells = "kind int, step bigint, label int, n bigint"

    def spans(batch):
        """(hash, label, span, text) of every span of a batch."""
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
            for y, s in labelled(text):
                yield _hashed(row, s), int(y), s, text

    def summed(count):
        keys = [*count]
        return pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32()))]
            + [pa.array([count[k] for k in keys], pa.int64())], names=["kind", "step", "label", "n"])

    def totals(rows):
        got = rows.groupBy("kind", "step", "label").agg(F.sum("n").alias("n")).toArrow()
        return [got.column(c).to_numpy() for c in ("kind", "step", "label", "n")]

    def count(batches):
        for batch in batches:
            yield summed(Counter((KINDS.index(s[0]), 0, y) for h, y, s, _ in spans(batch) if h % HELD_EVERY))

    share = np.ones((len(KINDS), 2))
    kind, _, label, n = totals(docs.mapInArrow(count, cells))
    if len(set(label)) < 2:
        return None
    share[kind, label] = np.minimum(1.0, FIT_SPANS / n)

    def draw(batches):
        for batch in batches:
            drawn = ((h - (1 << 63), [float(y), *span_features(text, *s)]) for h, y, s, text in spans(batch)
                     if h % HELD_EVERY and (h >> 2) < share[KINDS.index(s[0]), y] * (1 << 62))
            for rows in chunks(drawn):
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.int64()),
                                                  pa.array([r for _, r in rows], pa.list_(pa.float64()))], names=["h", "row"])

    # repeated rows are drawn once, as they share their hashes
    got = (docs.mapInArrow(draw, "h bigint, row array<double>").groupBy("h").agg(F.min("row").alias("row"))
           .select("row").toArrow())
    rows = got.column("row").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    rows = rows[np.lexsort(rows.T)]                          # one order, whatever the partitions
    y, x = rows[:, 0], rows[:, 1:]
    if len(set(y)) < 2:
        return None
    model = SpanModel(x, y, np.log(share[:, 0] / share[:, 1]))

    def scores(batches):
        for batch in batches:
            found: Counter = Counter()
            for held in chunks((y, span_features(text, *s)) for h, y, s, text in spans(batch) if h % HELD_EVERY == 0):
                x = np.array([f for _, f in held], float)
                found.update(zip(x[:, 0].astype(int).tolist(), model.score(x).tolist(), [y for y, _ in held]))
            if found:
                yield summed(found)

    model.set_thresholds(*totals(docs.mapInArrow(scores, cells)))
    return model


def added_spans(model: SpanModel, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Accepted looser spans of a text; candidates are scored in chunks."""
    out: set[tuple[str, int, int]] = set()
    for part in chunks(loose_spans(text, base)):
        ok = model.accept(np.array([span_features(text, *s) for s in part], float))
        out.update(s for s, good in zip(part, ok) if good)
    return sorted(out)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans by
    that of the one that starts first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       keep: list[str] | None = None) -> DataFrame:
    """Per row: ``id_col``, ``spans`` (array of kind, start, end, base; by
    kind as listed, then start) and ``redacted`` text, after the columns of
    ``keep``."""
    keep = [c for c in (keep or []) if c not in (id_col, text_col)]
    names = {c: f"k{i}" for i, c in enumerate(keep)}
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                      *[F.col(c).alias(n) for c, n in names.items()])
    model = fit_spans(src.select(F.xxhash64("id", "text").alias("row"), "text"))
    order = {k: i for i, k in enumerate(KINDS)}

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                found, clean = [], []
                for text in texts:
                    base = base_spans(text)
                    more = added_spans(model, text, base) if model is not None else []
                    spans = [(*s, True) for s in base] + [(*s, False) for s in more]
                    spans.sort(key=lambda s: (order[s[0]], s[1], s[2]))
                    found.append([dict(zip(("kind", "start", "end", "base"), s)) for s in spans])
                    clean.append(redacted(text, [s[:3] for s in spans]) if spans else text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *[part.column(n) for n in names.values()],
                     pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                                         ("end", pa.int64()), ("base", pa.bool_())]))),
                     pa.array(clean, pa.string())], names=["id", *names.values(), "spans", "redacted"])
            release()

    kinds = "".join(f", {n} {src.schema[n].dataType.simpleString()}" for n in names.values())
    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}{kinds}, "
                              "spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>, redacted string")
    return out.select(F.col("id").alias(id_col), *[F.col(n).alias(c) for c, n in names.items()], "spans", "redacted")
