"""Dealt operators against brute force, held-out accuracy and edge cases."""
import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EDGE = [(1, "one two three four five six seven", "z", 1), (1, "one two three four five six seven", "z", 1),
        (2, None, None, None), (3, "", "z", 2), (4, "!!! ...", "z", 2), (None, "no id here", "z", 2),
        (5, "word " * 30000, "z", 2), (6, "One two three four five six SEVEN!", "z", 2)]
SCHEMA = "doc_id long, text string, score string, id int"


def words(text):
    return WORD.findall((text or "").translate(FOLD))


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def queries():
    from panelforge.llm.catalog import QUERIES
    return QUERIES


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


def held(i, k, r=0):
    return zlib.crc32(str(i).encode()) % k == r


def test_lm_counts_and_base_score(spark, queries, docs):
    out = queries["op2_lm_score"](spark, SF).collect()
    toks = {i: (r.text or "").encode().lower().split() + [b"\0END"] for i, r in docs.items()}
    c = collections.Counter(w for i, t in toks.items() if not held(i, 10) for w in t)
    n, v = sum(c.values()), len(c)
    for r in out:
        t = toks[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in t), rel=1e-9)
    out = [r for r in out if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_edges(spark, edge):
    from panelforge.llm.ngram_lm import score_texts
    out = score_texts(edge, lambda i: F.lit(True)).collect()
    assert len(out) == len(EDGE) and all(r.score <= 0 and math.isfinite(r.score) for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (2, 3)} == {1}
    assert score_texts(edge.limit(0), lambda i: F.lit(True)).count() == 0


def test_language(spark, queries, docs, edge):
    out = queries["op3_language"](spark, SF).where("held_out").collect()
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in out]) > 0.97
    from panelforge.llm.langid import predict_language
    df = edge.withColumn("lang", F.when(F.col("doc_id") == 5, "xx").when(F.col("doc_id") == 1, "en"))
    got = predict_language(df, lambda i: F.lit(True)).collect()
    assert len(got) == len(EDGE)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (2, 3, 4))
    none = predict_language(df.withColumn("lang", F.lit(None).cast("string")), lambda i: F.lit(True)).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_toxicity(spark, queries, edge):
    out = queries["op1_toxicity"](spark, SF)
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    rows = out.join(lab, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9
    assert out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    from panelforge.llm.toxicity import score_toxicity
    every = lambda i: F.lit(True)
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (6, None)], "doc_id long, toxic int")
    assert score_toxicity(edge, labels, every, every).count() == len(EDGE)
    assert {r.score for r in score_toxicity(edge, labels.limit(0), every, every).collect()} == {0.0}


def test_join_matches_brute_force(spark, queries, docs):
    grams = {}
    for i, r in docs.items():
        w = words(r.text)
        grams[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()
    where = collections.defaultdict(set)
    for i, g in grams.items():
        for x in g:
            where[x].add(i)
    links = collections.Counter()
    for i, g in grams.items():
        both = collections.Counter(j for x in g for j in where[x] if j > i)
        for j, n in both.items():
            if 5 * n >= 4 * (len(g) + len(grams[j]) - n):
                links[i] += 1
                links[j] += 1
    out = {r.doc_id: r for r in queries["op4_ngram_join"](spark, SF).collect()}
    assert {i: r.n_links for i, r in out.items()} == {i: links[i] for i in docs}
    assert all((r.class_id == i) or r.n_links for i, r in out.items())


def test_join_edges_and_blocks(spark, edge, monkeypatch):
    from panelforge.llm import ngram_join
    out = [r for r in ngram_join.similarity_join(edge).collect()]
    assert len(out) == len(EDGE)
    assert [r.n_links for r in out if r.doc_id in (1, 6)] == [2, 2, 2]
    assert [r.n_links for r in out if r.doc_id in (2, 3)] == [1, 1] and [r.n_links for r in out if r.doc_id == 4] == [0]
    assert ngram_join.similarity_join(edge.limit(0)).count() == 0
    # a group far larger than a block is found whole
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base + [f"tail{i}"]), "", 0) for i in range(60)]
    out = ngram_join.similarity_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.class_id, r.n_links) for r in out} == {(0, 59)}


def test_join_cores_lose_and_add_no_link(spark, monkeypatch):
    """Large buckets of variants at all distances from their origin (equal
    texts, one to eight changed words, half another family) against all pairs."""
    from panelforge.llm import ngram_join
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = np.random.default_rng(7)
    texts = []
    for family in range(2):
        base = [f"f{family}w{k}" for k in range(150)]
        for v in range(70):
            w = list(base)
            for at in rng.choice(150, int(rng.choice([0, 1, 1, 1, 2, 3, 4, 8])), replace=False):
                w[at] = f"x{family}v{v}"
            texts.append(" ".join(w))
    texts += [texts[3]] * 5 + [" ".join([f"f0w{k}" for k in range(75)] + [f"f1w{k}" for k in range(75)]), "", ""]
    found = {}
    similar = ngram_join.find_cores
    monkeypatch.setattr(ngram_join, "find_cores", lambda *a: found.setdefault("cores", similar(*a)))
    out = {r.doc_id: r for r in ngram_join.similarity_join(
        spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA)).collect()}
    grams = [frozenset(tuple(t.split()[k:k + 5]) for k in range(max(len(t.split()) - 4, 0))) for t in texts]
    near = [[j for j in range(len(texts)) if j != i and (texts[i] == texts[j] or grams[i] and 5 * len(grams[i] & grams[j])
             >= 4 * len(grams[i] | grams[j]))] for i in range(len(texts))]
    assert {i: r.n_links for i, r in out.items()} == {i: len(x) for i, x in enumerate(near)}
    root = list(range(len(texts)))
    for _ in texts:
        root = [min([root[i], *(root[j] for j in near[i])]) for i in range(len(texts))]
    assert {i: r.class_id for i, r in out.items()} == dict(enumerate(root))
    assert found["cores"].groupBy("core").count().where("count > 15").count() >= 2


def test_bands_reach_the_recall():
    from panelforge.llm.ngram_join import choose_bands
    bands, rows = choose_bands()
    assert bands * rows <= 128 and 1 - (1 - 0.8 ** rows) ** bands >= 0.9999


def test_decontamination_edges(spark, edge):
    from panelforge.llm.decontam import build_index, contamination, proximity_matches
    items = spark.createDataFrame([(7, "three FOUR five"), (8, "six seven"), (9, None), (10, "  ")], "item_id int, text string")
    out = contamination(edge, items).collect()
    assert len(out) == len(EDGE)
    assert {(r.n_words, r.n_hit, tuple(r["items"])) for r in out if r.doc_id == 1} == {(7, 5, ("7", "8"))}
    assert all(r.n_hit == 0 and not r.contaminated for r in out if r.doc_id in (2, 3, 4, 5))
    assert contamination(edge, items.limit(0)).where("contaminated").count() == 0
    phrases = spark.createDataFrame([(1, ["one", "five"])], "phrase_id long, phrase array<string>")
    index = build_index(edge, phrases.select(F.explode("phrase").alias("term")))
    assert proximity_matches(index, phrases, 2).count() == 0
    assert {(r.start, r.span) for r in proximity_matches(index, phrases, 3).collect()} == {(0, 5)}


def test_quality(spark, queries, edge):
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries["op6_quality"](spark, SF).join(lab, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    from panelforge.llm.quality import keep_good, score_quality
    every = lambda i: F.lit(True)
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 1)], "doc_id long, quality int")
    assert score_quality(edge, labels, every, every).count() == len(EDGE)
    kept = keep_good(edge, labels.limit(0), every, every)
    assert kept.columns == edge.columns and kept.count() == len(EDGE)


def test_html(spark, queries):
    from panelforge.llm.html_text import extract, main_text
    page = ("<html><head><title>t</title></head><body><header>Top</header><div class='menu'>m</div><main>"
            "<div class='post-12'><h2>T &amp; x</h2><p>a <i>b</i><br>c<p>d<ul><li>e<li>f</ul><form>no</form>"
            "<div class='comments'><p>no</p></div></div></main><footer>f</footer>")
    assert extract(page, None) == "T & x\n\na b c\n\nd\n\ne\n\nf"
    rows = [(1, "http://h.x/a", page, 1), (1, "http://h.x/a", page, 1), (2, None, None, 2), (3, "::bad", "", 3),
            (4, "http://h.x/b", "<p>only <b>this", 4), (5, "http://h.x/c", "<div" * 5000, 5)]
    out = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(out) == 6
    assert {r.page_id: r.text for r in out}[4] == "only this" and {r.text for r in out if r.page_id in (2, 3)} == {""}
    got = queries["op7_html_text"](spark, SF).where("n_chars > 0").count()
    assert got == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_personal_data(spark, queries, docs, edge):
    import hashlib

    from panelforge.llm.pii import base_spans, find_personal_data, luhn, redacted
    digits = lambda s: re.sub("[^0-9]", "", s)
    plain = {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
             "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
             "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)}

    def brute(text):
        return [(k, m.start(), m.end()) for k, (p, ok) in plain.items() for m in re.finditer(p, text) if ok(m[0])]

    rng = np.random.default_rng(0)
    for _ in range(3000):
        text = "".join(rng.choice(list("a1259.@+- ()Z%"), rng.integers(0, 40)))
        assert base_spans(text) == brute(text), text
    for r in queries["op8_pii"](spark, SF).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(docs[r.doc_id].text or ""))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert find_personal_data(edge).count() == len(EDGE)
    assert redacted("a b@c.de f", [("email", 2, 8)]) == "a [EMAIL] f"


def test_nearest(spark, queries):
    from panelforge.llm.ann import nearest
    t = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in t]), np.array([r.embedding for r in t], float)
    s = (x @ x.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None]
    out = collections.defaultdict(list)
    for r in queries["op10_nearest"](spark, SF).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
    hits = []
    for q in np.flatnonzero(ids % 50 == 0):
        best = sorted((-s[q, j], ids[j]) for j in range(len(ids)) if j != q)[:5]
        hits += [j in {v for v, _ in out[ids[q]]} for _, j in best]
        assert all(sc == pytest.approx(s[q, np.flatnonzero(ids == v)[0]], abs=1e-12) for v, sc in out[ids[q]])
    assert np.mean(hits) >= 0.9
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]),
            (6, [float("nan"), 1.0]), (7, [1.0]), (8, [0.0, 3.0]), (8, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, lambda i: i == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 8, 0.0)]
    assert nearest(df.limit(0), lambda i: i == 0).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p
    out = p.run(spark, "/root/testdata/sf0.001")
    assert out.count() == out.select("doc_id").distinct().count() > 0
    docs = spark.createDataFrame([(*r[:2], "en", "s", 1) for r in EDGE], "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 4, 5]


def test_personal_data_in_lists_and_without_marks(spark):
    from panelforge.llm.pii import base_spans, find_personal_data, labelled, loose_spans, span_features
    found = lambda t: {(k, t[a:b]) for k, a, b in loose_spans(t, base_spans(t))}
    both = {("phone", "555-123-4567"), ("phone", "555-765-4321")}
    assert both <= found("555-123-4567, 555-765-4321") and both <= found("555-123-4567 555-765-4321")
    assert ("phone", "(555) 123-4567") in found("10.1.2.3 (555) 123-4567")
    assert not any(k == "ip" and s == "10.1.2.3" for k, s in found("10.1.2.3 (555) 123-4567"))
    # a span that only lacks the mark is no counter-example, and the mark no feature
    t = "write ann (at) mail (dot) org or 49 30 1234567"
    assert not {"ann (at) mail (dot) org", "49 30 1234567"} & {t[a:b] for _, (_, a, b) in labelled(t)}
    a, b = "x ann@mail.org y", "x ann (at) mail (dot) org y"
    assert span_features(a, "email", 2, 14) == span_features(b, "email", 2, 25)
    rng = np.random.default_rng(4)
    num = lambda: "-".join(str(v) for v in [rng.integers(10, 99), rng.integers(100, 999), rng.integers(1000000, 9999999)])
    rows = [(i, f"order 1{i:07d}x phone +{num()} call") for i in range(400)]
    rows += [(1000 + i, f"phone {num()} call") for i in range(200)]
    out = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = {r.doc_id: [(s.kind, s.base) for s in r.spans] for r in out.collect()}
    assert all(("phone", False) in spans[1000 + i] for i in range(200))


def test_personal_data_model_does_not_depend_on_the_layout(spark, monkeypatch):
    from panelforge.llm import pii
    monkeypatch.setattr(pii, "FIT_SPANS", 150)
    # the first document alone has more numbers than are drawn
    rows = [(0, " ; ".join(f"x{7000000 + 13 * i}y" for i in range(3000)))]
    rows += [(i, f"phone +{10 + i % 80} {100 + i % 700} {1000000 + 7919 * i} call") for i in range(1, 900)]
    df = spark.createDataFrame(rows, "row long, text string").coalesce(1)
    models = [pii.fit_spans(d) for d in (df, df.repartition(7, "row"), df.orderBy(F.desc("row")).coalesce(1))]
    assert all(m is not None for m in models)
    phone = pii.KINDS.index("phone")
    assert math.isfinite(models[0].threshold[phone])
    for m in models[1:]:
        assert np.array_equal(m.threshold, models[0].threshold)
        assert all(np.array_equal(a, b) for t, u in zip(m.trees.trees, models[0].trees.trees) for a, b in zip(t, u))


def test_decontamination_of_items_without_id(spark, tmp_path):
    import duckdb

    from panelforge.llm.catalog import ORACLE, QUERIES
    docs = [(1, "a copy of one two three four"), (2, "five six and one two three four"), (3, "clean")]
    items = [(None, "one two three four"), (7, "five six")]
    con = duckdb.connect()
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("benchmark", items, "item_id int, text string")):
        path = str(tmp_path / f"{name}.parquet")
        spark.createDataFrame(rows, schema).write.parquet(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = sorted(map(tuple, QUERIES["op5_decontamination"](spark, str(tmp_path)).collect()))
    assert [r[:4] + r[5:] for r in got] == [(1, 7, 4, 0, True), (2, 7, 6, 1, True), (3, 1, 0, 0, False)]
    assert got == sorted(con.sql(ORACLE["op5_decontamination"]).fetchall())


def test_proximity_needs_every_word(spark):
    from panelforge.llm.decontam import build_index, proximity_matches
    docs = spark.createDataFrame([(1, "a x b c"), (2, "a b q q q q q q c"), (3, "c b a"), (4, "b"), (5, "d"), (6, "d x d")],
                                 "doc_id long, text string")
    phrases = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b"]), (3, ["d", "d"])], "phrase_id long, phrase array<string>")
    index = build_index(docs, phrases.select(F.explode("phrase").alias("term")))
    names = index.docs.select(F.xxhash64("id", "text").alias("doc"), "id")
    got = lambda slop: {tuple(r) for r in proximity_matches(index, phrases, slop).join(names, "doc")
                        .select("phrase_id", "id", "start", "span").collect()}
    one = {(2, 1, 2, 1), (2, 2, 1, 1), (2, 3, 1, 1), (2, 4, 0, 1)}
    assert got(0) == one
    assert got(1) == one | {(1, 1, 0, 4), (3, 6, 0, 3)}
    assert (1, 3, 0, 3) in got(4) and not any(i == 2 and p == 1 for p, i, *_ in got(5))


def test_html_wrappers_named_like_furniture():
    from panelforge.llm.html_text import extract
    body = "<p>" + "the article goes on " * 20 + "</p>"
    want = ("the article goes on " * 20).strip()
    for name in ("content no-sidebar", "layout with-sidebar", "post has-comments", "page-with-left-sidebar"):
        page = (f"<body><div class='menu'><a href='/'>Home</a></div><div class='{name}'>{body}"
                "<div class='sidebar'><p>side</p></div></div><div class='footer'>foot</div>")
        assert extract(page, None) == want, name
    page = f"<body><div class='layout sidebar'><h1>T</h1>{body}<div class='menu'>m</div></div><div>other words</div>"
    assert extract(page, None) == f"T\n\n{want}"
    # reader comments stay out however long they are, as does small furniture
    page = f"<body><div class='post'><p>short</p></div><div class='has-replies comments'>{body}</div><div class='ad'>buy"
    assert extract(page, None) == "short"
    assert extract("<body><p>a<span class='ad'>x</span>b<div class='ad'>buy</div>c d e f", None) == "ab\n\nc d e f"


def test_lm_weights_do_not_depend_on_the_layout(spark, monkeypatch):
    from panelforge.llm import ngram_lm
    monkeypatch.setattr(ngram_lm, "BLOCK", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = [{r.doc_id: r.score for r in ngram_lm.score_texts(d, lambda i: i % 10 != 0).collect()}
           for d in (docs.coalesce(1), docs.repartition(5, "doc_id"))]
    assert len(got[0]) > 100 and got[0] == pytest.approx(got[1], rel=1e-9)


def test_pipeline_drops_by_row(spark, tmp_path):
    import corpus_pipeline as p
    one, other, bad = "one two three four five six seven", "red green blue grey pink black white", "copied passage of the test " * 4
    docs = spark.createDataFrame([(1, one), (2, one), (2, other), (3, other + " !"), (3, bad), (None, one), (None, bad),
                                  (None, "own words only"), (4, "clean"), (4, bad), (4, "clean")], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in p.near_duplicates(spark, docs, "").collect()), key=str)
    assert kept == sorted([(1, one), (2, other), (3, bad), (None, "own words only"), (4, "clean")], key=str)
    spark.createDataFrame([(1, bad)], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = sorted(((r.doc_id, r.text) for r in p.decontaminate(spark, docs, str(tmp_path)).collect()), key=str)
    assert kept == sorted([tuple(r) for r in docs.collect() if r.text != bad], key=str)


def test_language_beyond_one_matrix(spark):
    from panelforge.llm.langid import TILE, predict_language
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: letters[i // 26 % 26] + letters[i % 26] + letters[i // 676 + 3] + letters[i * 7 % 26]
    rows = [(2 * i + k, " ".join([word(i)] * (20 + k)), f"l{i:03d}") for i in range(501) for k in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in predict_language(df, lambda i: i % 2 == 0).collect()}
    assert TILE < 501 and len(out) == 1002 and all(0 <= r.score <= 1 for r in out.values())
    assert sum(out[i].lang_pred == lang for i, _, lang in rows) >= 0.99 * len(rows)


def test_language_tiles_do_not_change_the_result(spark, monkeypatch):
    from panelforge.llm import langid
    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    run = lambda: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in
                         langid.predict_language(df, lambda i: i % 3 != 1).collect())
    whole = run()
    monkeypatch.setattr(langid, "TILE", 2)
    assert run() == whole


def test_language_against_plain_bayes(spark):
    """Scores from a dictionary of cell counts, document by document."""
    from panelforge.llm.langid import ALPHA, BUCKETS, cells, predict_language
    docs = [(0, "the cat and the dog", "en"), (1, "der hund und die katze", "de"), (2, "a dog", "en"), (3, "die", "de"),
            (4, "the hund", None), (5, "", "en"), (6, "123", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")

    def of(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return [int(c) for cell, _ in cells(raw, np.array([0, len(raw)])) for c in cell] if len(raw) else []
    n = {lang: collections.Counter(c for i, t, l in docs if l == lang and i != 2 for c in of(t)) for lang in ("en", "de")}
    for r in predict_language(df, lambda i: i != 2).collect():
        text = docs[r.doc_id][1]
        s = {lang: sum(math.log((n[lang][c] + ALPHA) / (sum(n[lang].values()) + ALPHA * BUCKETS)) for c in of(text)) for lang in n}
        best = max(sorted(s), key=s.get)
        if any(ch.isalpha() for ch in text):
            assert r.lang_pred == best and r.score == pytest.approx(1 / sum(math.exp(v - s[best]) for v in s.values()), abs=1e-5)
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_quality_limit_with_many_ties():
    from panelforge.llm.quality import _limit
    for ties in (1000, 6000):
        p = np.concatenate([np.full(3000, 0.95), np.full(ties, 0.5)])
        y = np.concatenate([np.ones(3000), np.zeros(ties)])
        assert _limit(p, y) == 0.95
    assert _limit(np.zeros(0), np.zeros(0)) == 2.0 and _limit(np.full(2000, 0.7), np.ones(2000)) == 0.7
