"""Quality, language, URL and personal-data operators: held-out accuracy, exact parts against brute force, odd rows."""
import os
import random
import re

import numpy as np
import pytest

from riskspark.llm import langid, pii, quality, urls
from riskspark.llm.queries import URL_RULES

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@needs_tables
def test_quality_on_held_out_documents(spark):
    scores = {r.doc_id: r for r in quality.quality_scores(read(spark, "documents"), read(spark, "labels")).collect()}
    pairs = [(scores[r.doc_id], r.quality) for r in read(spark, "labels").collect() if scores[r.doc_id].held_out]
    good, bad = [s.score for s, q in pairs if q == 1], [s.score for s, q in pairs if q == 0]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.93 and np.mean([s.predicted == q for s, q in pairs]) > 0.9


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(k, q, 0) for k, q in [(5, 1), (6, 1), (7, 0), (8, 0), (9, None), (10, 0), (10, 1), (None, 1), (3, 0), (2, 1)]], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= .5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1 and len({r.score for r in rows if r.doc_id == 8}) == 1
    assert {r.score for r in quality.quality_scores(odd_docs, labels.limit(0)).collect()} == {0.5} and quality.quality_scores(no_docs, labels).count() == 0


@needs_tables
def test_language_on_held_out_documents(spark):
    docs = read(spark, "documents")
    found = langid.identify(docs, keep=["lang"]).where("held_out").collect()
    assert len(found) > 100 and np.mean([r.lang == r.lang_pred for r in found]) > 0.97


def test_folded_network_equals_the_trained_one():
    net, x = langid.ByteNet(3), np.random.default_rng(0).integers(0, 256, (20, langid.WINDOW)).astype(np.uint8)
    logits = np.maximum(net.pooled(x)[0], 0) @ net.p["W"] + net.p["c"]
    want = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    assert np.abs(langid.FoldedNet(net.p).log_probabilities(x) - want).max() < 1e-4


def test_gradients_match_differences():
    net, rng = langid.ByteNet(3), np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (6, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        z = np.maximum(net.pooled(x)[0], 0) @ net.p["W"] + net.p["c"]
        return -(z - np.log(np.exp(z).sum(1, keepdims=True)))[np.arange(6), y].mean()
    g = net.gradients(x, y)
    for name in net.p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        net.p[name][at] += 1e-6
        up = loss()
        net.p[name][at] -= 2e-6
        assert abs((up - loss()) / 2e-6 - g[name][at]) < 1e-4
        net.p[name][at] += 1e-6


def test_language_odd_rows(odd_docs, no_docs):
    rows = langid.identify(odd_docs).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == odd_docs.count() and all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (1, 2, 3, 4)) and by_id[5].lang_pred in ("en", "de")
    kept = langid.with_language(odd_docs)
    assert kept.columns == odd_docs.columns and not {1, 2, 3, 4} & {r.doc_id for r in kept.collect()} and kept.where("doc_id = 8").count() == 2
    assert langid.identify(no_docs).count() == 0 and {r.lang_pred for r in langid.identify(odd_docs.where("lang IS NULL")).collect()} == {"und"}


def test_language_found_goes_with_the_document(spark):
    """Wrong and missing labels give way to the language found; the other columns, repeated rows included, stay as they are."""
    word = {"en": "the house stands near the river and they were walking home", "de": "das haus steht nahe dem fluss und wir gehen gerne nach hause"}
    rows = [(i, f"{w} {i} {w[i % 30:]}", k, i * 10) for i in range(300) for k, w in word.items()]
    odd = [(1000, word["de"], None, 1), (1001, word["en"], "de", 2), (1001, word["en"], "de", 2), (None, word["de"], "en", 3)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score long").repartition(4)
    got = langid.with_language(docs)
    assert got.schema.names == docs.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    assert sorted((r.text, r.score) for r in got.collect()) == sorted((r[1], r[3]) for r in rows + odd)
    found = {(r.doc_id, r.text): r.lang for r in got.collect()}
    assert [found[r[0], r[1]] for r in odd] == ["de", "en", "en", "de"]


def test_segmentation_is_the_most_probable():
    counts = {"free": 30, "bets": 20, "fre": 1, "ebets": 1, "casino": 9, "win": 40, "a": 5, "b": 5}
    s, rnd = urls.Segmenter(counts, 200), random.Random(1)
    assert s.words("freebetscasinowin") == ["free", "bets", "casino", "win"]

    def best(name):
        if not name:
            return 0.0
        return max(s.log.get(name[:k], s.unknown[k]) + best(name[k:]) for k in range(1, len(name) + 1))
    for _ in range(60):
        name = "".join(rnd.choice(["free", "a", "b", "win", "x"]) for _ in range(rnd.randint(1, 4)))[:12]
        assert abs(sum(s.log.get(w, s.unknown[len(w)]) for w in s.words(name)) - best(name)) < 1e-9


def test_urls(spark):
    names = ["http://A.Example.ORG/es/1?q", "http://example.org/en/12#x", "https://example.org/en/2", "http://x.com/fr/", "http://com/de/9", "http://y.com/de", "http://y.net?x=://z/", "http://org", None, "no scheme", "://", "http://u:80/p", "http://myorg/"]
    pages = spark.createDataFrame([(k, u, "<p>free bets</p>" if k % 2 else None) for k, u in enumerate(names)] + [(None, names[0], ""), (0, names[0], None)], "page_id long, url string, html string")
    rows = urls.judge(pages.selectExpr("*", "'clash' AS host", "'clash' AS rule", "'clash' AS verdict"), URL_RULES).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict if r.rule else None) for r in rows if r.page_id is not None}
    assert len(rows) == len(names) + 2 and all(r.verdict in ("allow", "block") for r in rows)
    assert got == {0: ("a.example.org", "/es/1", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"), 2: ("example.org", "/en/2", "org/", "allow"),
                   3: ("x.com", "/fr/", "com/fr/", "allow"), 4: ("com", "/de/9", "com/de/", "block"), 5: ("y.com", "/de", None, None), 6: ("y.net", "", None, None), 7: ("org", "", None, None),
                   8: ("", "", None, None), 9: ("", "", None, None), 10: ("", "", None, None), 11: ("u:80", "/p", None, None), 12: ("myorg", "/", None, None)}
    assert urls.judge(pages.limit(0), URL_RULES).count() == 0 and {r.verdict for r in urls.judge(pages.where("page_id > 7"), URL_RULES).collect()} == {"allow"}


def test_urls_use_words_and_tokens_beyond_the_broadcast_ones(spark):
    names = ["http://casinowin.net/play/now", "http://example.org/es/casino/poker", "http://x.com/fr/garden/tea", "http://y.com/de/poker/now", "http://gardentea.net/play/tea", "http://example.org/fr/tea", "http://gardentea.net/play/tea", "http://zzqq.info/", None]
    html = ["<p>casino win casino</p>", "<p>garden tea garden tea</p>", "<p>play</p>", None]
    pages = spark.createDataFrame([(k, u, html[k % 4]) for k, u in enumerate(names)], "page_id long, url string, html string")
    want = sorted(map(tuple, urls.judge(pages, URL_RULES).collect()))
    assert want[0][5] == ["casino", "win", "net"] and len({r[6] for r in want}) > 3
    for kept in (0, 1, 3):
        assert sorted(map(tuple, urls.judge(pages, URL_RULES, vocabulary=kept, tokens=kept).collect())) == want


def direct(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for k, pattern, least, most in ((2, r"[0-9]([\x20-]?[0-9])+", 16, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            check = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if least <= len(d) <= most and (k == 3 or check):
                out.append((k, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rnd = random.Random(0)
    for _ in range(15000):
        letters = rnd.choice(["a@.-b1", "0123456789 .-", "+1 (2)3-4.5 ", "ab@c.d +1 23.4.5.6 ", "12.3@é ٣", "4 0-"])
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 45)))
        assert pii.base_spans(text) == direct(text)
    for text in ("1" * 100000, "1." * 50000, "@" * 100000, "a@" * 50000, "+1 " * 50000):
        pii.base_spans(text)


def test_skip_edges_carry_a_kind_to_a_similar_run(spark):
    number = lambda k: f"+1 (974) 555-{3000 + k}"
    docs = [(k, f"call {number(k)} today or mail user{k}@mail.example.com . order 12{k} of 2019 . call again {number(k)}") for k in range(300)]
    target = "call +1 (974) 555-3436 soon , or 974-555-3436 tomorrow . order 77 of 2020"
    df = spark.createDataFrame(docs + [(1000, target)], "doc_id long, text string")
    row = pii.find(df, threshold=0.5).where("doc_id = 1000").first()
    spans = [s.split(":") for s in row.spans.split(",")]
    assert row.n_phone == 1 and ["phone", "5", "22"] in spans and ["phone", "33", "45"] in spans and len(spans) == 2


def test_message_passing_is_exact_on_a_tree():
    import itertools
    rng = np.random.default_rng(0)
    graph = pii.Graph()
    graph.place, graph.on, graph.label = [(0, 0, 1)] * 4, [[0], [1], [2], [3]], [-1, -1, 2, -1]
    graph.chain, graph.skip = [(0, 1), (1, 2)], [(1, 3)]
    weight, chain, skip = rng.normal(size=(pii.FEATURES, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5))
    want = np.zeros((4, 5))
    for y in itertools.product(range(5), repeat=4):
        if y[2] == 2:
            p = np.exp(sum(weight[i, y[i]] for i in range(4)) - weight[2, y[2]] + chain[y[0], y[1]] + chain[y[1], y[2]] + skip[y[1], y[3]])
            want[np.arange(4), y] += p
    assert np.abs(pii.marginals(graph, (weight, chain, skip), 60) - want / want.sum(1, keepdims=True)).max() < 1e-4


def test_message_passing_goes_on_until_messages_settle():
    graph, n = pii.Graph(), 300
    graph.add(0, " ".join(f"a{k}" for k in range(n)), [])
    graph.label[0] = 4
    chain = 12.0 * np.eye(5)
    assert len(graph.chain) == n - 1 and not graph.skip
    want = [np.eye(5)[4]]
    step = np.exp(chain) / np.exp(chain).sum(1)
    for _ in range(n - 1):
        want.append(want[-1] @ step)
    assert np.abs(pii.marginals(graph, (np.zeros((pii.FEATURES, 5)), chain, np.zeros((5, 5)))) - want).max() < 1e-4


def test_all_repeats_of_a_base_span_are_found_at_the_production_threshold(spark):
    docs = [" . ".join([f"call +1  974-555-{3000 + k} today"] * 2) for k in range(300)] + [" . ".join([f"item 974-555-{6000 + k} of 12"] * 2) for k in range(600)]
    repeat = "then 974-555-3436 once more . "
    planted = ["call +1  974-555-3436 soon , or 974-555-3436 tomorrow . order 77 of 2020", "call +1  974-555-3436 soon . " + repeat * 50, repeat * 50 + "call +1  974-555-3436 soon ."]
    df = spark.createDataFrame(list(enumerate(docs + planted)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(df).where("doc_id >= 300").collect()}
    masked = {r.doc_id: r.text for r in pii.redact(df).where("doc_id >= 900").collect()}
    assert [rows[k].n_phone for k in (900, 901, 902)] == [1, 1, 1] and {rows[k].spans for k in range(300, 900)} == {""}
    assert [len(rows[k].spans.split(",")) for k in (900, 901, 902)] == [2, 51, 51]
    assert masked[900] == "call [PHONE] soon , or [PHONE] tomorrow . order 77 of 2020" and [masked[k].count("[PHONE]") for k in (901, 902)] == [51, 51]


def test_pii_odd_rows(spark, odd_docs, no_docs):
    rows = pii.find(odd_docs).collect()
    assert len(rows) == odd_docs.count() and next(r for r in rows if r.doc_id == 1).spans == ""
    masked = pii.redact(spark.createDataFrame([(1, "x a@b.de, +1 (974) 555-3436.", "k"), (2, None, "k"), (3, "", "k"), (4, "none", "k")], "doc_id long, text string, spans string"))
    assert [tuple(r) for r in masked.orderBy("doc_id").collect()] == [(1, "x [EMAIL], [PHONE].", "k"), (2, None, "k"), (3, "", "k"), (4, "none", "k")]
    assert pii.find(no_docs).count() == 0 and pii.redact(odd_docs).columns == odd_docs.columns


@pytest.mark.parametrize("ids", ["null", "one", "third", "equal"])
def test_draws_do_not_depend_on_ids(spark, ids):
    """Null ids, one id for all, one id for a third, and one equal row that makes up most of the table: the operators still learn, from a bounded sample."""
    from riskspark.llm.text import drawn, once
    word = {"en": "the house stands near the river and they were walking home", "de": "das haus steht nahe dem fluss und wir gehen gerne nach hause"}
    rows = [(i, f"{w} {i} {w[i % 30:]} call +49 30 1234{i:04d} or mail a{i}@b.org", k) for i in range(300) for k, w in word.items()]
    give = {"null": lambda i: None, "one": lambda i: 192, "third": lambda i: 192 if i % 3 else i, "equal": lambda i: i}[ids]
    rows = [(give(i), t, k) for i, t, k in rows]
    if ids == "equal":
        rows += [(5000, "the very same row of text, again and again", "en")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    for want in (20, 100):
        got = once(drawn(df, want, 41, "lang"), 3 * want).groupBy("lang").count().collect()
        assert {r["lang"] for r in got} == {"de", "en"} and sum(r["count"] for r in got) <= 3 * want and all(r["count"] > want // 3 for r in got)
    x, y, languages = langid.training_windows(df, 50, 2)
    assert languages == ["de", "en"] and len(x) <= 2 * 160 and min(np.bincount(y, minlength=2)) > 10
    assert pii.fit(df, 50) is not None
