"""Event resolution against a sequential restatement of the rule on small random inputs."""
import random
import re

import pytest

from riskspark.operators import dedup as D

STOP = {"the", "and", "for", "near", "with", "from", "into", "over", "report", "advisory", "official"}
RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def toks(t):
    return {w for w in re.findall(r"[a-z0-9]{3,}", (t or "").lower()) if w not in STOP}


def sim(a, b):
    x, y = toks(a["title"]), toks(b["title"])
    j = len(x & y) / len(x | y) if x and y else 0.0
    place = 0.0
    if a["country"] and b["country"] and a["country"].lower() == b["country"].lower():
        place = 0.4
        if a["city"] and b["city"] and a["city"].lower() == b["city"].lower():
            place = 1.0
    kind = 1.0 if a["event_type"] == b["event_type"] else 0.0
    m, n = set(a["entities"] or []), set(b["entities"] or [])
    if m and n:
        kind = 0.6 * kind + 0.4 * len(m & n) / len(m | n)
    if a["published_s"] is None or b["published_s"] is None:
        tm = 0.5
    else:
        h = abs(a["published_s"] - b["published_s"]) / 3600
        tm = 1.0 if h <= 24 else 0.5 if h <= 72 else 0.0
    return int((0.5 * j + 0.25 * place + 0.15 * kind + 0.1 * tm) * 1000 + 0.5 + 1e-6) / 1000


def conflict(a, b):
    def disr(e):
        return any(w in e["description"].lower() for w in ("outage", "disruption", "instability"))

    def rest(e):
        return any(w in e["description"].lower() for w in ("no outage", "fully restored", "false alarm")) or e["status"] == "RESOLVED"
    neg = (rest(b) and disr(a) and a["status"] == "ACTIVE") or (rest(a) and disr(b) and b["status"] == "ACTIVE")
    if neg:
        return "operational_status_and_impact"
    return "severity_assessment" if abs(RANK[a["severity"]] - RANK[b["severity"]]) >= 2 else None


def sequential(events, sources):
    canon, links, topics = [], {}, {}
    for raw in sorted(events, key=lambda e: e["arrival"]):
        e = dict(raw, srcs=[raw["source_id"]], hashes=[raw["origin_hash"]], nconf=0, merged=0, ind=1,
                 corr="Single-source signal")
        best, s0 = None, 0.0
        for c in canon:
            s = sim(c, e)
            if s > s0:
                best, s0 = c, s
        cls = "unique" if s0 < .36 else "candidate_duplicate" if s0 < .55 else "probable_duplicate" if s0 < .78 else "confirmed_duplicate"
        links[e["event_id"]] = (cls, best["event_id"] if cls != "unique" else None, s0 if cls != "unique" else None)
        official = sources[e["source_id"]][1]
        if cls == "unique":
            if official:
                e["status"], e["corr"] = "CONFIRMED", "Official-source confirmation"
            canon.append(e)
            continue
        t = conflict(best, e)
        if t:
            topics[e["event_id"]] = t
            best["nconf"] += 1
        if cls != "confirmed_duplicate":
            if t:
                e["nconf"], e["status"], e["corr"] = 1, "CONTESTED", "Conflicting-source signal"
                best["corr"] = "Conflicting-source signal"
            canon.append(e)
            continue
        b = best
        b["merged"] += 1
        b["srcs"] += [] if e["source_id"] in b["srcs"] else [e["source_id"]]
        b["hashes"] += [] if e["origin_hash"] in b["hashes"] else [e["origin_hash"]]
        b["ind"] = min(len({sources[x][0] for x in b["srcs"]}), max(1, len(b["hashes"])))
        if b["nconf"]:
            b["corr"], b["status"] = "Conflicting-source signal", "CONTESTED"
            b["confidence"] = round(max(.45, b["confidence"] - .15), 3)
        elif any(sources[x][1] for x in b["srcs"]):
            b["corr"], b["status"] = "Official-source confirmation", "CONFIRMED"
            if b["ind"] >= 2:
                b["confidence"] = round(min(.98, b["confidence"] + .08), 3)
        elif b["ind"] >= 2:
            b["corr"], b["status"] = "Multi-source corroborated signal", "CONFIRMED"
            b["confidence"] = round(min(.95, b["confidence"] + .06 * (b["ind"] - 1)), 3)
        else:
            b["corr"] = "Single-source signal"
    return canon, links, topics


def make(seed, n, undated=0.0, named=0.0):
    rnd = random.Random(seed)
    vocab = ["power", "grid", "outage", "campus", "network", "flood", "river", "strike", "port", "virus", "alert", "rail"]
    out = []
    order = rnd.sample(range(5 * n), n)
    for i, a in enumerate(sorted(order)):
        base = rnd.choice([["power", "grid", "outage", "campus"], ["flood", "river", "alert"], []])
        words = base + rnd.sample(vocab, rnd.randint(0, 3))
        out.append({
            "event_id": f"e{i}", "arrival": a, "entities": rnd.sample(["U", "V", "W", "X", "Y"], rnd.randint(1, 3)) if named and rnd.random() < named else rnd.choice([None, []]), "title": " ".join(words), "country": rnd.choice(["IN", "in", "FR", None]),
            "city": rnd.choice(["a", "A", "b", None]), "event_type": rnd.choice(["x", "x", "y"]),
            "published_s": None if rnd.random() < undated else rnd.randint(0, 10 * 86400), "severity": rnd.choice(["LOW", "MEDIUM", "HIGH", "CRITICAL", "MEDIUM"]),
            "status": rnd.choice(["ACTIVE", "ACTIVE", "RESOLVED"]),
            "description": rnd.choice(["outage reported", "fully restored", "no outage seen", "minor news", "disruption"]),
            "source_id": f"s{rnd.randint(0, 6)}", "origin_hash": f"h{rnd.randint(0, 9)}", "confidence": 0.75})
    return out


SOURCES = {f"s{i}": (f"g{i % 3}", i == 6) for i in range(7)}
SCHEMA = ("event_id string, arrival bigint, title string, country string, city string, event_type string, published_s bigint, "
          "severity string, status string, description string, source_id string, origin_hash string, confidence double, entities array<string>")


@pytest.mark.parametrize("seed,n,undated,named", [(1, 40, 0.0, 0.0), (2, 120, 0.0, 0.5), (3, 90, 0.3, 0.0), (4, 120, 0.2, 0.9)])
def test_resolution_conflicts_and_corroboration(spark, seed, n, undated, named):
    events = make(seed, n, undated, named)
    canon, links, topics = sequential(events, SOURCES)
    df = spark.createDataFrame([tuple(e[c.split()[0]] for c in SCHEMA.split(", ")) for e in events], SCHEMA)
    src = spark.createDataFrame([(k, g, o) for k, (g, o) in SOURCES.items()],
                                "source_id string, independence_group string, is_official_source boolean")
    from riskspark.session import stage
    res = stage(D.resolve_duplicates(df))
    got = {r.event_id: (r.duplicate_status, r.matched_id, r.similarity) for r in res.collect()}
    assert got == links
    linked = stage(D.linked_events(df, res, src))
    conf = stage(D.resolve_conflicts(linked))
    assert {r.event_id: r.conflict_topic for r in conf.where("conflict_topic IS NOT NULL").collect()} == topics
    out = {r.event_id: (r.status, r.corroboration_status, r.confidence, r.source_count, r.independent_source_count, r.n_conflicts, r.n_merged)
           for r in D.corroborate(linked, conf).collect()}
    want = {c["event_id"]: (c["status"], c["corr"], c["confidence"], len(c["srcs"]), c["ind"], c["nconf"], c["merged"]) for c in canon}
    assert out == want


@pytest.mark.parametrize("seed,undated,named", [(5, 0.0, 0.6), (6, 0.3, 0.0)])
def test_folds_and_rounds_keep_the_same_events(spark, seed, undated, named):
    """Groups folded in one task, dealt to several tasks, and resolved by rounds alone."""
    from riskspark.session import stage
    events = make(seed, 100, undated, named)
    canon = {c["event_id"] for c in sequential(events, SOURCES)[0]}
    df = spark.createDataFrame([tuple(e[c.split()[0]] for c in SCHEMA.split(", ")) for e in events], SCHEMA)
    ev = stage(D.with_shape(df))
    near = stage(D.similar_shapes(D.shapes(ev)))
    for small in (50_000, 40, 1):
        assert {r.event_id for r in D.resolve_canonical(ev, near, small).collect()} == canon


def test_recurring_report_without_a_city(spark):
    """One headline every day for ten years: a canonical report every fourth day, without a round for each."""
    import time
    rows = [(f"e{i}", i, "power grid outage", "IN", None, "x", i * 86400, "LOW", "ACTIVE", "d", "s1", "h", 0.75, None) for i in range(3650)]
    ev = D.with_shape(spark.createDataFrame(rows, SCHEMA))
    began = time.time()
    got = {r.arrival for r in D.resolve_canonical(ev, D.similar_shapes(D.shapes(ev))).collect()}
    assert got == set(range(0, 3650, 4)) and time.time() - began < 120


def test_pairs_below_the_bound_are_not_written(spark):
    """Groups of titles that share one rare word each: no pair of them leaves the join, while every really similar pair does."""
    from pyspark.sql import functions as F
    rows = [(f"s{i}", "x", "y", "t", [f"g{i // 20:03d}"] + [f"w{i}x{k}" for k in range(9)], []) for i in range(200)]
    rows += [(f"c{i}", "x", "y", "t", rows[i][4][:9] + [f"new{i}"], []) for i in range(0, 200, 7)]
    sh = spark.createDataFrame(rows, "shape string, country_l string, city_l string, event_type string, tokens array<string>, ents array<string>").repartition(3)
    found = D._blocked_pairs(D.ranked_words(sh), ["country_l", "city_l", "event_type"], F.lit(0.559), F.lit(0.559)).distinct().count()
    assert 58 <= found <= 100  # both ways
    got = {(r.shape_a, r.shape_b) for r in D.similar_shapes(sh).collect()}
    assert got == {p for i in range(0, 200, 7) for p in ((f"s{i}", f"c{i}"), (f"c{i}", f"s{i}"))}


def test_best_matches_come_from_blocks_not_from_pairs(spark):
    """However many reports share a frequent word, no row stands for a pair: one comes from each block of earlier reports at most, and the best of them is the best of all."""
    from pyspark.sql import functions as F
    events = make(9, 150, 0.2, 0.6)
    df = spark.createDataFrame([tuple(e[c.split()[0]] for c in SCHEMA.split(", ")) for e in events], SCHEMA).repartition(3)
    said = [e for e in events if toks(e["title"]) or e["entities"]]
    want = {}
    for i, e in enumerate(said):
        best = max(((sim(c, e), -c["arrival"], c["event_id"]) for c in said[:i]), default=(0,))
        if best[0] >= .36:
            want[e["event_id"]] = (best[2], best[0])
    none = spark.createDataFrame([], "event_id string, floor double")
    for block in (16, 8192):
        found = D._shared_word_candidates(D.with_shape(df), none, block)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
        assert found.groupBy("event_id").count().agg(F.max("count")).first()[0] <= -(-len(said) // block)
        assert {r.event_id: (r.matched_id, r.similarity) for r in D._best(found).collect()} == want


def test_matches_at_or_above_the_floor_only(spark):
    """A floor leaves out weaker matches and keeps equal ones; reports without a type, words or entities have no match by words."""
    rows = [("a", 1, "power outage", "IN", "x", "t", 0, []), ("b", 2, "power grid", "IN", "x", "t", 0, []), ("c", 3, "power outage now", "IN", "x", "t", None, ["U"]),
            ("d", 4, "power outage", "IN", "x", None, 0, []), ("e", 5, "", "IN", "x", "t", 0, None)]
    df = D.with_shape(spark.createDataFrame(rows, "event_id string, arrival bigint, title string, country string, city string, event_type string, published_s bigint, entities array<string>"))
    found = lambda floors: sorted((r.event_id, r.matched_id, r.similarity) for r in D._shared_word_candidates(df, spark.createDataFrame(floors, "event_id string, floor double"), 2).collect())
    assert found([]) == [("b", "a", 0.667), ("c", "a", 0.783)]
    assert found([("b", 0.667), ("c", 0.784)]) == [("b", "a", 0.667)]


@pytest.mark.parametrize("seed,undated,named", [(10, 0.0, 0.0), (11, 0.2, 0.7)])
def test_close_events_first_then_all_others(spark, seed, undated, named):
    """The best match of every report is found among those of its city and type or within three days, or by the blocks that need not look there again."""
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.8)) % 300}" for _ in range(400)]
    events = make(seed, 160, undated, named)
    for e in events:  # skewed words, months apart; some reports name entities only
        e["title"] = " ".join(rnd.sample(words, rnd.randint(1, 25))) if rnd.random() < 0.95 else ""
        e["published_s"] = e["published_s"] and e["published_s"] * 90
        e["city"], e["event_type"] = rnd.choice(["a", "A", "b", "c", "d", "e", None]), rnd.choice("uvwxyz")
    for i in range(40, 160, 3):
        events[i]["title"] = events[i - 40]["title"] + " " + rnd.choice(words)
    df = spark.createDataFrame([tuple(e[c.split()[0]] for c in SCHEMA.split(", ")) for e in events], SCHEMA).repartition(3)
    said = [e for e in events if toks(e["title"]) or e["entities"]]
    want = {}
    for i, e in enumerate(said):
        top = max(((sim(c, e), -c["arrival"], c["event_id"]) for c in said[:i]), default=(0,))
        if top[0] >= .36:
            want[e["event_id"]] = (top[2], top[0])
    from pyspark.sql import functions as F
    from riskspark.session import stage
    worded = D._worded(D.with_shape(df))
    best = lambda d: {r.event_id: (r.matched_id, r.similarity) for r in D._best(d).collect()}
    for block in (24, None):
        close = stage(D._close_candidates(worded[0], spark.createDataFrame([], "event_id string, floor double"), block))
        floors = close.groupBy("event_id").agg(F.max("similarity").alias("floor"))
        rest = D._shared_word_candidates(worded[0], floors, block, worded)
        assert best(close.unionByName(rest)) == want
        assert block is None or best(close) != want


def test_frequent_words_are_not_looked_up():
    """Titles of three words that all share and nine of their own: where a match needs half of a title, no pair of them is scored, and a later copy finds its original."""
    import numpy as np
    import pyarrow as pa
    titles = [[0, 1, 2] + [10 + 9 * i + k for k in range(9)] for i in range(500)] + [[0, 1, 2] + [10 + 9 * 7 + k for k in range(8)] + [9]]
    e = pa.array([{"event_id": f"e{i}", "arrival": i, "published_s": i * 10 ** 6, "country_l": "in", "city_l": f"c{i}", "event_type": f"t{i}", "words": sorted(t), "ents": [], "floor": 0.5} for i, t in enumerate(titles)],
                 pa.struct([("event_id", pa.string()), ("arrival", pa.int64()), ("published_s", pa.int64()), ("country_l", pa.string()), ("city_l", pa.string()), ("event_type", pa.string()),
                            ("words", pa.list_(pa.int32())), ("ents", pa.list_(pa.string())), ("floor", pa.float64())]))
    scored = []
    kept, D.sharing = D.sharing, lambda a, b, part, narrowed: kept(a, b, part, lambda y, x: (scored.extend(x.tolist()), narrowed(y, x))[1])
    try:
        got = D._best_between(e, e, 0, True).to_pylist()
    finally:
        D.sharing = kept
    assert got == [{"event_id": "e500", "matched_id": "e7", "matched_arrival": 7, "similarity": 0.523}] and len(scored) < 1600
    assert np.isclose(0.5 * 11 / 13 + 0.1, 0.523, atol=1e-3)
