"""Near-duplicate resolution and corroboration of event reports.

Reports with equal place, type, title words and entities form one *shape*. All similarity parts except time are constant per
pair of shapes, so copies never have to be paired with each other: joins run between distinct shapes, and an event
meets only the few canonical events of similar shapes. Links below the confirmed class compare canonical events block by block:
first those of one city and type and those within three days, then all others, which by then have to be far more alike.
"""
from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskspark.functions.num import key9, rnd
from riskspark.operators.set_join import Sets, numbered, numbered_words, sharing
from riskspark.session import stage

# Title words that carry no meaning, and the similarity weights and class limits.
STOP_WORDS = ["the", "and", "for", "near", "with", "from", "into", "over", "report", "advisory", "official"]
W_TITLE, W_PLACE, W_KIND, W_TIME = 0.50, 0.25, 0.15, 0.10
CONFIRMED, PROBABLE, CANDIDATE = 0.78, 0.55, 0.36
KIND_TYPE, KIND_ENTITIES = 0.6, 0.4  # split of the kind part between two reports that both name entities
HALF_STEP = 0.0005  # scores are rounded to three decimals before they are compared
SIGNATURE = 4  # longs of a set's signature
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def severity_rank(c: Column, default: int = 2) -> Column:
    m = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    return F.coalesce(m[c], F.lit(default))


def title_tokens(title: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(STOP_WORDS))))


def with_shape(events: DataFrame) -> DataFrame:
    """Add lower-cased place, title tokens, entities (none where there is no such column) and the shape id."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    none = F.array().cast("array<string>")
    ents = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("entities", none)))) if "entities" in events.columns else none
    d = events.withColumns({"country_l": low("country"), "city_l": low("city"), "tokens": title_tokens(F.col("title")), "ents": ents})
    key = F.concat_ws("\u0001", "country_l", "city_l", "event_type", F.array_join("tokens", " "), F.array_join("ents", "\u0002"))
    return d.withColumn("shape", F.sha2(key, 256))


def shapes(shaped: DataFrame) -> DataFrame:
    return shaped.select("shape", "country_l", "city_l", "event_type", "tokens", "ents").distinct()


def jaccard(a: str, b: str) -> Column:
    inter = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        inter / (F.size(a) + F.size(b) - inter).cast("double"))


def place_match(a: str, b: str) -> Column:
    same = (F.col(f"{a}.country_l") != "") & (F.col(f"{a}.country_l") == F.col(f"{b}.country_l"))
    city = (F.col(f"{a}.city_l") != "") & (F.col(f"{a}.city_l") == F.col(f"{b}.city_l"))
    return F.when(same & city, 1.0).when(same, 0.4).otherwise(0.0)


def time_match(seconds: Column) -> Column:
    """Full credit within a day, half within three days or where a time is missing."""
    return F.when(seconds <= 86400, 1.0).when((seconds <= 259200) | seconds.isNull(), 0.5).otherwise(0.0)


def classify(sim: Column) -> Column:
    return (F.when(sim >= CONFIRMED, "confirmed_duplicate").when(sim >= PROBABLE, "probable_duplicate")
            .when(sim >= CANDIDATE, "candidate_duplicate").otherwise("unique"))


def kind_match(a: str, b: str) -> Column:
    """Equal types, and the overlap of entities where both reports name some."""
    same = (F.col(f"{a}.event_type") == F.col(f"{b}.event_type")).cast("double")
    both = (F.size(F.col(f"{a}.ents")) > 0) & (F.size(F.col(f"{b}.ents")) > 0)
    return F.when(both, KIND_TYPE * same + KIND_ENTITIES * jaccard(f"{a}.ents", f"{b}.ents")).otherwise(same)


def _most_kind(same_type: bool) -> Column:
    """The largest kind part that a report can have with any other of the same, or of another, type."""
    return F.lit(1.0) if same_type else F.when(F.size("ents") > 0, KIND_ENTITIES).otherwise(0.0)


def _ranked(sh: DataFrame, words: str, out: str) -> DataFrame:
    """The words of every shape ordered from rare to frequent (the order that makes prefixes selective), and a signature of SIGNATURE longs.

    Every word flips one bit, so two signatures differ in at most as many bits as the sets differ in words.
    """
    t = sh.select("sid", F.explode(words).alias("token"))
    freq = t.groupBy("token").agg(F.count("*").alias("df"))
    bit = F.xxhash64("token")
    flip = lambda k: F.when(F.pmod(F.shiftright(bit, 6), F.lit(SIGNATURE)) == k, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))).otherwise(0)
    got = t.join(freq, "token").groupBy("sid").agg(
        F.array_sort(F.collect_list(F.struct("df", "token"))).alias("_r"), *[F.bit_xor(flip(k)).alias(f"{out}_{k}") for k in range(SIGNATURE)])
    return sh.join(got, "sid", "left").withColumns({
        out: F.coalesce(F.transform("_r", lambda x: x["token"]), F.array().cast("array<string>")),
        **{f"{out}_{k}": F.coalesce(f"{out}_{k}", F.lit(0).cast("long")) for k in range(SIGNATURE)}}).drop("_r")


def ranked_words(sh: DataFrame) -> DataFrame:
    """Title words and entities of every shape, both ordered from rare to frequent, and a number ``sid`` in place of the long id."""
    numbered = stage(sh.withColumn("sid", F.monotonically_increasing_id()))
    return _ranked(_ranked(numbered, "tokens", "ranked"), "ents", "ranked_ents")


def _prefix(min_jaccard: Column, words: str = "ranked") -> Column:
    """Leading words of which two sets with at least this Jaccard must share one."""
    n = F.size(words)
    keep = n - F.ceil(n * F.greatest(min_jaccard, F.lit(1e-9))).cast("int") + 1
    return F.slice(words, F.lit(1), F.greatest(F.lit(0), F.least(n, keep)))


def _blocked_pairs(side_of: DataFrame, keys: list[str], need_left: Column, need_right: Column | None = None, words: str = "ranked") -> DataFrame:
    """Pairs (sid_a, sid_b) equal on ``keys`` that share a prefix word and may reach the left row's Jaccard; a pair may come several times.

    Thresholds may differ by row; the right ones are the lowest that any left row may ask of that row. Without right ones both sides ask the same, and a pair comes with the
    smaller number first. A posting holds numbers only: sizes, the place of the word (sets share no more than what follows their first common word) and the signature
    bound the overlap inside the join, so that the many pairs which share no more than a frequent word or two are never written.
    """
    sig = [f"_s{k}" for k in range(SIGNATURE)]

    def side(x: str, j: Column) -> DataFrame:
        d = side_of.select("sid", *keys, F.size(words).alias("_n"), F.greatest(j, F.lit(1e-9)).alias("_j"),
                           *[F.col(f"{words}_{k}").alias(s) for k, s in enumerate(sig)], F.posexplode(_prefix(j, words)).alias("_at", "_t"))
        return d.select(F.xxhash64(*keys, "_t").alias("_k"), "sid", "_j", "_n", (F.col("_n") - F.col("_at")).alias("_rest"), *sig).alias(x)
    a, b = side("a", need_left), side("b", need_left if need_right is None else need_right)
    both = F.col("a._n") + F.col("b._n")
    apart = sum((F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in sig), F.lit(0))
    shared = F.least(F.col("a._rest"), F.col("b._rest"), F.floor((both - apart) / 2))
    order = F.col("a.sid") < F.col("b.sid") if need_right is None else F.col("a.sid") != F.col("b.sid")
    return a.join(b, (F.col("a._k") == F.col("b._k")) & order & (shared >= F.col("a._j") * (both - shared) - 1e-9)).select(
        F.col("a.sid").alias("sid_a"), F.col("b.sid").alias("sid_b"))


def _score_pairs(pairs: DataFrame, ranked: DataFrame, name: str = "shape") -> DataFrame:
    """Similarity of pairs of ranked shapes without the time part; column ``name`` of the shapes names them in the result."""
    side = ranked.select("sid", F.col(name).alias("name"), "country_l", "city_l", "event_type", "tokens", "ents")
    a, b = side.alias("a"), side.alias("b")
    met = pairs.groupBy("sid_a").agg(F.collect_set("sid_b").alias("_met"))  # once each, and as one row of numbers a shape
    d = met.join(a, F.col("sid_a") == F.col("a.sid")).withColumn("sid_b", F.explode("_met")).drop("_met").join(b, F.col("sid_b") == F.col("b.sid"))
    base = (F.lit(W_TITLE) * jaccard("a.tokens", "b.tokens") + F.lit(W_PLACE) * place_match("a", "b")
            + F.lit(W_KIND) * kind_match("a", "b"))
    return d.select(F.col("a.name").alias("shape_a"), F.col("b.name").alias("shape_b"), base.alias("base"))


def similar_shapes(sh: DataFrame, name: str = "shape") -> DataFrame:
    """Ordered pairs of distinct shapes that can reach the confirmed class, with their time-free similarity.

    Limits on title Jaccard follow from the weights: with full time credit a confirmed pair needs .559 in the same
    city and type; .859 in the same country with equal type; and in the same city with different types .859, or .739 where
    both reports name entities, whose overlap then counts .06 at most. No other pair can reach it. Column ``name`` of the shapes names them in the result.
    """
    r = stage(ranked_words(sh))
    need = lambda place, kind: (CONFIRMED - HALF_STEP - W_PLACE * place - W_KIND * kind - W_TIME) / W_TITLE
    block = lambda keys, place, kind: _blocked_pairs(r, keys, need(place, kind))
    pairs = (
        block(["country_l", "city_l", "event_type"], 1.0, _most_kind(True))
        .unionByName(block(["country_l", "city_l"], 1.0, _most_kind(False)))
        .unionByName(block(["country_l", "event_type"], 0.4, _most_kind(True)))
    )
    once = _score_pairs(pairs, r, name).where(F.col("base") + W_TIME >= CONFIRMED - HALF_STEP)
    ways = F.array(F.struct("shape_a", "shape_b", "base"), F.struct(F.col("shape_b").alias("shape_a"), F.col("shape_a").alias("shape_b"), "base"))
    return once.select(F.inline(ways))


def self_similarity() -> Column:
    """Time-free similarity of two events of one shape."""
    return (F.when(F.size("tokens") > 0, W_TITLE).otherwise(0.0)
            + F.when((F.col("country_l") != "") & (F.col("city_l") != ""), W_PLACE)
            .when(F.col("country_l") != "", W_PLACE * 0.4).otherwise(0.0) + F.lit(W_KIND))


def score(base: Column, t_a: Column, t_b: Column) -> Column:
    return rnd(key9(base + F.lit(W_TIME) * time_match(F.abs(t_a - t_b))), 3)


def _reach(base: Column) -> Column:
    """Seconds within which two reports of this time-free similarity are confirmed duplicates; null where they never are."""
    at = lambda credit: rnd(key9(base + F.lit(W_TIME * credit)), 3) >= CONFIRMED
    return F.when(at(0.0), F.lit(1 << 62)).when(at(0.5), 259200).when(at(1.0), 86400)


def _groups(edges: DataFrame) -> DataFrame:
    """(shape, grp): shapes linked over any number of edges get the same group, by spreading the least label and jumping over labels."""
    label = stage(edges.select(F.col("shape_a").alias("shape")).distinct().withColumn("grp", F.col("shape")))
    while True:
        of = label.select(F.col("shape").alias("shape_b"), F.col("grp").alias("_g"))
        near = edges.join(of, "shape_b").groupBy(F.col("shape_a").alias("shape")).agg(F.min("_g").alias("_g"))
        low = label.join(near, "shape").select("shape", F.col("grp").alias("_old"), F.least("grp", "_g").alias("_l"))
        up = low.select(F.col("shape").alias("_l"), F.col("_l").alias("_up"))
        moved = stage(low.join(up, "_l").select("shape", "_old", F.least("_l", "_up").alias("grp")))
        label = moved.drop("_old")
        if moved.where("grp <> _old").isEmpty():
            return label


def _fold(events: pa.Table, edges: pa.Table) -> pa.Table:
    """The sequential rule over the events of some groups, in arrival order: rows of the events that become canonical."""
    near: dict[str, list[tuple[str, int]]] = {}
    for a, b, reach in zip(*(edges.column(c).to_pylist() for c in ("shape_a", "shape_b", "reach"))):
        near.setdefault(a, []).append((b, reach))
    dated: dict[str, list[int]] = {}  # times of each shape's canonical events, in order
    undated: set[str] = set()
    rows, kept = zip(*(events.column(c).to_pylist() for c in ("shape", "published_s"))), []
    order = pc.sort_indices(events, sort_keys=[("arrival", "ascending")]).to_pylist()
    rows = list(rows)
    for i in order:
        shape, t = rows[i]
        for other, reach in near[shape]:
            times = dated.get(other, ())
            if t is None or reach >= 1 << 62:
                hit = reach >= 259200 and (bool(times) or other in undated)
            else:
                k = bisect_left(times, t - reach)
                hit = k < len(times) and times[k] <= t + reach or reach >= 259200 and other in undated
            if hit:
                break
        else:
            kept.append(i)
            if t is None:
                undated.add(shape)
            else:
                insort(dated.setdefault(shape, []), t)
    return events.select(["event_id", "arrival", "published_s", "shape"]).take(pa.array(kept, pa.int64()))


def resolve_canonical(shaped: DataFrame, near: DataFrame, small: int = 50_000) -> DataFrame:
    """Events that start a canonical record: first in arrival order among everything they would be merged with.

    Sequentially, an event is merged when an earlier canonical event scores .78 or more. Shapes linked by such scores form groups that do
    not touch each other: groups of at most ``small`` events are folded in arrival order, about ``small`` events in a task. Larger groups take parallel rounds, which give
    the same result: the earliest open event of a shape becomes canonical once no similar
    shape holds an earlier open event; then every open event it covers is closed. The globally earliest open event always qualifies, so the rounds end. Two
    canonical events of one fully located shape cannot exist, so a round joins events with few canonical rows.
    """
    cols = ["event_id", "arrival", "published_s", "shape"]
    own = shapes(shaped).select(F.col("shape").alias("shape_a"), F.col("shape").alias("shape_b"), self_similarity().alias("base"))
    edges = stage(near.unionByName(own).withColumn("reach", _reach(F.col("base"))).where("reach IS NOT NULL"))
    # a shape without any edge cannot be merged: all its events are canonical at once
    done = shaped.select(*cols).join(edges.select(F.col("shape_a").alias("shape")).distinct(), "shape", "left_anti").select(*cols)
    group = _groups(edges)
    rest = stage(shaped.select(*cols).join(group, "shape"))
    size = rest.groupBy("grp").agg(F.count("*").alias("_n"))
    tasks = max(1, -(-rest.count() // small))
    dealt = stage(size.where(F.col("_n") <= small).select("grp", F.pmod(F.xxhash64("grp"), F.lit(tasks)).alias("task")))
    links = edges.select("shape_a", "shape_b", "reach").join(group.withColumnRenamed("shape", "shape_a"), "shape_a").join(dealt, "grp")
    folded = rest.join(dealt, "grp").select("task", *cols).groupBy("task").cogroup(
        links.select("task", "shape_a", "shape_b", "reach").groupBy("task")).applyInArrow(_fold, shaped.select(*cols).schema)
    done = done.unionByName(folded)
    open_ = stage(rest.join(dealt, "grp", "left_anti").select(*cols))
    while not open_.isEmpty():
        lead = open_.groupBy("shape").agg(F.min_by(F.struct("event_id", "arrival", "published_s"), "arrival").alias("l"))
        lead = lead.select("shape", "l.*")
        first = lambda n: lead.select(F.col("shape").alias(f"shape_{n}"), F.col("arrival").alias(f"_{n}"))
        blocked = (
            edges.where("shape_a <> shape_b").join(first("a"), "shape_a").join(first("b"), "shape_b")
            .where("_b < _a").select(F.col("shape_a").alias("shape")).distinct()
        )
        new = stage(lead.join(blocked, "shape", "left_anti").select(*cols))
        cover = new.select(F.col("shape").alias("shape_a"), F.col("arrival").alias("_c"), F.col("published_s").alias("_ct"))
        closed = (
            open_.join(edges, open_.shape == edges.shape_b).join(cover, "shape_a")
            .where((F.col("arrival") > F.col("_c"))
                   & (score(F.col("base"), F.col("published_s"), F.col("_ct")) >= CONFIRMED)).select("event_id")
        )
        open_ = stage(open_.join(closed.unionByName(new.select("event_id")), "event_id", "left_anti"))
        done = done.unionByName(new)
    return done


def _best(cands: DataFrame) -> DataFrame:
    """Best earlier canonical event per event: highest score, earliest arrival on ties."""
    return cands.groupBy("event_id").agg(
        F.max_by(F.struct("matched_id", "similarity"), F.struct("similarity", -F.col("matched_arrival"))).alias("_m")
    ).select("event_id", "_m.*")


def _earliest_in_group(canon: DataFrame, key: list[str], base: Column, asks: Column | bool = True, answers: Column | bool = True) -> DataFrame:
    """Earliest canonical event of the same group: within a day, within three days, at any time.

    ``asks`` tells which members look for a match, ``answers`` which may be one. These are equally similar but for time, so these three are the only possible best matches and
    the members are never paired with each other. Rows are copied to their own and the two adjacent three-day
    buckets: a busy group is spread over its days and the frames stay inside one bucket. Undated events have half the time
    credit with every member.
    """
    asks, answers = (F.lit(c) if isinstance(c, bool) else c for c in (asks, answers))
    canon = canon.withColumns({"_asks": asks, "_answers": answers}).where("_asks OR _answers")
    span = 259200
    b = F.floor(F.col("published_s") / span)
    d = canon.where("published_s IS NOT NULL").withColumns({"_own": b, "_base": base}).withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    me = F.when(F.col("_answers"), F.struct(F.col("arrival"), F.col("event_id")))
    frame = lambda s: W.partitionBy(*key, "_b").orderBy("published_s").rangeBetween(-s, s)
    d = d.withColumns({"_d1": F.min(me).over(frame(86400)), "_d3": F.min(me).over(frame(span))}).where("_b = _own AND _asks")
    first = canon.groupBy(*key).agg(F.min(me).alias("_any"), F.min(F.when(F.col("published_s").isNull(), me)).alias("_undated"))
    undated = canon.where("published_s IS NULL AND _asks").withColumns({"_base": base, "_d1": F.lit(None).cast(d.schema["_d1"].dataType)})
    cols = ["event_id", "arrival", *key, "_base", "_d1", "_d3", "_any"]
    d = d.join(first, key).withColumn("_d3", F.least("_d3", "_undated")).select(cols).unionByName(
        undated.join(first, key).withColumn("_d3", F.col("_any")).select(cols))
    opts = F.array(*[F.struct(F.col(f"{n}.event_id").alias("matched_id"), F.col(f"{n}.arrival").alias("matched_arrival"),
                              rnd(key9(F.col("_base") + W_TIME * t), 3).alias("similarity"))
                     for n, t in (("_d1", 1.0), ("_d3", 0.5), ("_any", 0.0))])
    return d.select("event_id", "arrival", F.inline(opts)).where("matched_arrival < arrival").drop("arrival")


def _place_candidates(canon: DataFrame) -> DataFrame:
    """Best matches that share city and type but no title word.

    Without entities on one side the type stands for them; between two reports with entities this counts no overlap, and pairs
    that share an entity are scored on their own.
    """
    c, key = canon.where("country_l <> '' AND city_l <> ''"), ["country_l", "city_l", "event_type"]
    named = F.size("ents") > 0
    full, bare = F.lit(W_PLACE + W_KIND), F.lit(W_PLACE + W_KIND * KIND_TYPE)
    return (_earliest_in_group(c, key, full, ~named, True).unionByName(_earliest_in_group(c, key, full, named, ~named))
            .unionByName(_earliest_in_group(c, key, bare, named, named)))


def _codes(*columns: pa.Array) -> list[np.ndarray]:
    """Columns of strings as numbers, equal ones for equal strings in any of the columns."""
    all_ = pa.chunked_array([c.cast(pa.large_string()) for c in columns]).combine_chunks().dictionary_encode()
    return np.split(all_.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([len(c) for c in columns])[:-1])


class _Holders:
    """Which rows of a block hold a word: one list for each word; rows of another block count the words that they share with every row."""

    def __init__(self, a: pa.ListArray, b: pa.ListArray):
        (word_a, word_b), self.size = _codes(a.flatten(), b.flatten()), len(a)
        self.n_a, self.n_b = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
        words = int(max(word_a.max(initial=-1), word_b.max(initial=-1))) + 1
        held = np.repeat(np.arange(self.size), self.n_a)[np.argsort(word_a, kind="stable")]
        self.lists = np.split(held, np.cumsum(np.bincount(word_a, minlength=words))[:-1]) if words else []
        self.word_b, self.at = word_b.tolist(), np.concatenate([[0], np.cumsum(self.n_b)]).tolist()

    def shared(self, y: int) -> np.ndarray:
        mine = self.word_b[self.at[y]:self.at[y + 1]]
        return np.bincount(np.concatenate([self.lists[w] for w in mine]), minlength=self.size) if mine else np.zeros(self.size, np.int64)

    def jaccard(self, shared: np.ndarray, y: int, x: np.ndarray | slice = slice(None)) -> np.ndarray:
        return shared / np.maximum(self.n_a[x] + self.n_b[y] - shared, 1).astype(np.float64)


def _best_between(a: pa.StructArray, b: pa.StructArray, frequent: int = 0, settled: bool = False) -> pa.Table:
    """Best earlier event among those of block a for every event of block b that finds one at or above its floor; scored as `score` does.

    Settled: pairs of one city and type, and pairs within three days, may be left out, so titles must be so much more alike; the words of such
    titles are counted only until it is clear that they are not. The first ``frequent`` words are kept as bits.
    """
    field = lambda x, c: x.field(c).to_numpy(zero_copy_only=False)
    (country_a, country_b), (city_a, city_b), (type_a, type_b) = (_codes(a.field(c), b.field(c)) for c in ("country_l", "city_l", "event_type"))
    country_a[field(a, "country_l") == ""] = -1  # an empty place equals none
    city_a[field(a, "city_l") == ""] = -1
    came_a, came_b, floor = field(a, "arrival"), field(b, "arrival"), field(b, "floor")
    time_a, time_b = (x.field("published_s").fill_null(0).to_numpy(zero_copy_only=False) for x in (a, b))
    undated_a, undated_b = (x.field("published_s").is_null().to_numpy(zero_copy_only=False) for x in (a, b))
    words_a, words_b, names = Sets(a.field("words"), frequent), Sets(b.field("words"), frequent), _Holders(a.field("ents"), b.field("ents"))
    most = W_PLACE + W_KIND + W_TIME  # what two events may score without a shared title word
    if settled:
        first = np.full(max(country_a.max(initial=-1), country_b.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, country_a[country_a >= 0], came_a[country_a >= 0])  # first event of each country
        same_country = W_PLACE + W_KIND * KIND_ENTITIES * (names.n_b > 0)  # one city but not one type; or one type, and less for the country
        most = np.where(first[country_b] < came_b, same_country, W_KIND) + W_TIME * np.where(undated_b | undated_a.any(), 0.5, 0.0)
    least = np.maximum((floor - most - HALF_STEP - 1e-6) / W_TITLE, 0.0)
    part = np.where(came_a.min(initial=np.iinfo(np.int64).max) < came_b, least / (1 + least), 2.0)

    def others(y: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place part of the score, equal types, and time credit."""
        near = country_a[x] == country_b[y]
        apart = np.abs(time_a[x] - time_b[y])
        time = np.where(undated_a[x] | undated_b[y], 0.5, np.where(apart <= 86400, 1.0, np.where(apart <= 259200, 0.5, 0.0)))
        return W_PLACE * np.where(near & (city_a[x] == city_b[y]), 1.0, np.where(near, 0.4, 0.0)), (type_a[x] == type_b[y]).astype(np.float64), time

    def narrowed(y: int, x: np.ndarray) -> np.ndarray:
        """As `part`, for the pair at hand; only entities are still taken for equal."""
        place, kind, time = others(y, x)
        kind = np.where(names.n_a[x] > 0, KIND_TYPE * kind + KIND_ENTITIES, kind) if names.n_b[y] else kind
        least = np.maximum((floor[y] - place - W_KIND * kind - W_TIME * time - HALF_STEP - 1e-6) / W_TITLE, 0.0)
        return np.where(came_a[x] < came_b[y], least / (1 + least), 2.0)
    found: list[tuple[int, int, float]] = []
    for y, x, shared in sharing(words_a, words_b, part, narrowed):
        earlier = came_a[x] < came_b[y]
        x, shared = x[earlier], shared[earlier]
        if not len(x):
            continue
        title = shared / np.maximum(words_a.n[x] + words_b.n[y] - shared, 1).astype(np.float64)
        place, kind, time = others(y, x)
        if names.n_b[y]:
            alike = KIND_TYPE * kind + KIND_ENTITIES * names.jaccard(names.shared(y)[x], y, x)
            kind = np.where(names.n_a[x] > 0, alike, kind)
        total = W_TITLE * title + place + W_KIND * kind + W_TIME * time
        total = np.floor(np.floor(total * 1e9 + 0.5) / 1e9 * 1e3 + 0.5) / 1e3
        top = total.max()
        if top >= floor[y]:
            tied = x[total == top]
            found.append((y, int(tied[np.argmin(came_a[tied])]), float(top)))
    at_b, at_a, top = (list(c) for c in zip(*found)) if found else ([], [], [])
    at_a = pa.array(at_a, pa.int64())
    return pa.table([b.field("event_id").take(pa.array(at_b, pa.int64())), a.field("event_id").take(at_a), a.field("arrival").take(at_a), pa.array(top, pa.float64())],
                    names=["event_id", "matched_id", "matched_arrival", "similarity"])


COMPARED = ["event_id", "arrival", "published_s", "country_l", "city_l", "event_type", "words", "ents"]


def _worded(canon: DataFrame, common: int = 12) -> tuple[DataFrame, int]:
    """Events with title words or entities, their words as numbers from frequent to rare, and how many words more than one ``common``-th of the events hold."""
    d = canon.where("event_type IS NOT NULL AND arrival IS NOT NULL AND (size(tokens) > 0 OR size(ents) > 0)")
    d = stage(d.withColumn("_row", F.monotonically_increasing_id()))
    words, of = numbered_words(d.select("_row", F.explode("tokens").alias("token")), "_row")
    none = F.array().cast("array<int>")
    d = stage(d.join(of, "_row", "left").select(*COMPARED[:-2], F.coalesce("words", none).alias("words"), "ents"))
    return d, words.where(F.col("minus_df") < -(d.count() // common)).count()


def _with_floor(said: DataFrame, floors: DataFrame) -> DataFrame:
    return said.join(floors, "event_id", "left").withColumn("floor", F.greatest(F.coalesce("floor", F.lit(CANDIDATE)), F.lit(CANDIDATE)))


def _block_size(rows: int) -> int:
    """Eight blocks of a small table; the pairs of blocks of a large one are many tasks anyway."""
    return min(1 << 16, max(1 << 13, rows // 8))


def _met_blocks(rows: DataFrame, block: int, n: int, meet: Column) -> DataFrame:
    """Every two blocks a and b of ``block`` consecutive rows (``idx``) that may hold an earlier event for one of b: a Cartesian product of a checkpoint."""
    blocks = rows.groupBy(F.floor(F.col("idx") / block).alias("blk"), "way").agg(
        F.array_sort(F.collect_list(F.struct("idx", "key", *COMPARED, "floor"))).alias("events"), F.min("arrival").alias("least"), F.max("arrival").alias("most"),
        F.min("key").alias("from"), F.max("key").alias("to"))
    blocks = stage(blocks.repartitionByRange(max(1, -(-n // block)), "blk"))
    return blocks.alias("a").join(blocks.alias("b").hint("shuffle_replicate_nl"), (F.col("a.way") == F.col("b.way")) & (F.col("a.least") < F.col("b.most")) & meet).select(
        F.col("a.way").alias("way"), F.col("a.events").alias("a"), F.col("b.events").alias("b"))


def _match_type(canon: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in canon.schema}
    return f"event_id {kinds['event_id']}, matched_id {kinds['event_id']}, matched_arrival {kinds['arrival']}, similarity double"


def _close_candidates(said: DataFrame, floors: DataFrame, block: int | None = None) -> DataFrame:
    """Best match among the earlier events of the same city and type, and among those within three days, one row for each block of events.

    These are few of all pairs, and most best matches are among them. Events stand in blocks by city and type, and once more by time; only blocks meet that
    hold one city and type, or times within three days.
    """
    given = stage(_with_floor(said, floors))
    cell = given.where("country_l <> '' AND city_l <> ''").withColumns({"way": F.lit(0), "key": F.shiftright(F.xxhash64("country_l", "city_l", "event_type"), 2)})
    dated = given.where("published_s IS NOT NULL").withColumns({"way": F.lit(1), "key": F.col("published_s").cast("long")})
    n = given.count()
    size = block or _block_size(n)
    reach = F.col("a.way") * 259200
    met = _met_blocks(numbered(cell.unionByName(dated), "way", "key", "arrival"), size, 2 * n,
                      (F.col("a.from") <= F.col("b.to") + reach) & (F.col("b.from") <= F.col("a.to") + reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for way, x, y in zip(batch.column("way").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                a, b = x.values, y.values
                key_a, key_b, far, step = *(e.field("key").to_numpy(zero_copy_only=False) for e in (a, b)), 259200 * way, 1 << 11 - 2 * way
                for s in range(0, len(b), step):
                    some = b.slice(s, step)
                    lo, hi = int(np.searchsorted(key_a, key_b[s] - far)), int(np.searchsorted(key_a, key_b[s + len(some) - 1] + far, "right"))
                    if lo < hi:
                        yield from _best_between(a.slice(lo, hi - lo), some).to_batches()
    return met.mapInArrow(run, _match_type(said))


def _shared_word_candidates(canon: DataFrame, floors: DataFrame, block: int | None = None, worded: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Best match below the confirmed class among the earlier canonical events that share title words or entities, scored exactly, one row for each block of events.

    An event already has the score of its best match by place or equal shape (its floor), so only a match that reaches that score is returned. A single frequent word
    is enough for a link, so pairs are never written: events stand in blocks, one row of a checkpoint each, and every two blocks meet in a task of a Cartesian
    product, which counts the words that events share and keeps the best match of every later event. Disk grows with the events and not with their pairs.

    Given ``worded`` events, the floors hold the best of `_close_candidates` too. Other matches then need titles so much alike that the frequent words of an event
    need not be looked up, and an event whose rare words are not those of the other block's country is left at once.
    """
    said, frequent = worded or _worded(canon)
    given = _with_floor(said, floors).withColumns({"way": F.lit(0), "key": F.lit(0)})
    n = said.count()
    size = block or _block_size(n)
    met = _met_blocks(numbered(given, "country_l", "arrival"), size, n, F.lit(True))
    settled = worded is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                yield from _best_between(x.values, y.values, frequent, settled).to_batches()
    return met.select("a", "b").mapInArrow(run, _match_type(canon))


def resolve_duplicates(events: DataFrame) -> DataFrame:
    """One row per event: duplicate class, best earlier canonical event and similarity.

    Confirmed duplicates are merged into their match; every other event is canonical and keeps a link to its match
    when the score reaches the candidate limit.
    """
    ev = with_shape(events).select("event_id", "arrival", "published_s", "country_l", "city_l", "event_type", "tokens", "ents", "shape")
    number = stage(ev.select("shape").distinct().withColumn("_no", F.monotonically_increasing_id()))  # pairs of shapes name them by numbers
    ev = stage(ev.join(number, "shape").drop("shape").withColumnRenamed("_no", "shape"))
    near = stage(similar_shapes(shapes(ev)))
    keep = stage(resolve_canonical(ev, near))
    canon = stage(ev.join(keep.select("event_id"), "event_id", "left_semi"))
    merged = ev.join(keep.select("event_id"), "event_id", "left_anti")
    edges = near.unionByName(shapes(ev).select(
        F.col("shape").alias("shape_a"), F.col("shape").alias("shape_b"), self_similarity().alias("base")))
    c = canon.select(F.col("shape").alias("shape_b"), F.col("event_id").alias("matched_id"),
                     F.col("arrival").alias("matched_arrival"), F.col("published_s").alias("_t"))
    m = merged.join(edges, merged.shape == edges.shape_a).join(c, "shape_b").where("matched_arrival < arrival").select(
        "event_id", "matched_id", "matched_arrival", score(F.col("base"), F.col("published_s"), F.col("_t")).alias("similarity"))
    alike = stage(_place_candidates(canon).unionByName(_earliest_in_group(canon, ["shape"], self_similarity())))
    floors = alike.groupBy("event_id").agg(F.max("similarity").alias("floor"))
    worded = _worded(canon)
    alike = stage(alike.unionByName(_close_candidates(worded[0], floors)))
    floors = alike.groupBy("event_id").agg(F.max("similarity").alias("floor"))
    best = _best(m.unionByName(alike).unionByName(_shared_word_candidates(canon, floors, worded=worded)))
    linked = F.col("similarity") >= CANDIDATE
    return ev.select("event_id", "arrival").join(best, "event_id", "left").select(
        "event_id", "arrival", F.when(linked, F.col("matched_id")).alias("matched_id"),
        F.when(linked, F.col("similarity")).alias("similarity"),
        F.coalesce(classify(F.col("similarity")), F.lit("unique")).alias("duplicate_status"))


# ---- conflicts and corroboration ----------------------------------------------------------------

RESTORED = ["no outage", "fully restored", "false alarm"]
DISRUPTED = ["outage", "disruption", "instability"]


def claim_flags(events: DataFrame) -> DataFrame:
    """What a report claims: restored or disrupted, by text."""
    low = F.lower(F.coalesce("description", F.lit("")))
    hit = lambda words: F.coalesce(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), F.lit(False))
    return events.withColumns({"says_restored": hit(RESTORED), "says_disrupted": hit(DISRUPTED),
                               "sev": severity_rank(F.col("severity"))})


def conflict_of(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Topic on which record a (current status) and report b disagree, or null."""
    neg = (
        ((b["restored"] | (b["status"] == "RESOLVED")) & a["disrupted"] & (a["status"] == "ACTIVE"))
        | ((a["restored"] | (a["status"] == "RESOLVED")) & b["disrupted"] & (b["status"] == "ACTIVE")))
    return F.when(neg, "operational_status_and_impact").when(F.abs(a["sev"] - b["sev"]) >= 2, "severity_assessment")


def linked_events(events: DataFrame, resolved: DataFrame, sources: DataFrame) -> DataFrame:
    """Every linked event next to the canonical event it matched, with claims, source group and origin of both."""
    s = sources.select("source_id", F.coalesce("independence_group", "source_id").alias("grp"), "is_official_source")
    e = claim_flags(events).join(s, "source_id", "left").withColumns({
        "grp": F.coalesce("grp", "source_id"), "official": F.coalesce("is_official_source", F.lit(False))})
    e = e.select("event_id", "arrival", "status", "says_restored", "says_disrupted", "sev", "source_id", "grp", "official",
                 "origin_hash", "confidence")
    return e.join(resolved.select("event_id", "matched_id", "duplicate_status"), "event_id")


def _topic(prefix_a: str, status_a: Column) -> Column:
    side = lambda p, st: {"restored": F.col(f"{p}says_restored"), "disrupted": F.col(f"{p}says_disrupted"),
                          "sev": F.col(f"{p}sev"), "status": st}
    return conflict_of(side(prefix_a, status_a), side("", F.col("status")))


def resolve_conflicts(linked: DataFrame) -> DataFrame:
    """Linked events with ``conflict_topic`` against the status their match had when they arrived.

    The status of a canonical record is its initial one until the first merge that confirms or contests it, and
    neither ACTIVE nor RESOLVED afterwards. Its initial status is CONTESTED when the record itself conflicted on
    arrival, so each link has an answer for both cases of its parent; pointer jumping over the forest of links then
    picks the right one in a logarithmic number of rounds.
    """
    me = [c for c in linked.columns if c not in ("matched_id", "duplicate_status")]
    p = linked.select(*[F.col(c).alias("p_" + c) for c in me], F.col("duplicate_status").alias("p_dup"))
    kids = stage(linked.where("matched_id IS NOT NULL").join(p, F.col("matched_id") == F.col("p_event_id")))
    merge = F.col("duplicate_status") == "confirmed_duplicate"
    raw0 = F.when((F.col("p_dup") == "unique") & F.col("p_official"), "CONFIRMED").otherwise(F.col("p_status"))
    kids = kids.withColumns({
        "t0": _topic("p_", raw0), "t1": _topic("p_", F.lit("CONTESTED")),
        "_m": F.when(merge, F.col("arrival")), "is_merge": merge})
    first_if = lambda cond: F.min(F.when(cond, F.col("arrival")))
    pa = kids.groupBy("matched_id").agg(
        first_if(F.col("t0").isNotNull()).alias("c0"),
        first_if(merge & (F.col("official") | F.col("p_official"))).alias("o1"),
        first_if(merge & (F.col("grp") != F.col("p_grp"))).alias("g2"),
        first_if(merge & (F.col("origin_hash") != F.col("p_origin_hash"))).alias("h2"))
    k = kids.join(pa, "matched_id")
    # first merge under the plain initial status that changes the record's status
    two = F.when(F.col("g2").isNotNull() & F.col("h2").isNotNull(), F.greatest("g2", "h2"))
    after = first_if(merge & (F.col("arrival") >= F.col("c0")))
    t1 = k.groupBy("matched_id").agg(F.least(after, F.min("o1"), F.min(two)).alias("switch"))
    k = k.join(t1, "matched_id")
    late = F.coalesce(F.col("arrival") > F.col("switch"), F.lit(False))
    k = stage(k.withColumns({"x0": F.when(late, F.col("t1")).otherwise(F.col("t0")), "x1": F.col("t1")}))
    # c(e) = whether e conflicted on arrival; a link maps the parent's c to its own. Merged events have no children.
    links = stage(k.select("event_id", F.col("matched_id").alias("up"), F.col("x0").isNotNull().alias("f0"),
                           F.col("x1").isNotNull().alias("f1")))
    while True:
        u = links.select(F.col("event_id").alias("up"), F.col("up").alias("_u2"), F.col("f0").alias("_g0"), F.col("f1").alias("_g1"))
        nxt = stage(links.join(u, "up", "left").select(
            "event_id", F.col("_u2").alias("up"),
            F.when(F.col("_g0").isNull(), F.col("f0")).when(F.col("_g0"), F.col("f1")).otherwise(F.col("f0")).alias("f0"),
            F.when(F.col("_g1").isNull(), F.col("f1")).when(F.col("_g1"), F.col("f1")).otherwise(F.col("f0")).alias("f1"),
            F.col("_g0").isNotNull().alias("_go")))
        links = nxt.drop("_go")
        if nxt.where("_go").isEmpty():
            break
    # a root never conflicted, so its children and, composed, all descendants take the f0 branch
    parent_c = links.select(F.col("event_id").alias("matched_id"), F.col("f0").alias("p_contested"))
    return k.join(parent_c, "matched_id", "left").withColumn("p_contested", F.coalesce("p_contested", F.lit(False))).withColumn(
        "conflict_topic", F.when(F.col("p_contested"), F.col("x1")).otherwise(F.col("x0")))


def claim_conflicts(conflicts: DataFrame) -> DataFrame:
    """Conflict records between a canonical event and the linked events that contradict it."""
    cid = F.substring(F.sha2(F.concat_ws(":", F.lower("matched_id"), F.lower("event_id"), "conflict_topic"), 256), 1, 12)
    return conflicts.where("conflict_topic IS NOT NULL").select(
        F.concat(F.lit("conf_"), cid).alias("conflict_id"), F.col("matched_id").alias("event_id"),
        F.col("event_id").alias("other_event_id"), F.col("conflict_topic").alias("topic"),
        F.col("p_source_id").alias("source_a_id"), F.col("source_id").alias("source_b_id"),
        F.lit(0.60).alias("confidence"), F.lit("UNRESOLVED").alias("resolution_status"))


def _smallest(df: DataFrame, key: str, value: str, k: int, out: str) -> DataFrame:
    """The k smallest values per key, narrowed slice by slice so that no step gathers a whole group."""
    low = lambda c: F.slice(F.array_sort(c), 1, k)
    a = df.groupBy(key, F.floor(F.col(value) / 4096).alias("_a"), F.floor(F.col(value) / 4194304).alias("_b")).agg(
        low(F.collect_list(value)).alias("_v"))
    b = a.groupBy(key, "_b").agg(low(F.flatten(F.collect_list("_v"))).alias("_v"))
    return b.groupBy(key).agg(low(F.flatten(F.collect_list("_v"))).alias(out))


def corroborate(linked: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Canonical events after all merges: sources, independent streams, status, corroboration and confidence.

    The step-by-step rule in closed form. Merges before the first conflict raise the confidence: by .06 per extra
    independent stream and merge (at most .95), and by .08 per merge with two streams once an official source is in
    (at most .98). Every merge from the first conflict on lowers it by .15, not below .45.
    """
    base = linked.where("duplicate_status <> 'confirmed_duplicate'").select(
        "event_id", F.col("status").alias("raw_status"), "official", "confidence", "duplicate_status", "source_id", "grp",
        "origin_hash")
    own = conflicts.where("NOT is_merge").select("event_id", F.col("conflict_topic").isNotNull().alias("own_conflict"))
    m = conflicts.where("is_merge")
    key = F.col("matched_id").alias("event_id")
    # a record's conflict list also holds those recorded when it, or a linked later event, arrived
    first_c = conflicts.where("conflict_topic IS NOT NULL").groupBy(key).agg(
        F.min("arrival").alias("c1"), F.count("*").alias("n_conflicts"), F.max("arrival").alias("c_last"))
    grp = m.where("grp <> p_grp").groupBy("matched_id", "grp").agg(F.min("arrival").alias("at"))
    org = m.where("origin_hash <> p_origin_hash").groupBy("matched_id", "origin_hash").agg(F.min("arrival").alias("at"))
    src = m.where("source_id <> p_source_id").groupBy("matched_id", "source_id").agg(F.min("arrival").alias("at"))
    levels = 20  # from .0 to .95 in steps of .06 needs at most 16 raises, so further levels cannot matter
    gl, ol = _smallest(grp, "matched_id", "at", levels, "_g"), _smallest(org, "matched_id", "at", levels, "_o")
    n_of = lambda d, n: d.groupBy(key).agg(F.count("*").alias(n))
    off = m.where("official").groupBy(key).agg(F.min("arrival").alias("o1"))
    b = (
        base.join(own, "event_id", "left").join(first_c, "event_id", "left").join(off, "event_id", "left")
        .join(gl.withColumnRenamed("matched_id", "event_id"), "event_id", "left")
        .join(ol.withColumnRenamed("matched_id", "event_id"), "event_id", "left")
        .join(n_of(src, "_ns"), "event_id", "left").join(n_of(grp, "_ng"), "event_id", "left")
        .join(n_of(org, "_no"), "event_id", "left")
    )
    own_c = F.coalesce("own_conflict", F.lit(False))
    b = b.withColumns({
        "own_conflict": own_c, "c1": F.when(own_c, F.lit(-1)).otherwise(F.col("c1")),
        "o1": F.when(F.col("official"), F.lit(-1)).otherwise(F.col("o1")),
        # arrival at which the j-th independent stream is complete: a new group and a new origin both present
        "_lv": F.when(F.col("_g").isNull() | F.col("_o").isNull(), F.array().cast("array<bigint>")).otherwise(
            F.transform(F.arrays_zip("_g", "_o"), lambda x: F.greatest(x["_g"], x["_o"])))})
    # arrays_zip pads the shorter list with nulls, and greatest() would skip them: keep complete levels only
    b = b.withColumn("_lv", F.slice("_lv", F.lit(1), F.greatest(
        F.lit(0), F.least(F.size("_g"), F.size("_o"), F.size("_lv"))))).withColumn(
        "_lv", F.coalesce("_lv", F.array().cast("array<bigint>")))
    b = stage(b)
    mm = m.select(key, "arrival").join(b.select("event_id", "c1", "o1", "_lv"), "event_id")
    hit = F.coalesce(F.col("arrival") >= F.col("c1"), F.lit(False))
    official = F.coalesce(F.col("arrival") >= F.col("o1"), F.lit(False))
    ind = F.size(F.filter("_lv", lambda x: x <= F.col("arrival")))
    agg = mm.groupBy("event_id").agg(
        F.count("*").alias("n_merged"), F.count_if(hit).alias("n_down"),
        F.sum(F.when(~hit & ~official, ind).otherwise(0)).alias("n_up"),
        F.count_if(~hit & official & (ind >= 1)).alias("n_off"), F.max("arrival").alias("last_merge"))
    d = b.join(agg, "event_id", "left").fillna(0, ["n_merged", "n_down", "n_up", "n_off", "_ns", "_ng", "_no", "n_conflicts"])
    c0 = F.col("confidence")
    up = F.when(F.col("n_up") > 0, F.least(F.lit(0.95), c0 + F.lit(0.06) * F.col("n_up"))).otherwise(c0)
    up = F.when(F.col("n_off") > 0, F.least(F.lit(0.98), up + F.lit(0.08) * F.col("n_off"))).otherwise(up)
    conf = F.when(F.col("n_down") > 0, F.greatest(F.lit(0.45), up - F.lit(0.15) * F.col("n_down"))).otherwise(up)
    streams = F.when(F.col("n_merged") > 0, F.least(F.col("_ng") + 1, F.col("_no") + 1)).otherwise(1)
    d = d.withColumns({"confidence": rnd(key9(conf), 3), "independent_source_count": streams.cast("int"),
                       "source_count": (F.col("_ns") + 1).cast("int"),
                       "n_conflicts": (F.col("n_conflicts") + F.col("own_conflict").cast("int")).cast("int")})
    merged, contested = F.col("n_merged") > 0, F.col("n_down") > 0
    any_c = F.col("n_conflicts") > 0
    has_off, multi = F.col("o1").isNotNull(), F.col("independent_source_count") >= 2
    status = (
        F.when(contested, "CONTESTED").when(merged & (has_off | multi), "CONFIRMED")
        .when(F.col("own_conflict"), "CONTESTED").when((F.col("duplicate_status") == "unique") & F.col("official"), "CONFIRMED")
        .otherwise(F.col("raw_status")))
    corr = (
        F.when(any_c, "Conflicting-source signal")
        .when(merged & has_off, "Official-source confirmation").when(merged & multi, "Multi-source corroborated signal")
        .when(merged, "Single-source signal")
        .when((F.col("duplicate_status") == "unique") & F.col("official"), "Official-source confirmation")
        .otherwise("Single-source signal"))
    return d.select("event_id", status.alias("status"), corr.alias("corroboration_status"), "confidence", "source_count",
                    "independent_source_count", "n_conflicts", F.col("n_merged").cast("int").alias("n_merged"))
