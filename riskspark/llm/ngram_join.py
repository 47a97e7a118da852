"""Exact Jaccard self-join of n-gram sets with prefix trees, and the components of its links.

1. Documents with equal sets form one class (64-bit digest of the set and its size); a class is joined once.
2. Grams are dealt by value to buckets, packed per task. A bucket counts, for each gram, the classes that hold it; only grams
   of two or more classes go on. A class whose shared grams cannot reach the threshold has no partner.
3. The other classes order their shared grams from rare to frequent. A pair that reaches the threshold shares a gram among
   the first few of both (prefix filter), so each prefix gram names a group of possible partners.
4. Every group first compares all members with two pivots (the smallest of a size band, and one by hash): as many rows as the
   groups have. The links found give first components.
5. Groups that still hold several components are gathered to clusters; a cluster is cut into blocks of at most BLOCK sets,
   and all block pairs whose sizes allow a link are joined. Thus every pair that could link two components is looked at.
6. Each comparison is a prefix-tree join: the sets of one side are stored in a path-compressed trie, a set of the other side
   descends it, overlaps of shared paths are counted once, and subtrees are cut when partial overlap plus the remaining length (of
   the longest set below, or of the probing set) misses the needed overlap.

Defined results: null or empty texts and texts without words have no shingles and form their own component; a component is
named by its smallest non-null id (null if it has none); repeated rows fall into one class; extra columns are ignored; an empty table
gives an empty result. Shingles are compared by 64-bit fingerprints.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.bpe import release
from riskspark.llm.components import components
from riskspark.llm.text import byte_class, chunks, distinct_sorted, grams, map_arrow, minus, mix, text_key, utf8, words
from riskspark.session import stage

#: A word is a run without white space; A-Z are lower-cased.
WORD = byte_class(r"[^\x20\x09-\x0D]")
#: Grams of one bucket, aimed at; grams a task packs at once; sets in a block.
BUCKET, PACK, BLOCK = 2_000_000, 1_000_000, 512


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row range, sorted distinct shingles, offsets and set digests of a batch (doc_id, text), chunk by chunk."""
    data, offsets = utf8(batch.column(batch.num_columns - 1))
    for i, j in chunks(offsets):
        value, _, _, word_offsets = words(data, offsets[i:j + 1], WORD)
        shingle, at = distinct_sorted(*grams(value, word_offsets, width))
        size = np.diff(at)
        digest = np.zeros(j - i, np.uint64)
        full = np.flatnonzero(size)
        if len(full):
            digest[full] = mix(np.add.reduceat(mix(shingle + np.uint64(0x51ED27)), at[full]) + size[full].astype(np.uint64))
        yield i, j, shingle, at, digest


def shingle_classes(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, a digest `key` of the text, n_shingles and the digest `sig` of the shingle set of every row."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, _, at, digest in _sets(batch, width):
            yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(at)), pa.array(digest.view(np.int64))],
                                  names=["doc_id", "key", "n_shingles", "sig"])
    return map_arrow(docs.select("doc_id", text_key().alias("key"), "text"), run, "doc_id long, key long, n_shingles long, sig long")


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return start, np.diff(np.append(start, len(key)))


_PACKED = ["tokens", "sigs", "sizes", "counts"]


def _pack(part: np.ndarray, token: np.ndarray, run: np.ndarray, sig: np.ndarray, size: np.ndarray, extra: np.ndarray | None = None) -> Iterator[list]:
    """Rows [part, tokens, sigs, sizes, counts(, extra)] in binary; the input is ordered by part and run."""
    start, length = _runs(part)
    for a, n in zip(start.tolist(), length.tolist(), strict=True):
        r, c = _runs(run[a:a + n])
        ids = run[a:a + n][r]
        row = [int(part[a]), token[a:a + n].tobytes(), sig[ids].tobytes(), size[ids].astype(np.int32).tobytes(), c.astype(np.int32).tobytes()]
        yield row if extra is None else [*row, extra[a:a + n].tobytes()]


def _batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.record_batch([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def gram_blocks(docs: DataFrame, bits: int, width: int = 5) -> DataFrame:
    """Grams of every class that a task meets, packed by the leading `bits` bits of the gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[int] = set()
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            token = np.concatenate([h[0] for h in held])
            sig, size = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            owner = np.repeat(np.arange(len(sig), dtype=np.uint32), size)
            part = (token >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
            order = np.argsort(part, kind="stable")
            return _batch(list(_pack(part[order], token[order], owner[order], sig, size)), ["part", *_PACKED])
        for batch in batches:
            if not batch.num_rows:
                continue
            for _, _, shingle, at, digest in _sets(batch, width):
                size = np.diff(at)
                new = np.zeros(len(size), bool)
                for k, (s, n) in enumerate(zip(digest.tolist(), size.tolist(), strict=True)):
                    if n and s not in seen:  # copies within a task go out once
                        seen.add(s)
                        new[k] = True
                if len(seen) > 1_000_000:
                    seen.clear()
                held.append((shingle[np.repeat(new, size)], digest[new], size[new]))
                total += len(held[-1][0])
                if total >= PACK:
                    yield flush()
                    held, total = [], 0
        if total:
            yield flush()
    return docs.select("doc_id", "text").mapInArrow(run, "part long, " + ", ".join(f"{c} binary" for c in _PACKED))


def shared_grams(blocks: DataFrame, bits: int) -> DataFrame:
    """Grams of at least two classes with the number of their classes, packed anew by class."""
    def run(table: pa.Table) -> pa.Table:
        release()
        sig, size, count = _joined(table, "sigs", np.uint64), _joined(table, "sizes", np.int32), _joined(table, "counts", np.int32)
        token = _joined(table, "tokens", np.uint64)
        first = np.zeros(len(sig), bool)
        first[np.unique(sig, return_index=True)[1]] = True  # a class that several tasks met counts once
        owner = np.repeat(np.arange(len(sig), dtype=np.uint32), count)
        if not first.all():
            keep = first[owner]
            token, owner = token[keep], owner[keep]
        order = np.argsort(token)
        token, owner = token[order], owner[order]
        del order
        same = token[1:] == token[:-1]
        keep = np.zeros(len(token), bool)  # neighbours of an equal gram: most grams go here, before anything is counted
        keep[1:] |= same
        keep[:-1] |= same
        token, owner = token[keep], owner[keep]
        _, length = _runs(token)
        classes = np.repeat(length, length).astype(np.uint32)
        part = (mix(sig) >> np.uint64(64 - bits)).astype(np.int64)[owner]
        order = np.lexsort((owner, part))
        rows = _pack(part[order], token[order], owner[order], sig, size, classes[order])
        return pa.Table.from_batches([_batch(list(rows), ["part", *_PACKED, "classes"])])
    return blocks.groupBy("part").applyInArrow(run, "part long, " + ", ".join(f"{c} binary" for c in [*_PACKED, "classes"]))


def candidates(shared: DataFrame, percent: int) -> DataFrame:
    """Classes whose shared grams can reach the threshold: sig, n, n_shared, items (shared grams, rare first) and their prefix."""
    def run(table: pa.Table) -> pa.Table:
        sig, size, count = _joined(table, "sigs", np.uint64), _joined(table, "sizes", np.int32), _joined(table, "counts", np.int32)
        token, classes = _joined(table, "tokens", np.uint64), _joined(table, "classes", np.uint32)
        ids, at, inverse = np.unique(sig, return_index=True, return_inverse=True)
        n = size[at].astype(np.int64)
        have = np.bincount(inverse, count, minlength=len(ids)).astype(np.int64)
        spare = have - -(-percent * n // 100) + 1
        owner = np.repeat(inverse, count)
        keep = (spare > 0)[owner]
        token, classes, owner = token[keep], classes[keep], owner[keep]
        order = np.lexsort((token, classes, owner))
        token, owner = token[order], owner[order]
        start, length = _runs(owner)
        who = owner[start]
        items = [token[a:a + k].tobytes() for a, k in zip(start.tolist(), length.tolist(), strict=True)]
        signed = token.view(np.int64)
        prefix = [signed[a:a + k] for a, k in zip(start.tolist(), spare[who].tolist(), strict=True)]
        return pa.table([pa.array(ids[who].view(np.int64)), pa.array(n[who]), pa.array(length), pa.array(items, pa.binary()),
                         pa.array(prefix, pa.list_(pa.int64()))], names=["sig", "n", "n_shared", "items", "prefix"])
    return shared.groupBy("part").applyInArrow(run, "sig long, n long, n_shared long, items binary, prefix array<long>")


class Trie:
    """Path-compressed prefix tree over ordered sets; a node holds a segment of grams and the sets that end in it."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, percent: int):
        """`sets` are ascending ranks of a common gram order, `sizes` the whole set sizes (grams held by no other class included)."""
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        parent, low, high, rep, ends = [-1], [0], [0], [order[0] if order else 0], []
        stack, last = [0], np.zeros(0, np.int64)
        for k in order:
            s = sets[k]
            m = min(len(s), len(last))
            differ = np.flatnonzero(s[:m] != last[:m])
            shared = int(differ[0]) if len(differ) else m
            below = None
            while high[stack[-1]] > shared:
                below = stack.pop()
            if high[stack[-1]] < shared:  # split the segment where the sets part
                parent.append(stack[-1]), low.append(low[below]), high.append(shared), rep.append(rep[below])
                low[below], parent[below] = shared, len(parent) - 1
                stack.append(len(parent) - 1)
            if len(s) > shared:
                parent.append(stack[-1]), low.append(shared), high.append(len(s)), rep.append(k)
                stack.append(len(parent) - 1)
            ends.append((stack[-1], k))
            last = s
        nodes = len(parent)
        self.sizes, self.share = sizes, percent / (100 + percent)
        self.grams = np.concatenate([sets[r][a:b] for r, a, b in zip(rep, low, high, strict=True)]) if nodes > 1 else np.zeros(0, np.int64)
        self.length = np.array(high) - np.array(low)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.tail = np.array([sets[r][b - 1] if b else -1 for r, b in zip(rep, high, strict=True)])
        # Best (remaining length - share of the size) and smallest size below each node, for the bounds.
        best, least = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        for node, k in ends:
            while node >= 0:
                best[node] = max(best[node], len(sets[k]) - high[node] - self.share * sizes[k])
                least[node] = min(least[node], sizes[k])
                node = parent[node]
        self.best, self.least = best, least
        by_parent = np.argsort(np.array(parent), kind="stable")[1:]
        self.child = by_parent
        sorted_parent = np.array(parent)[by_parent]
        self.child_from, self.child_to = np.searchsorted(sorted_parent, np.arange(nodes)), np.searchsorted(sorted_parent, np.arange(nodes), "right")
        end_node = np.array([e[0] for e in ends], np.int64)
        by_node = np.argsort(end_node, kind="stable")
        self.end_set = np.array([e[1] for e in ends], np.int64)[by_node]
        self.end_from = np.searchsorted(end_node[by_node], np.arange(nodes))
        self.end_to = np.searchsorted(end_node[by_node], np.arange(nodes), "right")

    @staticmethod
    def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
        total = np.cumsum(length)
        return np.arange(total[-1] if len(total) else 0) + np.repeat(start - total + length, length)

    def probe(self, ranks: np.ndarray, size: int, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets that may reach the threshold with the probing set, and their overlaps. `flags` is all False and left so."""
        flags[ranks] = True
        found, overlaps = [], []
        node, partial = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(node):
            here = self._ranges(self.end_from[node], self.end_to[node] - self.end_from[node])
            if len(here):
                found.append(self.end_set[here])
                overlaps.append(np.repeat(partial, self.end_to[node] - self.end_from[node]))
            width = self.child_to[node] - self.child_from[node]
            below = self.child[self._ranges(self.child_from[node], width)]
            if not len(below):
                break
            at = np.concatenate(([0], np.cumsum(self.length[below])))
            inside = np.concatenate(([0], np.cumsum(flags[self.grams[self._ranges(self.start[below], self.length[below])]])))
            partial = np.repeat(partial, width) + inside[at[1:]] - inside[at[:-1]]
            left = len(ranks) - np.searchsorted(ranks, self.tail[below], "right")
            alive = (partial + self.best[below] >= self.share * size - 1e-6) & (partial + left >= self.share * (self.least[below] + size) - 1e-6)
            node, partial = below[alive], partial[alive]
        flags[ranks] = False
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(overlaps)


def trie_links(sig: list[int], n: np.ndarray, items: list[bytes], side: np.ndarray, component: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between sets of side 0 (stored) and side 1 (probing); side 2 is both. Links inside one component are left out."""
    token = np.frombuffer(b"".join(items), np.uint64)
    length = np.array([len(b) // 8 for b in items])
    vocabulary, rank = np.unique(token, return_inverse=True)
    owner = np.repeat(np.arange(len(items)), length)
    rank = rank[np.lexsort((rank, owner))]
    at = np.concatenate(([0], np.cumsum(length)))
    sets = [rank[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    stored, probing = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(stored) or not len(probing):
        return []
    trie = Trie([sets[k] for k in stored], n[stored], percent)
    flags = np.zeros(len(vocabulary), bool)
    root = {c: c for c in component}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x
    links = []
    for p in probing.tolist():
        found, overlap = trie.probe(sets[p], int(n[p]), flags)
        other = stored[found]
        for k in other[100 * overlap >= percent * (n[other] + n[p] - overlap)].tolist():
            a, b = find(component[k]), find(component[p])
            if k != p and a != b:
                root[max(a, b)] = min(a, b)
                links.append((sig[k], sig[p]))
    return links


def _verify(cells: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) found by the trie join of every cell; rows: keys, side, sig, n, items, component."""
    def run(table: pa.Table) -> pa.Table:
        links = trie_links(table.column("sig").to_pylist(), table.column("n").to_numpy(), table.column("items").to_pylist(),
                           table.column("side").to_numpy(), table.column("component").to_pylist(), percent)
        return pa.table([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])
    return cells.select(*keys, "side", "sig", "n", "items", "component").groupBy(*keys).applyInArrow(run, "a long, b long")


def _may_link(a: str, b: str, percent: int):
    """Size and position filters of two postings that share a prefix gram."""
    n_a, n_b = F.col(f"{a}n"), F.col(f"{b}n")
    bound = 1 + F.least(f"{a}pos", f"{b}pos") + F.least(F.col(f"{a}n_shared") - F.col(f"{a}pos"), F.col(f"{b}n_shared") - F.col(f"{b}pos")) - 1
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * bound >= percent * (n_a + n_b))


def _band(percent: int):
    """Sizes of linked sets lie in the same or in neighbouring bands."""
    return F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent * 1.005))).cast("int")


def star_links(sets: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """Links of every prefix group's members with its two pivots."""
    me = F.struct("n", "sig", "pos", "n_shared")
    small = postings.groupBy("gram", "band").agg(F.min(me).alias("p"))
    drawn = postings.groupBy("gram").agg(F.min_by(me, F.struct(F.xxhash64("gram", "sig"), "sig")).alias("p"))
    cols = ["sig", "n", "pos", "n_shared", "p.*"]
    both = postings.join(small, ["gram", "band"]).unionByName(postings.join(drawn, "gram"), allowMissingColumns=True)
    both = both.select("sig", "n", "pos", "n_shared", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("sig", "n", "pos", "n_shared")])
    pairs = both.where((F.col("sig") != F.col("p_sig")) & _may_link("", "p_", percent)) \
        .select(F.greatest("sig", "p_sig").alias("x"), F.least("sig", "p_sig").alias("y"), "p_sig").groupBy("x", "y").agg(F.min("p_sig").alias("pivot"))
    pairs = stage(pairs.select("pivot", (F.col("x").bitwiseXOR(F.col("y")).bitwiseXOR(F.col("pivot"))).alias("sig")))
    blocks = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    pairs = pairs.join(blocks, "pivot").select("pivot", "sig", F.pmod(F.xxhash64("sig"), F.col("blocks")).alias("block"))
    body = sets.select("sig", "n", "items", F.col("sig").alias("component"))
    stored = pairs.join(body, "sig").withColumn("side", F.lit(0))
    probing = pairs.select("pivot", "block").distinct().join(body, F.col("pivot") == F.col("sig")).withColumn("side", F.lit(1))
    return _verify(stored.unionByName(probing), ["pivot", "block"], percent)


def residual_links(sets: DataFrame, postings: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between different components of groups that the pivots have not joined: block pairs of whole clusters."""
    postings = postings.join(labels, postings["sig"] == labels["node"], "left") \
        .select("gram", "sig", F.coalesce("component", "sig").alias("component"))
    ends = postings.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    live = stage(postings.join(ends.select("gram", "low"), "gram").select("sig", "component", "low").distinct())
    clusters = components(live.select(F.col("component").alias("a"), F.col("low").alias("b"))).withColumnRenamed("component", "cluster")
    members = live.select("sig", "component").distinct().join(clusters, F.col("component") == F.col("node")) \
        .join(sets.select("sig", "n", "items", "band"), "sig").select("cluster", "band", "sig", "component", "n", "items")
    heads = stage(members.select("cluster", "band", "sig"))
    count = heads.groupBy("cluster", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = count.select("cluster", "band", "blocks")
    above = count.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = count.select("cluster", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    shape = own.join(above, ["cluster", "band"], "left").join(below, ["cluster", "band"], "left")
    m = members.join(shape, ["cluster", "band"]).withColumn("s", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    zero, one = F.lit(0), F.lit(1)
    upto = lambda c: F.when(F.coalesce(c, zero) > 0, F.sequence(zero, c - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda k1, s1, k2, s2, side: F.struct(k1.alias("k1"), s1.alias("s1"), k2.alias("k2"), s2.alias("s2"), side.alias("side"))
    band, s = F.col("band"), F.col("s")
    places = F.concat(
        F.transform(upto(F.col("blocks")), lambda t: cell(band, F.least(s, t), band, F.greatest(s, t), F.when(s == t, 2).when(s < t, zero).otherwise(one))),
        F.transform(upto(F.col("above")), lambda t: cell(band, s, band + 1, t, zero)),
        F.transform(upto(F.col("below")), lambda t: cell(band - 1, t, band, s, one)))
    cells = m.select("cluster", "sig", "component", "n", "items", F.explode(places).alias("c")).select("cluster", "sig", "component", "n", "items", "c.*")
    return _verify(cells, ["cluster", "k1", "s1", "k2", "s2"], percent)


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, key, n_shingles, component (null without shingles) and the component's smallest id of every row."""
    rows = stage(shingle_classes(docs, width))
    total = rows.where("n_shingles > 0").groupBy("sig").agg(F.max("n_shingles").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bits = max(3, int(np.ceil(np.log2(max(total, 1) / BUCKET))))
    sets = stage(candidates(shared_grams(gram_blocks(docs, bits, width), bits), percent).withColumn("band", _band(percent)))
    postings = stage(sets.select("sig", "n", "n_shared", "band", F.posexplode("prefix").alias("pos", "gram")))
    sets = sets.drop("prefix")
    first = stage(star_links(sets, postings, percent))
    labels = components(first)
    links = first.unionByName(residual_links(sets, postings, labels, percent))
    labels = components(links)
    classes = rows.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("least_id"))
    classes = classes.join(labels, classes["sig"] == labels["node"], "left").select("sig", "least_id", F.coalesce("component", "sig").alias("component"))
    named = classes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = classes.select("sig", "component").join(named, "component").select("sig", "component", "component_id")
    filled = rows.where("n_shingles > 0").join(named, "sig").select("doc_id", "key", "n_shingles", "component", "component_id")
    return filled.unionByName(rows.where("n_shingles = 0").select("doc_id", "key", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id")))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; rows link when 100 * intersection >= percent * union of their shingle sets."""
    return _labelled(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def without_near_copies(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Rows of `docs` that stand for their component: the smallest id (ids before nulls), then the smallest text digest; all its columns.

    Rows without shingles all stay; rows that repeat an id and its text count once.
    """
    rows = stage(_labelled(docs, width, percent).select("doc_id", "key", "component"))
    order = F.struct(F.col("doc_id").isNull().alias("o"), F.col("doc_id").alias("i"), F.col("key").alias("k"))
    best = rows.where("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("b"))
    lost = rows.where("component IS NOT NULL").join(best, "component") \
        .where(~(F.col("doc_id").eqNullSafe(F.col("b.i")) & F.col("key").eqNullSafe(F.col("b.k")))).select("doc_id", "key").distinct()
    again = rows.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "key")
    docs = minus(docs, lost)
    return minus(docs, again).unionByName(minus(docs, again, "left_semi").dropDuplicates(["doc_id", "text"]))
