"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give base spans of e-mail addresses, IP addresses, payment cards and phone numbers; base spans always stay. The field adds spans: its
nodes are the runs without white space that hold a digit or "@" (any other run can only be "no personal data" and is left out as a
constant). Neighbouring runs share chain potentials; equal or similar runs of a document (same letters and digits, or the same closing digits) share skip
potentials, each with its previous occurrence and with the first one inside a base span, wherever that stands, so that a document has at most four
skip edges per node and a base span reaches all repeats of its run at once. Nodes inside base spans are
observed; loopy message passing, carried on until no message moves, gives the others' marginals, and a node of a kind with probability over `threshold`
becomes a span.

Potentials are trained by pseudo-likelihood, with the base spans as labels, on a sample of about `sample` documents that hold a node, drawn by id hash.

Defined results: a null text is empty and has no spans; repeated rows give repeated results; extra columns are ignored; an empty table gives
an empty result; with nothing to learn from only base spans are found. Positions are code points, ends exclusive.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.text import drawn, map_arrow, once, utf8

KINDS = ["email", "ip", "card", "phone"]
# The patterns (possessive repeats where giving back cannot help, so that long runs cost linear time).
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"\S+")
_NODE = re.compile(r"[0-9@]")
Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """Pattern spans by kind, then start; matches that fail their check are dropped and not tried again."""
    out: list[Span] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


FEATURES = 24


def _shape(run: str) -> list[int]:
    """Active unary features of a run."""
    d = _digits(run)
    letters = sum(c.isalpha() for c in run)
    on = [0, 1 + min(len(d), 8) // 2]
    if len(d) >= 9:
        on.append(6 + min((len(d) - 9) // 3, 3))
    if "@" in run:
        on.append(10)
    if letters:
        on.append(11 if letters > len(d) else 12)
    on.append(13 + min(run.count("."), 3))
    if run[0] == "+":
        on.append(17)
    if run[0] == "(" or run[-1] == ")":
        on.append(18)
    if "-" in run:
        on.append(19)
    if re.fullmatch("[0-9a-f\"]{20,}", run, re.I) and letters:
        on.append(20)
    if 16 <= len(d) <= 19:
        on.append(21 if luhn(d) else 22)
    if "=" in run or "/" in run:
        on.append(23)
    return on


class Graph:
    """Nodes of some documents with features, labels and edges; label 0 is none, k + 1 is KINDS[k], -1 is open."""

    def __init__(self):
        self.place: list[tuple[int, int, int]] = []  # document, start, end
        self.on: list[list[int]] = []
        self.label: list[int] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.anchor: list[tuple[int, int]] = []  # skip edges from the first observed occurrence of a run
        self.rounds: list[int] = []  # of each node: the most rounds its document may take

    def add(self, doc: int, text: str, base: list[Span], labels: list[int] | None = None) -> None:
        """labels: of the nodes, in place of those that `base` gives."""
        before, previous_end, first, skips = -1, -1, len(self.place), len(self.skip)
        equal: dict[str, int] = {}
        closing: dict[str, int] = {}
        alike: dict[str, list[int]] = {}
        ordered = sorted((s, e, k) for k, s, e in base)
        at = 0
        for m in _RUN.finditer(text):
            if not _NODE.search(m[0]):
                continue
            start, end = m.span()
            while at < len(ordered) and ordered[at][1] <= start:
                at += 1
            kind = next((k for s, e, k in ordered[at:at + 4] if s < end and e > start), None)
            node = len(self.place)
            self.place.append((doc, start, end))
            self.on.append(_shape(m[0]))
            self.label.append(-1 if kind is None else kind + 1)
            if before >= 0 and start == previous_end + 1:
                self.chain.append((before, node))
            before, previous_end = node, end
            key = re.sub(r"[\W_]+", "", m[0]).lower()
            if len(key) >= 5:
                if key in equal:
                    self.skip.append((equal[key], node))
                equal[key] = node
                alike.setdefault(key, []).append(node)
            d = _digits(m[0])
            if len(d) >= 7:
                other = closing.get(d[-7:])
                if other is not None and (not self.skip or self.skip[-1] != (other, node)):
                    self.skip.append((other, node))
                closing[d[-7:]] = node
                alike.setdefault("-" + d[-7:], []).append(node)
        if labels is not None:
            self.label[first:] = labels
        self.rounds += [100 + 2 * (len(self.place) - first)] * (len(self.place) - first)
        linked = set(self.skip[skips:])
        for nodes in alike.values():
            seen = next((i for i in nodes if self.label[i] > 0), None)
            for i in nodes if seen is not None else ():
                # In a sample with labels all nodes count as repeats, else the open ones.
                edge = (seen, i)
                if i != seen and (labels is not None or self.label[i] < 0) and not {edge, edge[::-1]} & linked:
                    linked.add(edge)
                    self.anchor.append(edge)

    def unary(self, weight: np.ndarray) -> np.ndarray:
        length = np.array([len(o) for o in self.on])
        flat = np.fromiter((f for o in self.on for f in o), np.int64, int(length.sum()))
        out = np.zeros((len(self.on), len(KINDS) + 1))
        np.add.at(out, np.repeat(np.arange(len(self.on)), length), weight[flat])
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(graph: Graph, model: tuple[np.ndarray, np.ndarray, np.ndarray], rounds: int | None = None, damping: float = 0.3, tolerance: float = 1e-6) -> np.ndarray:
    """Label probabilities of all nodes by damped loopy message passing over chain and skip edges, until no message moves by more than `tolerance`.

    A message crosses an edge a round, so the most rounds follow the nodes: 100 and twice the nodes of a message's own document, or `rounds`; where messages
    swing, a document stops at its own bound, whatever stands beside it. Only messages whose source has changed are renewed; observed nodes send constants.
    """
    weight, chain, skip = model
    phi = graph.unary(weight)
    known = np.array(graph.label)
    seen = known >= 0
    phi[seen] = -1e3
    phi[seen, known[seen]] = 0.0
    edges = np.array(graph.chain + graph.skip + graph.anchor, np.int64).reshape(-1, 2)
    if len(edges):
        pairs = np.stack([chain, skip, chain.T, skip.T])
        kind = (np.arange(len(edges)) >= len(graph.chain)).astype(np.int64)
        for (tail, head), k in ((edges.T, kind), (edges.T[::-1], kind + 2)):
            sent = seen[tail] & ~seen[head]
            np.add.at(phi, head[sent], pairs[k[sent], known[tail[sent]]])
        both = ~seen[edges].any(1)
        edges, kind = edges[both], kind[both]
    if len(edges):
        tail, head = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
        kind = np.concatenate((kind, kind + 2))
        half = len(edges)
        back = np.concatenate((np.arange(half, 2 * half), np.arange(half)))
        message, active = np.zeros((2 * half, phi.shape[1])), np.arange(2 * half)
        message -= np.log(phi.shape[1])
        np.add.at(phi, head, message)
        most = np.array(graph.rounds)[tail] if rounds is None else np.full(len(tail), rounds)
        for done in range(int(most.max(initial=0))):
            new = _log_sum((phi[tail[active]] - message[back[active]])[:, :, None] + pairs[kind[active]], 1)
            new -= _log_sum(new, 1)[:, None]
            step = (1 - damping) * (new - message[active])
            message[active] += step
            np.add.at(phi, head[active], step)
            moved = active[np.abs(step).max(1) > tolerance]
            if not len(moved):
                break
            changed = np.zeros(len(phi), bool)
            changed[head[moved]] = True
            again = changed[tail]
            again[moved] = True
            active = np.flatnonzero(again & (most > done + 1))
    return np.exp(phi - _log_sum(phi, 1)[:, None])


def train(graph: Graph, steps: int = 300, rate: float = 0.5, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unary weights, chain and skip potentials that maximise the pseudo-likelihood of the base labels."""
    labels, kinds = np.maximum(np.array(graph.label, np.int64), 0), len(KINDS) + 1
    n = len(labels)
    x = np.zeros((n, FEATURES + 3 * kinds))
    for i, on in enumerate(graph.on):
        x[i, on] = 1
    for a, b in graph.chain:
        x[b, FEATURES + labels[a]] += 1
        x[a, FEATURES + kinds + labels[b]] += 1
    for a, b in graph.skip:
        x[b, FEATURES + 2 * kinds + labels[a]] += 1
        x[a, FEATURES + 2 * kinds + labels[b]] += 1
    for a, b in graph.anchor:  # the first occurrence is observed where the field is used
        x[b, FEATURES + 2 * kinds + labels[a]] += 1
    target = np.eye(kinds)[labels]
    w, speed = np.zeros((x.shape[1], kinds)), np.zeros((x.shape[1], kinds))
    for _ in range(steps):
        z = x @ w
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        speed = 0.9 * speed - rate * (x.T @ (q - target) / n + penalty * w)
        w += speed
    ahead, behind, skip = w[FEATURES:FEATURES + kinds], w[FEATURES + kinds:FEATURES + 2 * kinds], w[FEATURES + 2 * kinds:]
    return w[:FEATURES], (ahead + behind.T) / 2, (skip + skip.T) / 2


def holds_node(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a digit or "@"; only those can hold spans."""
    at = np.flatnonzero(((data[offsets[0]:offsets[-1]] - np.uint8(48)) < 10) | (data[offsets[0]:offsets[-1]] == 64))
    return np.diff(np.searchsorted(at, offsets - offsets[0])) > 0


def _marked(batch: pa.RecordBatch) -> list[tuple[int, str]]:
    """Row and text of the documents of a batch (first column id, second text) that can hold spans."""
    rows = np.flatnonzero(holds_node(*utf8(batch.column(1))))
    return list(zip(rows.tolist(), batch.column(1).take(pa.array(rows)).to_pylist(), strict=True))


def fit(docs: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Potentials from about `sample` documents that hold a node."""
    able = docs.where(F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    sample_of = drawn(able, sample, 17)  # doc_id, text, __k

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for row, text in _marked(batch):
            spans = base_spans(text)
            runs = [m.span() for m in _RUN.finditer(text) if _NODE.search(m[0])]
            # Only the runs themselves travel; a gap that is not one blank is written as two.
            parts, labels, last = [], [], None
            for s, e in runs:
                kind = next((k for k, a, b in spans if a < e and b > s), -1)
                parts.append(("" if last is None else " " if s == last + 1 else "  ") + text[s:e])
                labels.append(kind + 1)
                last = e
            keep.append((batch.column(2)[row].as_py(), "".join(parts), labels))
        return pa.record_batch([pa.array([k[0] for k in keep], pa.int64()), pa.array([k[1] for k in keep], pa.string()), pa.array([k[2] for k in keep], pa.list_(pa.int32()))],
                               names=["__k", "runs", "labels"])
    found = once(map_arrow(sample_of, run, "__k long, runs string, labels array<int>", 1), int(1.5 * sample) + 10)
    rows = sorted((tuple(r) for r in found.collect()), key=repr)
    graph = Graph()
    for k, (_, runs, labels) in enumerate(rows):
        graph.add(k, runs, [], labels)
    return train(graph) if graph.place else None


def all_spans(texts: list[tuple[int, str]], model, threshold: float) -> dict[int, tuple[list[Span], list[Span]]]:
    """Base spans and added spans of some documents, by row."""
    graph, found = Graph(), {}
    for row, text in texts:
        base = base_spans(text)
        found[row] = (base, [])
        graph.add(row, text, base)
    if model is not None and -1 in graph.label:
        q = marginals(graph, model)
        best = q[:, 1:].argmax(1)
        for i in np.flatnonzero((np.array(graph.label) < 0) & (q[:, 1:].max(1) > threshold)).tolist():
            row, start, end = graph.place[i]
            found[row][1].append((int(best[i]), start, end))
    return found


def written(spans: list[Span]) -> str:
    """kind:start:end by kind, then start, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _trimmed(spans: list[Span], text: str) -> list[Span]:
    """Added spans without the punctuation around them."""
    out = []
    for k, s, e in spans:
        while s < e and not (text[s].isalnum() or text[s] in "+("):
            s += 1
        while e > s and not text[e - 1].isalnum():
            e -= 1
        if s < e:
            out.append((k, s, e))
    return out


def find(docs: DataFrame, sample: int = 3000, threshold: float = 0.9) -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and all spans of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    none = hashlib.sha256(b"").hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        counts, digest, spans = np.zeros((len(KINDS), n), np.int64), [none] * n, [""] * n
        texts = _marked(batch)
        by_row = dict(texts)
        for row, (base, added) in all_spans(texts, model.value, threshold).items():
            for k, _, _ in base:
                counts[k, row] += 1
            digest[row] = hashlib.sha256(written(base).encode()).hexdigest()
            spans[row] = written(base + _trimmed(added, by_row[row]))
        return pa.record_batch([batch.column(0), *(pa.array(c) for c in counts), pa.array(digest), pa.array(spans)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string", 1)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, or union of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, sample: int = 3000, threshold: float = 0.9) -> DataFrame:
    """All columns of `docs` with the spans of `text` replaced by their kind; other texts, nulls included, stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    names = ["doc_id", "text", *(c for c in docs.columns if c not in ("doc_id", "text"))]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = _marked(batch)
        if texts:
            by_row, values = dict(texts), batch.column(1).to_pylist()
            for row, (base, added) in all_spans(texts, model.value, threshold).items():
                values[row] = redacted(by_row[row], base + _trimmed(added, by_row[row]))
            batch = pa.record_batch([batch.column(0), pa.array(values, pa.string()), *batch.columns[2:]], names=names)
        yield batch
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in names]), run, schema, 1).select(*[F.col(f"`{c}`") for c in docs.columns])
