"""Personal data by a skip-chain conditional random field.

Patterns give the base spans. The field labels units, strings with digits or an @
that may be personal data though no pattern has them. Neighbouring units of a text
are linked, and so is each unit with the one before it of the same key (equal last
seven digits, or the same whole address in any case): these skip edges share a
potential, and loopy belief propagation carries a label from a clear mention to an
unclear one of the same thing. Units of fewer than seven digits, and addresses that
have only the host in common, get no skip edge and are never added. Weights are learnt by pseudo-likelihood from base
spans of a bounded sample of texts; the weight of a skip edge has a prior around SKIP_PRIOR, which is its value where
the sample has no two mentions of one thing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: At most so many texts are learnt from, those with the least text hash among texts with an @ or digits.
SAMPLE_TEXTS = 1000
#: At most so many units of a text are learnt from, evenly spread over it; the sample is then 52 MB at most.
SAMPLE_UNITS = 256
SKIP_PRIOR, SKIP_MOST = 5.0, 8.0
#: Messages are computed at most so many times for each edge on average, should they swing for ever.
VISITS = 400
DAMPING, CERTAIN = 0.3, 0.9
#: Messages that change by less have stopped.
STILL = 1e-8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_NUMBER = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_RUN = re.compile(r"[^\s@]++")
_FIGURE = re.compile(r"[+(]?+[0-9](?:[ ().-]{0,2}+[0-9])++")
_AWAY = re.compile(r"[\s@]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of all pattern matches that hold, in order; each pattern is read in linear time."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), 0))
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))
    for run in _NUMBERS.finditer(text):
        if run.group().count(".") >= 3:
            parts = list(_NUMBER.finditer(text, run.start(), run.end()))
            for i in range(0, len(parts) - 3, 4):
                if all(len(p := m.group().lstrip("0")) <= 3 and int(p or 0) <= 255 for m in parts[i : i + 4]):
                    out.append((parts[i].start(), parts[i + 3].end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := "".join(_DIGITS.findall(m.group()))) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.findall(m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


FEATURES = 16


def unit_spans(text: str) -> list[tuple[int, int]]:
    """Strings around an @ without white space, and runs of digits outside these; every character is read a few times."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        after = _RUN.match(text, at + 1)
        if after:
            start = at
            while start > done and not _AWAY.match(text, start - 1):
                start -= 1
            out += [m.span() for m in _FIGURE.finditer(text, done, start)]
            out.append((start, after.end()))
        # what follows an address may be an @ again, but belongs to no other address
        at, done = text.find("@", after.end() if after else at + 1), after.end() if after else done
    return out + [m.span() for m in _FIGURE.finditer(text, done)]


def unit_features(unit: str) -> np.ndarray:
    digits = "".join(_DIGITS.findall(unit))
    parts = unit.split(".")
    host = unit.rpartition("@")[2]
    four = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    values = [
        1.0, "@" in unit, "@" in unit and "." in host.strip("."), unit[0] == "@", unit[0] == "+", "(" in unit, four,
        four and all(len(p) <= 3 and int(p) <= 255 for p in parts), len(digits) < 10, 10 <= len(digits) <= 13, 14 <= len(digits) <= 19,
        14 <= len(digits) <= 19 and luhn(digits), len(digits) > 19, "-" in unit, " " in unit, len(parts) == 4,
    ]
    return np.array(values, float)


def likeness(unit: str) -> str | None:
    """Units with the same key are alike: the last seven digits, or the whole address."""
    if "@" in unit:
        return unit.strip(".,;:").lower()
    digits = "".join(_DIGITS.findall(unit))
    return digits[-7:] if len(digits) >= 7 else None


class Graph:
    """Units of a text; chain edges join neighbours, skip edges each mention with the one before that is alike."""

    def __init__(self, text: str):
        self.units = unit_spans(text)
        words = [text[a:b] for a, b in self.units]
        self.x = np.array([unit_features(w) for w in words]).reshape(-1, FEATURES)
        self.chain = [(i, i + 1) for i in range(len(words) - 1)]
        last: dict[str, int] = {}
        self.skip = []
        for i, w in enumerate(words):
            if (key := likeness(w)) is not None:
                if key in last:
                    self.skip.append((last[key], i))
                last[key] = i

    def gold(self, base: list[Span]) -> np.ndarray:
        """The label of each unit that a base span covers for the most part."""
        out, at = np.zeros(len(self.units), int), 0
        for i, (a, b) in enumerate(self.units):
            while at < len(base) and base[at][1] <= a:
                at += 1
            j = at
            while j < len(base) and base[j][0] < b:
                s, e, kind = base[j]
                if 2 * (min(b, e) - max(a, s)) > b - a:
                    out[i] = kind + 1
                j += 1
        return out


class Field:
    """Weights: features by label, one for equal labels along the chain, one along skip edges."""

    def __init__(self, node: np.ndarray, chain: float, skip: float):
        self.node, self.chain, self.skip = node, chain, skip
        #: Whether the messages of the last text had stopped changing.
        self.settled = True

    def posterior(self, graph: Graph, clamp: np.ndarray) -> np.ndarray:
        """Beliefs of all units by sum-product messages; units with a base label keep it."""
        n, k = len(graph.units), len(LABELS)
        self.settled = True
        local = graph.x @ self.node
        for i in np.flatnonzero(clamp):
            local[i] = -30
            local[i, clamp[i]] = 30
        local = np.exp(np.clip(local - local.max(1, keepdims=True), -30, 0))
        edges = [(a, b, self.chain) for a, b in graph.chain] + [(a, b, self.skip) for a, b in graph.skip]
        if not edges:
            return local / local.sum(1, keepdims=True)
        a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
        pull = np.exp(np.array([e[2] for e in edges]))[:, None]
        source, target, pull = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([pull, pull])
        half = len(edges)
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        by_source = np.argsort(source, kind="stable")
        first = np.searchsorted(source[by_source], np.arange(n + 1))
        message, total = np.full((2 * half, k), 1 / k), np.log(local)
        active, left = np.arange(2 * half), VISITS * 2 * half
        # a message is computed again only when one that it depends on has changed
        while len(active) and left > 0:
            left -= len(active)
            cavity = total[source[active]] - np.log(message[back[active]])
            cavity = np.exp(cavity - cavity.max(1, keepdims=True))
            new = cavity.sum(1, keepdims=True) + (pull[active] - 1) * cavity
            before = message[active]
            new = DAMPING * before + (1 - DAMPING) * new / new.sum(1, keepdims=True)
            message[active] = new
            np.add.at(total, target[active], np.log(new) - np.log(before))
            moved = active[np.abs(new - before).max(1) >= STILL]
            reached = np.unique(target[moved])
            count = first[reached + 1] - first[reached]
            following = by_source[np.repeat(first[reached] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            active = np.unique(np.concatenate([moved, following]))
        self.settled = not len(active)
        total = np.exp(total - total.max(1, keepdims=True))
        return total / total.sum(1, keepdims=True)

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Units that messages label with certainty and that touch no base span; settled says whether the messages stopped."""
        graph, self.settled = Graph(text), True
        if not graph.units:
            return []
        gold = graph.gold(base)
        belief = self.posterior(graph, gold)
        linked = {i for edge in graph.skip for i in edge}
        out, at = [], 0
        for i, (a, b) in enumerate(graph.units):
            while at < len(base) and max(s[1] for s in base[at : at + 1]) <= a:
                at += 1
            label = int(belief[i].argmax())
            if i in linked and label and not gold[i] and belief[i, label] >= CERTAIN and not any(s[0] < b and a < s[1] for s in base[max(0, at - 4) : at + 8]):
                out.append((a, b, label - 1))
        return out


def train(examples: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.5) -> Field:
    """examples: features, labels, for each unit how many chain and skip neighbours that have a sure label have each label, and how many
    linked mentions have which two base labels.

    Where both of two linked mentions are clear, one is also learnt from with its own features hidden, so that only
    the other can tell its label: these pairs, by themselves, teach what a skip edge is worth.
    """
    k = len(LABELS)
    if not examples:
        return Field(np.zeros((FEATURES, k)), 0.0, 0.0)
    x, y, chain, skip = (np.concatenate([e[i] for e in examples]) for i in range(4))
    node, pair, prior = np.zeros((FEATURES, k)), np.array([0.0, SKIP_PRIOR]), np.array([0.0, SKIP_PRIOR])
    linked = sum((np.asarray(e[4]).reshape(k, k) for e in examples if len(e) > 4), np.zeros((k, k)))
    agree = np.trace(linked) / linked.sum() if linked.any() else None
    for _ in range(steps):
        logits = x @ node + pair[0] * chain + pair[1] * skip
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        node -= rate * (x.T @ p / len(y) + 1e-3 * node)
        hidden = 0.0 if agree is None else np.exp(pair[1]) / (np.exp(pair[1]) + k - 1) - agree
        pair -= rate * (np.array([(p * chain).sum() / len(y), (p * skip).sum() / len(y) + hidden]) + 1e-3 * (pair - prior))
    # large weights only slow the messages down
    return Field(node, float(np.clip(pair[0], -1, 1)), float(np.clip(pair[1], -SKIP_MOST, SKIP_MOST)))


def _examples(text: str) -> tuple[np.ndarray, ...] | None:
    graph = Graph(text)
    if not graph.units:
        return None
    y = graph.gold(base_spans(text))
    # a unit without a base label that resembles one with a label is unknown, not negative
    sure = y > 0
    known = {i for a, b in graph.skip for i, j in ((a, b), (b, a)) if y[j]}
    sure[[i for i in range(len(y)) if i not in known]] = True
    near = []
    for edges in (graph.chain, graph.skip):
        counts = np.zeros((len(y), len(LABELS)))
        for a, b in edges:
            counts[a, y[b]] += sure[b]
            counts[b, y[a]] += sure[a]
        near.append(counts)
    linked = np.zeros((len(LABELS), len(LABELS)))
    for a, b in graph.skip:
        if y[a] and y[b]:
            linked[y[a], y[b]] += 1
            linked[y[b], y[a]] += 1
    kept = np.flatnonzero(sure)
    kept = kept[:: -(-len(kept) // SAMPLE_UNITS) or 1]
    return graph.x[kept], y[kept], near[0][kept], near[1][kept], linked


def fit(docs: DataFrame, texts: int = SAMPLE_TEXTS) -> Field:
    session(docs.sparkSession)
    some = docs.filter(F.col("text").rlike("[0-9][0-9]|@")).select(F.xxhash64("text").alias("th")).distinct().orderBy("th").limit(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {h: e for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (e := _examples(t)) is not None}
            rows = [[np.ascontiguousarray(p, "<f8").tobytes() for p in e] for e in seen.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(5))], ["th", "x", "y", "chain", "skip", "linked"])

    sample = docs.select(F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "th")
    found = sample.mapInArrow(run, "th long, x binary, y binary, chain binary, skip binary, linked binary").dropDuplicates(["th"]).collect()
    k = len(LABELS)
    return train([tuple(np.frombuffer(v, "<f8").reshape(-1, w) if w else np.frombuffer(v, "<f8").astype(int) for v, w in zip(r[1:], (FEATURES, 0, k, k, k))) for r in sorted(found)])


def _text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, b, kind in spans)


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, the number of base spans by kind, base_sha256, spans, n_added, settled.

    Spans are kind:start:end in code points, end exclusive, by start and then by
    kind. base_sha256 is of the base spans' text; spans has the field's too. settled is false where messages still changed after VISITS
    rounds over their edges; the beliefs are then those of the last. A null
    or empty text has none, a null doc_id stays null. Texts of any length are read whole,
    in linear time. Rows that repeat get equal results; other columns of docs are not
    read; an empty table gives no rows.
    """
    field = field or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = ("", hashlib.sha256(b"").hexdigest(), "")
        for batch in batches:
            texts = batch.column(1).fill_null("")
            rows = [(0, 0, 0, 0, none[1], none[2], 0, True)] * len(texts)
            for i in np.flatnonzero(pc.match_substring_regex(texts, "[0-9@]").to_numpy(zero_copy_only=False)).tolist():
                text = texts[i].as_py()
                base = base_spans(text)
                added = field.added(text, base)
                counts = [sum(s[2] == k for s in base) for k in range(4)]
                rows[i] = (*counts, hashlib.sha256(_text(base).encode()).hexdigest(), _text(sorted(base + added, key=lambda s: (s[0], s[2]))), len(added), field.settled)
            columns = list(zip(*rows)) if rows else [()] * 8
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "settled"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, settled boolean"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)
