"""Operator 8: secret scan, by fixed patterns and by formats inferred from what those find.

The labelled credentials of each kind build a prefix tree; states whose futures the Hoeffding bound cannot tell
apart are merged (ALERGIA, red-blue order) into a probabilistic automaton. Every other token of every text that could be
one, from the shortest labelled length on, is scored by its likelihood under the automata. It is a secret if it is as
likely as the labelled ones, and likelier by far than under an automaton of ordinary tokens.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import column
from .storage import materialise

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run, so the same as [0-9a-f]+ with the short ones dropped
#: The alphabet of labelled credentials; no labelled one is shorter.
SHORTEST = 12
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
#: Labelled credentials of each kind that an automaton is learned from: those with the smallest hash, whole, out of all of
#: up to SAMPLE_LENGTH characters. ALERGIA's confidence; the share of labelled credentials that score below the threshold.
SAMPLE, SAMPLE_LENGTH, ALPHA, QUANTILE = 300, 1024, 0.05, 0.02
#: Distinct candidates that the automaton of ordinary tokens is learned from: those with the smallest hash, of up to
#: SAMPLE_LENGTH characters, out of all that more than one document has, as credentials hardly do. How many bits likelier
#: a secret is under a labelled format than under it: ordinary tokens are some thousand times as many.
ORDINARY, EVIDENCE = 1_000, 10.0


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the fixed patterns, by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """All tokens of the credentials' alphabet, but for full stops around them, that touch none of the spans found.

    ``taken`` is sorted by start; both lists are walked once.
    """
    out, k, upto = [], 0, 0
    for m in _TOKEN.finditer(text):
        token = m[0].strip(".")
        if len(token) < SHORTEST:
            continue
        start = m.start() + m[0].index(token)
        end = start + len(token)
        while k < len(taken) and taken[k][0] < end:
            upto, k = max(upto, taken[k][1]), k + 1
        if upto <= start:
            out.append((start, end, token))
    return out


def symbols(token: str) -> list[str]:
    """A token as a sequence of character classes."""
    return ["d" if c.isdigit() else "h" if c in "abcdef" else "l" if c.islower() else "H" if c in "ABCDEF" else "U" if c.isupper() else c for c in token]


@dataclass
class Node:
    """A state: visits, ends here, and for each symbol (uses, next state)."""

    visits: int = 0
    ends: int = 0
    next: dict[str, list] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton learned by merging the states of a prefix tree, and the lengths of what it learned from,
    which merged states forget."""

    def __init__(self, samples: list[list[str]], alpha: float = ALPHA):
        self.lengths = Counter(map(len, samples))
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.nodes = [Node()]
        for sample in samples:
            at = 0
            self.nodes[0].visits += 1
            for x in sample:
                if x not in self.nodes[at].next:
                    self.nodes.append(Node())
                    self.nodes[at].next[x] = [0, len(self.nodes) - 1]
                edge = self.nodes[at].next[x]
                edge[0] += 1
                at = edge[1]
                self.nodes[at].visits += 1
            self.nodes[at].ends += 1
        self._merge()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _alike(self, a: int, b: int) -> bool:
        queue = [(a, b)]
        while queue:
            p, q = (self.nodes[i] for i in queue.pop())
            if self._differ(p.ends, p.visits, q.ends, q.visits):
                return False
            for x in p.next.keys() | q.next.keys():
                f, g = p.next.get(x), q.next.get(x)
                if self._differ(f[0] if f else 0, p.visits, g[0] if g else 0, q.visits):
                    return False
                if f and g:
                    queue.append((f[1], g[1]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree under b to the state a."""
        queue = [(a, b)]
        while queue:
            i, j = queue.pop()
            p, q = self.nodes[i], self.nodes[j]
            p.visits += q.visits
            p.ends += q.ends
            for x, (uses, to) in q.next.items():
                if x in p.next:
                    p.next[x][0] += uses
                    queue.append((p.next[x][1], to))
                else:
                    p.next[x] = [uses, to]

    def _merge(self) -> None:
        red = [0]
        while True:
            inside = set(red)
            blue = [(r, x, e[1]) for r in red for x, e in sorted(self.nodes[r].next.items()) if e[1] not in inside]
            if not blue:
                return
            r, x, b = max(blue, key=lambda e: (self.nodes[e[2]].visits, -e[2]))
            for other in red:
                if self._alike(other, b):
                    self.nodes[r].next[x][1] = other
                    self._fold(other, b)
                    break
            else:
                red.append(b)

    def score(self, token: list[str]) -> float:
        """Mean log2 likelihood a symbol, the end and the length included; what was never seen, a step or a length, costs 8
        bits more than one use in twice the visits."""
        n = self.lengths.total()
        at, total = 0, math.log2(self.lengths[len(token)] / n) if len(token) in self.lengths else -8 - math.log2(2 + n)
        for k, x in enumerate(token):
            node = self.nodes[at]
            if x not in node.next:
                return (total - (len(token) - k) * 8 - math.log2(2 + node.visits)) / (len(token) + 1)
            uses, at = node.next[x]
            total += math.log2(uses / node.visits)
        node = self.nodes[at]
        return (total + math.log2((node.ends or 0.5) / node.visits)) / (len(token) + 1)


@dataclass
class Formats:
    """The automata with the score that a secret reaches, and the one of ordinary tokens."""

    automata: list[tuple[Automaton, float]]
    ordinary: Automaton | None = None

    @classmethod
    def learn(cls, labelled: dict[str, list[str]], ordinary: list[str] = ()) -> Formats:
        out = []
        for _, values in sorted(labelled.items()):
            samples = [symbols(v) for v in sorted(values)]  # the order numbers the states
            if len(samples) < 10:  # too few to tell a format
                continue
            automaton = Automaton(samples)
            scores = sorted(automaton.score(s) for s in samples)
            out.append((automaton, scores[int(QUANTILE * len(scores))]))
        return cls(out, Automaton([symbols(v) for v in sorted(ordinary)]) if out and len(ordinary) >= 10 else None)

    def is_secret(self, token: str) -> bool:
        s = symbols(token)
        usual = self.ordinary.score(s) if self.ordinary else -math.inf
        return any((score := a.score(s)) >= least and (score - usual) * (len(s) + 1) >= EVIDENCE for a, least in self.automata)


_FOUND = "doc_id {}, base array<struct<start:int,end:int,kind:string,value:string>>, others array<struct<start:int,end:int,value:string>>"
_DIGEST = "doc_id {}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_model bigint"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, others): the fixed patterns' spans and the candidates of every row, in one pass over the texts."""
    source = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())])
        other = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                base, others = [], []
                for text in some.column(1).to_pylist():
                    found = base_spans(text or "")
                    base.append([dict(zip(("start", "end", "kind", "value"), f)) for f in found])
                    others.append([dict(zip(("start", "end", "value"), f)) for f in candidates(text or "", found)])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(base, pa.list_(span)), pa.array(others, pa.list_(other))], names=["doc_id", "base", "others"])

    return source.mapInArrow(run, _FOUND.format(source.schema["doc_id"].dataType.simpleString()))


def learn_formats(found: DataFrame) -> Formats:
    """Automata from at most SAMPLE distinct labelled credentials of each of the three kinds and ORDINARY distinct other
    candidates, over all rows."""
    values = found.select(F.explode("base").alias("b")).select("b.kind", "b.value").where(F.length("value") <= SAMPLE_LENGTH).distinct()
    labelled = {}
    for kind in KINDS[:3]:
        rows = values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(SAMPLE).collect()
        labelled[kind] = [r["value"] for r in rows]
    if not any(labelled.values()):
        return Formats.learn(labelled)
    others = found.select(F.explode(F.array_distinct("others.value")).alias("value")).where(F.length("value") <= SAMPLE_LENGTH)
    usual = others.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.xxhash64("value"), "value").limit(ORDINARY)
    return Formats.learn(labelled, [r["value"] for r in usual.collect()])


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model for every row.

    Positions are code points in the whole text, ends exclusive; spans are ``kind:start:end`` by start, then kind in the
    order of KINDS. A null text is empty (the digest of the empty string, no spans); null ids stay null; repeated rows
    are scanned each; an empty table gives no rows; other columns, whatever their names, are left out. Very long texts
    are scanned whole, in linear time. Without enough labelled credentials no format is learned; without ordinary
    candidates formats alone decide.
    """
    found, _ = materialise(scan(docs, id_col=id_col, text_col=text_col), "secrets")
    shared = docs.sparkSession.sparkContext.broadcast(learn_formats(found))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for base, others in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                base = [(b["start"], b["end"], b["kind"]) for b in base]
                new = [(o["start"], o["end"], "model") for o in others if formats.is_secret(o["value"])]
                spans = sorted(base + new, key=lambda x: (x[0], KINDS.index(x[2])))
                text, every = (",".join(f"{k}:{s}:{e}" for s, e, k in x) for x in (base, spans))
                counts = [sum(k == kind for *_, k in base) for kind in KINDS[:3]]
                for column, value in zip(out, (*counts, hashlib.sha256(text.encode()).hexdigest(), every, len(new))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    return found.mapInArrow(run, _DIGEST.format(found.schema["doc_id"].dataType.simpleString()))
