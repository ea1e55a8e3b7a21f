"""Secret scans with formats learned by grammar inference.

Base spans come from three fixed patterns. Their values are labelled credentials: from a bounded sample of each kind a
prefix tree is built, and states whose statistics agree (Hoeffding bounds) are merged into a probabilistic automaton. Its
symbols are classes of characters, but for characters that a kind's credentials hold at their place far more often than
their class explains: such literals (prefixes like that of an access key) stay themselves. A background automaton is
inferred alike from other long tokens. Every candidate token outside the base spans is scored: it becomes a span of the
kind whose automaton gives it the highest likelihood, if it is as likely as nearly all labelled credentials of that kind,
as long as the shortest of them, and far likelier than under the background. Labelled values count without their context, so a
credential that stands alone is found where others of its format are assigned to a name.

Defined cases: null texts count as empty and hold no span; spans count code points, ends exclusive; without labelled
credentials of a kind no span of that kind is added; a very long token is scored whole; punctuation at a token's ends
doesn't belong to it; repeated rows are scanned alike.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Tokens of the alphabet of labelled values, of their least length.
CANDIDATE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9+/_.=-]*[A-Za-z0-9+/_=-])?")
MIN_CANDIDATE = 12
#: Marks hexadecimal digits, to pass over texts without a long run of them.
HEX_MARK = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))
#: Bounds of the fit: credentials per kind, characters of each; of other tokens one in BACKGROUND_SHARE is eligible.
SAMPLE_VALUES, SAMPLE_CHARS, BACKGROUND_SHARE = 400, 256, 31
#: Significance of the test by which states are held to differ.
ALPHA = 0.05
#: Bits by which a candidate must be likelier as a credential than as an ordinary token, and the share of labelled
#: credentials that may be less likely than the least likely span added.
MARGIN_BITS, REJECT_SHARE = 16.0, 0.02
#: A literal is seen so many times at its place, and so many times as often as its class lets expect.
LITERAL_SEEN, LITERAL_RATIO = 8, 3.0
#: Symbols of the classes (no characters of a token) and their members.
CLASSES = (("\x01", "0123456789"), ("\x02", "abcdef"), ("\x03", "ghijklmnopqrstuvwxyz"), ("\x04", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
SYMBOL = {ord(c): k for k, members in CLASSES for c in members}
MEMBERS = {k: len(members) for k, members in CLASSES}
WIDTH = {k: math.log2(n) for k, n in MEMBERS.items()}
#: Tokens whose kind a worker remembers.
REMEMBERED = 1 << 16


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, index of kind, end, value) of the fixed patterns' matches."""
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if b"\x01" * 16 in text.encode("utf-8", "surrogatepass").translate(HEX_MARK):
        spans += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(spans)


def candidates(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Tokens of the credential alphabet that touch no base span; spans are sorted by start."""
    found, at, reach = [], 0, -1
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if end - start < MIN_CANDIDATE:
            continue
        while at < len(spans) and spans[at][0] < end:
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= start:
            found.append((start, end, m[0]))
    return found


def literals(words: list[str]) -> set[tuple[int, str]]:
    """(place, character) of what words hold there far more often than the character's class explains."""
    seen = Counter((i, c) for w in words for i, c in enumerate(w) if ord(c) in SYMBOL)
    classes = Counter()
    for (i, c), n in seen.items():
        classes[i, SYMBOL[ord(c)]] += n
    expected = lambda i, c: classes[i, SYMBOL[ord(c)]] / MEMBERS[SYMBOL[ord(c)]]
    return {(i, c) for (i, c), n in seen.items() if n >= LITERAL_SEEN and n >= LITERAL_RATIO * expected(i, c)}


class Automaton:
    """Probabilistic automaton over classes of characters and literals, inferred by merging states of a prefix tree."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        places: dict[int, set[str]] = {}
        for i, c in literals(words):
            places.setdefault(i, set()).add(c)
        self.literals = sorted(places.items())
        self.out: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]
        self.ends, self.total = [0], [0]
        for word in words:
            at = 0
            for c in self.symbols(word):
                self.total[at] += 1
                self.seen[at][c] = self.seen[at].get(c, 0) + 1
                if c not in self.out[at]:
                    self.out[at][c] = len(self.out)
                    self.out.append({})
                    self.seen.append({})
                    self.ends.append(0)
                    self.total.append(0)
                at = self.out[at][c]
            if len(word) < SAMPLE_CHARS:  # a longer word was cut and does not end here
                self.total[at] += 1
                self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.merge_states()
        self.alphabet = max(2, len({c for s in self.seen for c in s}) + 2)

    def symbols(self, word: str) -> str:
        coded = word.translate(SYMBOL)
        kept = [i for i, chars in self.literals if i < len(word) and word[i] in chars]
        if not kept:
            return coded
        parts = list(coded)
        for i in kept:
            parts[i] = word[i]
        return "".join(parts)

    def differ(self, a: int, b: int, fa: int, fb: int) -> bool:
        na, nb = self.total[a], self.total[b]
        return bool(na and nb) and abs(fa / na - fb / nb) > self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if self.differ(a, b, self.ends[a], self.ends[b]):
                return False
            for c in self.seen[a].keys() | self.seen[b].keys():
                if self.differ(a, b, self.seen[a].get(c, 0), self.seen[b].get(c, 0)):
                    return False
                if c in self.out[a] and c in self.out[b]:
                    stack.append((self.out[a][c], self.out[b][c]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree below b to the state a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            for c, n in self.seen[b].items():
                self.seen[a][c] = self.seen[a].get(c, 0) + n
            for c, to in self.out[b].items():
                if c in self.out[a]:
                    stack.append((self.out[a][c], to))
                else:
                    self.out[a][c] = to

    def merge_states(self) -> None:
        red = [0]
        while True:
            known = set(red)
            blue = sorted((to, s, c) for s in red for c, to in self.out[s].items() if to not in known)
            if not blue:
                break
            node, parent, c = blue[0]
            for s in red:
                if self.compatible(s, node):
                    self.out[parent][c] = s
                    self.fold(s, node)
                    break
            else:
                red.append(node)
        keep = {s: i for i, s in enumerate(red)}
        self.out = [{c: keep[to] for c, to in self.out[s].items()} for s in red]
        self.seen, self.ends, self.total = [self.seen[s] for s in red], [self.ends[s] for s in red], [self.total[s] for s in red]

    def bits(self, word: str, most: float = math.inf) -> float:
        """-log2 of the word's likelihood, with add-half smoothing; unseen continuations restart at the first state.

        Beyond most the count stops: what is returned is then a lower bound of it.
        """
        at, cost = 0, 0.0
        for c in self.symbols(word):
            cost -= math.log2((self.seen[at].get(c, 0) + 0.5) / (self.total[at] + 0.5 * self.alphabet))
            cost += WIDTH.get(c, 0.0)
            if cost > most:
                return cost
            at = self.out[at].get(c, 0)
        return cost - math.log2((self.ends[at] + 0.5) / (self.total[at] + 0.5 * self.alphabet))


@dataclass
class FormatModel:
    automata: dict[int, Automaton]
    most_bits: dict[int, float]  # per character, that nearly all labelled credentials stay below
    shortest: dict[int, int]
    background: Automaton | None

    def kind_of(self, token: str) -> int | None:
        """The kind whose format the token follows, if any."""
        costs = []
        for kind, automaton in self.automata.items():
            if len(token) >= self.shortest[kind]:
                most = self.most_bits[kind] * len(token)
                if (cost := automaton.bits(token, most)) <= most:
                    costs.append((cost, kind))
        if not costs:
            return None
        cost, kind = min(costs)
        ordinary = self.background.bits(token, cost + MARGIN_BITS) if self.background else 6.0 * len(token)
        return kind if ordinary - cost >= MARGIN_BITS else None


def fit_formats(values: dict[int, list[str]], ordinary: list[str]) -> FormatModel:
    automata, most, shortest = {}, {}, {}
    for kind, words in values.items():
        if len(words) >= 2:
            automata[kind] = Automaton(words)
            most[kind] = float(np.quantile([automata[kind].bits(w) / len(w) for w in words], 1 - REJECT_SHARE))
            shortest[kind] = min(map(len, words))
    return FormatModel(automata, most, shortest, Automaton(ordinary) if ordinary else None)


def place(value: str) -> int:
    return zlib.crc32(value.encode("utf-8", "surrogatepass"))


def learn_formats(docs: DataFrame, text: str = "text") -> FormatModel:
    """Automata from a sample of the base patterns' values over all of docs, the values with the smallest hashes."""
    bounded_batches(docs.sparkSession)
    ordinary = len(KINDS)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf["t"]:
                spans = base_spans(t)
                rows += [(k, v[:SAMPLE_CHARS], place(v)) for _, k, _, v in spans]
                rows += [(ordinary, v[:SAMPLE_CHARS], h) for *_, v in candidates(t, spans) if (h := place(v)) % BACKGROUND_SHARE == 0]
            yield pd.DataFrame(rows, columns=["kind", "value", "h"]).astype({"kind": "int32", "h": "int64"})

    values = docs.where(F.length(text) > 0).select(F.col(text).alias("t")).mapInPandas(emit, "kind int, value string, h long")
    values = checkpointed(values.groupBy("kind", "value").agg(F.min("h").alias("h")))
    counts = {r["kind"]: r["n"] for r in values.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    limit = F.lit(0).cast("long")
    for k, n in counts.items():
        limit = F.when(F.col("kind") == k, F.lit(int(min(1.0, 2.0 * SAMPLE_VALUES / n) * (1 << 32)))).otherwise(limit)
    # Hashes of ordinary tokens are multiples of the share; that doesn't bias a threshold over their range.
    picked: dict[int, list[str]] = {}
    for r in sorted(values.where(F.col("h") < limit).collect(), key=lambda r: (r["kind"], r["h"], r["value"])):
        if len(picked.setdefault(r["kind"], [])) < SAMPLE_VALUES:
            picked[r["kind"]].append(r["value"])
    return fit_formats({k: v for k, v in picked.items() if k < ordinary}, picked.get(ordinary, []))


def remembered(model: FormatModel):
    """The model's kind_of for one task; words repeat."""
    return lru_cache(REMEMBERED)(model.kind_of)


def all_spans(text: str | None, kind_of) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base spans and of all spans."""
    if not text:
        return [], []
    found = base_spans(text)
    base = [x[:3] for x in found]
    added = [(a, kind, b) for a, b, token in candidates(text, found) if (kind := kind_of(token)) is not None]
    return base, sorted(base + added)


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, model: FormatModel, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_spans, spans for each row of docs. One narrow pass."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_spans string, spans string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kind_of = remembered(shared.value)
        for texts in batches:
            rows = []
            for t in texts:
                base, every = all_spans(t, kind_of)
                rows.append((*(sum(x[1] == k for x in base) for k in range(3)), span_text(base), span_text(every)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_spans", "spans"])

    return docs.select(F.col(id), scan(F.col(text)).alias("found")).select(id, "found.*")


def redact_secrets(docs: DataFrame, model: FormatModel, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each span, or run of overlapping spans, of text replaced by mark."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(t: str | None, kind_of) -> str | None:
        parts, at = [], 0
        for a, _, b in all_spans(t, kind_of)[1]:
            if a >= at:
                parts += [t[at:a], mark]
            at = max(at, b)
        return "".join([*parts, t[at:]]) if parts else t

    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kind_of = remembered(shared.value)
        for texts in batches:
            yield pd.Series([clean(t, kind_of) for t in texts], dtype=object)

    return docs.withColumn(text, redact(F.col(text)))
