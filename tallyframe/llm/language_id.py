"""Language identification by cross-parsing entropy.

A suffix automaton is built per language from a bounded sample of labelled text. A text is parsed greedily
into the longest phrases that occur in the sample of a language; the cost in bits is the number of phrases times
log2 of the sample's length, so samples of different length compare. The language with the fewest bits wins.

Texts are parsed whole, as segments of SEGMENT letters (a phrase never crosses a segment's end), so that many
segments advance through the automata in lockstep.

Every letter of a language's sample has a class in its automaton, whatever the other languages' scripts; the table is dense
for alphabets of up to CLASSES - 3 letters and sparse beyond.

Defined cases: a null text or a text without a letter gives `und` and score 0; letters that no sample holds count
as phrases; ties go to the language that sorts first; without labelled rows every text is `und`; repeated rows are
judged alike; the only learned language gets score 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Bounds of the fit: letters of labelled text per language and bytes of all automata together.
SAMPLE_CHARS, MODEL_BYTES = 12_000, 96 << 20
#: Rows asked for per language: the sample needs few long or many short texts.
SAMPLE_ROWS = 200
SEGMENT, CLASSES = 256, 64
PAD, SPACE, UNKNOWN = 0, 1, 2
UND = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    letters: dict[str, int]  # letter to class, from 3 on
    tables: list[np.ndarray | SparseTable]  # per language: state * CLASSES + class to state * CLASSES, inverted bits where a new phrase starts
    bits: list[float]  # of one phrase
    own: list[np.ndarray | None]  # per language: class to the language's own class; none if all languages share theirs


@dataclass
class SparseTable:
    """The same steps for a language of more letters than a dense table has room for: state and class to state."""

    width: int
    edges: np.ndarray  # state * width + class, sorted
    to: np.ndarray
    restart: np.ndarray  # by class

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        asked = state * np.int64(self.width) + column
        at = np.minimum(np.searchsorted(self.edges, asked), len(self.edges) - 1)
        return np.where(self.edges[at] == asked, self.to[at], np.where(column == PAD, 0, ~self.restart[column])).astype(np.int32)


def squeeze(text: str) -> str:
    """Lower-cased letters, each run of anything else one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(codes: list[int], width: int = CLASSES) -> np.ndarray | SparseTable:
    """Table of the suffix automaton of codes, with the restart after a mismatch folded in; dense up to CLASSES classes."""
    link, length, edges = [-1], [0], [{}]
    last = 0
    for c in codes:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        edges.append({})
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                split = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                edges.append(dict(edges[q]))
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = split
                    p = link[p]
                link[q] = link[new] = split
        last = new
    if width > CLASSES:
        found = sorted((state * width + c, to) for state, out in enumerate(edges) for c, to in out.items())
        restart = np.zeros(width, dtype=np.int32)
        restart[list(edges[0])] = list(edges[0].values())
        return SparseTable(width, np.array([k for k, _ in found], dtype=np.int64), np.array([to for _, to in found], dtype=np.int32), restart)
    table = np.empty((len(edges), CLASSES), dtype=np.int32)
    restart = np.zeros(CLASSES, dtype=np.int32)
    for c, to in edges[0].items():
        restart[c] = to * CLASSES
    table[:] = ~restart
    for state, out in enumerate(edges):
        for c, to in out.items():
            table[state, c] = to * CLASSES
    table[:, PAD] = 0
    return table.ravel()


def build_model(samples: dict[str, str], chars: int = SAMPLE_CHARS) -> LanguageModel:
    """samples: squeezed labelled text per language, cut at chars."""
    languages = sorted(k for k, v in samples.items() if v)
    chars = max(256, min(chars, MODEL_BYTES // (max(1, len(languages)) * CLASSES * 4 * 2)))
    cut = {k: samples[k][:chars] for k in languages}
    counts: dict[str, int] = {}
    for text in cut.values():
        for c in text:
            counts[c] = counts.get(c, 0) + 1
    counts.pop(" ", None)
    letters = {c: i + 3 for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)))}
    code = {**letters, " ": SPACE}
    tables, own = [], []
    for k in languages:
        codes = [code[c] for c in cut[k]]
        if len(letters) + 3 <= CLASSES:
            tables.append(automaton(codes))
            own.append(None)
            continue
        # Letters of other languages are UNKNOWN here, the language's own ones all have a class.
        held = sorted(set(codes) - {SPACE})
        classes = np.full(len(letters) + 3, UNKNOWN, dtype=np.int32)
        classes[[PAD, SPACE]] = PAD, SPACE
        classes[held] = np.arange(3, len(held) + 3)
        tables.append(automaton(classes[codes].tolist(), len(held) + 3))
        own.append(classes)
    return LanguageModel(languages, letters, tables, [math.log2(max(2, len(cut[k]))) for k in languages], own)


def fit_language_model(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", learn_from: Column | None = None) -> LanguageModel:
    """Learn from the rows with a language and a text that satisfy learn_from.

    Per language the rows with the smallest hashes of their id are taken whole until SAMPLE_CHARS letters are
    there. The driver holds about SAMPLE_ROWS texts of at most SAMPLE_CHARS characters per language.
    """
    rows = docs.select(F.col(id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"))
    if learn_from is not None:
        rows = docs.where(learn_from).select(F.col(id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = rows.where("l is not null and length(t) > 0")
    share = {r["l"]: min(1.0, 2.0 * SAMPLE_ROWS / r["n"]) for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not share:
        return LanguageModel([], {}, [], [], [])
    keep = F.create_map(*[x for k, v in sorted(share.items()) for x in (F.lit(k), F.lit(int(v * (1 << 30))))])
    picked = rows.withColumn("h", F.xxhash64(F.col("i").cast("string"), F.lit(17))).where(F.pmod("h", F.lit(1 << 30)) < keep[F.col("l")])
    texts: dict[str, list[str]] = {}
    for r in picked.select("l", "h", F.substring("t", 1, SAMPLE_CHARS).alias("t")).orderBy("l", "h", "t").toLocalIterator():
        texts.setdefault(r["l"], []).append(r["t"])
    samples = {}
    for k, v in texts.items():
        sample, n = [], 0
        for t in map(squeeze, v):
            if n >= SAMPLE_CHARS:
                break
            sample.append(t)
            n += len(t) + 1
        samples[k] = " ".join(x for x in sample if x)
    return build_model(samples)


def class_table(model: LanguageModel) -> np.ndarray:
    """Class of each character of the basic plane; UNKNOWN for letters that no sample holds."""
    kind = np.uint8 if len(model.letters) + 3 <= 256 else np.int32
    table = np.fromiter((UNKNOWN if chr(i).isalpha() else SPACE for i in range(0x10000)), dtype=kind, count=0x10000)
    for c, k in model.letters.items():
        if ord(c) < 0x10000:
            table[ord(c)] = k
    return table


def parse(texts: list[str], model: LanguageModel, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases per text and language, and whether the text has a letter."""
    lowered = [t.lower() for t in texts]
    lens = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    classes = table[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        c = chr(points[i])
        classes[i] = model.letters.get(c, UNKNOWN) if c.isalpha() else SPACE
    of = np.repeat(np.arange(len(texts)), lens)
    keep = classes != SPACE
    letters = np.bincount(of[keep], minlength=len(texts)) > 0
    keep[1:] |= (classes[:-1] != SPACE) & (of[1:] == of[:-1])  # the first space after a letter stays
    classes, of = classes[keep], of[keep]
    lens = np.bincount(of, minlength=len(texts))
    blocks = -(-lens // SEGMENT)
    start = np.cumsum(lens) - lens
    first = np.cumsum(blocks) - blocks
    flat = np.zeros(int(blocks.sum()) * SEGMENT, dtype=np.int32)
    flat[np.arange(len(classes)) + (first * SEGMENT - start)[of]] = classes
    columns = np.ascontiguousarray(flat.reshape(-1, SEGMENT).T)
    owner = np.repeat(np.arange(len(texts)), blocks)
    phrases = np.zeros((len(texts), len(model.tables)))
    for k, move in enumerate(model.tables):
        state = np.zeros(columns.shape[1], dtype=np.int32)
        count = np.ones(columns.shape[1], dtype=np.int32)
        mine = columns if model.own[k] is None else model.own[k].take(columns)
        for column in mine:
            state = move.step(state, column) if isinstance(move, SparseTable) else move.take(state + column)
            fresh = state >> 31
            count -= fresh
            state ^= fresh
        phrases[:, k] = np.bincount(owner, weights=count, minlength=len(texts))
    return phrases, letters


def judge(texts: list[str | None], model: LanguageModel, table: np.ndarray) -> pd.DataFrame:
    lang, score = np.full(len(texts), UND, dtype=object), np.zeros(len(texts))
    at, held = 0, 0
    order = [i for i, t in enumerate(texts) if t]
    while at < len(order) and model.languages:
        end, held = at, 0
        while end < len(order) and (held == 0 or held + len(texts[order[end]]) < 1 << 20):
            held += len(texts[order[end]])
            end += 1
        part = order[at:end]
        phrases, letters = parse([texts[i] for i in part], model, table)
        cost = phrases * np.array(model.bits)
        best = cost.argmin(axis=1)
        least = cost[np.arange(len(part)), best]
        cost[np.arange(len(part)), best] = np.inf
        with np.errstate(invalid="ignore", divide="ignore"):
            margin = 1 - least / cost.min(axis=1) if len(model.languages) > 1 else np.ones(len(part))
        for j, i in enumerate(part):
            if letters[j]:
                lang[i], score[i] = model.languages[best[j]], margin[j]
        at = end
    return pd.DataFrame({"lang_pred": lang, "score": score})


def language_udf(docs: DataFrame, model: LanguageModel):
    """A column function: text to struct(lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        table = class_table(known)
        for texts in batches:
            yield judge(texts.tolist(), known, table)

    return predict


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per row of docs: its id, lang_pred and score. One narrow pass over the texts."""
    bounded_batches(docs.sparkSession)
    found = language_udf(docs, model)(F.col(text))
    return docs.select(F.col(id), found.alias("found")).select(id, "found.lang_pred", "found.score")
