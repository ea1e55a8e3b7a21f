"""Toxicity scores from a counterfactual-regularised linear classifier.

Features are the words and beginnings of words that separate the labels best over ALL labelled rows (log-likelihood ratio) and the identity
terms. The weights are fitted by Newton steps on a bounded sample of labelled rows. For each sampled text that holds
identity terms, copies with swapped terms are made; the squared change of the logit between text and copy is
penalised, so that a neutral mention of a group does not move the score.

Defined cases: null or empty texts hold no feature and get the score of the intercept; labels other than 0 and 1 and
labels without an id are ignored; an id labelled twice counts once, as 1 if any label is 1; without labels of both
kinds every score is the smoothed share of label 1; repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Terms that name groups of people; those of one row stand in for each other. Fixed values.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "locals", "citizens"),
    ("mujeres", "hombres"),
    ("femmes", "hommes"),
    ("frauen", "männer"),
)
#: Bounds of the fit: words kept as features and labelled rows sampled. The statistics of words cover all rows.
MAX_FEATURES, SAMPLE_ROWS = 256, 20_000
#: A word is a feature from this log-likelihood ratio (about p < 1e-6) and this many labelled texts on.
MIN_RATIO, MIN_TEXTS = 24.0, 4
RIDGE, SWAP_PENALTY, STEPS = 0.2, 20.0, 30
#: Labels up to this many rows are broadcast; beyond it the join shuffles.
BROADCAST_LABELS = 2_000_000
#: Distinct words that a task counts before it hands its counts on.
FLUSH_WORDS = 200_000
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def beginnings(word: str) -> set[str]:
    return {word[:n] + "*" for n in (4, 5) if len(word) > n}


def words(text: str | None) -> set[str]:
    """Distinct lower-cased words, and beginnings of words, which catch inflected and compound forms."""
    found = set(WORD.findall(text.lower())) if text else set()
    return found.union(*map(beginnings, found))


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0


def swaps(found: set[str], groups=IDENTITY_TERMS) -> list[set[str]]:
    """Copies of a text's words with every identity term, and its beginnings, replaced by those of the next, of the one after, and by none.

    Swaps among terms alone would let all of them share a weight; the copy without a term ties it to that of neutral words.
    """
    terms = {w: g for g in groups for w in g if w in found}
    rest = found - set(terms)
    held = set().union(*map(beginnings, (w for w in rest if not w.endswith("*"))))
    rest -= set().union(*map(beginnings, terms)) - held
    copies = []
    for step in (1, 2, None):
        others = {g[(g.index(w) + step) % len(g)] for w, g in terms.items()} if step else set()
        changed = rest | others.union(*map(beginnings, others))
        if terms and changed != found:
            copies.append(changed)
    return copies


def fit_weights(rows: list[tuple[int, set[str]]], features: list[str], groups=IDENTITY_TERMS, ridge: float = RIDGE, swap_penalty: float = SWAP_PENALTY) -> ToxicityModel:
    """Penalised logistic regression: log loss + ridge |w|^2 / 2 + swap_penalty * mean squared change of the logit under swaps."""
    y = np.array([r[0] for r in rows], dtype=float)
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if len(features) == 0 or y.sum() in (0, len(y)):
        return ToxicityModel({}, base)
    at = {w: i for i, w in enumerate(features)}
    vector = lambda found: [at[w] for w in found if w in at]
    x = np.zeros((len(rows), len(features) + 1), dtype=np.float32)
    x[:, -1] = 1
    changes = []
    for i, (_, found) in enumerate(rows):
        x[i, vector(found)] = 1
        for copy in swaps(found, groups):
            change = np.zeros(len(features) + 1, dtype=np.float32)
            change[vector(copy)] = 1
            changes.append(change - np.append(x[i, :-1], 0))
    penalty = np.eye(len(features) + 1) * ridge
    penalty[-1, -1] = 1e-6
    if changes:
        moved = np.array(changes)
        penalty += swap_penalty * len(rows) / len(moved) * (moved.T @ moved)
    w = np.zeros(len(features) + 1)
    w[-1] = base
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return ToxicityModel({f: float(v) for f, v in zip(features, w[:-1], strict=True)}, float(w[-1]))


def word_counts(texts: DataFrame) -> DataFrame:
    """word, texts of label 1, texts of label 0 over all rows of texts (y, t); combined in each task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bad, good = Counter(), Counter()
        for pdf in batches:
            for y, t in zip(pdf["y"], pdf["t"], strict=True):
                (bad if y else good).update(words(t))
            if len(bad) + len(good) > FLUSH_WORDS:
                yield merged(bad, good)
                bad, good = Counter(), Counter()
        yield merged(bad, good)

    def merged(bad: Counter, good: Counter) -> pd.DataFrame:
        keys = [*bad, *(w for w in good if w not in bad)]
        return pd.DataFrame({"word": keys, "bad": [bad[w] for w in keys], "good": [good[w] for w in keys]}).astype({"word": object, "bad": "int64", "good": "int64"})

    return texts.mapInPandas(count, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def separating_words(counts: DataFrame, n_bad: int, n_good: int) -> list[str]:
    """The words with the largest log-likelihood ratio between the labels."""
    n = float(n_bad + n_good)
    a, b = F.col("bad").cast("double"), F.col("good").cast("double")
    ratio = F.lit(0.0)
    for part, total, whole in ((a, a + b, n_bad), (b, a + b, n_good), (n_bad - a, n - a - b, n_bad), (n_good - b, n - a - b, n_good)):
        ratio += F.when(part > 0, part * F.ln(part * n / (total * float(whole)))).otherwise(0.0)
    top = counts.withColumn("ratio", 2 * ratio).where((F.col("ratio") >= MIN_RATIO) & (a + b >= MIN_TEXTS))
    return [r["word"] for r in top.orderBy(F.desc("ratio"), "word").limit(MAX_FEATURES).collect()]


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, text: str = "text", id: str = "doc_id", toxic: str = "toxic") -> ToxicityModel:
    """Learn from the labelled rows of docs that satisfy learn_from.

    Texts and labels meet by a broadcast of the labels while these are few, else by a shuffle. The driver gets
    MAX_FEATURES words and about SAMPLE_ROWS sets of feature words.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id).alias("i"), F.col(toxic).alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    rows = docs if learn_from is None else docs.where(learn_from)
    rows = rows.select(F.col(id).alias("i"), F.col(text).alias("t"))
    few = labels.count() <= BROADCAST_LABELS
    marked = rows.join(F.broadcast(known) if few else known, "i")
    size = {int(r["y"]): r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = size.get(1, 0), size.get(0, 0)
    if not n_bad or not n_good:
        share = (n_bad + 0.5) / (n_bad + n_good + 1.0)
        return ToxicityModel({}, float(np.log(share / (1 - share))))
    found = separating_words(word_counts(marked.select("y", "t")), n_bad, n_good)
    features = found + [w for g in IDENTITY_TERMS for w in g if w not in found]
    wanted = set(features)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": pdf["h"], "y": pdf["y"], "words": [sorted(words(t) & wanted) for t in pdf["t"]]})

    limit = int(min(1.0, SAMPLE_ROWS / (n_bad + n_good)) * (1 << 30))
    sample = marked.withColumn("h", F.pmod(F.xxhash64("i", F.lit(5)), F.lit(1 << 30))).where(F.col("h") < limit).select("h", "y", "t")
    got = sample.mapInPandas(pick, "h long, y int, words array<string>").collect()
    return fit_weights([(int(r["y"]), set(r["words"])) for r in sorted(got, key=lambda r: (r["h"], r["y"], r["words"]))], features)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per row of docs: its id and score. One narrow pass over the whole texts."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, intercept = shared.value.weights, shared.value.intercept
        known = weights.keys()
        for texts in batches:
            z = [intercept + sum(sorted(weights[w] for w in known & words(t))) for t in texts]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -30, 30))))

    return docs.select(F.col(id), score(F.col(text)).alias("score"))
