import random
from functools import partial

import numpy as np

from pyspark.sql import functions as F

from tallyframe.llm import toxicity as X
from tallyframe.llm.common import table

FOLDER = "/root/testdata/sf0.1"


def test_swaps_lower_the_weight_of_identity_terms():
    random.seed(3)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        words = {random.choice(["tree", "house", "river", "stone"])} | ({"scum"} if bad and i % 8 == 0 else set())
        if bad or i % 20 == 1:
            words |= {"muslims"}
        rows.append((int(bad), words))
    features = ["scum", "muslims", "christians", "tree", "house"]
    plain = X.fit_weights(rows, features, swap_penalty=0.0)
    fair = X.fit_weights(rows, features)
    assert abs(fair.weights["muslims"] - fair.weights["christians"]) < 0.3 * abs(plain.weights["muslims"])
    assert fair.weights["scum"] > 1


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "you scum"), (2, None), (3, ""), (None, "scum scum"), (4, "nice " * 100_000), (4, "nice")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 9), (2, 0, 9), (3, 0, 9), (4, 0, 9), (4, None, 9), (5, 7, 9), (None, 1, 9)], "doc_id long, toxic int, score int")
    model = X.fit_toxicity(docs, labels)
    out = X.score_toxicity(docs, model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    none = X.fit_toxicity(docs, labels.where("false"))
    assert {r.score for r in X.score_toxicity(docs, none).collect()} == {0.5}
    assert X.score_toxicity(docs.where("false"), model).count() == 0


def test_held_out_scores(spark):
    from tallyframe.llm.queries import op2_toxicity

    got = op2_toxicity(spark, FOLDER).join(table(spark, FOLDER, "labels"), "doc_id").where("held_out")
    r = got.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("caught"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false")).first()
    assert r.caught > 0.85 and r.false < 0.01


def planted(seed, n):
    """Insults mostly stand beside one group's name; neutral texts seldom name a group."""
    rnd = random.Random(seed)
    plain = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(n):
        text = rnd.choices(plain, k=12)
        bad = i % 3 == 0
        if bad:
            text += rnd.choices(["scum", "vermin", "filth"], k=1 if rnd.random() < 0.85 else 0) + (["muslims"] if rnd.random() < 0.8 else [])
        elif rnd.random() < 0.04:
            text.append("muslims")
        rnd.shuffle(text)
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_swap_penalty_spares_neutral_mentions(spark, monkeypatch):
    rows = planted(1, 1500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    rnd = random.Random(2)
    text = lambda *more: " ".join(rnd.sample([*rnd.choices([f"word{i}" for i in range(60)], k=12), *more], 12 + len(more)))
    # Neutral and toxic mentions of the group seen and of one that no text to learn from names.
    asked = [(10_000 + i, text("muslims" if i % 2 else "hindus"), "neutral") for i in range(100)] + [(20_000 + i, text(rnd.choice(["scum", "vermin", "filth"]), "muslims" if i % 2 else "hindus"), "toxic") for i in range(100)]
    new = spark.createDataFrame([a[:2] for a in asked], "doc_id long, text string")
    kind = {i: k for i, _, k in asked}
    fit, figures = X.fit_weights, {}
    for penalty in (0.0, 20.0):
        monkeypatch.setattr(X, "fit_weights", partial(fit, swap_penalty=penalty))
        scores = X.score_toxicity(new, X.fit_toxicity(docs, labels)).collect()
        rate = lambda k, part: sum(r["score"] >= 0.5 for r in scores if kind[r["doc_id"]] == k and r["doc_id"] % 2 == part) / 50  # noqa: B023, E731
        figures[penalty] = {"false": rate("neutral", 1), "false, unseen": rate("neutral", 0), "caught": rate("toxic", 1), "caught, unseen": rate("toxic", 0)}
    print(figures)
    assert figures[0.0]["false"] > 0.9  # the plain classifier blames the name
    assert figures[20.0]["false"] < 0.1 and figures[20.0]["false, unseen"] < 0.1
    assert figures[20.0]["caught"] > 0.95 and figures[20.0]["caught, unseen"] > 0.95


def test_fit_is_a_minimum_of_the_stated_objective():
    rnd = random.Random(7)
    features = ["a", "b", "c", "muslims", "christians", "jews", "men"]
    rows = [(rnd.randrange(2), set(rnd.sample(features, rnd.randrange(5)))) for _ in range(80)]
    model = X.fit_weights(rows, features)
    w = np.array([*[model.weights[f] for f in features], model.intercept])
    x = np.array([[*[float(f in found) for f in features], 1.0] for _, found in rows])
    y = np.array([r[0] for r in rows])
    moved = np.array([[float(f in copy) - float(f in found) for f in features] + [0.0] for _, found in rows for copy in X.swaps(found)])

    def objective(w):
        z = x @ w
        return np.sum(np.log1p(np.exp(z)) - y * z) + X.RIDGE / 2 * np.sum(w[:-1] ** 2) + X.SWAP_PENALTY / 2 * len(rows) * np.mean((moved @ w) ** 2)

    best = objective(w)
    for i in range(len(w)):
        for h in (1e-3, -1e-3):
            assert objective(w + h * np.eye(len(w))[i]) >= best - 1e-9
