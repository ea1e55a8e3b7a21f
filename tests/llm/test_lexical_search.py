"""Rankings by brute force: ties, nulls, repeated rows, several shards and blocks; how many documents are scored."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import lexical_search as S

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counts = [Counter(terms(t)) for _, t in docs]
    n_docs, tokens = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), c in zip(docs, counts, strict=True):
            m = 10 + 90 * sum(c.values()) * n_docs // max(1, tokens)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(seed, n=300, words=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É1", "ß", "a-b", "A", "x_y"]
    weight = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda top: " ".join(rnd.choices(vocabulary, weight, k=rnd.randrange(top)))
    docs = [(rnd.randrange(10**6), text(40)) for _ in range(n)]
    docs += [(7, None), (None, "w0 w1 w2 É1"), (None, "w0 w1 w2 É1"), (-5, "w0 w1 w2 É1"), (8, ""), (9, "w3 " * 5000), *docs[:15], *[(i, docs[0][1]) for i in range(30)]]
    return docs, [(i % 9, text(25)) for i in range(12)] + [(None, "w1 W1 w5"), (50, None), (51, "nowhere to be found"), (52, "w0")]


@pytest.mark.parametrize(("shard", "block"), [(4096, 1 << 18), (37, 20)])
def test_equals_brute_force(spark, monkeypatch, shard, block):
    docs, items = corpus(1)
    monkeypatch.setattr(S, "SHARD_DOCS", shard)
    found = S.lexical_top_k(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), block_pairs=block)
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)


def one_shard(docs):
    return S.pack_shard([(i, len(S.terms_of(t)), dict(Counter(S.terms_of(t)))) for i, t in docs])


def searched(docs, items, shard_docs, k=10):
    """Search of local shards with carried thresholds, and documents scored."""
    n_docs, tokens = sum(bool(terms(t)) for _, t in docs), sum(len(terms(t)) for _, t in docs)
    df = Counter(t for _, text in docs for t in set(terms(text)))
    number = {t: i for i, t in enumerate(dict.fromkeys(t for _, text in items for t in terms(text) if t in df))}
    own = [[t for t in dict.fromkeys(terms(text)) if t in df] for _, text in items]
    w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
    block = S.Block(np.arange(len(items)), [i for i, _ in items], number, [np.array([number[t] for t in x], dtype=np.int64) for x in own], [np.array([w(t) for t in x], dtype=np.int64) for x in own])
    least, out, scored = np.ones(len(items), dtype=np.int64), [[] for _ in items], 0
    for low in range(0, len(docs), shard_docs):
        row = one_shard(docs[low : low + shard_docs])
        shard = S.open_shard(type("Row", (), row), n_docs, tokens)
        hits, n = S.search_shard(shard, row["terms"], block, least, k)
        scored += n
        for i, doc, score in hits:
            for a, d, s in zip(i, doc, score, strict=True):
                out[a].append((-s, shard.no_id[d], shard.ids[d]))
    ranked = [(items[a][0], r + 1, None if none else int(d), -int(s)) for a, rows in enumerate(out) for r, (s, none, d) in enumerate(sorted(rows)[:k])]
    return sorted(ranked, key=str), scored


@pytest.mark.parametrize("shard_docs", [1, 10, 1000])
@pytest.mark.parametrize("seed", range(4))
def test_shards_of_any_size_agree(seed, shard_docs):
    docs, items = corpus(seed + 10)
    assert searched(docs, items, shard_docs)[0] == brute(docs, items)


def test_documents_that_cannot_beat_the_threshold_are_skipped():
    rnd = random.Random(5)
    common, rare = [f"c{i}" for i in range(10)], [f"r{i}" for i in range(3000)]
    docs = [(i, " ".join(rnd.choices(common, k=20) + rnd.choices(rare, k=20))) for i in range(4000)]
    items = [(i, " ".join(rnd.sample(common, 5) + docs[i * 7][1].split()[20:])) for i in range(20)]
    found, scored = searched(docs, items, 4096)
    assert found == brute(docs, items)
    with_term = sum(bool(set(terms(x)) & set(terms(t))) for _, x in items for _, t in docs)
    assert scored < 0.1 * with_term


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert S.lexical_top_k(docs.limit(0), items).count() == 0
    assert S.lexical_top_k(docs, items.limit(0)).count() == 0
    assert S.lexical_top_k(docs.withColumnRenamed("doc_id", "u").withColumnsRenamed({"text": "item"}), items, id="u", text="item").columns == ["item_id", "rank", "u", "score"]
