import re
from collections import Counter

import numpy as np

import corpus_pipeline
from tallyframe.llm import near_copies as N
from tallyframe.llm.common import table

FOLDER = "/root/testdata/sf0.01"


def brute_similar(texts, least=0.8):
    """Root of each text: all pairs of sets of five words are compared by an inverted index over every shingle."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for t in texts]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {""} for w in words]
    holders, root = {}, list(range(len(texts)))
    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in holders.get(s, ()))
        for j, n in shared.items():
            if root[i] != root[j] and n >= least * (len(own) + len(sets[j]) - n):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
        for s in own:
            holders.setdefault(s, []).append(i)
    return root


def edited(seed=4, copies=150, words=120):
    """A dense group of copies with one to eight changed words."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(400, size=words)]
    for k in range(copies):
        ws = list(base)
        for at in rng.choice(words, 1 + k % 8, replace=False):
            ws[at] = f"z{k}"
        yield " ".join(ws)


def classes(spark, texts):
    rows = N.numbered(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    nodes, labels = N.text_classes(rows)
    of = {(r.u, r.v): r.n for r in nodes.collect()}
    roots = {r.n: r.root for r in labels.collect()}
    return [roots.get(n, n) for r in rows.orderBy("i").collect() for n in [of[r.u, r.v]]]


def test_classes_equal_all_pairs(spark):
    docs = table(spark, FOLDER, "documents").orderBy("doc_id").select("text").collect()
    texts = [r.text for r in docs] + list(edited()) + [None, "", " \t", "a b", "b a", "A b", "w " * 50_000]
    want, got = brute_similar(texts), classes(spark, texts)
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))
    assert len(set(want)) < len(set(texts)) - 10


def test_pivot_table_never_discards_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(1 << 63, size=rng.integers(1, 400), dtype=np.uint64)
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(1 << 63, size=rng.integers(0, 60), dtype=np.uint64)]))
        a = np.unique(a)
        table = [np.frombuffer(N.slice_counts(x), dtype=np.uint8).astype(int) for x in (a, b)]
        assert np.abs(table[0] - table[1]).sum() <= len(np.setxor1d(a, b))
        if len(b) and N.similarity(a, b) >= 0.8:
            zeros = np.zeros(N.ORDER_CELLS, dtype=np.int64)
            assert set(N.prefix(a, zeros, 0.8).tolist()) & set(N.prefix(b, zeros, 0.8).tolist())


def test_full_bit_table_gives_the_same_classes(spark, monkeypatch):
    monkeypatch.setattr(N, "PICK_BITS", 1 << 15)
    texts = list(edited(copies=60)) + [None, "", "a b c d e f"]
    want, got = brute_similar(texts), classes(spark, texts)
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_empty(spark):
    assert classes(spark, []) == []


def test_one_row_of_each_class_stays(spark):
    words = [f"w{k}" for k in range(80)]
    text, near, other, third = " ".join(words), " ".join(words[:-1] + ["x"]), "some other text of six words", "and a third one that is alone"
    rows = [
        (1, text, "en"), (2, near, "en"), (None, text, "en"), (None, near, None), (3, other, "b"), (3, other, "a"), (3, other, "a"), (3, near, "en"),
        (None, third, None), (None, third, "en"), (None, None, None), (9, "", "en"),
    ]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.dedup_stage(spark, docs, "")
    assert out.columns == list(corpus_pipeline.DOCUMENT_COLUMNS)
    assert sorted((r.doc_id or 0, r.text, r.lang or "") for r in out.collect()) == [(0, third, ""), (1, text, "en"), (3, other, "a"), (9, "", "en")]
    assert corpus_pipeline.dedup_stage(spark, docs.where("false"), "").count() == 0


def test_dedup_stage_links_by_simhash(spark):
    """Fingerprints count repeats: texts may link by them whose sets of shingles are not alike."""
    line = " ".join(f"w{k}" for k in range(10))
    a, b = (" ".join([line] * 50 + [f"{end}{k}" for k in range(6)]) for end in "xy")
    sets = [N.shingle_hashes(t.encode()) for t in (a, b)]
    assert N.similarity(*sets) < 0.8 and ((N.fingerprint(a.encode()) ^ N.fingerprint(b.encode())) % (1 << 64)).bit_count() <= N.RADIUS
    chain = " ".join([line] * 50 + [f"x{k}" for k in range(5)] + ["z"])  # alike with a by sets, too
    docs = spark.createDataFrame([(3, a, "en", "s", 1), (2, b, "en", "s", 1), (5, chain, "en", "s", 1), (4, "a text of its own", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()) == [2, 4]


def test_dedup_stage_joins_simhash_and_set_classes(spark):
    """The classes kept one row of are those of both kinds of links together."""
    docs = table(spark, FOLDER, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    rows = docs.orderBy("doc_id").collect()
    texts = [r.text for r in rows]
    root = brute_similar(texts)
    prints = [N.fingerprint((t or "").encode()) % (1 << 64) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and (prints[i] ^ prints[j]).bit_count() <= N.RADIUS:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    want = {}
    for r, of in zip(rows, root, strict=True):
        want.setdefault(of, r.doc_id)
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()) == sorted(want.values())
