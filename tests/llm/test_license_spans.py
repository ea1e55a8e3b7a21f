import duckdb
import pytest

from tallyframe.llm import license_scan as L

FOLDER = "/root/testdata/sf0.01"
MIT = L.TEMPLATES[0][0].split()


def labels(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.labels, r.score) for r in L.scan_licenses(docs).orderBy("doc_id").collect()]


def test_spans_are_verified(spark):
    texts = [
        "all rights all rights", "rights reserved rights reserved", "creative commons creative commons", "All rights reserved.",
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0.", " ".join(MIT[:2] * 20),
        " ".join(MIT), " ".join([*MIT[:6], "new", *MIT[6:]]), " ".join(MIT[:9]), " ".join(reversed(MIT)), "x " * 3000 + " ".join(MIT),
    ]
    got = labels(spark, texts)
    assert [x[0] for x in got] == ["", "", "", "reserved", "cc-by-nc", "cc-by-sa", "cc-by", "", "mit", "mit", "", "", "mit"]
    assert all(0 <= x[1] <= 1 for x in got) and got[8][1] == 1.0 and 0.6 <= got[9][1] < 1


def brute(text):
    """Labels by windows over all places of the text."""
    import re

    ws = re.findall(L.WORD, "".join(c.lower() if c.isascii() else c for c in text or ""))
    found = set()
    for words, label in [*L.PHRASES, *L.TEMPLATES]:
        t = words.split()
        grams = len(t) - 1
        hits = [(p, o) for p in range(len(ws) - 1) for o in range(grams) if ws[p : p + 2] == t[o : o + 2]]
        if grams < L.SHORT:
            good = any(ws[p : p + len(t)] == t for p in range(len(ws)))
        else:
            good = False
            for anchor in {p - o - k for p, o in hits for k in range(L.MAX_SHIFT + 1)}:
                near = [(p, o) for p, o in hits if anchor <= p - o <= anchor + L.MAX_SHIFT]
                good |= min(len({o for _, o in near}), max(p for p, _ in near) - min(p for p, _ in near) + 1) >= L.MIN_SHARE * grams
        found |= {label} if good else set()
    return ",".join(sorted(found))


def test_labels_equal_brute_force_and_sql(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in L.scan_licenses(docs).drop("spans").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(L.ORACLE_SQL).fetchall()
    assert len(want) == len(rows) and all(tuple(rows[w[0]]) == pytest.approx(w) for w in want)
    some = docs.orderBy("doc_id").limit(200).collect() + docs.where("text ilike '%license%' or text ilike '%reserved%'").limit(60).collect()
    assert all(rows[r.doc_id].labels == brute(r.text) for r in some)


def test_long_template_is_refused(spark):
    with pytest.raises(ValueError, match="more than 64 words"):
        L.template_grams(spark, [("w " * 70, "x")])
