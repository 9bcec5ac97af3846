"""Term counts and term weights, against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from siltstone.llm import distinct_terms, terms

WORDS = ["Ab", "cd", "é", "x", "漢", "Σας", "the", "THE", "of"]


def toks(text):
    return [w.replace("Σ", "σ").lower() for w in re.findall(r"[^\W_]+", text)]


def hits(seed, n=200):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "...", " ".join(rng.choice(WORDS) + rng.choice(["", ",", "_7"]) for _ in range(rng.randrange(12)))])
        rows.append((i, f"d{i % 60}" if i % 17 else None, text, rng.randrange(1, 7), "q"))
    by_id = {r[1]: r[2] for r in rows if r[1] and r[2] is not None}
    return [(a, i, by_id.get(i) if t is not None else None, c, q) for a, i, t, c, q in rows]


SCHEMA = "hit_no int, id string, document string, config_id int, term string"


def collection(rows):
    return {r[1]: r[2] for r in rows if r[1] is not None and r[2] is not None}


def test_term_marks(spark):
    rows = hits(1)
    docs = collection(rows)
    tf, df = Counter(), Counter()
    for t in docs.values():
        tf.update(toks(t))
        df.update(set(toks(t)))
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in terms.term_marks(spark.createDataFrame(rows, SCHEMA)).collect()}
    mark = lambda n: "rare" if n <= 2 else "common" if n * 5 > len(docs) * 2 else None
    assert got == {t: (tf[t], df[t], mark(df[t])) for t in tf}


def test_runs_over_batches_and_partitions(spark):
    pairs = [("t%02d" % (i % 9), 1 + i % 3) for i in range(100)]
    pairs.sort()
    batches = [pa.RecordBatch.from_pydict({"term": [p[0] for p in pairs[i : i + 7]], "tf": [p[1] for p in pairs[i : i + 7]]}) for i in range(0, 100, 7)]
    out = [r for b in terms.run_lengths(iter([*batches, batches[0].slice(0, 0)])) for r in b.to_pylist()]
    want = Counter()
    for t, n in pairs:
        want[t] += n
    assert {r["term"]: r["occurrences"] for r in out} == want and len(out) == 9
    df = spark.createDataFrame([("d%d" % i, "same", 2) for i in range(300)] + [("d1", "other", 1)], "id string, term string, tf long")
    got = {r["term"]: (r["occurrences"], r["records"]) for r in terms.term_counts(df, 7).collect()}
    assert got == {"same": (600, 300), "other": (1, 1)}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert terms.term_marks(none).count() == 0
    configs = spark.createDataFrame([], "config_id int, k1 double, b double")
    assert distinct_terms.top_terms(none, configs).count() == 0
    assert distinct_terms.top_terms(none).count() == 0


def test_long_text(spark):
    df = spark.createDataFrame([(1, "a", "w " * 200_000 + "v", 1, "")], SCHEMA)
    got = {r["term"]: r["occurrences"] for r in terms.term_marks(df).collect()}
    assert got == {"w": 200_000, "v": 1}


def test_bm25_places(spark, monkeypatch):
    monkeypatch.setattr(distinct_terms, "HEAVY_TERMS", 3)
    rows = hits(2)
    docs = collection(rows)
    settings = {1: (1.2, 0.75), 2: (0.5, 0.0), 3: (2.0, 1.0), 4: (0.0, 0.5), 5: (math.nan, 0.5), 6: (1.0, None)}
    configs = spark.createDataFrame([(k, *v) for k, v in settings.items()], "config_id int, k1 double, b double")
    got = sorted((r["id"], r["config_id"], r["place"], r["term"]) for r in distinct_terms.top_terms(spark.createDataFrame(rows, SCHEMA), configs).collect())
    n, total = len(docs), sum(len(toks(t)) for t in docs.values())
    df = Counter(w for t in docs.values() for w in set(toks(t)))
    want = []
    for i, c in {(r[1], r[3]) for r in rows if r[1] in docs}:
        if c not in (1, 2, 3):
            continue
        k1, b = settings[c]
        tf, dl = Counter(toks(docs[i])), len(toks(docs[i]))
        def weight(w):
            idf, lf = math.log(n + 1.0) - math.log(df[w] + 0.5), (1 - b) + b * (dl / (total / n))
            if k1 <= 1:
                return idf * (tf[w] * (1 + k1)) / (tf[w] + k1 * lf)
            return idf * (tf[w] * (1 + 1 / k1)) / (tf[w] * (1 / k1) + lf)
        best = sorted(tf, key=lambda w: (-weight(w), w.encode()))[:3]
        want += [(i, c, p, w) for p, w in enumerate(best, 1)]
    assert got == sorted(want)


def test_graph_degrees(spark):
    rows = hits(3)
    docs = collection(rows)
    frame = spark.createDataFrame(list(docs.items()), "id string, document string")
    got = {(r["id"], r["term"]): (r["tf"], r["degree"]) for r in distinct_terms.graph_of_words(frame, 3).collect()}
    want = {}
    for i, t in docs.items():
        ws, near = toks(t), defaultdict(set)
        for a in range(len(ws)):
            for b in range(max(0, a - 2), min(len(ws), a + 3)):
                near[ws[a]] |= {ws[b]} - {ws[a]}
        want |= {(i, w): (ws.count(w), len(near[w])) for w in ws}
    assert got == want


def test_graph_of_a_long_record(spark):
    """100,000 tokens: time and space grow with the length, not with its square."""
    import time

    text = " ".join(f"w{i * i % 5003}" for i in range(100_000))
    frame = spark.createDataFrame([("a", text), ("b", "one"), ("c", "--")], "id string, document string")
    began = time.time()
    rows = {(r["id"], r["term"]): r for r in distinct_terms.graph_of_words(frame).collect()}
    assert time.time() - began < 60
    assert (rows["b", "one"]["tf"], rows["b", "one"]["degree"]) == (1, 0)
    assert sum(r["tf"] for (i, _), r in rows.items() if i == "a") == 100_000 == rows["a", "w1"]["dl"]


def test_terms_are_cut_once(spark, monkeypatch):
    """The pairs are written out before the range partitioner looks at them."""
    cuts = []
    inner = terms.with_tokens
    monkeypatch.setattr(terms, "with_tokens", lambda *a: (cuts.append(a), inner(*a))[1])
    plan = terms.term_marks(spark.createDataFrame(hits(4), SCHEMA))._jdf.queryExecution().toString()
    assert len(cuts) == 1 and "regexp_extract_all" not in plan
