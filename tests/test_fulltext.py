"""Tokens, Boolean and ranked search, index maintenance."""

import math

import pytest

from siltstone.errors import InvalidInput
from siltstone.functions.bm25 import Bm25Config
from siltstone.functions.text import query_terms, tokens
from siltstone.operators import fulltext as ft


def docs(spark, **texts):
    return spark.createDataFrame(list(texts.items()) or [], "doc_id string, document string")


def ranked(spark, texts, words, every=False, **kw):
    a = ft.rank_texts(docs(spark, **texts), words, every=every, **kw).collect()
    b = ft.search_ranked(ft.build(docs(spark, **texts)), words, every=every, **kw).collect()
    assert [(r["doc_id"], r["document"]) for r in a] == [(r["doc_id"], r["document"]) for r in b]
    assert all(math.isclose(x["score"], y["score"], rel_tol=1e-12) for x, y in zip(a, b))
    return [(r["doc_id"], r["score"]) for r in a]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Straße 7_b, ŁÓDŹ; 港口 łódź", ["straße", "7", "b", "łódź", "港口", "łódź"]),
        ("ΟΔΟΣ ΣΑΣ", ["οδοσ", "σασ"]),
        ("İstanbul", ["i̇stanbul"]),
        ("½ Ⅷ ²", ["½", "ⅷ", "²"]),
        ("école", ["e", "cole"]),
        ("", []),
        ("!!!", []),
        (None, None),
    ],
)
def test_tokens(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tokens("t").alias("x")).first()["x"] == want


def test_query_terms(spark):
    assert query_terms(spark, ["b A", "a!", "c"]) == ["a", "b", "c"]


def test_boolean(spark):
    texts = {"n3": "tin copper", "n1": "tin zinc lead", "n2": "copper zinc"}
    for run in (lambda **k: ft.search_texts(docs(spark, **texts), **k), lambda **k: ft.search(ft.build(docs(spark, **texts)), **k)):
        ids = lambda words, every, limit=None: [r["doc_id"] for r in run(words=words, every=every, limit=limit).collect()]  # noqa: B023, E731
        assert ids(["tin", "copper"], True) == ["n3"]
        assert ids(["zinc", "tin", "zinc"], False, 2) == ["n1", "n2"]
        assert ids(["lead"], False, 0) == []
        assert ids(["Zinc COPPER"], True) == ["n2"]
        assert ids(["gold"], False, 5) == [] and ids(["gold", "tin"], True) == []


def test_refusals_come_in_order(spark):
    d = docs(spark, a="x")
    with pytest.raises(InvalidInput, match="1000"):
        ft.search_texts(d, [], every=True, limit=1001)
    with pytest.raises(InvalidInput, match="no term"):
        ft.search_texts(d, ["!!!"], every=True, limit=0)
    with pytest.raises(InvalidInput, match="32"):
        ft.search_texts(d, [str(i) for i in range(33)], every=False, limit=0)


def brute(texts, words, every=False, k1=1.2, b=0.75):
    """Scores by the formula, straight from word lists."""
    bags = {i: t.lower().split() for i, t in texts.items()}
    terms = sorted({w.lower() for w in words})
    n, avg = len(bags), sum(map(len, bags.values())) / len(bags)
    out = {}
    for i, bag in bags.items():
        have = [t for t in terms if t in bag]
        if len(have) >= (len(terms) if every else 1):
            total = 0.0
            for t in have:
                df = sum(t in other for other in bags.values())
                part = (1 - b + b * len(bag) / avg) * k1
                total += math.log((n + 1) / (df + 0.5)) * bag.count(t) * (k1 + 1) / (bag.count(t) + part)
            out[i] = total
    return sorted(out.items(), key=lambda x: (-round(x[1], 12), x[0]))


def test_formula_and_ties(spark):
    texts = {
        "q7": "gull gull tern gull", "q2": "tern gull", "q1": "gull tern", "q9": "tern tern heron stork crane",
        "q4": "heron", "q5": "stork gull heron heron crane crane crane",
    }
    for words, every in ((["gull"], False), (["tern", "gull", "TERN"], False), (["gull", "tern"], True), (["heron", "crane"], False)):
        got, want = ranked(spark, texts, words, every), brute(texts, words, every)
        assert [i for i, _ in got] == [i for i, _ in want]
        assert all(math.isclose(x[1], y[1], rel_tol=1e-12) for x, y in zip(got, want))
        assert ranked(spark, texts, words, every, limit=2) == got[:2]
    top = [i for i, _ in ranked(spark, texts, ["gull", "tern"])]
    assert top.index("q1") + 1 == top.index("q2")  # equal scores, the smaller id first


@pytest.mark.parametrize("k1", [math.ulp(0.0), 2.0**-1022, 1e300, math.nextafter(math.inf, 0)])
def test_extreme_k1(spark, k1):
    """Scores stay finite: at the smallest k1 a term counts once, at the largest its share of the length."""
    texts = {"brief": "oar oar", "wordy": "oar mast mast keel keel keel"}
    got = dict(ranked(spark, texts, ["oar"], config=Bm25Config(k1, 1.0)))
    idf = math.log(3 / 2.5)
    want = {"brief": idf, "wordy": idf} if k1 < 1 else {"brief": idf * 2 / (2 / 4), "wordy": idf / (6 / 4)}
    assert all(math.isclose(got[i], w, rel_tol=1e-12) for i, w in want.items())


def test_empty_corpora(spark):
    assert ranked(spark, {}, ["a"]) == []
    assert ranked(spark, {"x": "!!!"}, ["a"]) == []


def test_zero_token_documents_count(spark):
    """Texts without a term make the others longer than the mean and each term rarer."""
    texts = {"rope": "knot knot", "net": "knot float", "none": "?", "dash": "--"}
    got = dict(ranked(spark, texts, ["Knot", "KNOT"]))
    length = 0.25 + 0.75 * 2 / (4 / 4)
    assert math.isclose(got["net"], math.log(5 / 2.5) * 2.2 / (1 + 1.2 * length), rel_tol=1e-12)
    assert set(got) == {"rope", "net"}


@pytest.mark.parametrize("k1,b", [(math.nan, 0.5), (math.inf, 0.5), (0, 0.5), (1.2, math.nan), (1.2, -0.1), (1.2, 1.1)])
def test_bad_settings(k1, b):
    with pytest.raises(InvalidInput):
        Bm25Config(k1, b)


def test_delta_equals_rebuild(spark):
    index = ft.build(docs(spark, m1="fog fog bank", m2="fog bank", m3="bank shoal"))
    changes = spark.createDataFrame(
        [(1, "m1", "reef"), (2, "m1", "fog bank bank bank"), (3, "m3", None), (4, "m8", "--"), (5, "m9", None)],
        "pos int, doc_id string, document string",
    )
    after = ft.apply_delta(index, changes)
    assert ft.violations(after).count() == 0
    assert after.statistics.first().asDict() == {"n": 3, "total": 6}
    assert {r["term"]: r["delta"] for r in ft.frequency_delta(index, changes).collect()} == {"bank": -1, "shoal": -1}
    assert ft.violations(ft.Index(after.documents, index.lengths, after.postings)).count() > 0


def test_batches():
    assert ft.checked_documents([("a", b"1"), ("b", b"2"), ("a", b"3")]) == [("a", "3"), ("b", "2")]
    for bad in ([("a", b"")] * 257, [("a", b"x" * (4 << 20))], [("a", b"ok"), ("b", b"\xff")], [("", b"x")]):
        with pytest.raises(InvalidInput):
            ft.checked_documents(bad)
    assert ft.checked_documents([]) == []


def test_saved_index_answers_alike(spark, tmp_path):
    texts = {"p": "kelp kelp sand", "q": "kelp sand", "r": "...", "s": "sand dune"}
    index = ft.build(docs(spark, **texts))
    ft.save(index, str(tmp_path / "i"))
    loaded = ft.load(spark, str(tmp_path / "i"))
    assert ft.violations(loaded).count() == 0
    for every in (True, False):
        want = ft.search_ranked(index, ["kelp", "sand"], every=every, limit=10).collect()
        assert ft.search_ranked(loaded, ["kelp", "sand"], every=every, limit=10).collect() == want
        assert ft.search(loaded, ["kelp sand"], every=every).collect() == ft.search(index, ["kelp sand"], every=every).collect()


def test_a_hit_without_document_fails(spark):
    index = ft.build(docs(spark, a="kelp", b="kelp sand"))
    broken = ft.Index(index.documents.where("doc_id <> 'a'"), index.lengths, index.postings)
    for limit in (None, 5):
        for run in (ft.search, ft.search_ranked):
            with pytest.raises(Exception, match="no document: a"):
                run(broken, ["kelp"], every=False, limit=limit).collect()
