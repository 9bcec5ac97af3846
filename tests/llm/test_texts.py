"""Token ids, leaked passages and sentences."""

import os
import random
from itertools import accumulate

import pytest

from siltstone.llm import encoding, leakage, sentence_model, sentences
from siltstone.llm.sentence_sites import sites, sites_and_gaps, spans, CLOSING_OF

needs_vocabulary = pytest.mark.skipif(
    not os.path.exists(f"{encoding.VOCABULARIES}/{encoding.DEFAULT}.tiktoken"), reason="no vocabularies"
)
PARTS = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "​", "'s", "'LL", "a", "é", "ß", "1", "½", "漢", "<|endoftext|>",
         "😀", "́", "ก", "้", ".", "-", "_", "\x00", "Zug", "the", "ning"]


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(16))) for _ in range(n)]


@needs_vocabulary
def test_ids_equal_the_public_tokenizer():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{encoding.VOCABULARIES}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    texts = random_texts(1, 3000)
    bpe = encoding.ByteBpe()
    got = bpe.encode(texts)
    assert got == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]
    assert [bpe.decode(i) for i in got] == texts


@needs_vocabulary
def test_other_vocabulary_equals_tiktoken():
    import tiktoken

    bpe = encoding.ByteBpe("byte_bpe_multi_50k")
    ranks = {p: i for i, p in enumerate(bpe.ranks)}
    other = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = random_texts(2, 2000)
    assert bpe.encode(texts) == [other.encode_ordinary(t) for t in texts]


@needs_vocabulary
def test_encode_texts(spark, monkeypatch):
    monkeypatch.setattr(encoding, "CACHE_ENTRIES", 5)
    long = "word" * 30_000
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "a"), (4, long)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, ids int")
    got = encoding.encode_texts(df)
    ids = [(r["doc_id"], r["ids"]) for r in got.collect()]
    assert len(ids) == 6 and [i for d, i in ids if d in (1, 2)] == [[], []]
    assert sorted(t["text"] for t in encoding.decode_ids(got).collect()) == sorted(t or "" for _, t in rows)
    assert encoding.encode_texts(df.limit(0)).count() == 0


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def runs(a, b):
    """Longest run of equal words."""
    best, prev = 0, {}
    for w in a:
        cur = {j: prev.get(j - 1, 0) + 1 for j, x in enumerate(b) if x == w}
        best, prev = max([best, *cur.values()]), cur
    return best


@pytest.mark.parametrize("broadcast", [True, False])
def test_leaks_against_brute_force(spark, broadcast):
    rng = random.Random(4)
    words = PASSAGE.split()
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([5, 12, 20, 30])))) for i in range(30)]
    items += [(100, PASSAGE), (101, PASSAGE), (102, None), (103, ""), (None, PASSAGE)]
    docs = [(1, None), (2, "")]
    for d in range(3, 60):
        text = [rng.choice(words) for _ in range(rng.randrange(20))]
        source = rng.choice(items)[1] or ""
        cut = source.split()
        k = rng.randrange(1, 20)
        docs.append((d, " ".join(text + cut[:k] + text)))
    docs.append((60, ("filler " * 50_000) + PASSAGE))
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, gram string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = {tuple(r) for r in leakage.leaked(df, it, broadcast=broadcast).collect()}
    cutter = leakage.Words()
    want = {(d, i) for d, t in docs if d != 60 for i, x in items if i is not None and runs(cutter(t)[0], cutter(x)[0]) >= 12}
    assert {g for g in got if g[0] != 60} == want
    assert {(60, 100), (60, 101)} <= got
    assert leakage.leaked(df.limit(0), it).count() == 0 and leakage.leaked(df, it.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        PASSAGE.upper(),
        PASSAGE.replace(" ", ",\n \t"),
        PASSAGE.replace("alpha", "álphà").replace("beta", "béta"),
        PASSAGE.replace("gamma", "gam­ma").replace("delta", "d​el⁠ta﻿"),
        PASSAGE.replace("epsilon", "epsi-\nlon").replace("kappa", "kap‐ \r\n  pa"),
        "(" + PASSAGE.replace(" ", "—") + ")",
    ],
)
def test_what_makes_no_difference(text):
    items = leakage.ItemSet([(1, PASSAGE)], 12)
    forms, places = leakage.Words()("before " + text + " after")
    assert len(items.hits(forms)) == 4 and items.items_of(items.hits(forms)) == [1]
    assert leakage.without("before " + text + " after", places, items.hits(forms), 12).split() in (["before", "after"], ["before", "(", ")", "after"], ["before", "()", "after"])


@pytest.mark.parametrize("end", ["\u00ad\n", "\u200b\u00ad\r\n ", "\u00ad\u00ad \u2028", "\u00ad\ufeff\t\n\n"])
def test_a_soft_hyphen_at_a_line_end_parts_no_word(end):
    """Also in linear time where long runs of soft hyphens end no line."""
    import time

    cut = leakage.Words()
    assert cut(f"the parlia{end}ment sat")[0] == ["the", "parliament", "sat"]
    assert leakage.ItemSet([(1, PASSAGE)], 12).hits(cut(PASSAGE.replace("epsilon", f"epsi{end}lon"))[0])
    assert cut(f"a{end}5 x\u00ady z\u00ad w")[0] == ["a", "5", "xy", "z", "w"]
    began = time.time()
    assert cut("a" + "\u00ad" * 200_000 + " b")[0] == ["a", "b"]
    assert time.time() - began < 5


def test_twelve_words_are_needed():
    items, cut = leakage.ItemSet([(1, PASSAGE)], 12), leakage.Words()
    assert items.hits(cut(" ".join(PASSAGE.split()[:12]))[0]) and not items.hits(cut(" ".join(PASSAGE.split()[:11]))[0])
    assert cut("well- known a-b x-\n5")[0] == ["well", "known", "a", "b", "x", "5"]


def test_an_ngram_of_many_items_is_kept_once():
    items = leakage.ItemSet([(i, PASSAGE if i % 2 else PASSAGE + " more words") for i in range(2_000)], 12)
    assert len(items.hashes) == 6 and len(items.members) == 4 * 2_000 + 2 * 1_000
    hits = items.hits(leakage.Words()(PASSAGE)[0])
    assert len(hits) == 4 and items.items_of(hits) == list(range(2_000))
    assert items.items_of({}) == []


def test_cleaned(spark):
    docs = spark.createDataFrame([(1, f"Before. {PASSAGE} After."), (2, None), (3, "clean")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, PASSAGE)], "item_id bigint, text string")
    got = {r["doc_id"]: (r["items"], r["clean_text"]) for r in leakage.cleaned(docs, items).collect()}
    assert got == {1: ([7], "Before.  After."), 2: ([], None), 3: ([], "clean")}


def test_cleaned_beyond_the_broadcast(spark, monkeypatch):
    """Items too many to be broadcast are cut out by a join, with the same result."""
    rng = random.Random(8)
    words = PASSAGE.split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([5, 12, 20, 30]))) for _ in range(20)]
    items = [*enumerate(texts), (100, PASSAGE), (101, PASSAGE), (102, None), (None, "no " * 20)]
    docs = [(1, None), (2, ""), (None, f"A. {PASSAGE}"), (None, f"B. {PASSAGE}"), (3, f"C. {PASSAGE} D."), (3, "clean")]
    docs += [(d, f"Start, {rng.choice(texts).upper()}; middle. {PASSAGE}, {rng.choice(texts)} End.") for d in range(4, 40)]
    docs += [(50, "filler " * 6_000 + PASSAGE + " end" + " no" * 20)]
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, gram string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    rows = lambda f: sorted((tuple(r) for r in f.collect()), key=str)
    want = rows(leakage.cleaned(df, it))
    assert len(want) == len(docs) and sum(len(r[1]) > 1 for r in want) > 30
    monkeypatch.setattr(leakage, "MAX_GRAMS", 3)
    assert rows(leakage.cleaned(df, it)) == want
    assert leakage.cleaned(df.limit(0), it).count() == 0
    assert rows(leakage.cleaned(df, it.limit(0), broadcast=False)) == sorted([(d, [], t) for d, t in docs], key=str)


# sentences

TRAINING = (
    ["The bridge was closed. The boats waited for Dr. Halvorn until 4 p.m. The House rose. Why? Order! Mrs. Delven agreed.",
     "We paid 3.5 million. The sum is small.\nThe road is 12.4 km long. Nobody spoke. Is it so? The member sat down."] * 30
    + ["Am 7. Januar kam Herr Dr. Solm. Die Werft ist leer. Das Gesetz Nr. 7 gilt. Wir stimmen zu.\nDie 2. Lesung folgt. Nein!"] * 30
    + ["这不对！谁来付钱？他说：“太晚了。我反对。”请看第7条。这个……我们再考虑。"] * 20
)


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(t, 1) for t in [*TRAINING, None, ""]], "text string, last int")
    return sentences.train(df)


def cut(model, text):
    return [text[a:b] for a, b in sentences.units(text, model)]


@pytest.mark.parametrize(
    "parts",
    [
        ["The boats waited for Dr. Halvorn until 4 p.m.", "The House rose."],
        ["We paid 3.5 million.", "The sum is small."],
        ["The House rose.", "(Laughter)", "The member sat down."],
        ["The bridge (Laughter) was closed.", "Nobody spoke."],
        ["He said: “The road is long. It is closed.”", "Nobody spoke."],
        ["“Why? It is closed,” said Mrs. Delven.", "Nobody spoke."],
        ["The Chair: Order!", "Why?"],
        ["这不对！", "他说：“太晚了。我反对。”", "谁来付钱？", "（掌声）", "请看第7条。"],
        ["这个……我们再考虑。", "这不对！"],
        ["Am 7. Januar kam Herr Dr. Solm.", "Die 2. Lesung folgt."],
        ["Ποιος θα πληρώσει;", "Δεν συμφωνούμε· όχι."],
        ["पैसा कौन देगा?", "यह सही नहीं है।"],
    ],
)
def test_units(model, parts):
    joined = " ".join(parts) if parts[0].isascii() or parts[0][0] not in "这" else "".join(parts)
    if parts[0][0] == "Π":
        joined = " ".join(parts)
    assert cut(model, joined) == parts


def test_lines(model):
    assert cut(model, "AGENDA ITEM 3\nThe bridge was closed. The\nroad is long.") == ["AGENDA ITEM 3", "The bridge was closed.", "The\nroad is long."]
    assert cut(model, "[Corrected reissue]\nThe House rose.") == ["[Corrected reissue]", "The House rose."]
    assert cut(model, "The House rose. The member—\nThe bridge was closed.") == ["The House rose.", "The member—", "The bridge was closed."]
    assert cut(model, "The House rose.The member sat down.") == ["The House rose.", "The member sat down."]


def test_thai(model):
    assert cut(model, "ใครจะเป็นผู้จ่ายเงิน ชาวประมง 24 คนรอคำตอบ\nประธาน: เราไม่เห็นด้วย (เสียงปรบมือ) ผมขอขอบคุณ") == [
        "ใครจะเป็นผู้จ่ายเงิน", "ชาวประมง 24 คนรอคำตอบ", "ประธาน: เราไม่เห็นด้วย", "(เสียงปรบมือ)", "ผมขอขอบคุณ",
    ]


@pytest.mark.parametrize("text", [None, "", "   ", "\n \n"])
def test_blank(model, text):
    assert sentences.units(text, model) == []


def test_every_character_lies_in_one_unit(model):
    rng = random.Random(6)
    pieces = ["The", "Dr.", " ", "\n", "(", ")", "“", "”", "«", "»", "...", "…", "?", "。", "「", "」", "3.5", "ก", "—", "[", "]", '"', ";", ".", "X"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        covered, last = set(), 0
        for a, b in sentences.units(text, model):
            assert last <= a < b and text[a:b] == text[a:b].strip()
            covered |= set(range(a, b))
            last = b
        assert all(i in covered for i, c in enumerate(text) if not c.isspace())


def test_long_texts_take_linear_time(model):
    import time

    for base in ["He said “No. So.” and left. (Oh) ", "((((“““ ", "x.y.z ", "Dr. ", "\n\n", '"a." ']:
        text = base * (300_000 // len(base))
        began = time.time()
        sentences.units(text, model)
        assert time.time() - began < 20


def test_split_sentences(spark, model):
    rows = [(1, "Why? Order!"), (2, None), (3, "  "), (None, "Why?"), (4, "Why?"), (4, "Why?")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, sent_no int")
    got = sorted(map(tuple, sentences.split_sentences(df, model).collect()), key=str)
    assert got == sorted([(1, 1, 0, 4), (1, 2, 5, 11), (None, 1, 0, 4), (4, 1, 0, 4), (4, 1, 0, 4)], key=str)
    empty = df.limit(0)
    assert sentences.sentence_units(empty).count() == 0


def test_posteriors_follow_the_evidence():
    rows = [(("Dr", ".", False, "space", "<Xx>"), 300.0), (("closed", ".", False, "space", "The"), 300.0),
            (("closed", ".", False, "line", "The"), 60.0), (("open", ".", False, "space", "<xx>"), 40.0)]
    m = sentence_model.estimate(rows, {"Dr", "closed", "open"}, {"The"})
    assert m.posterior(rows[0][0]) < 0.2 and m.posterior(rows[1][0]) > 0.9 and m.posterior(rows[3][0]) < 0.5


def test_small_scripts_keep_their_evidence(spark, monkeypatch):
    """Next to a large script, rows of a small one are kept or made coarser, never left out."""
    rows = [("closed", ".", False, "space", "The", 3_000_000), ("Dr", ".", False, "space", "Smith", 1_000_000)]
    rows += [("κ", ".", False, "space", "Σολμ", 12), ("τέλος", ".", False, "space", "Η", 12)]
    rows += [(f"λέξη{chr(945 + i)}", ".", False, "space", f"Λ{chr(945 + i)}", 1) for i in range(20)]
    rows += [("word" + chr(97 + i), "!", False, "space", "Next" + chr(97 + i), 1) for i in range(20)]
    rows += [("§", "!", True, "none", "~", 1)]
    schema = "last string, mark string, one boolean, gap string, next string, n long"
    monkeypatch.setattr(sentences, "counted_sites", lambda *_: spark.createDataFrame(rows, schema))
    seen = []
    estimate = sentence_model.estimate
    monkeypatch.setattr(sentence_model, "estimate", lambda kept, *known: (seen.extend(kept), estimate(kept, *known))[1])
    model = sentences.train(spark.createDataFrame([], "text string"))
    assert sum(n for _, n in seen) == sum(r[-1] for r in rows)
    kept = dict(seen)
    assert kept[("κ", ".", False, "space", "Σολμ")] == 12 and {"κ", "τέλος"} <= model.before
    assert kept[("<xx:greek>", ".", False, "space", "<Xx:greek>")] == 20
    assert kept[("<any>", "!", False, "space", "<any>")] == 20 and ("<any>", "!", True, "none", "<any>") in kept
    assert len(model.before) == 4


def test_text_without_marks(spark):
    """Gaps between plain words are events where no mark comes for long; how sentences begin decides them."""
    sentence = "We paid the harbour dues to nobody."
    other = ["They moved old boats along quiet canals.", "Nobody spoke for the small mills there."]
    rng = random.Random(2)
    texts = [" ".join(rng.choice([sentence, *other, "Why?", "We paid!", "They moved!", "Nobody spoke!"]) for _ in range(12)) for _ in range(300)]
    m = sentences.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    plain = [sentence[:-1], other[0][:-1]] * 12
    text = " ".join(plain)
    found = [s for s in sites(text)[0] if s.mark == " "]
    assert len(found) > 60 and all(s.settled is None for s in found)
    got = cut(m, text)
    assert sum(g in plain for g in got) > 18 and "".join(got).replace(" ", "") == text.replace(" ", "")
    assert not [s for s in sites(" ".join(plain[:6]))[0] if s.mark == " "]
    assert [s.mark for s in sites("港口的船" * 30 + " " + "这里的路" * 5)[0]] == [" "]


def test_gaps_of_short_stretches_are_decided_too(spark):
    """A sentence or two without marks, far fewer words than make a long stretch, are parted by the model."""
    latin = ["We paid the harbour dues to nobody.", "They moved old boats along quiet canals.", "Nobody spoke for the small mills there."]
    han = ["我们反对这个计划。", "他们没有付钱。", "港口的船已经走了。"]
    rng = random.Random(2)
    texts = [" ".join(rng.choice([*latin, "Why?", "We paid!", "They moved!", "Nobody spoke!"]) for _ in range(12)) for _ in range(300)]
    texts += ["".join(rng.choice([*han, "我们反对！", "他们付钱！", "港口！"]) for _ in range(12)) for _ in range(300)]
    texts += [f"议长 {rng.choice(han)}" for _ in range(60)]
    m = sentences.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    bare = [t[:-1] for t in latin]
    assert cut(m, " ".join(bare)) == bare
    assert cut(m, " ".join([bare[0], latin[1], bare[2]])) == [bare[0], latin[1], bare[2]]
    assert cut(m, f"“{bare[1]} {latin[0]}”") == [f"“{bare[1]}", f"{latin[0]}”"]
    assert cut(m, f"He said: “{bare[1]} {latin[0]}”") == [f"He said: “{bare[1]} {latin[0]}”"]
    assert cut(m, f"{bare[0]} (Laughter) {latin[1]}") == [bare[0], "(Laughter)", latin[1]]
    assert cut(m, f"{latin[0][:20]} (Laughter) {latin[0][20:]}") == [f"{latin[0][:20]} (Laughter) {latin[0][20:]}"]
    bare = [t[:-1] for t in han]
    assert cut(m, "".join(bare)) == bare and cut(m, " ".join(bare)) == bare
    assert all(cut(m, t) == [t] for t in [*latin, *han, "议长 " + han[0]])


def gaps_of(text):
    """(text before, token before, token behind) of each gap and place beside a sign."""
    found, _, _, words, steps = sites_and_gaps(text)
    split = words.split(" ")
    pairs = [(a, b) for a, b in zip(split, split[1:]) if a and b]
    ends = list(accumulate(steps))[::2]
    assert 2 * len(pairs) == len(steps)
    more = [(s.at, s.last, s.next) for s in found if s.mark == "_"]
    return [(text[:at], a, b) for at, a, b in sorted([*((at, *p) for at, p in zip(ends, pairs)), *more])]


def test_all_gaps_are_looked_at():
    assert gaps_of("a bb, cc  dd. ee\nff") == [("a", "a", "bb"), ("a bb, cc", "cc", "dd")]
    assert gaps_of("He said “no way” to us") == [
        ("He", "He", "said"), ("He said", "said", "no"), ("He said “no", "no", "way"),
        ("He said “no way”", "way", "to"), ("He said “no way” to", "to", "us"),
    ]
    assert [g[1:] for g in gaps_of('We (all of us) paid « bien » 5 % to "them" again')] == [
        ("We", "paid"), ("paid", "bien"), ("bien", "0"), ("0", "%"), ("%", "to"), ("to", "them"), ("them", "again"),
    ]
    assert gaps_of("港口船 7人。走") == [("港", "^港", "口船"), ("港口", "^港口", "船"), ("港口船", "口船", "0han"), ("港口船 7", "^0", "人")]
    many = gaps_of(" ".join(["one two three."] * 50))
    assert len(many) == 100 and {g[1:] for g in many} == {("one", "two"), ("two", "three")}


def test_counted_signs(spark):
    df = spark.createDataFrame([(1, "港口船。港口 ^ab c"), (2, "no sign ^ here"), (3, None)], "doc_id int, text string")
    found = sentences.found_sites(df)
    got = {(r["last"], r["next"]): r["n"] for r in sentences.counted_signs(found).collect()}
    assert got == {("港", "口船"): 1, ("港口", "船"): 1, ("港", "口"): 1}
    assert [tuple(r) for r in sentences.counted_signs(found, "_").collect()] == [("港口", "^", 1)]


def test_abbreviations_are_learned():
    """A short word that hardly ever stands without its mark, and after which sentences do not begin."""
    rows = [(("xq", ".", False, "space", "<Xx>"), 400.0), (("end", ".", False, "space", "The"), 400.0),
            (("end", ".", False, "space", "<Xx>"), 90.0), (("why", "!", False, "space", "The"), 300.0)]
    pairs = [("end", "<xx>", 500.0), ("<xx>", "<xx>", 5000.0), ("<xx>", "<Xx>", 600.0), ("<xx>", "end", 300.0)]
    m = sentence_model.estimate(rows, {"xq", "end", "why"}, {"The", "end"}, pairs)
    assert m.abbreviated["xq"] > 0.99 and m.abbreviated["end"] < 0.01
    assert m.posterior(rows[0][0]) < 0.1 and m.posterior(rows[1][0]) > 0.9


def test_names_seen_in_no_other_place_tell_nothing():
    """In a large corpus names are known words, but neither begin sentences nor stand without a mark before."""
    names = [f"Name{c}" for c in "abcdef"]
    rows = [(("xq", ".", False, "space", n), 300.0) for n in names]
    rows += [(("why", "!", False, "space", "The"), 300.0), (("end", ".", False, "space", "The"), 900.0)]
    m = sentence_model.estimate(rows, {"xq", "end", "why"}, {"The", *names}, [("<xx>", "<xx>", 50_000.0)])
    assert m.abbreviated["xq"] > 0.99 and m.abbreviated["end"] < 0.01
    assert all(m.posterior(key) < 0.5 for key, _ in rows[:6])


def test_followers_of_the_word_before_count():
    """The same word behind the same mark: it continues after the one that it follows elsewhere."""
    rows = [(("st", ".", False, "space", "Aran"), 40.0), (("mill", ".", False, "space", "Aran"), 40.0), (("so", "!", False, "space", "Aran"), 40.0)]
    pairs = [("st", "Aran", 300.0), ("mill", "<xx>", 300.0), ("<xx>", "<xx>", 3000.0)]
    m = sentence_model.estimate(rows, {"st", "mill", "so"}, {"Aran"}, pairs)
    assert m.p_cont("st", ".", "Aran") > 5 * m.p_cont("mill", ".", "Aran")
    assert m.posterior(rows[0][0]) < m.posterior(rows[1][0])


def test_white_space_in_thai_is_decided_by_the_model(spark):
    text = "ใครจะเป็นผู้จ่ายเงิน ชาวประมง 24 คนรอคำตอบ ประธาน: เราไม่เห็นด้วย"
    found = sites(text)[0]
    assert [(s.last, s.next[:1]) for s in found if s.mark == "thai"] == [("<end:thai>", "ช"), ("<end:thai>", "0"), ("<end:thai>", "ป")]
    assert all(s.settled is None for s in found)


def test_counted_pairs(spark):
    df = spark.createDataFrame([("the old mill. The old, old mill x 12 y",), (None,), ("",), ("one",), ("ชาวประมง คนรอ",)], "text string")
    got = {(r["last"], r["next"]): r["n"] for r in sentences.counted_pairs(df).collect()}
    assert got == {("the", "old"): 1, ("The", "old"): 1, ("old", "mill"): 2, ("mill", "x"): 1, ("x", "12"): 1, ("12", "y"): 1}


def test_spans():
    assert spans("a (b (c) d) e) (f", CLOSING_OF) == [(2, 11)]
    assert sites("")[0] == []
