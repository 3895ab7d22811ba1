import os
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import boilerplate, encode, exact_copies, mixing, mojibake, near_copies, residue, truncation, visual_form


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# --- exact copies -----------------------------------------------------------------------------------------------

COPIES = [
    (0, "https://a.example/x?b=2&a=1", "Straße: one"), (1, "HTTPS://A.EXAMPLE/x/?a=1&b=2", "STRASSE one!"), (2, "<https://a.example/x?a=1&b=2>", " strasse - ONE"),
    (3, "https://a.example/y", "Straße: one"), (4, None, "Straße: one"), (5, "https://a.example/x", None), (6, "", ""), (7, "", ""), (8, "https://a.example/y", "straße one"), (9, "?", "!"),
]


def test_exact_copies_collapse_spellings(spark):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in COPIES], "ordinal bigint, url string, title string, value string, record string")
    e = exact_copies.encode(df, "ordinal", exact_copies.EVIDENCE)
    assert rows_of(exact_copies.copies(e, "ordinal"), "first_key", "copy_key") == [(0, 1), (0, 2), (3, 8)]
    assert rows_of(exact_copies.collapse(e, "ordinal"), "first_key", "copies") == [(0, 3), (3, 2)]
    assert exact_copies.copies(exact_copies.encode(df.limit(0), "ordinal", exact_copies.EVIDENCE), "ordinal").count() == 0


def test_exact_copies_records_hold_all_rows(spark):
    df = spark.createDataFrame(COPIES, "ordinal bigint, url string, title string")
    e = exact_copies.encode(df, "ordinal", exact_copies.EVIDENCE)
    assert rows_of(exact_copies.records(df, e, "ordinal"), "first_key", "copies") == [(0, 3), (3, 2), (4, 1), (5, 1), (6, 1), (7, 1), (9, 1)]


def test_exact_copies_hot_value(spark):
    df = spark.range(3000).select(F.col("id").alias("ordinal"), F.when(F.col("id") % 3 == 0, "https://hot.example/").otherwise(F.concat(F.lit("https://h.example/"), "id")).alias("url"), F.lit("T").alias("title"))
    got = exact_copies.copies(exact_copies.encode(df, "ordinal", exact_copies.EVIDENCE), "ordinal")
    assert got.count() == 999 and got.where("first_key <> 0").count() == 0


# --- visual form --------------------------------------------------------------------------------------------------

SAME = [("Fish pond", "Ｆｉｓｈ pond"), ("company filing", "company ﬁling"), ("café", "café"), ("Peter", "Реt​er"), ("ệ x", "ệ x"), ("ệ x", "ệ x"), ("vérifié", "ｖｅ́rifié"), ("ё", "ё"), ("mid-May", "mid‑May"), ("á̧", "á̧")]
OTHER = [("café", "cafe"), ("x²", "x2"), ("A", "a"), ("½", "1/2"), ("a–b", "a-b"), ("2,5", "2.5"), ("é", "è"), ("①", "1")]


def test_visual_form(spark):
    texts = [t for p in SAME + OTHER for t in p] + [None, "", "plain ascii", "z" * 200_000 + "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    form = {r["id"]: r["form"] for r in visual_form.common_form(df, ["id"], "text").collect()}
    for i, (a, b) in enumerate(SAME + OTHER):
        assert (form[2 * i] == form[2 * i + 1]) == (i < len(SAME)), (a, b, form[2 * i], form[2 * i + 1])
    n = 2 * len(SAME + OTHER)
    assert [form[n + i] for i in range(4)] == [None, "", "plain ascii", "z" * 200_000 + "é"]


def test_visual_form_composes_in_full(spark):
    same = [("\u00e9\u0323", "e\u0323\u0301"), ("\u304b\u3099", "\u304c"), ("\uff76\uff9e", "\u30ac"), ("\u0451\u0323", "e\u0323\u0308"), ("\u1112\u1161\u11ab", "\ud55c")]
    df = spark.createDataFrame(list(enumerate(t + " x" for p in same for t in p)), "id bigint, text string")
    form = {r["id"]: r["form"] for r in visual_form.common_form(df, ["id"], "text").collect()}
    assert all(form[2 * i] == form[2 * i + 1] for i in range(len(same))), form


def test_readable_form_keeps_scripts(spark):
    cases = ["сор в отчёте", "Fіrst раyment, обычный текст", "ｗｉｄｅ\u00a0te\u0301xt", "ᎪꓐC стол", "", None]
    df = spark.createDataFrame(list(enumerate(cases)), "id bigint, t string")
    got = {r["id"]: r["clean"] for r in visual_form.readable_form(df, ["id"], "t").collect()}
    assert [got[i] for i in range(6)] == ["сор в отчёте", "First payment, обычный текст", "wide téxt", "ABC стол", "", None]


def test_same_looks_pairs(spark):
    df = spark.createDataFrame([(1, "café"), (2, "café"), (3, "café"), (4, "other"), (5, "other"), (6, None), (7, ""), (8, "")], "ordinal bigint, text string")
    assert rows_of(visual_form.same_looks(df, "ordinal", "text"), "key_a", "key_b") == [(1, 2), (2, 3)]
    assert visual_form.same_looks(df.limit(0), "ordinal", "text").count() == 0


def test_visual_form_against_nfc(spark):
    r = random.Random(4)
    letters = "aeioucnszAEU ̧̣́̀̈ñçéøжд日"
    texts = ["".join(r.choice(letters) for _ in range(40)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    form = {x["id"]: x["form"] for x in visual_form.common_form(df, ["id"], "text").collect()}
    # equal under canonical equivalence exactly where the forms are
    for i, t in enumerate(texts):
        alt = unicodedata.normalize("NFD", t)
        assert unicodedata.normalize("NFC", form[i]) == unicodedata.normalize("NFC", "".join(visual_form._like().get(c, c) for c in alt))


# --- near copies --------------------------------------------------------------------------------------------------


def brute(texts, s):
    sets = {}
    for i, t in texts:
        w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        if len(w) >= max(s.least_words, s.shingle):
            sets[i] = {tuple(w[j : j + s.shingle]) for j in range(len(w) - s.shingle + 1)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= s.similarity * len(sets[a] | sets[b]) - 1e-9}


def edited(r, words):
    w = list(words)
    for _ in range(r.randrange(0, 12)):
        k = r.randrange(len(w))
        w[k : k + r.randrange(0, 2)] = [f"n{r.randrange(99)}"] * r.randrange(0, 2)
    if r.random() < 0.2:
        k = r.randrange(len(w))
        w = w[k:] + w[:k]
    return w


@pytest.mark.parametrize("s", [near_copies.FOUND, near_copies.Settings(), near_copies.Settings(3, 0.6, 30, hot=4)])
def test_near_copies_equal_brute_force(spark, s):
    r = random.Random(11)
    bases = [[f"w{r.randrange(400)}" for _ in range(r.randrange(25, 120))] for _ in range(40)]
    texts = [(i, " ".join(edited(r, r.choice(bases)))) for i in range(400)] + [(400, None), (401, ""), (402, "short text"), (403, "A b, c! " * 4000), (404, "a B c " * 4000), (405, "same words here " * 12), (406, "Same words, here " * 12)]
    df = spark.createDataFrame(texts, "ordinal bigint, text string").repartition(5)
    found = near_copies.links(df, "ordinal", "text", s)
    want = brute(texts, s)
    assert {tuple(x) for x in near_copies.expand(found).collect()} == want
    root = {}
    top = lambda x: x if root.setdefault(x, x) == x else top(root[x])
    for a, b in want:
        root[max(top(a), top(b))] = min(top(a), top(b))
    assert all(top(x["key"]) == x["group_id"] for x in near_copies.groups(found).collect())


def test_near_copies_empty_and_hot(spark):
    empty = spark.createDataFrame([], "ordinal bigint, text string")
    assert near_copies.expand(near_copies.links(empty, "ordinal", "text")).count() == 0
    hot = spark.range(600).select(F.col("id").alias("ordinal"), F.lit(" ".join(f"w{i}" for i in range(50))).alias("text"))
    found = near_copies.links(hot, "ordinal", "text")
    assert found.links.count() == 0 and near_copies.groups(found).select("group_id").distinct().count() == 1


def dynamic_program(costs, need):
    """Least cost of covering need bits, each partition one: the general program over (partitions, bits covered)."""
    best = [0.0] + [float("inf")] * need
    for c in costs:
        best = [0.0] + [min(best[k], best[k - 1] + c) for k in range(1, need + 1)]
    return best[need]


def test_allocation_by_ascending_cost_is_the_optimum():
    r = np.random.default_rng(2)
    owner = np.repeat(np.arange(40), r.integers(1, 12, 40))
    cost, tie, miss = r.integers(0, 255, len(owner)), r.integers(0, 1 << 62, len(owner)).astype(np.uint64), r.integers(0, 6, 40)
    bits = near_copies.ordered(owner, cost, tie)
    of, costs = (bits >> np.uint64(52)).astype(int), (bits >> np.uint64(44)) & np.uint64(255)
    probed = near_copies.allocate(of, np.unique(of, return_index=True)[1], miss)
    for i in range(40):
        need = min(int(miss[i]) + 1, int((owner == i).sum()))
        assert costs[probed & (of == i)].sum() == dynamic_program(cost[owner == i].tolist(), need)


def test_near_copies_links_of_classes(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(base)) for i in range(5)] + [(5, " ".join(base[:-1])), (6, " ".join(base[:-1])), (7, " ".join(f"x{i}" for i in range(60))), (8, None)]
    found = near_copies.links(spark.createDataFrame(texts, "ordinal bigint, text string"), "ordinal", "text")
    got = {r["key"]: (r["class_id"], r["n_links"]) for r in near_copies.linked(found).collect()}
    assert got == {**{i: (0, 1) for i in range(5)}, 5: (5, 1), 6: (5, 1), 7: (7, 0)}


def test_shingles_do_not_depend_on_the_batch():
    text = " ".join(f"w{i}" for i in range(40))
    alone, _ = near_copies.shingles(pa.array([text]), near_copies.FOUND)
    b = pa.RecordBatch.from_arrays([pa.array(range(70_001), pa.int64()), pa.array([text if i in (0, 70_000) else "a" for i in range(70_001)])], ["key", "text"])
    sets = [x for r in near_copies._sets(iter([b]), near_copies.FOUND) for x in r["set"].to_pylist()]
    assert len(sets) == 2 and all((np.frombuffer(x, np.uint64) == alone).all() for x in sets)


# --- residue ------------------------------------------------------------------------------------------------------


def test_residue_generalises_from_weak_labels():
    r = random.Random(3)
    topics = ["memory contracts", "salary bands", "wafer starts", "query planning"]
    good = [f"The schedule for {r.choice(topics)} slipped by {r.randrange(99)} weeks after Kelmor changed its plan. Analysts compare {r.choice(topics)} with {r.choice(topics)}." for _ in range(400)]
    told = ["The guide explains that a brace such as “{{ title }}” is filled in by the renderer.", "Designers stopped using lorem ipsum in mock-ups."] * 10
    latin = "ferrum oravit frugis verum sedari mundis suntque tellis".split()
    bad = [r.choice(["Please enable JavaScript to view this site.", "Error 403 - access denied.", "Dear {{name}}, welcome to [[city]].", "lorem ipsum " + " ".join(r.choice(latin) for _ in range(9))]) for _ in range(120)]
    m = residue.train(good + told + bad, [True] * (len(good) + len(told) + len(bad)), [200.0] * (len(good) + len(told) + len(bad)))
    unseen = [" ".join(r.choice(latin) for _ in range(11)), good[0] + " Please enable JavaScript to view that site.", "Dear {{role}}, welcome."]
    fine = [good[5], told[0], told[1], "The schedule for remote roles slipped by 7 weeks."]
    s = m.scores(unseen + fine + [" ", "?!"], np.ones(9, bool))
    assert (s[:3] > 0).all() and (s[3:7] < 0.5).all() and s[7] == -np.inf


def test_residue_on_tables(spark):
    df = spark.createDataFrame([(i, f"h{i % 9}.example", "Please enable JavaScript to go on." if i % 4 == 0 else f"Note {i} on memory contracts is calm and long enough.", True, None) for i in range(200)] + [(200, None, None, False, None), (201, "h", "", False, 404.0)], "key bigint, host string, text string, titled boolean, status double")
    m = residue.fit([df])
    assert rows_of(residue.residue(df, m, ["key"]), "key") == sorted([(i,) for i in range(0, 200, 4)], key=repr)
    empty = residue.fit([df.limit(0)])
    assert residue.residue(df.limit(0), empty, ["key"]).count() == 0


# --- truncation ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,kind",
    [("A whole sentence.", None), ("Ends here. Tags: release notes, export rules", None), ("Done. — Ostmor, 20 June", None), ("Done. Source: https://a.example/x/12", None), ("“We hold,” said X. (Updated)", None), ("He said “all is well.”", None),
     ("The second review of the", "bare"), ("The second revi", "bare"), ("It was cut he…", "marker"), ("It was cut [...]", "marker"), ("It was fetched 43 (continued)", "marker"), ("ends in th&#82", "broken"), ("ends in th\\u20", "broken"), ("was <a hre", "broken"),
     ("costs at jo�", "broken"), ("differ as shown in Fig.", "dangling"), ("listed under No.", "dangling"), ("runs in version 3.", "dangling"), ("He said “all is well.", "open"), ("404 - nothing here (269cc08f)", None), ("", None), ("   ", None)],
)
def test_truncation_evidence(text, kind):
    assert truncation.evidence(text) == kind


def test_truncation_follows_the_source(spark):
    df = spark.createDataFrame([(i, "bare" if i < 50 else "full" if i < 100 else None, "a heading without a stop" if i < 50 or i in (60, 110) else "A sentence.") for i in range(120)] + [(200, "full", None), (201, "full", " ")], "ordinal bigint, s string, t string")
    j = truncation.judge(df, ["ordinal"], "s", "t")
    assert rows_of(j.where("cut"), "ordinal") == [(110,), (60,)]
    assert {r["source"]: (r["n_texts"], r["n_cut"]) for r in truncation.rates(j).collect()} == {"bare": (50, 0), "full": (50, 1), None: (20, 1)}
    assert truncation.judge(df.limit(0), ["ordinal"], "s", "t").count() == 0
    assert truncation.evidence("x (" * 100_000) == "bare"


@pytest.mark.parametrize(
    "text,kind",
    [("The plan (as it was", "open"), ("He said “all is", "open"), ("x (" * 100_000, "open"), ("All is well. The second review of the", "unended"), ("A heading without a stop", "bare"), ("<b>All</b> is well.", None), ("<div>All is well. It <em>holds.", "open"),
     ("Wrap it in a <div> element.", None), ("It ends so. Tags: release notes", None), ("Version 3. of it", "bare")],
)
def test_truncation_firm_evidence(text, kind):
    assert truncation.firm_evidence(text) == kind


def test_truncation_of_a_source_that_cuts_most(spark):
    whole = "the committee reviewed every contract before publication and accepted amendments"
    cuts = [whole[: 20 + i] for i in range(55)]
    rows = [("cutter", c) for c in cuts] + [("cutter", "Done.")] * 5 + [("writer", "a heading about contract publication")] * 40 + [("writer", "a heading about amend")] + [("small", "all accepted amendments")] * 3 + [("full", whole + ".")] * 60
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal bigint, s string, t string")
    got = {r["source"]: (r["n_texts"], r["n_cut"]) for r in truncation.rates(truncation.judge(df, ["ordinal"], "s", "t")).collect()}
    assert got == {"cutter": (60, 55), "writer": (41, 1), "small": (3, 3), "full": (60, 0)}


def test_truncation_reads_texts_of_any_length():
    far = "Kelmor and others say so in their report, " * 60
    assert truncation.evidence("Source: Kelmor today") is None and truncation.evidence(f"It ended. Source: {far}today") is None
    assert truncation.evidence("It ended. And then the report of the group") == truncation.evidence(f"It ended. And then {far}") == "bare"
    assert truncation.evidence('Text. <a href="https://a.example/' + "x" * 300) == "broken" and truncation.evidence("Text. <i") == "broken"
    assert truncation.evidence("It is done" + "." + ")" * 200) is None
    for unclosed in ("<b>Bold text never closed. It ends here.", "<table><tr><td>Cell one. Cell two.", "He said “this.", "(see above. "):
        assert truncation.firm_evidence(unclosed) == "open", unclosed


# --- boilerplate --------------------------------------------------------------------------------------------------


def page(r, n):
    t = f"How site {n} works"
    body = [(t, f"Paragraph {i} tells about topic {r.randrange(99)} and says how it ended.") for i in range(r.randrange(1, 6))]
    top = [("", "Home | About | Jobs | Blog | Search"), ("", "We use cookies to improve your visit. Accept all")][: r.randrange(0, 3)]
    return [*top, (t, t), *body, (t, "Related: other things / more things / last things"), (t, "© 2024 Site. All rights reserved.")]


def test_boilerplate_field():
    r = random.Random(9)
    train = [page(r, i) for i in range(150)]
    f = boilerplate.Field().train([boilerplate.features(p) for p in train], [boilerplate.label(p) for p in train])
    test = [page(r, i) for i in range(150, 200)]
    got = f.decode([boilerplate.features(p) for p in test])
    assert got == [boilerplate.label(p) for p in test]
    # Viterbi and the marginals agree with an enumeration of all labellings
    e = f.scores([boilerplate.features(test[0][:5])])
    best, total, marg = None, 0.0, np.zeros(5)
    for code in range(32):
        y = [(code >> k) & 1 for k in range(5)]
        s = sum(e[k] * y[k] for k in range(5)) + sum(f.step[a, b] for a, b in zip(y, y[1:]))
        best = max(best or (s, y), (s, y))
        total += np.exp(s)
        marg += np.exp(s) * np.array(y)
    assert f.decode([boilerplate.features(test[0])[:5]])[0] is not None
    p, pair = f._marginals(e, np.array([5]))
    assert np.allclose(p, marg / total) and np.isclose(pair.sum(), 4)


def test_boilerplate_features_see_the_whole_block():
    long = " ".join(f"word{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}" for i in range(90))
    side = lambda t: {f for f in boilerplate._text_features(t) if f < boilerplate._SIDE}
    assert side(long + " we use cookies here") - side(long + " here") and side(long + " cookies use here") != side(long + " use cookies here")
    assert side("word " * 2000 + "accept") != side("word " * 2000 + "word")


def test_boilerplate_tables(spark):
    r = random.Random(1)
    data = [(i, page(r, i)) for i in range(80)] + [(80, None), (81, []), (82, [(None, None), ("h", " ")])]
    df = spark.createDataFrame(data, "ordinal bigint, content_blocks array<struct<heading string, text string>>")
    f = boilerplate.fit(df, "ordinal", "content_blocks")
    got = {x["ordinal"]: (x["main"], x["rest"]) for x in boilerplate.split(df, "ordinal", "content_blocks", f).collect()}
    assert set(got) == set(range(80)) | {82} and got[82] == ([], [0, 1])
    assert all(sorted(m + x) == list(range(len(p))) for (m, x), (_, p) in zip((got[i] for i in range(80)), data))


# --- tokenizer ----------------------------------------------------------------------------------------------------

TEXTS = ["Hello world, it's the wafers' 1,234 units!\n\n  x", "", None, "ünïcödé 日本語 текст 😀👩‍💻", "<|endoftext|> is text", "a" * 5000, "\t\r\n    ", "don't DON'T we'll"]


@pytest.mark.skipif(not os.path.exists(os.path.join(encode.TOKENIZERS, encode.VOCABULARY)), reason="no vocabularies")
def test_encode_equals_the_public_library(spark):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=encode.read_ranks(), special_tokens={})
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS * 2)], "doc_id bigint, text string, word string")
    got = {r["doc_id"]: r["ids"] for r in encode.encode(df, ["doc_id"], "text", lexicon_words=5).collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS * 2)}
    assert all(enc.decode(got[i]) == (t or "") for i, t in enumerate(TEXTS))
    n = {r["doc_id"]: r["n_tokens"] for r in encode.encode(df, ["doc_id"], "text", counts=True).collect()}
    assert n == {i: len(x) for i, x in got.items()}
    assert encode.encode(df.limit(0), ["doc_id"], "text").count() == 0


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w.encode(): [i, i + 1][: 1 + i % 2] for i, w in enumerate(["tops", "top", "taps", "tap", "stops", "é", "", "x" * 300])}
    lex = encode.Lexicon.build(words)
    (tmp_path / "l").write_bytes(lex.data())
    mapped = encode.Lexicon.map(str(tmp_path / "l"))
    assert all(mapped.find(w) == ids for w, ids in words.items())
    assert all(mapped.find(w) is None for w in (b"to", b"topsy", b"\xc3", b"y", b"x" * 299))
    small = encode.Lexicon.build({b"tops": [1], b"taps": [2]})
    assert len(small.final) == 5  # t, a shared "ps", and the end


# --- mixing -------------------------------------------------------------------------------------------------------


def test_rates():
    targets = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2), ("gone", 0.0, 9)]
    free = {r.source: r.rate for r in mixing.rates({"a": 1000, "b": 100, "c": 100}, targets)}
    assert free["b"] == pytest.approx(4.0) or free["c"] == pytest.approx(2.0) or free["a"] == pytest.approx(1.0)
    used = {s: free[s] * n for s, n in (("a", 1000), ("b", 100), ("c", 100))}
    assert [round(used[s] / sum(used.values()), 6) for s in "abc"] == [0.5, 0.3, 0.2]
    fixed = {r.source: r.rate for r in mixing.rates({"a": 1000, "b": 100, "c": 100}, targets, total=2000)}
    assert fixed == {"a": 1.0, "b": 4.0, "c": 2.0, "gone": 0.0}
    assert all(r.rate == 0 for r in mixing.rates({}, targets))


def test_mix(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 30 == 1, "b").otherwise("other").alias("source"), F.lit(10).cast("bigint").alias("n_tokens"))
    t = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3), ("none", 0.0, 3), ("missing", 0.0, None)], "source string, target_share double, max_repeats int")
    chosen, found = mixing.mix(docs, "doc_id", "source", t)
    s = {r["source"]: r for r in mixing.shares(chosen, "source", found).collect()}
    assert abs(s["a"]["actual_share"] - 0.6) < 0.03 and s["missing"]["used_tokens"] == 0 and "other" not in s
    assert chosen.where("source = 'b'").agg(F.max("repeats")).first()[0] <= 3 and chosen.where("source = 'a'").agg(F.max("repeats")).first()[0] <= 1
    assert rows_of(chosen, "doc_id", "repeats") == rows_of(mixing.mix(docs.repartition(7), "doc_id", "source", t)[0], "doc_id", "repeats")
    assert mixing.emit(chosen).count() == chosen.agg(F.sum("repeats")).first()[0]
    none, found = mixing.mix(docs.limit(0), "doc_id", "source", t)
    assert none.count() == 0 and mixing.shares(none, "source", found).where("actual_share is null").count() == 4


# --- mojibake -----------------------------------------------------------------------------------------------------

CLEAN = ["La compañía de Málaga revisó el número de vacantes en 2024 después del año.", "Die Prüfung über Größe und Wärme fand in München 17 Fälle.", "Аналитики считают в отчёте Kelmor 45 что индекс вырос на 12 пунктов.", "Le marché espère que l'été sera fraîche à Nîmes, note 88."]


def test_garble_and_restore():
    for t in CLEAN:
        for c in mojibake.CHAINS:
            g = mojibake.garble(t, c)
            if g is not None and g != t:
                back = mojibake.restore(g, c)
                assert back is None or back == t


def test_mojibake(spark):
    r = random.Random(8)
    docs = [(i, r.choice(CLEAN) + f" Zeile {r.randrange(5)}.") for i in range(300)]
    bad = {}
    for i in range(300, 360):
        t, c = r.choice(CLEAN), r.choice([("utf-8", "cp1252", 1), ("utf-8", "latin-1", 2), ("utf-8", "cp1251", 1)])
        g = mojibake.garble(t, c)
        bad[i] = t
        docs.append((i, g))
    docs += [(400, "Readers may see “Ã©” when a page is read wrongly."), (401, None), (402, ""), (403, "plain"), (404, "SÃO PAULO E NÃO"), (405, "the team�s own")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {x["doc_id"]: x["restored"] for x in mojibake.garbled(df, "doc_id", "text").collect()}
    assert set(got) == set(bad) | {405}
    assert sum(got[i] == t for i, t in bad.items()) >= 0.95 * len(bad)
    assert mojibake.garbled(df.limit(0), "doc_id", "text").count() == 0


def test_explains_aligned_runs_that_differ():
    chain = mojibake.CHAINS.index(("utf-8", "cp1252", 1))
    assert chain in mojibake.explains("Málaga – café für 12 Tage", "Málaga – cafÃ© für 12 Tage")
    assert mojibake.explains("Málaga – café für 12 Tage", "Málaga – cafÃ© fur 12 Tage") == []
    assert mojibake.explains("same café", "same café") == []


@pytest.mark.parametrize(
    "clean,chain",
    [(["По мнению аналитики, рынок спорный.", "Запас мощности вырос, но мало."], ("koi8_r", "cp1251", 1)), (["データ品質", "メモリ価格の見直し"], ("utf-8", "cp1252", 1)), (["データ品質", "メモリ価格の見直し"], ("cp932", "cp1252", 1)), (["担当者は84ポイント前後で安定", "納期が63ポイント増えた"], ("cp932", "mac_roman", 1))],
)
def test_mojibake_learns_from_short_and_split_lines(spark, clean, chain):
    docs = [(i, x) for i, x in enumerate(x for t in clean for x in (t, mojibake.garble(t, chain)))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert chain in mojibake.learn(df, "doc_id", "text")


def test_mojibake_learns_from_a_garbled_passage_of_a_split_line(spark):
    c = ("cp932", "cp1252", 1)
    docs = [(i, x) for i, x in enumerate(x for a, b in (("担当者は", "ポイント前後で安定"), ("納期が", "ポイント増えた")) for x in (f"{a}84{b}", f"{a}84{mojibake.garble(b, c)}"))]
    assert c in mojibake.learn(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text")


# --- queries ------------------------------------------------------------------------------------------------------

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "p2_found": "first_ordinal copy_ordinal", "p3_found": "tbl ordinal", "p4_found": "ordinal_a ordinal_b", "p5_found": "tbl ordinal", "p6_found": "ordinal block_index",
    "p7_found": "tbl ordinal_a ordinal_b", "p8_ids": "doc_id ids", "p4_classes": "ordinal class_id n_links", "p7_forms": "tbl ordinal form clean", "p9_shares": "source target_share max_repeats tokens rate binding used_tokens actual_share", "p10_found": "doc_id",
}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_have_their_columns_and_no_row_twice(spark, name):
    from sievework.llm import queries

    df = queries.QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS[name].split()
    got = df.collect()
    if name.endswith("_found"):
        assert got and len(got) == len({tuple(r) for r in got})


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["p2_found", "p2_collapsed", "p2_records"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from sievework.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW false_positive_evidence AS SELECT * FROM read_parquet('{DATA}/false_positive_evidence.parquet')")
    r = con.execute(queries.ORACLE[name])
    cols = [c[0] for c in r.description]
    assert sorted(r.fetchall()) == sorted(tuple(x[c] for c in cols) for x in queries.QUERIES[name](spark, DATA).collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_records_equal_their_sql_and_hold_all_rows(spark):
    import duckdb

    from sievework.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW false_positive_evidence AS SELECT * FROM read_parquet('{DATA}/false_positive_evidence.parquet')")
    got = sorted((x["first_ordinal"], x["copies"]) for x in queries.QUERIES["p2_records"](spark, DATA).collect())
    assert got == sorted(con.execute(queries.ORACLE["p2_records"]).fetchall())
    assert sum(n for _, n in got) == con.execute("SELECT count(*) FROM false_positive_evidence").fetchall()[0][0]
