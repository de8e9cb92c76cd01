import random
import time
import zlib
from itertools import product

import numpy as np
import pytest

from lacuna.llm import quality as Q
from lacuna.llm import toxicity as X


def good(r, n=12):
    return "\n".join(" ".join("".join(r.choice("aeinrst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(5, 14))).capitalize() + "." for _ in range(n))


def bad(r, n=12):
    kind = r.randrange(3)
    line = lambda: " ".join({0: w + r.choice(("###", "%%%")), 1: w.upper() + "!!", 2: w + " |"}[kind] for w in good(r, 1).split())
    return "\n".join(line() for _ in range(n))


def labelled(n=260, seed=1):
    r = random.Random(seed)
    rows = [(i, good(r, r.randint(1, 20)) if i % 3 else bad(r, r.randint(1, 20)), int(i % 3 > 0)) for i in range(n)]
    return rows


def test_chain_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    e, link = r.normal(size=6), r.normal(size=(2, 2))
    doc = np.array([0, 0, 0, 0, 1, 2])
    got = 1 / (1 + np.exp(-Q.messages(e, doc, link)[2]))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        total, one = 0.0, np.zeros(len(at))
        for y in product((0, 1), repeat=len(at)):
            p = np.exp(sum(e[i] * v for i, v in zip(at, y)) + sum(link[a, b] for a, b in zip(y, y[1:])))
            total += p
            one += p * np.array(y)
        assert np.allclose(got[at], one / total)


def test_line_features_equal_a_plain_count():
    text = "The cat, the cat.\n\nThe cat, the cat.\nUP! 12 é|# x"
    x, length, doc = Q.line_features(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    assert len(x) == 3 and doc.tolist() == [0, 0, 0] and length.tolist() == [17, 17, 13]
    assert x[0, 0] == pytest.approx(np.log1p(4)) and x[0, 10] == pytest.approx(3 / 4) and x[0, 11] == 1 and x[2, 11] == 0
    assert x[2, 3] == pytest.approx(2 / 5) and x[2, 4] == pytest.approx(2 / 13)


def test_long_documents_in_runs_give_the_same(monkeypatch):
    r = random.Random(8)
    text = "\n".join([*(good(r, 3) for _ in range(20)), "x" * 700, *(bad(r, 3) for _ in range(20)), "", good(random.Random(8), 3)]).encode()
    data, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    from lacuna.llm import _text as T

    one, words = Q.line_features(data, off), T.words(data, off)
    monkeypatch.setattr(T, "LONG", 100)
    monkeypatch.setattr(T, "STEP", 300)
    two, again = Q.line_features(data, off), T.words(data, off)
    assert all((a == b).all() for a, b in zip(one[:2], two[:2], strict=True)) and one[0][:, Q.REPEATED].sum() >= 6
    assert (words[0] == again[0]).all() and words[1].tolist() == again[1].tolist()


def test_quality_on_held_out_rows(spark):
    rows = labelled()
    odd = [(1000, None), (1001, ""), (1002, "\n \n"), (1003, "word"), (1004, "x " * 200_000), (None, rows[0][1]), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, 0.5, "s") for i, t, _ in rows] + [(i, t, 0.5, "s") for i, t in odd], "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = Q.score_quality(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [(r.score >= 0.5) == bool(truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and np.mean(held) > 0.95
    by = {r.doc_id: r.score for r in got}
    assert by[1000] == by[1001]


def test_quality_learns_from_whole_documents_within_bounds(spark):
    """The first labelled documents by hash, each with all its lines, up to the bound of bytes."""
    rows = labelled(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    few = Q.train(docs, labels, most=150, most_bytes=30_000)
    seen = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    order = {r[0]: k for k, r in enumerate(docs.selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h", "doc_id").collect())}
    seen, size, parts = sorted(seen, key=lambda r: order[r[0]])[:150], 0, []
    for i, t, y in seen:
        size += len(t.encode()) + 1
        if size <= 30_000:
            parts.append((i, *Q.line_features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[:2], y))
    parts.sort(key=lambda r: r[0])
    assert 10 < len(parts) < 150
    x, length = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    plain = Q.fit(x, length, np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts]), np.array([p[3] for p in parts]))
    assert np.allclose(few.weight, plain.weight) and np.allclose(few.link, plain.link)


def test_quality_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.score_quality(docs, none).collect()] == [0.5, 0.5]
    assert Q.score_quality(docs.limit(0), none).collect() == []


def test_keep_good_keeps_columns(spark):
    rows = labelled(120)
    docs = spark.createDataFrame([(t, i, y) for i, t, y in rows], "text string, doc_id long, score int")
    kept = Q.keep_good(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    assert kept.columns == docs.columns
    assert np.mean([r.score for r in kept.collect()]) > 0.95


def test_folding():
    assert X.fold("MОRОN") == "moron"  # Cyrillic O
    assert X.fold("m0r0n 5tup1d") == "moron stupid"
    assert X.fold("tr@sh $cum l​o​ser") == "trash $cum loser"
    assert X.fold("ｔｒａｓｈ") == "trash"
    assert X.fold(None) == "" and X.fold("wow! yes") == "wow! yes"


def test_lexicon_matches_word_beginnings_but_not_exceptions():
    lex = X.Lexicon({"trash": 2.0, "moron": 3.0, "tra": 1.0}, ["trash can"])
    assert lex.features("nothing here") == (0.0, 0.0) and lex.features(None) == (0.0, 0.0) and lex.features("oxymoron") == (0.0, 0.0)
    assert lex.features("Trashy")[0] == pytest.approx(np.log1p(2.0))
    assert lex.features("a trash can, m0ron")[0] == pytest.approx(np.log1p(3.0))
    assert lex.features("a trash canister")[0] == pytest.approx(np.log1p(2.0))
    assert lex.features("moron " * 3)[0] == pytest.approx(np.log1p(9.0))
    assert X.Lexicon({}).features("moron") == (0.0, 0.0)


def test_exceptions_are_found_in_one_pass():
    r = random.Random(12)
    for _ in range(300):
        hits = [(a, a + r.randint(0, 6), 1.0) for a in (r.randrange(60) for _ in range(12))]
        spans = [(a, a + r.randint(0, 9)) for a in (r.randrange(60) for _ in range(8))]
        assert X._outside(hits, spans) == sorted(h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in spans))
    lex = X.Lexicon({"trash": 2.0}, ["trash can"])
    began = time.process_time()
    assert lex.features("trash can " * 100_000) == (0.0, 0.0)
    assert lex.features("trash can " * 100_000 + "trash")[0] == pytest.approx(np.log1p(2.0))
    assert time.process_time() - began < 20


def test_lexicon_equals_plain_search():
    r = random.Random(3)
    terms = {"abc": 1.0, "bca": 2.0, "ab": 0.5, "cc": 1.5}
    lex = X.Lexicon(terms)
    for _ in range(200):
        text = "".join(r.choice("abc  .") for _ in range(40))
        folded, total = X.fold(text), 0.0
        for i in range(len(folded)):
            if i == 0 or not folded[i - 1].isalnum():
                total += max((w for t, w in terms.items() if folded.startswith(t, i)), default=0.0)
        assert lex.features(text)[0] == pytest.approx(np.log1p(total))


def test_terms_are_chosen_once():
    counts = [("idiot", 100, 0), ("idio", 100, 0), ("idi", 100, 5), ("idiots", 40, 0), ("the", 100, 900), ("rare", 2, 0)]
    assert list(X.choose_terms(counts, 300, 1000)) == ["idiot"]


def test_terms_of_a_rare_language_are_kept(spark):
    counts = [("tonto", 9, 0), ("idiot", 900, 3), ("casual", 4, 0), ("the", 1200, 9000), ("some", 9, 8)]
    assert set(X.choose_terms(counts, 1300, 10_700)) == {"idiot", "tonto"}
    assert X.choose_terms(counts, 1300, 0) == X.choose_terms(counts, 0, 1300) == {}
    assert X._tail(2, 1, 0.25) == pytest.approx(3 * 0.25**2 * 0.75 + 0.25**3)
    nested = [("glorpish"[:k], 500, 0) for k in range(3, 9)] + [("tonto", 9, 0)]
    df = spark.createDataFrame(nested, "term string, p long, n long")
    assert list(X.learn_terms(df, 1300, 10_700, most=2)) == ["glorpish", "tonto"]


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(7)
    insults = ["glorpish", "vantok", "skrell"]
    rows = []
    for i in range(400):
        t = good(r, 5)
        if i % 5 == 0:
            w = t.split(" ")
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(insults).upper() if i % 2 else r.choice(insults).replace("o", "0"))
            t = " ".join(w)
        rows.append((i, t, int(i % 5 == 0)))
    odd = [(1000, None), (1001, ""), (1002, "x " * 100_000), (None, rows[0][1]), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(i, t, 1) for i, t in odd], "doc_id long, text string, label int")
    got = X.score_toxicity(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    truth = {i: y for i, _, y in rows}
    held = [x.predicted == truth[x.doc_id] for x in got if x.held_out and x.doc_id in truth]
    assert len(held) > 100 and np.mean(held) > 0.98
    assert {x.predicted for x in got if x.doc_id in (1000, 1001, 1002)} == {0}


def test_documents_that_share_a_word_count_each(spark):
    r = random.Random(9)
    few = lambda: " ".join("".join(r.choice("aeinrst") for _ in range(r.randint(2, 5))) for _ in range(12))
    rows = [(i, f"company {few()}" + " glorp" * (i % 4 == 0), int(i % 4 == 0)) for i in range(200)]
    rows += [(i, "company zzyzx", 1) for i in range(200, 230)]  # copies count once
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    lexicon, _ = X.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert any("glorp".startswith(t) for t in lexicon.terms) and not any(t.startswith("zzy") for t in lexicon.terms)


def test_toxicity_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert len({x.score for x in X.score_toxicity(docs, none).collect()}) == 1
    assert X.score_toxicity(docs.limit(0), none).collect() == []
