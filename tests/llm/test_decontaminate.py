import random

import numpy as np
import pytest

from lacuna.llm import decontaminate as D


def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def passages(r):
    word = lambda: "".join(r.choice("aeioustrné") for _ in range(r.randint(1, 7)))
    return [" ".join(word() for _ in range(n)) for n in (12, 20, 30, 40, 8, 5)]


def edited(t, k, r):
    t = list(t)
    for _ in range(k):
        i = r.randrange(1, len(t) - 1)
        what = r.randrange(3)
        if what == 0:
            t[i] = r.choice("xyz")
        elif what == 1:
            t.insert(i, r.choice("xyz"))
        elif len(t) > 3:
            del t[i]
    return "".join(t)


def test_equals_brute_force(spark):
    r = random.Random(4)
    items = passages(r)
    docs = []
    for i, p in enumerate(items):
        for share in (0, 0.03, 0.08, 0.1, 0.14, 0.3):
            docs.append((10 * i + len(docs), passages(r)[2] + "\n" + edited(p, int(share * len(p)), r).upper() + " " + passages(r)[1]))
    docs += [(900, None), (901, ""), (902, items[0]), (902, items[0]), (903, items[1][: len(items[1]) // 2]), (904, items[4].replace(" ", " \n\t ")), (None, items[2])]
    bench = [(i, t) for i, t in enumerate(items)] + [(90, items[0]), (91, None), (92, " "), (93, "ab c")]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, item_id int").repartition(3)
    want = set()
    for d, t in docs:
        for k, p in bench:
            p = D.normalise(p)
            if not p:
                continue
            e = 0 if p in D.normalise(t) else edit_distance_in(p, D.normalise(t)) if len(p) >= D.Q else 99
            if e <= D.budget(len(p), 0.1):
                want.add((d, k, e))
    got = D.find_leaks(df, spark.createDataFrame([(*b, "x") for b in bench], "item_id long, text string, doc_id string")).collect()
    assert {(x.doc_id, x.item_id, x.edits) for x in got} == want
    assert len(got) == len(want) + sum(d == 902 for d, _, _ in want)  # the repeated row
    sliced = D.find_leaks(df, spark.createDataFrame(bench, "item_id long, text string"), slice_chars=200).collect()
    assert sorted(map(tuple, sliced), key=str) == sorted(map(tuple, got), key=str)


def test_long_documents_are_searched_in_parts(monkeypatch):
    monkeypatch.setattr(D, "STEP", 300)
    r = random.Random(5)
    items = passages(r)[:4]
    index = D.Index(list(enumerate(items)), 0.1)
    for at in range(0, 900, 37):
        text = "k" * at + " " + items[at % 4] + " " + "v" * 500
        assert at % 4 in D.document_leaks(text, index)


def test_banded_alignment():
    r = random.Random(6)
    for _ in range(60):
        text = "".join(r.choice("abc") for _ in range(60))
        a = r.randrange(0, 30)
        pattern = edited(text[a : a + 24], r.randrange(4), r)
        code = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.int64)
        want = edit_distance_in(pattern, text)
        assert D.distance(code(pattern), code(text), -70, 70, 6) == min(want, 7)


@pytest.mark.parametrize("bench", [[], [(1, None)]])
def test_nothing_to_find(spark, bench):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    assert D.find_leaks(docs, b).collect() == []
    assert D.drop_leaked(docs, b).count() == 1
    assert D.find_leaks(docs.limit(0), b).collect() == []


def test_drop_leaked(spark):
    p = "a passage that is long enough to be found again somewhere"
    rows = [(1, "x " + p + " y", 1), (2, "clean words", 2), (None, p, 3), (3, None, 4), (None, "other clean words", 5), (1, "clean, same number", 6), (4, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    for slices in (8 << 20, 40):
        bench = spark.createDataFrame([(7, p), (8, "another one that no document holds at all")], "item_id long, text string")
        kept = D.drop_leaked(docs, bench, slice_chars=slices)
        assert kept.columns == docs.columns and sorted(x.item_id for x in kept.collect()) == [2, 4, 5, 6, 7]


def test_counts_do_not_depend_on_pieces(monkeypatch):
    """Bands of frequent q-grams, counted by places, equal those of listed pairs."""
    r = random.Random(8)
    items = ["ab" * 30, "abc" * 20, "a" * 50, passages(r)[2], "ab" * 15 + passages(r)[1]]
    index = D.Index(list(enumerate(items)), 0.1)
    for text in ("ab" * 400, "abc" * 100 + "a" * 300, passages(r)[3] + items[4] + "ab" * 70, "x"):
        g = D._grams(text.encode("latin-1"))
        at = np.flatnonzero(np.isin(g, index.gram))
        u = np.searchsorted(index.gram, g[at])
        found = []
        for pairs in (1 << 20, 500, 1):
            monkeypatch.setattr(D, "PAIRS", pairs)
            key, count = index.counts(at, u)
            found.append((key.tolist(), count.tolist()))
        want = {}
        for a, k in zip(at.tolist(), u.tolist(), strict=True):
            for h in range(index.first[k], index.first[k + 1]):
                i = int(index.item[h])
                w = int(index.edits[i]) + 1
                key = i << 40 | ((a - int(index.place[h])) // w + index.longest // w + 1)
                want[key] = want.get(key, 0) + 1
        assert all(dict(zip(*f, strict=True)) == want and f[0] == sorted(want) for f in found)


def test_texts_that_repeat_themselves_take_bounded_memory():
    import resource

    index = D.Index([(0, "ab" * 1000)], 0.1)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = D.document_leaks("ab" * 500_000, index)
    assert got[0][0] == 0
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000
