import random
import re

import pytest

from lacuna.llm.components import connected_components
from lacuna.llm.near_dedup import keep_one, near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted(((i, len(s), (find(i) if i is not None and s else i), True if i is None or not s else find(i) == i) for i, s in sets), key=str)


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(1, 6)))
    base = [[word() for _ in range(n)] for n in (60, 200, 30, 9, 4, 1)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for k in range(80):  # chains of edits: neighbours alike, ends not
        b = list(base[k % 4])
        for _ in range(r.randint(0, max(1, len(b) // 20))):
            b[r.randrange(len(b))] = word()
        rows.append((100 + k, "\t".join(b).upper() if k % 7 == 0 else " ".join(b)))
        if k % 3 == 0:
            base[k % 4] = b
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, rows[0][1]), (304, rows[0][1].replace(" ", "\n ")), (None, rows[0][1]), (None, None), (5, "one two three")]
    rows += [(305, "x " * 5000), (306, "x " * 6000)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 7, "z") for i, t in rows], "doc_id long, text string, component_id int, rep string").repartition(5)
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    ids = [i for i, _ in rows]
    once = [r for r in got if ids.count(r[0]) == 1]
    assert once == [r for r in brute(rows) if ids.count(r[0]) == 1]


def test_repeated_ids_and_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(2, text), (2, text), (3, "other words altogether here now and then"), (3, text)]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(r[0], r[2], r[3]) for r in got] == [(2, 2, True), (2, 2, True), (3, 2, False), (3, 2, False)]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(4, text, 1), (9, text + " more", 2), (4, text, 1), (None, text, 3), (7, None, 4)], "doc_id long, text string, extra int")
    kept = keep_one(df, near_duplicates(df))
    assert sorted(((r.doc_id, r.extra) for r in kept.collect()), key=str) == [(4, 1), (7, 4), (None, 3)]


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 60)], [(i % 5, i + 100) for i in range(50)], [(1, 1)], []])
def test_components(spark, links):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([(*x,) for x in links] + [(None, 3)], "a long, b long")).collect()}
    want = {}
    for a, b in links:
        if a != b:
            for v in (a, b):
                want.setdefault(v, v)
    for _ in range(len(links)):
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
