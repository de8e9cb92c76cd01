import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lacuna.llm import substring_dedup
from lacuna.llm.substring_dedup import _repeats, anchors, cut_repeats, remove_repeats, repeat_report, repeated


def brute(rows, size):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[s : s + size] for b in texts for s in range(len(b) - size + 1))
    out = []
    for (i, _), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - size + 1):
            if seen[b[s : s + size]] > 1:
                gone[s] += 1
                gone[s + size] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def corpus(size, seed=3):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("ab é\n") for _ in range(n))
    shared = [text(size // 2), text(size), text(3 * size), text(size - 1)]
    rows = [(k, text(r.randint(0, 4 * size)) + r.choice(shared) + text(r.randint(0, 2 * size))) for k in range(40)]
    rows += [(50, "z" * (3 * size)), (51, "y" * (size + 3)), (52, "q" * (size - 1)), (53, None), (54, ""), (50, "z" * 3), (None, rows[3][1]), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(55, "line\n" * size), (56, (shared[1] + "x") * 4), (57, shared[2] * 2)]
    return rows


@pytest.mark.parametrize(("size", "gram", "unit"), [(400, 128, 4096), (40, 12, 4096), (40, 12, 3)])
def test_equals_brute_force(spark, size, gram, unit):
    rows = corpus(size)
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, h int, dk string").repartition(7)
    want = brute(rows, size)
    if unit == 4096:
        assert sorted((tuple(x) for x in repeat_report(df, size, gram).collect()), key=str) == want
    got = {(r.id, r.n_removed, r.n_spans, r.kept_sha256) for r in cut_repeats(df, size, gram, unit).collect() if r.n_removed}
    assert got == {(-(1 << 63) if i is None else i, n, s, d) for i, _, n, s, d in want if n}


def test_remaining_text(spark):
    block = "".join(random.Random(1).choice("abcdefgh ") for _ in range(500))
    df = spark.createDataFrame([(1, "head " + block + " tail", 510, "a"), (2, block, 500, "b"), (3, "own", 3, "c"), (4, None, None, "d")], "doc_id long, text string, n_chars long, kept string")
    got = {r.doc_id: tuple(r) for r in remove_repeats(df).collect()}
    assert got == {1: (1, "head  tail", 10, "a"), 2: (2, "", 0, "b"), 3: (3, "own", 3, "c"), 4: (4, None, None, "d")}


def test_characters_cut_in_two_leave_valid_text(spark):
    common = "b" * 7 + "é" * 300
    df = spark.createDataFrame([(1, common + "xyz"), (2, common[:-1] + "è" + "uvw")], "doc_id long, text string")
    for r in remove_repeats(df).collect():
        r.text.encode()


def test_empty_table(spark):
    assert repeat_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_string_holds_its_anchor_at_the_same_place():
    r = np.random.default_rng(1)
    a = r.integers(97, 100, 3000, dtype=np.uint8)
    b = np.concatenate([r.integers(97, 100, 777, dtype=np.uint8), a[500:1500]])
    pa_, _, ha, _ = anchors(a, np.array([0, 3000]), 60, 20)
    pb, _, hb, _ = anchors(b, np.array([0, len(b)]), 60, 20)
    inside = {(int(p) - 500, int(h)) for p, h in zip(pa_, ha, strict=True) if 560 <= p < 1400}
    assert inside <= {(int(p) - 777, int(h)) for p, h in zip(pb, hb, strict=True)}


def test_column_wise_order_finds_what_comparison_finds():
    r = random.Random(2)
    size, gram = 12, 4
    width = 2 * size - gram
    strings = ["".join(r.choice("ab") for _ in range(width)).encode() for _ in range(60)]
    group = np.sort(np.array([r.randrange(4) for _ in strings]))
    found = repeated(strings, np.full(60, size - gram), group, size, gram)
    for j, s in enumerate(strings):
        for t in range(width - size + 1):
            assert found[j, t] == any(i != j and group[i] == group[j] and strings[i][t : t + size] == s[t : t + size] for i in range(60))


def test_digests_that_collide_change_nothing(spark):
    size = 40
    rows = corpus(size, 7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {(-(1 << 63) if i is None else i, n, s, d) for i, _, n, s, d in brute(rows, size) if n}
    for unit in (4096, 3):
        assert {(r.id, r.n_removed, r.n_spans, r.kept_sha256) for r in cut_repeats(df, size, 12, unit, bits=2).collect()} == want


def few_words(rows, size, words, whole):
    """Brute force of runs that go although only long passages do."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[s : s + size] for b in texts for s in range(len(b) - size + 1))
    out = {}
    for (i, _), b in zip(rows, texts, strict=True):
        gone = set()
        for s in range(len(b) - size + 1):
            if seen[b[s : s + size]] > 1:
                gone |= set(range(s, s + size))
        kept, at = b"", 0
        while at < len(b):
            end = at
            while end in gone:
                end += 1
            if end == at:
                kept, at = kept + b[at : at + 1], at + 1
            else:
                if len(b[at:end].split()) < words and end - at < whole:
                    kept += b[at:end]
                at = end
        out[i] = kept.decode(errors="replace")
    return out


def test_only_long_passages_go(spark):
    r = random.Random(5)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(n))
    passages = [text(20), text(51), text(52), text(60), text(80), "x" * 210, "y" * 401, text(300)]
    rows = [(k, f"{text(r.randint(1, 90))} {passages[k % 8]} {text(r.randint(0, 50))}") for k in range(32)] + [(40, None), (41, "")]
    df = spark.createDataFrame([(i, t, len(t or ""), 1, 2, 3) for i, t in rows], "doc_id long, text string, n_chars long, id int, dk int, `row.x` int").repartition(5)
    got = remove_repeats(df, 100, 32, 51)
    assert got.columns == df.columns
    want = few_words(rows, 100, 51, 400)
    for x in got.collect():
        assert (x.text or "") == want[x.doc_id] and x.n_chars == len(want[x.doc_id]) and tuple(x)[3:] == (1, 2, 3)
        p = passages[x.doc_id % 8]
        if x.doc_id < 32:
            assert (p in x.text) == (len(p.split()) < 51 and len(p) < 400)


def test_a_common_anchor_is_parted_by_what_stands_beside_it(spark, monkeypatch):
    size, gram = 40, 12
    r = random.Random(11)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    common, before, after = text(18), text(30), text(30)
    rows = [(k, text(60) + common + text(60)) for k in range(40)]
    rows += [(100 + k, text(20) + before + common + text(50)) for k in range(2)] + [(200 + k, text(50) + common + after + text(20)) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # no string need be told to other units, as no three contexts share a half
    monkeypatch.setattr(substring_dedup, "_late_differ", lambda *_: pytest.fail("units told each other strings"))
    want = {(i, n, s, d) for i, _, n, s, d in brute(rows, size) if n}
    assert {i for i, *_ in want} == {100, 101, 200, 201}
    assert {(x.id, x.n_removed, x.n_spans, x.kept_sha256) for x in cut_repeats(df, size, gram, 3).collect()} == want


def test_a_unit_of_contexts_is_told_in_little_memory():
    r = random.Random(12)
    left, gram, near, n = 272, 128, 136, 4096
    middle = bytes(r.choices(range(97, 123), k=near + gram))
    rows = [bytes(r.choices(range(97, 123), k=left - near)) + middle + bytes(r.choices(range(97, 123), k=left)) for _ in range(n)]
    columns = [[1] * n, list(range(n)), [2] * n, [0] * n, [left * 2] * n, rows]
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 5 + [pa.binary()], strict=True)], ["h", "c", "half", "part", "left", "bytes"])
    tracemalloc.start()
    told = sum(len(x.column(3).flatten()) for x in _repeats(400, gram, n)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert told == n * (near + 1) and peak < 120 << 20
