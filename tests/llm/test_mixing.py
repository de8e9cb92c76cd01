import random
import re
from fractions import Fraction

import pytest

from lacuna.llm.mixing import mix_sources


def targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), cap=2):
    """Shares by weight, the excess over the cap shared out again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out = share * sum(sizes.values()), dict.fromkeys(names, Fraction(0))
    free = set(names)
    while total > 0 and free:
        each = total / sum(w[s] for s in free)
        add = {s: each * w[s] for s in free}
        over = {s for s in free if out[s] + add[s] >= cap * sizes[s]}
        for s in free:
            out[s] += add[s]
        total = Fraction(0)
        for s in over:
            total += out[s] - cap * sizes[s]
            out[s] = Fraction(cap * sizes[s])
        free -= over
    return out


def corpus(seed, sources):
    r = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(int(r.paretovariate(0.7)) % 3000)), r.choice(sources)) for i in range(300)]
    return rows + [(400, None, "a"), (401, "", "b"), (402, " \t\n", None), (7, "same id", "a"), (7, "same id", "a"), (None, "no id here", "Z"), (403, "x " * 50_000, "é"), (404, "only " * 3, "zz")]


@pytest.mark.parametrize("sources", [["a"] * 12 + ["b", "B", "é", "z", None, ""], ["a", "b", "c", "d"]])
def test_targets_and_takings(spark, sources):
    rows = corpus(len(sources), sources)
    df = spark.createDataFrame([(*x, 3, "q") for x in rows], "doc_id long, text string, source string, size int, bucket string")
    got = mix_sources(df.repartition(5)).collect()
    again = mix_sources(df.repartition(2)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((i, words(t)) for i, t, _ in rows), key=str)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]}
        assert own[0].target == pytest.approx(float(want[s]))
        assert abs(sum(r.taken for r in own) - float(want[s])) <= 0.5
    assert all(0 <= r.taken <= 2 * r.size for r in got)


def test_nothing_to_mix(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    got = mix_sources(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_one_source_and_small_blocks(spark):
    df = spark.createDataFrame([(i, "w " * i, "only") for i in range(50)], "doc_id long, text string, source string")
    for block in (1, 7, 256):
        got = mix_sources(df, block=block).collect()
        assert sum(r.taken for r in got) == round(1.5 * sum(range(50)))
