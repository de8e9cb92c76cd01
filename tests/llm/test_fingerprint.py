import base64
import hashlib
import random
import re

import numpy as np
import pytest

from lacuna.llm import fingerprint as P
from lacuna.llm._text import BASE, RAW


def words(line):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", line) if w]


def print_of(text):
    """The fingerprint as plain sums over paragraphs: digests, and each three words in a row with a sign in a place."""
    wide, m = [0] * (P.DENSE + P.SKETCH), (1 << 64) - 1

    def mixed(x):
        for _ in range(2):
            x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & m
        return x ^ (x >> 32)

    for line in text.encode().split(b"\n"):
        if not line:
            continue
        digest = hashlib.blake2b(line).digest()
        for k in range(P.DENSE):
            wide[k] += digest[2 * k] + 256 * digest[2 * k + 1]
        hashes = [mixed(sum(int(RAW[c]) * BASE**i for i, c in enumerate(w)) & m ^ len(w)) for w in words(line)]
        q = 0xC2B2AE3D27D4EB4F
        if len(hashes) >= 3:
            runs = [mixed(sum(h * q**i for i, h in enumerate(hashes[k : k + 3])) & m) for k in range(len(hashes) - 2)]
        else:
            runs = [mixed(sum(h * q**i for i, h in enumerate(hashes)) + q**3 * len(hashes) & m)] if hashes else []
        for h in runs:
            wide[P.DENSE + h % P.SKETCH] += 1 if h >> 40 & 1 else -1
    return [x % (1 << 32) for x in wide]


def signed(x):
    return (x + (1 << 31)) % (1 << 32) - (1 << 31)


def likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([signed(v) for v in p[P.DENSE :]] for p in (a, b))
    gap = [signed((u - v) % (1 << 32)) for u, v in zip(a[P.DENSE :], b[P.DENSE :], strict=True)]
    total = sum(v * v for v in x + y)
    return min(1.0, max(0.0, 1 - sum(g * g for g in gap) / total)) if total else 0.0


def encoded(wide):
    return base64.b64encode(b"".join(v.to_bytes(4, "little") for v in wide)).decode()


def brute(rows):
    rows = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        a, b, c = print_of(t), print_of(edited), print_of(after)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), encoded(a), encoded(b), round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 40])
def test_equals_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 3)
    r = random.Random(n)
    line = lambda: " ".join("".join(r.choice("abcé🙂") for _ in range(4)) for _ in range(r.randint(0, 12)))
    rows = [(k * 7 - 20, "\n".join(line() for _ in range(r.randint(0, 9)))) for k in range(n)]
    if n > 2:
        rows += [(None, "null id"), (None, None), (1, None), (1, ""), (8, rows[3][1]), (8, rows[3][1]), (1 << 60, "x\n" * 3000)]
    df = spark.createDataFrame([(d, t, 0, True) for d, t in rows], "doc_id long, text string, bucket int, halo boolean").repartition(4)
    got = [(*tuple(x)[:5], round(x.near_edited, 9), round(x.near_next, 9)) for x in P.compare_with_next(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(spark):
    assert P.compare_with_next(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_order_insertion_and_deletion():
    lines = [f"line {i} with words {i * i}" for i in range(30)]
    whole = P.encode(P.vectors(["\n".join(lines).encode()]))[0]
    assert P.encode(P.vectors(["\n".join(reversed(lines)).encode()]))[0] == whole
    part = P.encode(P.vectors(["\n".join(lines[:20]).encode()]))[0]
    assert P.change(part, added=lines[20:]) == whole
    assert P.change(whole, removed=lines[20:]) == part
    assert P.encode(P.vectors(["\n".join([*lines, lines[0]]).encode()]))[0] != whole


def test_likeness_follows_shared_content():
    lines = [" ".join(f"w{i}_{j}" for j in range(20)) for i in range(40)]
    a = P.vectors(["\n".join(lines).encode()])
    share = [float(P.likeness(a, P.vectors([("\n".join(lines[:k] + [x + " changed" * 20 for x in lines[k:]][:0]) or "-").encode()]))[0]) for k in (40, 30, 20, 5)]
    assert share[0] == 1 and share == sorted(share, reverse=True) and share[-1] < 0.5
    other = P.vectors(["\n".join(" ".join(f"v{i}_{j}" for j in range(20)) for i in range(40)).encode()])
    assert P.likeness(a, other)[0] < 0.2
    assert np.isfinite(P.likeness(P.vectors([b""]), a)).all() and P.likeness(P.vectors([b""]), P.vectors([b""]))[0] == 1


def test_many_repeats_do_not_wrap():
    a, b = (P.vectors([b"one two three\n" * n]) for n in (40_000, 20_000))
    assert P.likeness(a, b)[0] == pytest.approx(0.8)
