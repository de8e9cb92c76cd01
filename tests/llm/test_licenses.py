import hashlib
import re
from pathlib import Path

import pytest

from lacuna.llm import licenses as L


def brute(text):
    lines = []
    for line in (text or "").lower().split("\n"):
        w = " " + re.sub(r"[^\w]+|_+", " ", line).strip() + " "
        w = re.sub(r" +", " ", w)
        for a, b in L.SPELLINGS:
            w = w.replace(f" {a} ", f" {b} ")
        w = w.strip()
        if w and not re.match(r"(copyright( c)? [0-9]|c [0-9]{4}|all rights reserved)", w):
            lines.append(w)
    return lines


MIT = next(t for i, t in L.KNOWN if i == "MIT" and len(t) > 200)


def test_equals_brute_force(spark):
    texts = [
        MIT, MIT.upper(), "Copyright (c) 2024 Someone\n\n" + MIT, "(c) 2001 x\r\n" + MIT.replace(". ", ".\n   "), MIT.replace("license", "licence"), MIT + " more", "words\n  Released under the MIT Licence!\nmore\nLicensed under CC BY-NC 4.0",
        "RELEASED UNDER THE MIT LICENSE", "All rights reserved.", "", None, " \n\n ", "Released under the MIT License. And more", "é" * 100_000, "Released under the MIT License.\n" * 3000,
    ]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(3, texts[3], "x", "y"), (None, "Released under the MIT License.", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string, digest string")
    known = {}
    for i, t in sorted(L.KNOWN):
        known.setdefault(" ".join(brute(t)), i)
    assert not {hashlib.sha256(k.encode()).hexdigest() for k in known} & {d for _, d in L.DIGESTS}
    want = []
    for i, t, *_ in rows:
        lines = brute(t)
        whole = " ".join(lines)
        want.append((i, hashlib.sha256(whole.encode()).hexdigest(), known.get(whole), ",".join(sorted({known[x] for x in lines if x in known}))))
    got = L.license_scan(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    by = {r.doc_id: r.license for r in got}
    assert [by[i] for i in range(6)] == ["MIT"] * 5 + [None]


def test_own_list_and_empty_table(spark):
    df = spark.createDataFrame([(1, "House rules"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.license for r in L.license_scan(df, [("Own", "house  RULES"), ("Blank", "")]).collect()} == {1: "Own", 2: None}
    assert L.license_scan(df, []).count() == 2
    assert L.license_scan(df.limit(0)).collect() == []


def test_every_known_whole_text_is_found(spark):
    """Each known text alone and under a copyright line, respelled, and with another word."""
    long = [(i, t) for i, t in L.KNOWN if len(t) > 200]
    rows = [(k, f"Copyright (c) 2019, Somebody\nAll rights reserved.\n\n{t.replace(' ', '  ').replace('.', ' .')}") for k, (_, t) in enumerate(long)]
    rows += [(100 + k, re.sub(r"\blicense\b", "licence", t)) for k, (_, t) in enumerate(long)] + [(200 + k, t + " But not here.") for k, (_, t) in enumerate(long)]
    got = {r.doc_id: r.license for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (i, _) in enumerate(long):
        assert (got[k], got[100 + k], got[200 + k]) == (i, i, None)
    assert {i for i, _ in long} == {"MIT", "ISC", "Zlib", "BSD-2-Clause", "BSD-3-Clause", "Unlicense"}


def test_digest_tables(spark):
    here = Path("/usr/share/common-licenses")
    if not (here / "MPL-2.0").exists():
        pytest.skip("no published licence texts on this machine")
    files = [(k, (here / f).read_text(errors="replace")) for k, f in enumerate(("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "BSD"))]
    docs = spark.createDataFrame(files + [(50, files[0][1].upper()), (51, files[1][1][:-200])], "doc_id long, text string")
    want = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "BSD-3-Clause"]
    got = {r.doc_id: r.license for r in L.license_scan(docs).collect()}
    assert [got[k] for k in range(7)] == want and got[50] == "Apache-2.0" and got[51] is None
    own = L.read_texts(spark.createDataFrame([("Mine", files[2][1]), ("Blank", " ")], "license string, text string"))
    got = {r.doc_id: r.license for r in L.license_scan(docs, [], own).collect()}
    assert got[2] == "Mine" and got[0] is None
