import random

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from lacuna.llm import decontaminate, queries
from lacuna.llm._store import materialise

from .test_near_dedup import brute as components
from .test_substring_dedup import few_words

DIR = "/root/testdata/sf0.001"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinsh") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(materialise(f(spark, out[-1], DIR)))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontaminate", "mixing"]
    assert all(d.columns == stages[0].columns and dict(d.dtypes) == dict(stages[0].dtypes) for d in stages[1:-1])


def test_quality_keeps_what_scores_well(spark, stages):
    good = {r.doc_id for r in queries.op8_quality(spark, DIR).collect() if r.predicted}
    assert {r.doc_id for r in stages[1].collect()} == good


def test_near_duplicates_leave_one(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(i for i, _, _, kept in components(rows) if kept)


def test_repeats_are_cut(stages):
    want = few_words([(r.doc_id, r.text) for r in stages[2].collect()], 200, 51, 400)
    after = {r.doc_id: r for r in stages[3].collect()}
    assert after.keys() == want.keys()
    assert all((r.text or "").replace("�", "") == want[i].replace("�", "") for i, r in after.items())
    assert all(len(r.text) == r.n_chars for r in after.values())


def test_repeated_passages_below_400_bytes_go(spark):
    """Passages of over 50 words in documents that are no copies of each other, and what stays of clean ones."""
    rows = [(k, f"{words(60, 3 * k)} {words(51 + k % 4, 900 + k % 4)} {words(80, 3 * k + 1)}") for k in range(24)] + [(50 + k, words(150, 500 + k)) for k in range(6)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.substring_dedup_stage(spark, docs, DIR).collect()}
    for i, t in rows:
        assert words(51 + i % 4, 900 + i % 4) not in got[i] and (i < 50 or got[i] == t)


def test_leaks_go(spark, stages):
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    left = {r.doc_id for r in stages[4].collect()}
    for r in stages[3].collect():
        if any(i and i in decontaminate.normalise(r.text) for i in items):
            assert r.doc_id not in left
    assert len(left) >= 0.8 * stages[3].count()


def test_run_mixes_what_is_left(spark, stages):
    got = sorted(map(tuple, corpus_pipeline.run(spark, DIR).collect()))
    assert got == sorted(map(tuple, stages[-1].collect()))


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def least_edits(pattern, text):
    """Edit distance between the pattern and its best substring, column by column."""
    code = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    text, ramp = code(text), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for c in code(pattern):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != c))
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


def test_leaks_equal_brute_force(spark, stages):
    """A passage of m characters is held with at most a tenth of edits, or (m - 8) / 8 where that is less."""
    flat = lambda t: " ".join((t or "").lower().split())
    items = [flat(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()][:12]
    rows = [(r.doc_id, flat(r.text)) for r in stages[3].collect()]
    items = [i for i in items if i]
    docs = [(r.doc_id, r.text) for r in stages[3].collect()]
    for k, p in enumerate(items):  # planted with more and more characters changed
        every = max(2, 60 // (k + 1))
        docs.append((10_000 + k, f"{rows[k][1][:500]} {''.join('#' if i % every == 1 else c for i, c in enumerate(p))} {rows[k + 1][1][:300]}"))
    rows += [(i, flat(t)) for i, t in docs[len(rows) :]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    kept = {r.doc_id for r in decontaminate.drop_leaked(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    want = {i for i, t in rows if not any(least_edits(p, t) <= min(len(p) // 10, (len(p) - 8) // 8) for p in items)}
    assert kept == want and len(rows) - 10 < len(want) < len(rows) - 2


ODD = "doc_id long, text string, lang string, source string, n_chars long, id long, dk long, rep long, score double, `a.b` string, row string"


def odd_rows():
    """Nulls in every column, empty, blank and long texts, repeated rows and names that operators use themselves."""
    prose = [words(120, 7000 + k) for k in range(12)]
    rows = [(k, t, "en", "web", len(t), k, -k, 5, 0.5, "x", "r") for k, t in enumerate(prose)]
    rows += [rows[2], rows[2], (None, prose[3], None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    rows += [(60, "", "en", "web", 0, 1, 1, 1, 1.0, "y", "r"), (61, " \n\t ", "en", "web", 4, 1, 1, 1, 1.0, "y", "r"), (4, words(90, 1), "en", None, 1, 1, 1, 1, 1.0, "y", "r")]
    return rows + [(62, "\n".join(words(12, 8000 + k) for k in range(9000)), "en", "long", 1, 1, 1, 1, 1.0, "y", "r")]


def test_odd_rows_pass_through_every_stage(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, DIR))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = sorted(map(tuple, out.collect()), key=str)
        if name == "near_dedup":
            assert [r[0] for r in got].count(2) == 1 and [r[0] for r in got].count(None) == 2
        elif name == "substring_dedup":
            # the text with no doc_id that equals another goes from both
            assert all(r[1] == "" for r in got if r[0] == 3 or r[0] is None and r[1] is not None)
            assert all(any(r[0] == x[0] and r[5:] == x[5:] for x in rows) for r in got)
        else:
            assert all(r in rows for r in got)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    assert len(mixed) == len(rows) and sum(r.size for r in mixed) == sum(len((t[1] or "").split()) for t in rows)


def test_empty_table_passes_through_every_stage(spark):
    docs = spark.createDataFrame([], ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).collect() == []


def test_run_with_odd_rows(spark, tmp_path):
    spark.createDataFrame(odd_rows(), ODD).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {r[0] for r in odd_rows()} and len(got) > 8
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
