import json
import random

from lacuna.llm import chat as H

SCHEMA = "conv_id long, turn long, role string, text string, status string, id string"


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "s", "i") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in H.format_chat(df, **more).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def test_results_follow_their_calls(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 4, "tool", result("a", "sunny")), (1, 1, "assistant", call(("a", "get_weather", {"days": 2, "city": "Rom"}), ("b", "search", {"query": "q"}))), (1, 2, "user", "more"), (1, 0 + 5, "tool", result("b", "none")),
        (2, 0, "tool", result("a", "1")), (3, 1, "assistant", call(("z", "search", {"query": "q"}))), (3, 0, "tool", result("z", "early")),
    ]
    got = run(spark, rows)
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in got] == [
        (1, 0, 0, None, "ok"), (1, 1, 1, None, "ok"), (1, 4, 2, 1, "ok"), (1, 5, 3, 1, "ok"), (1, 2, 4, None, "ok"), (2, 0, 0, None, "orphan"), (3, 1, 0, None, "ok"), (3, 0, 1, 1, "ok"),
    ]


def test_messages_are_canonical_json(spark):
    got = run(spark, [(1, 0, "assistant", call(("a", "search", {"query": "é\"\n", "limit": 3}), content="look")), (1, 1, "tool", result("a", "x")), (1, 2, None, None), (1, 3, "user", "a/b \\ \t ")])
    for r in got:
        value = json.loads(r[5])
        assert r[5] == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(json.loads(got[0][5])["tool_calls"][0]["arguments"]) == {"limit": 3, "query": 'é"\n'}
    assert got[0][5].index('limit') < got[0][5].index('query')
    assert json.loads(got[2][5]) == {"content": None, "role": None}


def test_arguments_are_validated(spark):
    cases = [
        ({"query": "q"}, "no_result"), ({}, "invalid: missing query"), ({"query": 1}, "invalid: query is not string"), ({"query": "q", "limit": "x"}, "invalid: limit is not integer"), ({"query": "q", "limit": 2.5}, "invalid: limit is not integer"),
        ({"query": "q", "limit": None}, "invalid: limit is not integer"), ({"query": None}, "invalid: query is not string"), ({"query": ["q"]}, "invalid: query is not string"), ({"query": "q", "other": 1}, "no_result"),
    ]
    rows = [(i, 0, "assistant", call(("c", "search", a))) for i, (a, _) in enumerate(cases)]
    rows.append((99, 0, "assistant", call(("c", "nothing", {}))))
    got = [r[4] for r in run(spark, rows)]
    assert got == [w for _, w in cases] + ["invalid: unknown tool"]


def test_repeated_identifiers_long_and_broken(spark):
    rows = [(1, 0, "assistant", call(("a", "search", {"query": "1"}))), (1, 1, "tool", result("a", "r")), (1, 2, "assistant", call(("a", "search", {"query": "2"}))), (1, 3, "tool", result("a", "s"))]
    rows += [(None, 0, "assistant", call(("n", "search", {"query": "1"}))), (None, 1, "tool", result("n", "r")), (4, 0, "assistant", "{broken"), (4, 1, "tool", "{broken"), (4, 2, "user", "y" * 200_000), (4, 2, "user", "y" * 200_000), (4, None, "user", "")]
    got = run(spark, rows)
    assert [(r[1], r[3]) for r in got if r[0] == 1] == [(0, None), (1, 0), (3, 0), (2, None)]
    assert [r[4] for r in got if r[0] is None] == ["ok", "orphan"]  # without a conversation nothing is looked for
    assert [r[2] for r in got if r[0] == 4] == [0, 1, 2, 3, 4]
    assert run(spark, []) == []


def test_positions_do_not_depend_on_segments(spark, monkeypatch):
    monkeypatch.setattr(H, "SEGMENT", 4)
    r = random.Random(1)
    turns = r.sample(range(1000), 100)
    got = run(spark, [(1, t, "user", str(t)) for t in turns])
    assert [(x[1], x[2]) for x in got] == [(t, i) for i, t in enumerate(sorted(turns))]
