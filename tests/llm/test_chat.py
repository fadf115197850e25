import json

import duckdb
from pyspark.sql import functions as F

from codexlake.llm import chat as C

SCHEMAS = {"find": {"q": (("string",), True), "n": (("number",), False)}, "sum": {"xs": (("array",), True)}}


def call(i, name, args, after=()):
    return {"id": i, "name": name, "arguments": args, "after": list(after)}


def rows():
    calls = [call("a", "find", {"q": "é\"\n", "n": 2}), call("b", "find", {"n": "2"}), call("c", "sum", {"xs": [2, 1], "deep": {"z": 1, "a": 2}}, ["a", "b"]), call("d", "sum", {"xs": []}, ["c", "gone"])]
    return [
        (1, 1, "assistant", json.dumps({"tool_calls": calls[:2]})), (1, 3, "assistant", json.dumps({"tool_calls": calls[2:]})), (1, 4, "tool", json.dumps({"tool_call_id": "c", "content": "3"})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "first"})), (1, 5, "tool", json.dumps({"tool_call_id": "a", "content": "again"})), (1, 6, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})),
        (2, 1, "assistant", json.dumps({"tool_calls": [call("a", "find", {"q": "x"}, ["b"]), call("b", "nope", {}, ["a"]), call("k", "find", None)]})),
        (3, 1, "user", None), (3, 2, "assistant", "tool_call {broken"), (None, None, None, "tool_call"),
    ]


def test_links(spark):
    messages = spark.createDataFrame([(*r, 1) for r in rows()], "conv_id long, turn long, role string, text string, level int")
    got = {(r.conv_id, r.call_id): r for r in C.link(*C.tool_messages(messages), SCHEMAS).collect()}
    assert len(got) == 8
    level = {k: v.level for k, v in got.items()}
    assert [level[1, x] for x in "abcd"] == [0, 0, 1, 2] and level[2, "a"] is None and level[2, "b"] is None and level[2, "k"] == 0
    assert {k: v.status for k, v in got.items() if k[0] == 1} == {(1, "a"): "linked", (1, "b"): "unanswered", (1, "c"): "linked", (1, "d"): "unanswered", (1, "zz"): "orphan"}
    assert got[1, "a"].errors == "" and got[1, "b"].errors == "wrong type n; missing q" and got[1, "c"].errors == "unexpected deep"
    assert got[2, "b"].errors == "unknown tool nope" and got[2, "k"].errors == "malformed arguments" and got[1, "a"].n_results == 2
    assert got[1, "c"].json == '{"arguments":{"deep":{"a":2,"z":1},"xs":[2,1]},"id":"c","name":"sum","result":"3"}'
    for r in got.values():
        said = json.loads(r.json)
        assert r.json == json.dumps(said, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(got[1, "a"].json)["result"] == "first" and json.loads(got[1, "a"].json)["arguments"]["q"] == 'é"\n'


def test_levels_of_a_long_chain_and_a_cycle(spark):
    chain = [(1, str(i), [str(i - 1)]) for i in range(200)] + [(2, "x", ["y"]), (2, "y", ["x"]), (3, "z", ["z"])]
    got = {(r.conv_id, r.call_id): r.level for r in C.levels(spark.createDataFrame(chain, "conv_id long, call_id string, after array<string>")).collect()}
    assert all(got[1, str(i)] == i for i in range(200)) and got[2, "x"] is None and got[3, "z"] is None


def test_dialogue_against_sql(spark):
    turns = [(1, 0, "system", "be\tgood"), (1, 1, "user", 'say "hi"\n'), (1, 2, "assistant", "hi é"), (1, 3, "user", "more"), (1, 4, "assistant", "x"), (1, 5, "user", "end"), (2, 3, "assistant", "alone"), (2, 3, "assistant", "alone"), (2, 9, "user", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    c = duckdb.connect()
    c.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    rel = c.sql(C.ORACLE)
    got = C.digest(df).select(*rel.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rel.fetchall(), key=str)
    assert C.digest(df.limit(0)).count() == 0


def test_talk_of_tool_calls_is_dialogue(spark):
    said = json.dumps({"tool_calls": [call("a", "find", {"q": "x"})]})
    turns = [
        (1, 1, "user", "what is a tool_call?"), (1, 2, "assistant", 'a tool_call is {"tool_call_id": ...}'), (1, 3, "user", '{"tool_calls": [{"id": '), (1, 4, "assistant", "that is cut off"),
        (1, 5, "user", '{"tool_calls": []}'), (1, 6, "assistant", '{"tool_call_id": null, "content": "x"}'), (1, 7, "user", '["tool_call_id"]'),
    ]
    schema = "conv_id long, turn long, role string, text string"
    c = duckdb.connect()
    c.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    rel = c.sql(C.ORACLE)
    got = C.digest(spark.createDataFrame(turns, schema)).select(*rel.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rel.fetchall(), key=str)
    tools = [(2, 1, "assistant", said), (2, 2, "tool", json.dumps({"tool_call_id": "a", "content": "3"}))]
    assert [(r.call_id, r.status) for r in C.digest(spark.createDataFrame(tools, schema)).collect()] == [("a", "linked")]


def test_levels_by_frontier(spark):
    """Branching calls beside a cycle: rounds follow the depth, not the number of edges; what a cycle leads to has no level."""
    import os

    from codexlake.llm.common import shared_dir

    calls = [("c", f"x{k}", [f"x{k // 2}", f"x{k // 3}"] if k else []) for k in range(500)] + [("c", "p", ["q", "x3"]), ("c", "q", ["p"]), ("c", "r", ["q"]), ("d", "p", ["gone", "p2"]), ("d", "p2", None)]
    df = spark.createDataFrame([(c, i, a) for c, i, a in calls], "conv_id string, call_id string, after array<string>").withColumn("after", F.coalesce("after", F.array().cast("array<string>")))
    before = len(os.listdir(shared_dir(spark).removeprefix("file:")))
    got = {(r.conv_id, r.call_id): r.level for r in C.levels(df).collect()}
    depth = {0: 0}
    for k in range(1, 500):
        depth[k] = 1 + max(depth[k // 2], depth[k // 3])
    assert got == {("c", f"x{k}"): depth[k] for k in range(500)} | {("c", "p"): None, ("c", "q"): None, ("c", "r"): None, ("d", "p"): 1, ("d", "p2"): 0}
    assert len(os.listdir(shared_dir(spark).removeprefix("file:"))) - before <= 2 * (max(depth.values()) + 3)
