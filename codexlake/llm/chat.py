"""Chat formatting by tool-call linking.

Calls and results meet by a hash join on (conversation, identifier); calls are ordered topologically over what they
come after; arguments are checked against schemas; each linked call is serialised as canonical JSON: keys in Spark's
order of variant keys, no blanks, numbers as Spark's to_json writes them.

Scale: native columns, one grouping per side and one join; the row is a call, never a whole conversation, so a hot
conversation is only many rows. Identifiers that occur again are brought together before the join, so no identifier
pairs all with all. Levels come from pointer doubling while every call comes after one at most (rounds: the logarithm
of the longest chain), else from rounds that place what comes after placed calls only (rounds: the longest path and one
more, cycles or not); each round is written to the shared folder. Schemas are literals of the plan.

Defined cases: of repeated calls or results with one identifier the first by turn (then by content) counts and the
number is told; a call without a result is `unanswered`, a result without a call is `orphan`; a call after unknown
identifiers stands as if they were not named; calls on a cycle have no level; null or malformed arguments are invalid
and serialised as null; a text that does not parse as a tool message is dialogue; a null identifier links to nothing; a text of any length is one row
of its scan; empty tables give no rows; further columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.llm.common import written

#: Schema: parameter -> (kinds of JSON values, required).
Schema = dict[str, tuple[tuple[str, ...], bool]]
REPLY: dict[str, Schema] = {"reply": {"prompt": (("string",), True), "turn": (("number",), True)}}
_KINDS = {"string": "STRING", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY<.*>", "object": "OBJECT<.*>", "null": "VOID"}


def argument_errors(name: Column, arguments: Column, schemas: dict[str, Schema]) -> Column:
    """What is wrong with a call's JSON arguments under the schema of its name, as an array of sayings in order."""
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    whole = F.when(~F.array_contains(F.array(*(F.lit(n) for n in schemas)), F.coalesce(name, F.lit(""))), F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    whole = whole.when(parsed.isNull() | keys.isNull(), "malformed arguments")
    out = F.array().cast("array<string>")
    for tool, schema in schemas.items():
        said = []
        for p, (kinds, required) in sorted(schema.items()):
            value = F.try_variant_get(parsed, f"$.{p}", "variant")
            kind = F.schema_of_variant(value)
            pattern = "^(" + "|".join(_KINDS[k] for k in kinds) + ")$"
            said.append(F.when(~F.array_contains(keys, p), F.lit(f"missing {p}") if required else F.lit(None)).when(~kind.rlike(pattern), F.lit(f"wrong type {p}")))
        more = F.transform(F.array_sort(F.array_except(keys, F.array(*(F.lit(p) for p in schema)))), lambda k: F.concat(F.lit("unexpected "), k))
        out = F.when(name == tool, F.concat(F.array_compact(F.array(*said)), more)).otherwise(out)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(out)


def canonical(value: Column) -> Column:
    """A JSON text in canonical form; null if it is none."""
    return F.to_json(F.try_parse_json(value))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, after array<string>): 0 for calls after none; null on cycles and behind them."""
    ids = calls.select("conv_id", "call_id").where("conv_id IS NOT NULL AND call_id IS NOT NULL").distinct()
    wanted = calls.select("conv_id", "call_id", F.explode("after").alias("dep")).distinct()
    edges = written(wanted.join(ids.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"]), "call-edges")
    chain = not edges.groupBy("conv_id", "call_id").count().where("count > 1").limit(1).count()
    rounds, limit = 0, max(1, edges.count())
    if chain:
        # (pointer, steps): doubled until all pointers are at a start; 2^rounds beyond the number of edges means a cycle
        at = ids.join(edges, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.col("dep").alias("ptr"), F.when(F.col("dep").isNull(), 0).otherwise(1).cast("long").alias("level"))
        at = written(at, "levels")
        while at.where("ptr IS NOT NULL").limit(1).count() and 2 ** (rounds - 1) <= limit:
            to = at.select("conv_id", F.col("call_id").alias("ptr"), F.col("ptr").alias("next"), F.col("level").alias("more"))
            at = written(at.join(to, ["conv_id", "ptr"], "left").select("conv_id", "call_id", F.col("next").alias("ptr"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
            rounds += 1
        return at.select("conv_id", "call_id", F.when(F.col("ptr").isNull(), F.col("level")).alias("level"))
    # a call is placed in the round after the last call that it comes after; what is never placed is on a cycle or behind one
    waiting = edges.select("conv_id", "call_id").distinct()
    front = placed = written(ids.join(waiting, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("long")), "levels")
    while not front.isEmpty():
        done = front.select("conv_id", F.col("call_id").alias("dep"))
        freed = edges.join(done, ["conv_id", "dep"], "left_semi").select("conv_id", "call_id").distinct()
        edges = written(edges.join(done, ["conv_id", "dep"], "left_anti"), "call-edges")
        rounds += 1
        front = written(freed.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(rounds).cast("long")), "levels")
        placed = placed.unionByName(front)
    return ids.join(placed, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "level")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """One row for each identifier: calls (conv_id, turn, call_id, name, arguments, after), results (conv_id, turn, call_id, content)."""
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    first = F.min(F.struct("turn", "name", "arguments", "after"))
    own = calls.groupBy("conv_id", "call_id").agg(first.alias("call"), F.count("*").alias("n_calls"))
    got = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("result"), F.count("*").alias("n_results"))
    both = own.join(got, ["conv_id", "call_id"], "full").join(levels(calls), ["conv_id", "call_id"], "left")
    status = F.when(F.col("call").isNull(), "orphan").when(F.col("result").isNull(), "unanswered").otherwise("linked")
    errors = F.when(F.col("call").isNull(), F.array().cast("array<string>")).otherwise(argument_errors(F.col("call.name"), F.col("call.arguments"), schemas))
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    null = F.lit("null")
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("call.arguments")), null), F.lit(',"id":'), F.coalesce(text(F.col("call_id")), null),
        F.lit(',"name":'), F.when(F.col("call.name").isNull(), null).otherwise(text(F.col("call.name"))), F.lit(',"result":'), F.when(F.col("result.content").isNull(), null).otherwise(text(F.col("result.content"))), F.lit("}"),
    )
    return both.select(
        "conv_id", "call_id", F.col("call.turn").alias("call_turn"), F.col("result.turn").alias("result_turn"), "level", status.alias("status"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.array_join(errors, "; ").alias("errors"), json.alias("json"),
    )


def _said(text: Column) -> Column:
    """What a text says as a tool message; null for all other texts, those that only talk of tool calls or are malformed among them."""
    kind = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>,tool_call_id:string,content:string>"
    said = F.when(text.contains("tool_call"), F.from_json(text, kind))
    return F.when((F.size(said["tool_calls"]) > 0) | said["tool_call_id"].isNotNull(), said)


def tool_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results written in messages (conv_id, turn, role, text): {"tool_calls": [{id, name, arguments, after}]} and {"tool_call_id", "content"}."""
    said = messages.withColumn("said", _said(F.col("text"))).where("said IS NOT NULL")
    calls = said.where("said.tool_calls IS NOT NULL").select("conv_id", "turn", F.explode("said.tool_calls").alias("c"))
    calls = calls.select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after"))
    results = said.where("said.tool_call_id IS NOT NULL").select("conv_id", "turn", F.col("said.tool_call_id").alias("call_id"), F.col("said.content").alias("content"))
    return calls, results


def dialogue(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A plain dialogue as calls: what is asked in a turn is answered in the next, and comes after what was asked two turns before."""
    name = lambda turn: F.concat_ws("-", F.lit("turn"), turn)
    asked = messages.where("role <> 'assistant'").select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt"))).alias("arguments"), F.array(name(F.col("turn") - 2)).alias("after"),
    )
    return asked, messages.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))


def digest(messages: DataFrame) -> DataFrame:
    """Dialogue turns and tool messages of a whole table, linked."""
    messages = messages.select("conv_id", "turn", "role", "text")
    pairs = [tool_messages(messages), dialogue(messages.where(_said(F.col("text")).isNull()))]
    return link(pairs[0][0].unionByName(pairs[1][0]), pairs[0][1].unionByName(pairs[1][1]), REPLY)


ORACLE = """
WITH RECURSIVE asked AS (
  SELECT conv_id, turn, 'turn-' || turn AS call_id, min(text) AS text, count(*) AS n FROM conversations WHERE role <> 'assistant' GROUP BY conv_id, turn
), answered AS (
  SELECT conv_id, turn, 'turn-' || (turn - 1) AS call_id, min(text) AS text, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn
), deep AS (
  SELECT conv_id, turn, 0::BIGINT AS level FROM asked a WHERE NOT EXISTS (SELECT 1 FROM asked b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 2)
  UNION ALL
  SELECT a.conv_id, a.turn, d.level + 1 FROM deep d JOIN asked a ON a.conv_id = d.conv_id AND a.turn = d.turn + 2
)
SELECT coalesce(a.conv_id, r.conv_id) AS conv_id, coalesce(a.call_id, r.call_id) AS call_id, a.turn AS call_turn, r.turn AS result_turn, d.level,
       CASE WHEN a.turn IS NULL THEN 'orphan' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       coalesce(a.n, 0) AS n_calls, coalesce(r.n, 0) AS n_results, '' AS errors,
       '{"arguments":' || CASE WHEN a.turn IS NULL THEN 'null' ELSE '{"prompt":' || to_json(a.text)::VARCHAR || ',"turn":' || a.turn || '}' END || ',"id":"' || coalesce(a.call_id, r.call_id)
       || '","name":' || CASE WHEN a.turn IS NULL THEN 'null' ELSE '"reply"' END || ',"result":' || CASE WHEN r.turn IS NULL THEN 'null' ELSE to_json(r.text)::VARCHAR END || '}' AS json
FROM asked a FULL JOIN answered r ON a.conv_id = r.conv_id AND a.call_id = r.call_id
LEFT JOIN deep d ON d.conv_id = a.conv_id AND d.turn = a.turn
"""
