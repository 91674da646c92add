"""Chat formatting: tool calls linked with their results, in DataFrame functions only.

Calls and results are hash-joined by conversation and call identifier, calls are put in topological
order of the results that their arguments refer to (`${id}`), arguments are checked against the
tools' schemas, and messages are written as canonical JSON (keys sorted, no spaces).

Rows stay rows: no conversation is ever gathered, so one of any length is dealt out like the others.
Topological levels: chains of calls with one reference each are followed by pointer doubling (a chain
of 1,000 calls takes ten rounds); only calls with several references take a round for each layer of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.llm import common as C

#: Tools: parameter -> (type, required).  Types are those of schema_of_variant.
TOOLS = {"answer": {"chars": ("BIGINT", True), "sha256": ("STRING", True), "lines": ("BIGINT", True), "after": ("STRING", False)}}
_CALLS = "array<struct<id:string,name:string,arguments:string>>"


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no spaces; null for text that is no JSON."""
    return F.to_json(F.try_parse_json(json))


def argument_errors(name: Column, arguments: Column, tools: dict) -> Column:
    """Sorted list of what is wrong with a call's arguments: empty if nothing is."""
    v = F.try_parse_json(arguments)
    out = F.when(~F.coalesce(name.isin(list(tools)), F.lit(False)), F.array(F.lit("unknown tool")))
    out = out.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.array(F.lit("arguments are no object")))
    for tool, params in tools.items():
        found = []
        for p, (kind, required) in sorted(params.items()):
            own = F.schema_of_variant(F.try_variant_get(v, f"$.{p}", "variant"))
            absent = own.isNull() | (own == "VOID")
            found.append(F.when(absent, F.lit(f"{p} is missing") if required else F.lit(None)).when(own != kind, F.lit(f"{p} is no {kind}")))
        out = out.when(name == tool, F.array_compact(F.array(*found)))
    return out


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of messages whose text is JSON: {"tool_calls": [...]} and {"tool_call_id", "content"}."""
    json = messages.where(F.substring(F.ltrim("text"), 1, 1) == "{")
    calls = json.select("conv_id", "turn", F.explode(F.from_json(F.get_json_object("text", "$.tool_calls"), _CALLS)).alias("c")).select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
    results = json.select("conv_id", "turn", F.get_json_object("text", "$.tool_call_id").alias("call_id"), F.get_json_object("text", "$.content").alias("content"))
    return calls.where("call_id is not null"), results.where("call_id is not null")


def levels(calls: DataFrame) -> DataFrame:
    """calls with level: 0 without references, else one more than the deepest call they refer to.

    Null where a reference has no call or references run in a circle.  Arguments that are null, no
    JSON or very long are searched alike; an empty table gives an empty result; a column named level
    or refs is replaced.  conv_id and call_id together must be unique.
    """
    keys = ["conv_id", "call_id"]
    refs = F.array_distinct(F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit(r"\$\{([^}]*)\}"), F.lit(1)))
    nodes = C.materialise(calls.drop("level", "refs").withColumn("refs", refs), "calls")
    # chains: the nearest call before each that has no reference or several, and how far away it is
    step = C.materialise(nodes.where(F.size("refs") == 1).select(*keys, F.col("refs")[0].alias("to"), F.lit(1).cast("long").alias("far")), "step")
    left = None
    while True:
        next_ = step.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("further"), F.col("far").alias("more"))
        joined = C.materialise(step.join(next_, ["conv_id", "to"], "left"), "step")
        inside = joined.where("further is not null").count()
        step = joined.select(*keys, F.coalesce("further", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
        if inside in (0, left):  # what is left then runs in a circle, and its `to` has no level
            break
        left = inside
    edges = nodes.where(F.size("refs") > 1).select(*keys, F.size("refs").alias("n"), F.explode("refs").alias("ref"))
    via = step.select("conv_id", F.col("call_id").alias("ref"), "to", "far")
    edges = C.materialise(edges.join(via, ["conv_id", "ref"], "left").select(*keys, "n", F.coalesce("to", "ref").alias("to"), F.coalesce("far", F.lit(0)).alias("far")), "edges")
    first = nodes.where(F.size("refs") == 0).select(*keys, F.lit(0).cast("long").alias("level"))
    known, size = first, -1
    while (now := known.count()) != size and not edges.isEmpty():
        size = now
        parent = known.select("conv_id", F.col("call_id").alias("to"), "level")
        ready = edges.join(parent, ["conv_id", "to"]).groupBy(*keys, "n").agg(F.count("*").alias("k"), F.max(F.col("level") + F.col("far")).alias("deep")).where("k = n")
        known = C.materialise(first.unionAll(ready.select(*keys, (F.col("deep") + 1).alias("level"))), "levels")
    on_chain = step.join(known.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"]).select(*keys, (F.col("level") + F.col("far")).alias("level"))
    return nodes.drop("refs").join(known.unionAll(on_chain), keys, "left")


def link(calls: DataFrame, results: DataFrame, tools: dict) -> DataFrame:
    """One row for each call and each result without a call, in topological order within a conversation.

    Columns: conv_id, call_id, turn, kind (call or orphan_result), name, level, linked, errors, json.
    Of several calls or results of one identifier the first turn counts; n_calls and n_results say
    how many there were.  Null identifiers link with nothing and are left out.  Rows are sorted by
    conversation, level (null last), turn and identifier: a distributed sort.  Null names are unknown
    tools, null arguments no object; repeated rows and ties of turn count as one call, the smaller
    name and arguments first; very long arguments are kept whole; empty tables give an empty result;
    other columns are ignored.
    """
    keys = ["conv_id", "call_id"]
    one = calls.where("call_id is not null and conv_id is not null").groupBy(*keys).agg(F.min(F.struct("turn", "name", "arguments")).alias("c"), F.count("*").alias("n_calls")).select(*keys, "c.*", "n_calls")
    got = results.where("call_id is not null and conv_id is not null").groupBy(*keys).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    both = levels(one).withColumn("kind", F.lit("call")).join(got, keys, "full_outer").withColumn("kind", F.coalesce("kind", F.lit("orphan_result")))
    errors = F.when(F.col("kind") == "call", argument_errors(F.col("name"), F.col("arguments"), tools)).otherwise(F.array().cast("array<string>"))
    args = F.coalesce(canonical(F.col("arguments")), F.to_json(F.struct(F.col("arguments").alias("text"))))
    string = lambda c: F.substring(F.to_json(F.array(c)), 2, F.length(F.to_json(F.array(c))) - 2)
    text = F.when(F.col("kind") == "call", F.concat(F.lit('{"arguments":'), args, F.lit(',"id":'), string(F.col("call_id")), F.lit(',"name":'), F.coalesce(string(F.col("name")), F.lit("null")), F.lit(',"result":'), F.coalesce(F.when(F.col("r.content").isNotNull(), string(F.col("r.content"))), F.lit("null")), F.lit("}")))
    text = text.otherwise(F.concat(F.lit('{"content":'), F.coalesce(F.when(F.col("r.content").isNotNull(), string(F.col("r.content"))), F.lit("null")), F.lit(',"tool_call_id":'), string(F.col("call_id")), F.lit("}")))
    out = both.select(*keys, F.coalesce("turn", "r.turn").alias("turn"), "kind", "name", "level", F.col("r").isNotNull().alias("has_result"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), errors.alias("errors"), text.alias("json"))
    return out.orderBy("conv_id", F.col("level").asc_nulls_last(), "turn", "call_id")


def conversation_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls of the tool `answer`: each user turn is a call, the turn after it its result.

    A call names its text by length, line ends (left out where there are none) and digest, and refers
    to the call of the user turn two turns earlier, if there is one.
    """
    users = messages.where("role = 'user' and conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    earlier = users.select("conv_id", (F.col("turn") + 2).alias("turn")).distinct().withColumn("follows", F.lit(True))
    lines = F.length("text") - F.length(F.translate("text", "\n", ""))
    args = F.to_json(F.struct(F.when(F.col("follows"), F.concat(F.lit("${c"), F.col("turn") - 2, F.lit("}"))).alias("after"), F.length("text").alias("chars"), F.when(lines > 0, lines).alias("lines"), F.sha2("text", 256).alias("sha256")))
    calls = users.join(earlier, ["conv_id", "turn"], "left").select("conv_id", "turn", F.concat(F.lit("c"), "turn").alias("call_id"), F.lit("answer").alias("name"), args.alias("arguments"))
    results = messages.where("role = 'assistant' and conv_id is not null and turn is not null").select("conv_id", "turn", F.concat(F.lit("c"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations: calls that messages hold as JSON, and the turns themselves as calls of `answer`."""
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said, answered = parse_messages(messages)
    calls, results = conversation_calls(messages)
    out = link(calls.unionByName(said), results.unionByName(answered), TOOLS)
    return out.select("conv_id", "call_id", "turn", "kind", "name", "level", "has_result", "n_calls", "n_results", F.array_join("errors", "; ").alias("errors"), F.sha2("json", 256).alias("json_sha256"), F.length("json").cast("long").alias("json_chars"))


ORACLE = r"""
WITH u AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL),
t AS (SELECT DISTINCT conv_id, turn FROM u),
k AS (SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM t),
f AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS level FROM k),
x AS (SELECT *, length(text) - length(replace(text, chr(10), '')) AS lines FROM u),
c AS (SELECT conv_id, 'c' || turn AS call_id, min(turn) AS turn, count(*) AS n_calls,
        min('{' || CASE WHEN level > 0 THEN '"after":"${c' || (turn - 2) || '}",' ELSE '' END || '"chars":' || length(text) || CASE WHEN lines > 0 THEN ',"lines":' || lines ELSE '' END || ',"sha256":"' || sha256(text) || '"}') AS args,
        max(level) AS level
      FROM x JOIN f USING (conv_id, turn) GROUP BY conv_id, x.turn),
r AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, min(turn) AS turn, min(text) AS content, count(*) AS n_results
      FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, conversations.turn),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS turn,
        CASE WHEN c.conv_id IS NULL THEN 'orphan_result' ELSE 'call' END AS kind,
        CASE WHEN c.conv_id IS NOT NULL THEN 'answer' END AS name, c.level, r.conv_id IS NOT NULL AS has_result,
        coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
        CASE WHEN c.conv_id IS NULL THEN '{"content":' || coalesce(to_json(r.content)::VARCHAR, 'null') || ',"tool_call_id":' || to_json(r.call_id)::VARCHAR || '}'
          ELSE '{"arguments":' || c.args || ',"id":' || to_json(c.call_id)::VARCHAR || ',"name":"answer","result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' END AS json
      FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT conv_id, call_id, turn, kind, name, level, has_result, n_calls, n_results,
  CASE WHEN kind = 'call' AND NOT contains(json, '"lines":') THEN 'lines is missing' ELSE '' END AS errors, sha256(json) AS json_sha256, length(json)::BIGINT AS json_chars FROM j
"""
