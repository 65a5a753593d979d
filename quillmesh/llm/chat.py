"""Chat formatting: tool-call linking, topological order, argument validation and canonical JSON, in built-in functions only.

Calls and results are hash-joined by identifier. A call may depend on another one; depths along those links come from pointer
doubling (a chain of n calls takes log2 n joins, whatever conversation holds it, and no window over a conversation).
Arguments are checked against schemas, and each message is written as JSON with sorted keys and no spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table

#: name, argument, type (string, integer, number or boolean), required, least and most (length of a string, else value).
SCHEMAS = (
    ("ask", "text", "string", True, 1, 20000),
    ("ask", "words", "integer", True, 1, 4000),
    ("ask", "question", "boolean", False, None, None),
)
SCHEMA_TYPE = "name string, arg string, type string, required boolean, low long, high long"
#: A schema table up to this many rows is broadcast; a larger one is joined by name.
BROADCAST_ROWS = 10_000


def json_string(x: Column) -> Column:
    """A string as a JSON string: {"v":"..."} without its wrapping; null stays null."""
    wrapped = F.to_json(F.struct(x.alias("v")))
    return F.when(x.isNotNull(), F.substring(wrapped, F.lit(6), F.length(wrapped) - 6))


def depths(ws: Workspace, links: DataFrame) -> DataFrame:
    """id and depth of each id in links (id, parent): how many ancestors it has; null on or behind a cycle.

    A parent that is no id counts as absent. One parent for each id; of several the least counts.
    """
    links = links.groupBy("id").agg(F.min("parent").alias("parent"))
    ids = links.select(F.col("id").alias("known"))
    first = links.join(ids, F.col("parent") == F.col("known"), "left").select("id", F.col("known").alias("up"), F.when(F.col("known").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    at = ws.save(first)
    rounds = max(1, at.count()).bit_length() + 1
    for _ in range(rounds):
        if not at.filter("up is not null").limit(1).count():
            break
        over = at.select(F.col("id").alias("over"), F.col("up").alias("next"), F.col("steps").alias("more"))
        new = ws.save(at.join(over, F.col("up") == F.col("over"), "left").select("id", F.col("next").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
        ws.drop(at)
        at = new
    return at.select("id", F.when(F.col("up").isNull(), F.col("steps")).alias("depth"))


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds args_json and errors (sorted, joined by a comma) to calls (name, args map<string,string>).

    Errors: unknown_tool, missing:x, unknown:x, type:x, range:x. A null value counts as absent. Valid integers, numbers and
    booleans are written bare, everything else as a string.
    """
    spec = schemas.groupBy("name").agg(F.array_sort(F.collect_set(F.struct("arg", "type", "required", "low", "high"))).alias("spec"))
    if schemas.count() <= BROADCAST_ROWS:
        spec = F.broadcast(spec)
    out = calls.join(spec, "name", "left").withColumn("args", F.coalesce("args", F.create_map().cast("map<string,string>")))
    value = lambda s: F.get(F.transform(F.filter(F.map_entries("args"), lambda e: e["key"] == s["arg"]), lambda e: e["value"]), F.lit(0))
    typed = lambda s, v: (
        F.when(s["type"] == "integer", v.rlike(r"^-?(0|[1-9][0-9]{0,17})$")).when(s["type"] == "number", v.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")).when(s["type"] == "boolean", v.isin("true", "false")).otherwise(F.lit(True))
    )
    size = lambda s, v: F.when(s["type"] == "string", F.length(v).cast("double")).otherwise(v.try_cast("double"))
    outside = lambda s, v: F.coalesce((size(s, v) < s["low"]) | (size(s, v) > s["high"]), F.coalesce(size(s, v) < s["low"], F.lit(False)) | F.coalesce(size(s, v) > s["high"], F.lit(False)))
    fault = lambda s, v: (
        F.when(v.isNull(), F.when(s["required"], F.concat(F.lit("missing:"), s["arg"]))).when(~typed(s, v), F.concat(F.lit("type:"), s["arg"])).when(outside(s, v), F.concat(F.lit("range:"), s["arg"]))
    )
    wrong = F.filter(F.transform("spec", lambda s: fault(s, value(s))), lambda x: x.isNotNull())
    names = F.transform("spec", lambda s: s["arg"])
    extra = F.transform(F.filter(F.map_keys("args"), lambda k: ~F.array_contains(names, k)), lambda k: F.concat(F.lit("unknown:"), k))
    errors = F.when(F.col("spec").isNull(), F.array(F.lit("unknown_tool"))).otherwise(F.array_sort(F.concat(wrong, extra)))
    kind = lambda k: F.get(F.transform(F.filter("spec", lambda s: s["arg"] == k), lambda s: s), F.lit(0))
    bare = lambda e: F.coalesce(kind(e["key"])["type"].isin("integer", "number", "boolean") & typed(kind(e["key"]), e["value"]), F.lit(False))
    entries = F.filter(F.array_sort(F.map_entries("args")), lambda e: e["value"].isNotNull())
    pairs = F.transform(entries, lambda e: F.concat(json_string(e["key"]), F.lit(":"), F.when(bare(e), e["value"]).otherwise(json_string(e["value"]))))
    out = out.withColumn("args_json", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))
    return out.withColumn("errors", F.array_join(errors, ",")).drop("spec")


def link(ws: Workspace, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Messages in canonical JSON from calls (conv_id, turn, id, name, args, after) and results (conv_id, turn, id, content).

    One row a call and one a result: conv_id, turn, kind, id, linked, depth, place, errors, json. A call's `after` names the
    call it depends on. place orders a conversation's linked messages: a call after all it depends on, a result after its
    call. Results without a call, and calls without a result, are kept and not linked.
    """
    depth = depths(ws, calls.filter("id is not null").select("id", F.col("after").alias("parent")))
    answered = results.groupBy("id").agg(F.count("*").alias("answers"))
    asked = calls.groupBy("id").agg(F.count("*").alias("asked"))
    kinds = ["conv_id", "turn", "kind", "id", "linked", "depth", "place", "errors", "json"]
    c = validate(calls, schemas).join(depth, "id", "left").join(answered, "id", "left")
    text = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    head = F.concat(F.lit('{"arguments":'), F.col("args_json"), F.lit(',"depth":'), text(F.col("depth")), F.lit(',"id":'), F.coalesce(json_string(F.col("id")), F.lit("null")))
    c = c.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "id", F.col("answers").isNotNull().alias("linked"), "depth", (2 * F.col("depth")).alias("place"), "errors",
        F.concat(head, F.lit(',"name":'), json_string(F.col("name")), F.lit(',"role":"assistant","turn":'), text(F.col("turn")), F.lit("}")).alias("json"),
    )
    r = results.join(depth, "id", "left").join(asked, "id", "left")
    body = F.concat(F.lit('{"content":'), F.coalesce(json_string(F.col("content")), F.lit("null")), F.lit(',"id":'), F.coalesce(json_string(F.col("id")), F.lit("null")), F.lit(',"role":"tool","turn":'), text(F.col("turn")), F.lit("}"))
    r = r.select("conv_id", "turn", F.lit("result").alias("kind"), "id", F.col("asked").isNotNull().alias("linked"), "depth", (2 * F.col("depth") + 1).alias("place"), F.lit("").alias("errors"), body.alias("json"))
    return c.select(*kinds).union(r.select(*kinds))


def format_conversations(messages: DataFrame) -> DataFrame:
    """Links the messages of a table conv_id, turn, role, text; one row a message, in the columns of link().

    A user's message is a call of the tool `ask` with the identifier c<conv>-<turn>; an assistant's message is the result of
    the call one turn before. A call depends on the call two turns before, if there is one. Messages of other roles (null
    too) are of kind 'message'. Null texts are absent arguments or contents; null conv_id or turn give a null identifier,
    which links with nothing. Repeated rows are kept, each linked to what shares its identifier. No rows give no rows.
    """
    ws = Workspace(messages.sparkSession)
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("string")
    args = F.map_from_arrays(F.array(F.lit("question"), F.lit("text"), F.lit("words")), F.array(F.col("text").contains("?").cast("string"), F.col("text"), F.when(F.col("text").isNotNull(), words)))
    calls = m.filter("role = 'user'").select("conv_id", "turn", name(F.col("turn")).alias("id"), F.lit("ask").alias("name"), args.alias("args"), name(F.col("turn") - 2).alias("after"))
    results = m.filter("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("id"), F.col("text").alias("content"))
    schemas = messages.sparkSession.createDataFrame(list(SCHEMAS), SCHEMA_TYPE)
    linked = link(ws, calls, results, schemas)
    other = m.filter("role is null or role not in ('user', 'assistant')")
    content = F.coalesce(json_string(F.col("text")), F.lit("null"))
    body = F.concat(F.lit('{"content":'), content, F.lit(',"role":'), F.coalesce(json_string(F.col("role")), F.lit("null")), F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}"))
    none = F.lit(None)
    return linked.union(other.select("conv_id", "turn", F.lit("message"), none.cast("string"), F.lit(False), none.cast("long"), none.cast("long"), F.lit(""), body))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH m AS (SELECT conv_id, turn, role, text FROM conversations),
ids AS (SELECT DISTINCT conv_id, turn FROM m WHERE role = 'user'),
chains AS (SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS start FROM ids),
depths AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, start ORDER BY turn) - 1 AS depth FROM chains),
answers AS (SELECT DISTINCT conv_id, turn - 1 AS turn FROM m WHERE role = 'assistant'),
calls AS (
  SELECT m.conv_id, m.turn, 'call' AS kind, 'c' || m.conv_id || '-' || m.turn AS id, a.turn IS NOT NULL AS linked, d.depth::BIGINT AS depth, (2 * d.depth)::BIGINT AS place,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n, text
  FROM m JOIN depths d USING (conv_id, turn) LEFT JOIN answers a USING (conv_id, turn) WHERE role = 'user'
),
faults AS (SELECT *, list_filter([
    CASE WHEN text IS NULL THEN 'missing:text' END, CASE WHEN text IS NULL THEN 'missing:words' END,
    CASE WHEN length(text) NOT BETWEEN 1 AND 20000 THEN 'range:text' END, CASE WHEN n NOT BETWEEN 1 AND 4000 THEN 'range:words' END], lambda x: x IS NOT NULL) AS e FROM calls)
SELECT conv_id, turn, kind, id, linked, depth, place, array_to_string(list_sort(e), ',') AS errors,
  '{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"question":' || CASE WHEN contains(text, '?') THEN 'true' ELSE 'false' END || ',"text":' || to_json(text)::VARCHAR || ',"words":' || n END || '},"depth":' || depth
    || ',"id":"' || id || '","name":"ask","role":"assistant","turn":' || turn || '}' AS json
FROM faults
UNION ALL
SELECT m.conv_id, m.turn, 'result', 'c' || m.conv_id || '-' || (m.turn - 1), d.turn IS NOT NULL, d.depth::BIGINT, (2 * d.depth + 1)::BIGINT, '',
  '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"id":"' || 'c' || m.conv_id || '-' || (m.turn - 1) || '","role":"tool","turn":' || m.turn || '}'
FROM m LEFT JOIN depths d ON d.conv_id = m.conv_id AND d.turn = m.turn - 1 WHERE role = 'assistant'
UNION ALL
SELECT conv_id, turn, 'message', NULL, FALSE, NULL, NULL, '', '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"turn":' || turn || '}'
FROM m WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
