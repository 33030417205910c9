"""Chat formatting: link tool calls to results, order them, validate arguments, write
canonical JSON. Native throughout.

Calls and results are joined by conversation and call identifier, so a conversation of any
length spreads over the cluster; nothing is gathered by conversation, and the output is one
row per call with its order key. Arguments are read as a map of variants and checked
against the tool's fields. Variants write their fields in order of name and without
spaces, which makes the JSON canonical.

Order: the level of a call is the length of the longest chain of calls that it depends on, 0 without
any; the order is that of (level, position). A call in or behind a cycle has no level. Levels come
from rounds that are each written. In a round, each dependency on a call whose level is known is
settled, and each on a call that itself waits for one call only moves on to that call. So chains
halve in every round, whatever their length, and a path that has become longer than the
conversation has calls tells a cycle. Only where calls wait for several unsettled calls each, one
after the other, do rounds grow with the number of such calls on a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.tables import discard, fresh_path, hot_join, literal_table, table, written

MAX_BROADCAST_TOOLS = 10_000
#: Tools of the registered query: name, field, type, whether required.
SCHEMA = [("search", "query", "string", True), ("search", "limit", "integer", True), ("write", "text", "string", True), ("write", "lines", "integer", True)]
MIN_ARGUMENT_CHARS = 60


def calls_of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in ``turns`` (conv_id, turn, role, text), by rules on the rows' own content.

    A user turn is a call, an assistant turn the result for the turn before it. A text with a line
    break calls ``write`` with the text and its number of lines; else one with a comma calls
    ``search`` with the text, from 20 words on also with their number as ``limit``, and from turn
    5 on with ``turn``; all else calls ``echo``, which nobody offers. Lines of texts that do not
    start with A-Z or a-z are given as a string. A text of under 60 characters is itself the
    arguments, which then are no JSON object. A call depends on the call at that turn of its
    conversation which is the number of its commas, and ``write`` also on the call two turns
    earlier; so calls wait for later ones, and for themselves. Null conversation or turn gives
    a null identifier; a null text calls nothing by name and depends on nothing.
    """
    call_id = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    text, turn = F.col("text"), F.col("turn").cast("long")
    count = lambda c: F.length("text") - F.length(F.replace(text, F.lit(c), F.lit("")))
    name = F.when(text.contains("\n"), "write").when(text.contains(","), "search").when(text.isNotNull(), "echo")
    n_words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    lines = count("\n") + 1
    plain = text.rlike("^[A-Za-z]")
    arguments = (
        F.when(F.length("text") < MIN_ARGUMENT_CHARS, text)
        .when(name == "write", F.to_json(F.struct(text.alias("text"), F.when(plain, lines).alias("lines"), F.when(~plain, lines.cast("string")).alias("lines_"))))
        .when(name == "search", F.to_json(F.struct(text.alias("query"), F.when(n_words >= 20, n_words).alias("limit"), F.when(turn >= 5, turn).alias("turn"))))
        .when(text.isNotNull(), F.to_json(F.struct(text.alias("text"))))
    )
    # One field, of either type.
    arguments = F.replace(arguments, F.lit(',"lines_":'), F.lit(',"lines":'))
    needs = F.array_compact(F.array(F.when(text.isNotNull(), call_id(count(","))), F.when((name == "write") & (turn >= 2), call_id(turn - 2))))
    calls = turns.filter("role = 'user'").select("conv_id", turn.alias("position"), call_id(turn).alias("call_id"), name.alias("name"), arguments.alias("arguments"), needs.alias("depends_on"))
    results = turns.filter("role = 'assistant'").select("conv_id", turn.alias("position"), call_id(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def _type_fits(kind: Column, wanted: Column) -> Column:
    """Whether a variant's type is that of a schema; an unknown schema type fits all."""
    return (
        F.when(wanted == "string", kind == "STRING").when(wanted == "integer", kind == "BIGINT").when(wanted == "boolean", kind == "BOOLEAN")
        .when(wanted == "number", kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*)$")).when(wanted == "array", kind.startswith("ARRAY")).when(wanted == "object", kind.startswith("OBJECT")).otherwise(True)
    )


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` (…, name, arguments) with ``_parsed``, the arguments as a variant, and ``_errors``:
    sorted names of what is wrong with them by ``schemas`` (name, field, type, required)."""
    tools = schemas.groupBy("name").agg(F.collect_set(F.struct("field", "type", "required")).alias("_fields"))  # a tool's own parameters
    if tools.limit(MAX_BROADCAST_TOOLS + 1).count() <= MAX_BROADCAST_TOOLS:
        rows = calls.join(F.broadcast(tools), "name", "left")
    else:
        rows = hot_join(written(calls, "calls"), tools, ["name"], ["conv_id", "call_id"])
    # JSON that is no object, and an object with a repeated key, give no map.
    rows = rows.withColumn("_parsed", F.try_parse_json("arguments"))
    is_object = F.startswith(F.ltrim("arguments"), F.lit("{"))
    rows = rows.withColumn("_args", F.when(is_object & F.col("_parsed").isNotNull(), F.from_json("arguments", "map<string,variant>")))
    entries = F.map_entries("_args")
    field = lambda key: F.filter("_fields", lambda s: s["field"] == key)
    missing = F.transform(F.filter("_fields", lambda s: s["required"] & ~F.array_contains(F.map_keys("_args"), s["field"])), lambda s: F.concat(F.lit("missing:"), s["field"]))
    wrong = F.transform(F.filter(entries, lambda e: F.exists(field(e["key"]), lambda s: ~F.coalesce(_type_fits(F.schema_of_variant(e["value"]), s["type"]), F.lit(False)))), lambda e: F.concat(F.lit("type:"), e["key"]))
    unknown = F.transform(F.filter(entries, lambda e: F.size(field(e["key"])) == 0), lambda e: F.concat(F.lit("unknown:"), e["key"]))
    errors = (
        F.when(F.col("_fields").isNull(), F.array(F.lit("unknown tool")))
        .when(is_object & F.col("_parsed").isNull() & F.json_object_keys("arguments").isNotNull(), F.array(F.lit("duplicate key")))
        .when(F.col("_args").isNull(), F.array(F.lit("no JSON object")))
        .otherwise(F.array_sort(F.concat(missing, wrong, unknown)))
    )
    return rows.withColumn("_errors", errors).drop("_fields", "_args")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls of ``calls`` (conv_id, call_id, depends_on) with
    identifiers, one row each; the level is null in and behind cycles. See the module's text."""
    spark = calls.sparkSession
    key = ["conv_id", "call_id"]

    def save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = fresh_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    def replaced(old: str, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        new = save(df, name)
        discard(spark, old)
        return new

    known = calls.select(*key).dropna().distinct()
    needs = calls.select(*key, F.explode("depends_on").alias("dep")).dropna().distinct()
    needs = needs.join(known.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left_semi")  # what no call has, no call waits for
    # A need: the call is at least `w` above dep. A state: what is settled of a call's level.
    needs, needs_at = save(needs.withColumn("w", F.lit(1).cast("long")), "needs")
    sizes = known.groupBy("conv_id").agg(F.count("*").alias("n_calls"))
    states, states_at = save(known.join(sizes, "conv_id").select(*key, "n_calls", F.lit(0).cast("long").alias("base"), F.lit(False).alias("cyclic")), "states")
    while n_needs := needs.count():
        own = needs.groupBy(*key).agg(F.count("*").alias("degree"), F.min("dep").alias("next"), F.min("w").alias("next_w"))
        facts = states.join(own, key, "left").select("conv_id", F.col("call_id").alias("dep"), F.col("base").alias("dep_base"), F.col("cyclic").alias("dep_cyclic"), "degree", "next", "next_w", "n_calls")
        settled, moves, far = F.col("degree").isNull(), F.coalesce(F.col("degree") == 1, F.lit(False)), F.col("w") > F.col("n_calls")
        met = hot_join(needs, facts, ["conv_id", "dep"], ["call_id"], "inner", n_needs).withColumn("moves_on", settled | moves | far | F.col("dep_cyclic"))
        met, met_at = save(met, "met")
        gained = met.groupBy(*key).agg(
            F.max(F.when(settled | moves, F.col("dep_base") + F.col("w"))).alias("gain"), F.max(far | F.col("dep_cyclic")).alias("turns"))
        progress = met.filter("moves_on").limit(1).count() > 0
        states, states_at = replaced(states_at, states.join(gained, key, "left").select(
            *key, "n_calls", F.greatest("base", F.coalesce("gain", F.lit(0))).alias("base"), (F.col("cyclic") | F.coalesce("turns", F.lit(False))).alias("cyclic")), "states")
        if not progress:  # every call left waits for a call left
            waiting = met.select(*key).distinct().withColumn("waits", F.lit(True))
            return save(states.join(waiting, key, "left").select(*key, F.when(~F.col("cyclic") & F.col("waits").isNull(), F.col("base")).alias("level")), "levels")[0]
        left = met.join(gained.filter("turns").select(*key), key, "left_anti")  # a call known to be cyclic needs nothing more
        left = left.filter(~settled).select(*key, F.when(moves, F.col("next")).otherwise(F.col("dep")).alias("dep"), F.when(moves, F.col("w") + F.col("next_w")).otherwise(F.col("w")).alias("w"))
        needs, needs_at = replaced(needs_at, left.groupBy(*key, "dep").agg(F.max("w").alias("w")), "needs")
        discard(spark, met_at)
    return states.select(*key, F.when(~F.col("cyclic"), F.col("base")).alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call of ``calls`` (conv_id, position, call_id, name, arguments, depends_on)
    and per result of ``results`` (conv_id, position, call_id, content) without a call.

    Returns conv_id, call_id, position, level, status, n_results, errors, json. Status:
    ``linked``, ``no_result``, ``orphan_result`` or ``cycle``. Of several results the first by
    position, then content, is linked, and all are counted; calls that repeat each get
    a row, and what they depend on counts together. Null identifiers link to nothing and have level
    0. Of an identifier without a call, also of a null one, all results together give one row. Texts
    of any length are kept whole. Empty tables give no rows; other columns are ignored.
    """
    key = ["conv_id", "call_id"]
    first = F.min_by(F.struct("content"), F.struct("position", "content"))["content"]
    best = results.groupBy(*key).agg(first.alias("content"), F.count("*").alias("found"), F.min("position").alias("result_position"), F.lit(True).alias("has_result"))
    best = written(best, "results")
    checked = written(validated(calls.select("conv_id", "position", "call_id", "name", "arguments", "depends_on"), schemas), "calls")
    ranked = best.select(*key, "content", "found", "has_result").join(levels(checked.select(*key, "depends_on")).withColumn("leveled", F.lit(True)), key, "full")
    rows = hot_join(checked, ranked.dropna(subset=key), key, ["position", "arguments"])
    status = F.when(F.col("leveled") & F.col("level").isNull(), "cycle").when(F.col("has_result"), "linked").otherwise("no_result")
    # Of broken arguments the text itself is kept.
    text = lambda c: F.when(c.isNull(), "null").otherwise(F.to_json(F.to_variant_object(F.array(c))))
    bare = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_extract(text(c), r"(?s)^\[(.*)\]$", 1))
    json = lambda args, name: F.concat(F.lit('{"arguments":'), args, F.lit(',"content":'), bare(F.col("content")), F.lit(',"id":'), bare(F.col("call_id")), F.lit(',"name":'), name, F.lit("}"))
    linked = rows.select(
        *key, "position", F.when(F.col("leveled"), F.col("level")).otherwise(F.lit(0)).cast("long").alias("level"), status.alias("status"),
        F.coalesce("found", F.lit(0)).cast("long").alias("n_results"), F.coalesce(F.array_join("_errors", ","), F.lit("")).alias("errors"),
        json(F.coalesce(F.to_json("_parsed"), bare(F.col("arguments"))), bare(F.col("name"))).alias("json"))
    orphans = best.join(checked.select(*key).dropna().distinct(), key, "left_anti").select(
        *key, F.col("result_position").alias("position"), F.lit(0).cast("long").alias("level"), F.lit("orphan_result").alias("status"),
        F.col("found").cast("long").alias("n_results"), F.lit("").alias("errors"), json(F.lit("null"), F.lit("null")).alias("json"))
    return linked.unionByName(orphans)


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_of_conversations(table(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results, literal_table(spark, SCHEMA, "name string, field string, type string, required boolean"))


ORACLE = r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn AS position, 'c' || conv_id || '-' || turn AS call_id, text,
    length(text) - length(replace(text, ',', '')) AS commas, length(text) - length(replace(text, chr(10), '')) + 1 AS lines,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    CASE WHEN contains(text, chr(10)) THEN 'write' WHEN contains(text, ',') THEN 'search' WHEN text IS NOT NULL THEN 'echo' END AS name
  FROM conversations WHERE role = 'user'),
results AS (
  SELECT conv_id, 'c' || conv_id || '-' || (turn - 1) AS call_id, min(turn) AS rpos, count(*) AS n,
    arg_min(text, struct_pack(a := turn, b := text)) AS content
  FROM conversations WHERE role = 'assistant' GROUP BY ALL),
needs AS (
  SELECT DISTINCT c.conv_id, c.call_id, d.call_id AS dep FROM calls c JOIN calls d
    ON c.conv_id = d.conv_id AND (d.position = c.commas OR (c.name = 'write' AND d.position = c.position - 2))),
walk(conv_id, call_id, level) AS (
  SELECT conv_id, call_id, 0 FROM calls
  UNION
  SELECT n.conv_id, n.call_id, w.level + 1 FROM walk w JOIN needs n ON n.conv_id = w.conv_id AND n.dep = w.call_id
    JOIN (SELECT conv_id, count(DISTINCT call_id) AS size FROM calls GROUP BY conv_id) s ON s.conv_id = w.conv_id
  WHERE w.level < s.size),
leveled AS (
  SELECT w.conv_id, w.call_id, CASE WHEN max(w.level) < any_value(s.size) THEN max(w.level) END AS level
  FROM walk w JOIN (SELECT conv_id, count(DISTINCT call_id) AS size FROM calls GROUP BY conv_id) s USING (conv_id) GROUP BY ALL),
shaped AS (
  SELECT *, regexp_matches(text, '^[A-Za-z]') AS plain, CAST(to_json(text) AS VARCHAR) AS quoted FROM calls),
checked AS (
  SELECT *,
    CASE WHEN name IS NULL OR name = 'echo' THEN 'unknown tool' WHEN length(text) < 60 THEN 'no JSON object'
      WHEN name = 'write' THEN CASE WHEN plain THEN '' ELSE 'type:lines' END
      ELSE concat_ws(',', CASE WHEN words < 20 THEN 'missing:limit' END, CASE WHEN position >= 5 THEN 'unknown:turn' END) END AS errors,
    CASE WHEN text IS NULL THEN 'null' WHEN length(text) < 60 THEN quoted
      WHEN name = 'write' THEN '{"lines":' || CASE WHEN plain THEN '' || lines ELSE '"' || lines || '"' END || ',"text":' || quoted || '}'
      WHEN name = 'search' THEN '{' || CASE WHEN words >= 20 THEN '"limit":' || words || ',' ELSE '' END || '"query":' || quoted
        || CASE WHEN position >= 5 THEN ',"turn":' || position ELSE '' END || '}'
      ELSE '{"text":' || quoted || '}' END AS arguments
  FROM shaped)
SELECT c.conv_id, c.call_id, c.position, CAST(l.level AS BIGINT) AS level,
  CASE WHEN l.level IS NULL THEN 'cycle' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_results, c.errors,
  '{"arguments":' || c.arguments || ',"content":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || ',"id":"' || c.call_id
    || '","name":' || coalesce('"' || c.name || '"', 'null') || '}' AS json
FROM checked c JOIN leveled l ON c.conv_id = l.conv_id AND c.call_id = l.call_id LEFT JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
UNION ALL
SELECT r.conv_id, r.call_id, r.rpos, CAST(0 AS BIGINT), 'orphan_result', CAST(r.n AS BIGINT), '',
  '{"arguments":null,"content":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || ',"id":"' || r.call_id || '","name":null}'
FROM results r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
"""
