"""Raw log lines to usage lines: classification, extraction, redaction, normalisation.

Only allowlisted fields are parsed, so prompt and output text never reaches a result column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tokenledger.functions.scalars import MESSAGE_ID, MODEL_ID, TOOL_NAME, fingerprint, if_matches, iso_timestamp

USAGE = "struct<input_tokens:double,cache_creation_input_tokens:double,cache_read_input_tokens:double,output_tokens:double,cache_creation:struct<ephemeral_1h_input_tokens:double,ephemeral_5m_input_tokens:double>>"
#: Ids, names and counters are read with their JSON types: what is no string there is no id, what is no number no counter.
LINE = "type string, requestId variant, timestamp string, message struct<id:variant,model:variant,role:string,content:string,usage:variant>, _corrupt string"
#: The rest of a line, for lines of which a typed value can't be read (an object with repeated keys).
REST = f"type string, timestamp string, message struct<role:string,content:string,usage:{USAGE}>, _corrupt string"
BLOCKS = "array<struct<type:string,name:variant>>"
#: Columns that may leave the parser; anything else is content.
ALLOWED = ("file_path", "source", "project", "line_no", "kind", "message_id", "request_id", "model", "ts", "tools", "usage", "parse_error")


def _string(value: Column) -> Column:
    """A JSON string's text; null for numbers, booleans, objects and arrays."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _number(value: Column, path: str) -> Column:
    """The JSON number at a path; null for strings, booleans, objects and arrays."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(value, path, "double"))


def _is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "struct<input_tokens:variant>").isNotNull()  # cheaper than the whole schema


def _blocks(content: Column) -> Column:
    """The blocks of a line's content; a content that is a string has none, whatever its text looks like."""
    read = F.from_json("value", f"message struct<content:{BLOCKS}>")["message"]["content"]
    return F.coalesce(F.when(content.startswith("["), read), F.array().cast(BLOCKS))


def parse(raw: DataFrame) -> DataFrame:
    """raw (source, line_no, value, ...) with kind, message_id, request_id, model, ts, tools, usage and parse_error.

    Ids and names count only as JSON strings.  Counters are numbers from 0 on that fit a BIGINT, of which the whole part
    counts; anything else counts as 0.  A usage that is no object is none, and the line is not billed; neither makes a line malformed.

    kind: B billed assistant line, T assistant line with tools but no usage, R tool result, H anything
    else, null for blank and malformed lines.  Only the line's own top-level type counts.  A malformed line whose
    complete is false is a half-written append: no error, and the next scan reads it again."""
    df = raw.withColumn("value", F.regexp_replace("value", "\r$", ""))
    read = {"columnNameOfCorruptRecord": "_corrupt"}
    df = df.withColumn("v", F.from_json("value", LINE, read))
    v, m = F.col("v"), F.col("v")["message"]
    odd = v["_corrupt"].isNotNull()
    df = df.withColumn("rest", F.when(odd, F.from_json("value", REST, read)))
    r = F.col("rest")

    def line(of: Column, usage: Column) -> Column:
        message = F.struct(of["message"]["role"].alias("role"), of["message"]["content"].alias("content"), usage.alias("usage"))
        return F.struct(of["type"].alias("type"), of["timestamp"].alias("timestamp"), F.when(of["message"].isNotNull(), message).alias("message"), of["_corrupt"].alias("_corrupt"))

    again = F.when(r["message"]["usage"].isNotNull(), F.to_variant_object(r["message"]["usage"]))
    read_line = F.when(odd, F.when(r.isNotNull(), line(r, again))).otherwise(line(v, m["usage"]))
    # An array of one: a filter on what follows stays above it, or Catalyst would write the reading of JSON into the filter at each use
    df = df.select("*", F.explode(F.array(read_line)).alias("j"))
    j = F.col("j")
    blank = F.trim("value") == ""
    bad = ~blank & (j["_corrupt"].isNotNull() | j.isNull() | j["type"].isNull())
    error = bad & F.col("complete") if "complete" in raw.columns else bad
    df = df.withColumn("b", _blocks(j["message"]["content"]))
    assistant = (j["type"] == "assistant") | ((j["type"] == "message") & (j["message"]["role"] == "assistant"))
    names = F.filter(F.transform(F.filter("b", lambda x: x["type"] == "tool_use"), lambda x: _string(x["name"])), lambda n: n.rlike(TOOL_NAME))
    tools = F.when(assistant, F.array_distinct(names)).otherwise(F.array().cast("array<string>"))
    result = (j["type"] == "user") & F.exists("b", lambda x: x["type"] == "tool_result")
    u = j["message"]["usage"]
    n = lambda path: F.greatest(F.lit(0), F.coalesce(_number(u, f"$.{path}").try_cast("bigint"), F.lit(0)))
    usage = F.struct(
        n("input_tokens").alias("input"), n("cache_creation_input_tokens").alias("cache_create"),
        n("cache_creation.ephemeral_1h_input_tokens").alias("cache_create_1h"), n("cache_creation.ephemeral_5m_input_tokens").alias("cache_create_5m"),
        n("cache_read_input_tokens").alias("cache_read"), n("output_tokens").alias("output"))
    kind = F.when(blank | bad, None).when(assistant & _is_object(u), "B").when(assistant & (F.size(tools) > 0), "T").when(result, "R").otherwise("H")
    out = df.withColumns({
        "kind": kind, "message_id": if_matches(_string(m["id"]), MESSAGE_ID), "request_id": if_matches(_string(v["requestId"]), MESSAGE_ID),
        "model": F.when(assistant, F.coalesce(if_matches(_string(m["model"]), MODEL_ID), F.lit("<unknown>"))),
        "ts": iso_timestamp(j["timestamp"]), "tools": tools, "usage": usage, "parse_error": F.coalesce(error, F.lit(False))})
    return out.select(*[c for c in ALLOWED if c in out.columns])


def assert_redacted(df: DataFrame) -> DataFrame:
    extra = set(df.columns) - set(ALLOWED)
    if extra:
        raise ValueError(f"content may leak through {sorted(extra)}")
    return df


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count("*").alias("lines"), F.count_if("parse_error").alias("parse_errors"))


def parse_counted(raw: DataFrame) -> tuple[DataFrame, Observation, Observation]:
    """parse(raw), and what its one pass counts: lines, bytes and half-written tails as they come, then lines parsed, billed and in error.

    The counts are there when an action on the result has ended; nothing is scanned for them.  A task that is run again counts once."""
    came, read = Observation("raw"), Observation("parsed")
    tails = F.count_if(~F.col("complete") if "complete" in raw.columns else F.lit(False))
    one = F.lit(1)
    counted = raw.observe(came, F.count(one).alias("lines"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes"), tails.alias("tails"))
    return parse(counted).observe(read, F.count(one).alias("parsed"), F.count_if(F.col("kind") == "B").alias("billed"), F.count_if("parse_error").alias("parse_errors")), came, read


def fingerprinted(df: DataFrame, salt: str, *columns: str) -> DataFrame:
    return df.withColumns({c: fingerprint(F.col(c).cast("string"), salt) for c in columns})


def normalize(df: DataFrame) -> DataFrame:
    """Stored records rebuilt field by field: (source, project, message_id, request_id, model, ts, tools, usage counters)
    from loose string columns; what is not well formed becomes null, ``<unknown>`` or 0."""
    number = lambda c: F.greatest(F.lit(0), F.coalesce(F.expr(f"try_cast({c} as bigint)"), F.lit(0))).alias(c)
    return df.select(
        "source", if_matches(F.col("project"), "^[a-f0-9]{12}$").alias("project"),
        if_matches(F.col("message_id"), MESSAGE_ID).alias("message_id"), if_matches(F.col("request_id"), MESSAGE_ID).alias("request_id"),
        F.coalesce(if_matches(F.col("model"), MODEL_ID), F.lit("<unknown>")).alias("model"), iso_timestamp(F.col("timestamp")).alias("ts"),
        F.array_distinct(F.filter("tools", lambda t: t.rlike(TOOL_NAME))).alias("tools"),
        *[number(c) for c in ("input", "cache_create", "cache_create_1h", "cache_create_5m", "cache_read", "output")])
