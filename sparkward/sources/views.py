"""The engine's tables as views of the given ones: calls, security events, and texts as parameters of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATEGORIES, NO_SESSION

RULES = ("exec-guard", "path-guard", "network-guard", "rate-limiter", "baseline-drift", "prompt-injection", "data-exfil")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str, factor: int = 1440) -> DataFrame:
    """Tool calls from events; time runs `factor` times as fast, so that windows fill."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / factor).cast("long").alias("ts_ms"),
        F.concat(F.col("event_type"), F.lit("_"), F.floor(k / 10).cast("string")).alias("tool_name"),
        F.col("props").alias("params"),
        F.concat(F.lit("sess_"), (F.col("user_id") % 25).cast("string")).alias("session_id"),
        F.lit(None).cast("string").alias("agent_id"),
        F.concat(F.lit("skill_"), (F.col("user_id") % 7).cast("string")).alias("skill_name"),
    )


def security_events(spark: SparkSession, sf_dir: str, factor: int = 1) -> DataFrame:
    id_ = F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    severity = pick(("critical", "high", "medium", "low", "info"), id_ % 5)
    rows = calls(spark, sf_dir, factor).drop("params", "agent_id")
    more = table(spark, sf_dir, "events").select(
        id_.alias("seq"),
        F.concat(F.lit("evt_"), id_.cast("string")).alias("id"),
        severity.alias("severity"),
        pick(CATEGORIES, id_ % 7).alias("category"),
        F.when(id_ % 11 != 0, pick(RULES, id_ % 7)).alias("rule_name"),
        F.when(id_ % 5 == 0, "blocked").otherwise("alert").alias("action"),
        F.concat(F.lit("title "), (id_ % 7).cast("string")).alias("title"),
        F.concat(F.lit("=description, "), (id_ % 13).cast("string")).alias("description"),
        F.concat(F.lit("pattern_"), (id_ % 3).cast("string")).alias("matched_pattern"),
    )
    return rows.join(more, "seq")


def text_calls(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """documents, pages or conversations as calls that carry their text."""
    no = F.lit(None).cast("string")
    if name == "documents":
        rows = table(spark, sf_dir, name)
        cols = [F.col("doc_id"), F.lit("write_file"), F.to_json(F.struct(F.col("text").alias("content"))), no, F.col("source")]
    elif name == "pages":
        rows = table(spark, sf_dir, name)
        cols = [F.col("page_id"), F.lit("http_request"), F.to_json(F.struct("url", F.col("html").alias("body"))), no, no]
    else:
        rows = table(spark, sf_dir, name)
        cols = [F.col("conv_id") * 1000 + F.col("turn"), F.col("role"), F.to_json(F.struct("text")), F.col("conv_id").cast("string"), no]
    names = ("seq", "tool_name", "params", "session_id", "skill_name")
    picked = rows.select(*[c.alias(n) for c, n in zip(cols, names)])
    return picked.select("seq", F.col("seq").alias("ts_ms"), "tool_name", "params", "session_id", no.alias("agent_id"), "skill_name")


def planted_calls(spark: SparkSession, sf_dir: str, cases: list[tuple[int, str, str]]) -> DataFrame:
    """Events that carry the texts of `cases` (id, tool, parameters in JSON) beside their own parameters, by turns."""
    small = spark.createDataFrame(cases, "case_id int, tool_name string, planted string")
    rows = calls(spark, sf_dir).drop("tool_name").withColumn("case_id", (F.col("seq") % len(cases)).cast("int"))
    both = F.expr("""concat(substring(planted, 1, length(planted) - 1), ',"event":', params, '}')""")
    joined = rows.join(F.broadcast(small), "case_id").withColumn("params", F.when(F.length("planted") > 2, both).otherwise(F.col("planted")))  # as many rows as cases
    return joined.select("seq", "ts_ms", "tool_name", "params", "session_id", "agent_id", "skill_name")


def hook_calls(raw: DataFrame) -> DataFrame:
    """Calls from a hook's messages: session falls back to the session's key, then to one for all."""
    session = F.coalesce("session_id", "session_key", F.lit(NO_SESSION))
    return raw.withColumn("session_id", session).drop("session_key")


def results_as_calls(raw: DataFrame, more_than: int = 50) -> DataFrame:
    """Results of calls as parameters, where they are texts of more than so many characters."""
    rows = raw.where((F.col("phase") == "after") & (F.length("result") > more_than))
    return rows.withColumn("params", F.to_json(F.struct(F.col("result").alias("_result"))))


def rpc_calls(lines: DataFrame) -> DataFrame:
    """JSON-RPC lines (seq, line): kind is call, pass, error or none; calls have name and arguments."""
    get = lambda p: F.get_json_object("line", p)
    obj = F.try_parse_json("line")
    kind = F.schema_of_variant(obj)
    is_object = F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))
    method_kind = F.schema_of_variant(F.try_variant_get(obj, "$.method", "variant"))
    bad = F.coalesce(method_kind != "STRING", F.lit(False))
    what = F.when(~is_object, "none").when(bad, "error").when(get("$.method") == "tools/call", "call").otherwise("pass")
    rows = lines.withColumn("kind", what)
    call = F.col("kind") == "call"
    return rows.select(
        "seq",
        "kind",
        F.when(F.col("kind") == "error", -32600).alias("code"),
        F.when(call, F.coalesce(get("$.params.name"), F.lit("unknown"))).alias("tool_name"),
        F.when(call, F.coalesce(get("$.params.arguments"), F.lit("{}"))).alias("params"),
    )


def rpc_counts(rows: DataFrame) -> DataFrame:
    """requests, tool_calls, errors of a proxy's lines."""
    return rows.agg(F.count("*").alias("requests"), F.count_if(F.col("kind") == "call").alias("tool_calls"), F.count_if(F.col("kind") == "error").alias("errors"))


#: What a single check is told of a body that it can't take.
MISSING, INVALID = "Missing or invalid required fields: toolName (string), toolParams (object)", "Invalid JSON body"


def single_checks(bodies: DataFrame) -> DataFrame:
    """Bodies (seq, body) of single checks: seq, tool_name, params, error; error is null where the check can be made."""
    get = lambda p: F.try_variant_get(F.try_parse_json("body"), p, "variant")
    kind = lambda p: F.coalesce(F.schema_of_variant(get(p)), F.lit(""))
    name = F.get_json_object("body", "$.toolName")
    good = (kind("$.toolName") == "STRING") & (name != "") & F.startswith(kind("$.toolParams"), F.lit("OBJECT"))
    error = F.when(F.try_parse_json("body").isNull(), INVALID).when(~good, MISSING)
    rows = bodies.select("seq", name.alias("tool_name"), F.get_json_object("body", "$.toolParams").alias("params"), error.alias("error"))
    return rows.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in ("tool_name", "params")})


def framed(chunks: DataFrame) -> DataFrame:
    """Messages (seq, text) of several lines each as frames: seq, nth, line, kind (json, blank, or dropped, which isn't JSON)."""
    rows = chunks.select("seq", F.posexplode(F.split("text", "\r?\n")).alias("nth", "line"))
    kind = F.when(F.trim("line") == "", "blank").when(F.try_parse_json("line").isNotNull(), "json").otherwise("dropped")
    return rows.withColumn("kind", kind)


def batch_items(bodies: DataFrame, most: int = 100) -> DataFrame:
    """Batches (batch_id, body) as items in their order; a batch is valid only if all its items are, and it isn't too long."""
    items = F.from_json("body", "array<struct<toolName:string,toolParams:string>>")
    rows = bodies.select("batch_id", items.alias("items")).select("batch_id", F.size("items").alias("n"), F.posexplode_outer("items").alias("seq", "item"))
    params = F.schema_of_variant(F.try_parse_json("item.toolParams"))
    good = F.coalesce((F.length("item.toolName") > 0) & F.startswith(params, F.lit("OBJECT")), F.lit(False))
    rows = rows.withColumn("good", good & F.col("n").between(1, most))
    verdict = rows.groupBy("batch_id").agg(F.bool_and("good").alias("accepted"))
    return rows.join(verdict, "batch_id").select("batch_id", "seq", F.col("item.toolName").alias("tool_name"), F.col("item.toolParams").alias("params"), "accepted")


TRANSCRIPT = "role string, type string, text string, toolName string, toolCallId string, toolParams string, toolResult string, toolError string, timestamp bigint, sessionId string"


def transcript(lines: DataFrame) -> DataFrame:
    """Entries of JSONL transcripts (line); malformed and blank lines are skipped."""
    ok = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("line")), F.lit("OBJECT")), F.lit(False))
    return lines.where(ok).select(*[c for c in lines.columns if c != "line"], F.from_json("line", TRANSCRIPT).alias("e")).select("*", "e.*").drop("e")


def fanned_out(inputs: DataFrame) -> DataFrame:
    """Each input text (case_id, input) as a command, as a path and as a request."""
    body = lambda **k: F.to_json(F.struct(*[F.col("input").alias(n) if v is None else F.lit(v).alias(n) for n, v in k.items()]))
    three = F.array(
        F.struct(F.lit("shell_exec").alias("tool_name"), body(command=None).alias("params")),
        F.struct(F.lit("read_file").alias("tool_name"), body(path=None).alias("params")),
        F.struct(F.lit("http_request").alias("tool_name"), body(url=None, body=None, method="POST").alias("params")),
    )
    return inputs.select("case_id", F.posexplode(three).alias("context", "c")).select("case_id", "context", "c.tool_name", "c.params")
