"""Readers and writers of files: request captures, logs, plan stores, learned state, runs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import wire
from turnloom.operators import logs

#: Version of stored plans and of learned state, UTC days that are kept.
PLAN_VERSION, STATE_VERSION, KEPT_DAYS = 2, 1, 14


def log_coverage(spark: SparkSession, path: str) -> DataFrame:
    """logs.coverage of a log file, and whether its last line ends without a line feed."""
    lines = logs.read_lines(spark, path)
    # the last byte of each file: a reader of whole files sees it, one of lines does not
    tails = spark.read.format("binaryFile").load(path).select((F.col("length") > 0).alias("full"), F.expr("substring(content, -1, 1)").alias("last"))
    open_end = tails.agg(F.coalesce(F.max(F.col("full") & (F.col("last") != F.lit(b"\n"))), F.lit(False)).alias("partial_final_line"))
    return logs.coverage(lines).crossJoin(F.broadcast(open_end))


def text_coverage(spark: SparkSession, text: str) -> DataFrame:
    """The same for a text at hand."""
    rows = [(x,) for x in text.split("\n") if x.strip()]
    return logs.coverage(logs.parse_lines(spark.createDataFrame(rows, "line string"))).withColumn("partial_final_line", F.lit(bool(text) and not text.endswith("\n")))


def collected_requests(spark: SparkSession, path: str) -> DataFrame:
    """label, n, body, defect of each request in .json and .jsonl files, files in the order of people, items in theirs.

    A byte-order mark is dropped; a file holds one item, an array of items, or one item a line; a record may wrap its body.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "\\A\ufeff", "").alias("text"))
    files = files.where(F.col("file").rlike(r"\.jsonl?\z"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    array = F.from_json("text", "array<string>")
    whole = F.when(F.ltrim("text").startswith("["), array).otherwise(F.array("text"))
    items = files.select("file", F.posexplode(F.when(F.col("file").endswith(".jsonl"), lines).otherwise(whole)).alias("n", "item"))
    body = wire.unwrapped(F.col("item"))
    out = items.select("file", "n", body.alias("body"), F.when(body.isNull(), F.coalesce(wire.body_defect(F.col("item")), F.lit("no_messages"))).otherwise(wire.body_defect(body)).alias("defect"))
    return out.select(F.concat_ws(":", "file", (F.col("n") + 1).cast("string")).alias("label"), "body", "defect", wire.natural_key(F.col("file")).alias("file_key"), "n").orderBy("file_key", "n")


def stored_plans(spark: SparkSession, path: str, today: Column | None = None, days: int = KEPT_DAYS) -> tuple[DataFrame, DataFrame]:
    """Plans of a store (a folder day=YYYY-MM-DD of JSON lines for each UTC day), newest first for each key; and what was skipped.

    Days beyond the kept ones are not read: the day is a partition.
    """
    day = today if today is not None else F.current_date()
    lines = spark.read.text(path).where(F.col("day") > F.date_sub(day, days))
    parsed = lines.select("day", F.octet_length("value").alias("bytes"), F.from_json("value", "version int, key string, at string, plan string", {"mode": "PERMISSIVE"}).alias("r"))
    ok = F.coalesce((F.col("bytes") <= logs.MAX_BYTES) & (F.col("r.version") == PLAN_VERSION) & F.col("r.key").isNotNull() & F.col("r.plan").isNotNull(), F.lit(False))
    newest = parsed.where(ok).groupBy("r.key").agg(F.max_by(F.struct("day", "r.plan"), F.struct("day", "r.at")).alias("m")).select("key", "m.day", "m.plan")
    skipped = parsed.agg(F.count_if(F.col("bytes") > logs.MAX_BYTES).alias("oversized"), F.count_if(F.col("r.version") > PLAN_VERSION).alias("newer"), F.count_if(~ok).alias("skipped"))
    return newest, skipped


def store_plans(plans: DataFrame, path: str) -> None:
    """Append plans(day, key, at, plan) to a store; results never depend on it."""
    plans.select("day", F.to_json(F.struct(F.lit(PLAN_VERSION).alias("version"), "key", "at", "plan")).alias("value")).write.partitionBy("day").mode("append").text(path)


def learned_state(spark: SparkSession, path: str, window: int, counter: str) -> DataFrame:
    """Learned entries of a state file that are of this version, window and counter; values out of range are dropped."""
    schema = "version int, window long, counter string, entries map<string, struct<window: long, maxPrompt: long, tighten: long, correction: double, ratios: array<double>>>"
    s = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("s")).where((F.col("s.version") == STATE_VERSION) & (F.col("s.window") == window) & (F.col("s.counter") == counter))
    e = s.select(F.explode("s.entries").alias("key", "e"))
    return e.select(
        "key", F.when((F.col("e.window") > 0) & (F.col("e.window") <= window), F.col("e.window")).alias("window"), F.when(F.col("e.maxPrompt") > 0, F.col("e.maxPrompt")).alias("max_prompt"), F.greatest(F.coalesce("e.tighten", F.lit(0)), F.lit(0)).cast("long").alias("tighten"),
        F.least(F.greatest(F.coalesce("e.correction", F.lit(1.0)), F.lit(1.0)), F.lit(2.5)).alias("correction"), F.slice(F.reverse(F.filter(F.coalesce("e.ratios", F.array().cast("array<double>")), lambda r: r > 0)), 1, 64).alias("newest_ratios"),
    )


def run_records(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The upstream, client and ledger records of a run's folder; a missing file is an empty table."""
    schemas = {
        "mock": "seq long, session string, step int, kind string, status int, prompt long, completion long, digests array<string>",
        "client": "session string, step int, kind string, attempt int, status int, prompt long, error string",
        "ledger": "action string, tokens_in long, tokens_out long",
    }
    out = {}
    for name, schema in schemas.items():
        found = spark.read.schema(schema).option("mode", "PERMISSIVE").option("pathGlobFilter", f"{name}.jsonl").json(path)
        out[name] = found
    return out


def newest_results(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """The newest result of each cell of manifest(system, scenario, window); cells without one are NOT RUN."""
    r = spark.read.schema("system string, scenario string, window long, at string, passed boolean, tokens long").json(path)
    newest = r.groupBy("system", "scenario", "window").agg(F.max_by(F.struct("passed", "tokens"), "at").alias("m"))
    state = F.when(F.col("m").isNull(), "NOT RUN").when(F.col("m.passed"), "PASS").otherwise("FAIL")
    return manifest.join(newest, ["system", "scenario", "window"], "left").select("system", "scenario", "window", state.alias("state"), F.col("m.tokens").alias("tokens"))


def append_records(records: DataFrame, path: str) -> None:
    """Request records as JSON lines, added to a log's folder."""
    records.write.mode("append").json(path)


def write_redacted(requests: DataFrame, path: str) -> None:
    """Bodies of requests(label, body) with all text masked, as JSON lines."""
    requests.select("label", redacted(F.col("body")).alias("value")).write.mode("overwrite").json(path)


#: Keys whose texts say what a thing is, and stay.
PROTECTED = {"role", "type", "model", "id", "tool_call_id", "object", "finish_reason", "required", "format"}
FILLERS = {1: "xyzwvu", 2: "éüøñ", 3: "一丁上下", 4: "😀😁😂😃"}


def mask(text: str) -> str:
    """wire.placeholder of one text."""
    chosen = {n: next((c for c in pool if c not in text), pool[-1]) for n, pool in FILLERS.items()}
    out = []
    for c in text:
        if c in "\n\r":
            out.append(c)
        elif c in '\t\b\f"\\':
            out.append("\t")
        elif c < " ":
            out.append("\x01")
        else:
            out.append(chosen[len(c.encode("utf-8", "surrogatepass"))])
    return "".join(out)


def mask_arguments(text: str) -> str:
    """JSON arguments of a call: keys, numbers and structure stay, texts are masked; what is no JSON is masked whole."""
    try:
        json.loads(text)
    except ValueError:
        return mask(text)
    return re.sub(r'"((?:[^"\\]|\\.)*)"(\s*:)?', lambda m: m[0] if m[2] else '"' + re.sub(r"\\u[0-9a-fA-F]{4}|\\.|[^\\]+", _mask_encoded, m[1]) + '"', text)


def _mask_encoded(m: re.Match) -> str:
    part = m[0]
    if part.startswith("\\u"):
        return "\\u0078"
    if part.startswith("\\"):
        return part if part[1] in "nrt" else "\\\\" if part[1] in '"\\' else "\\t"
    return mask(part)


def redact(value, key: str | None = None, path: str = ""):
    """A request with its texts masked: roles, ids and names of tools stay where they are such."""
    if isinstance(value, str):
        named = key == "name" and re.fullmatch(r"(?:tools\.#\.function|functions\.#|tool_choice\.function|function_call|messages\.#\.tool_calls\.#\.function|messages\.#\.function_call|result)\.name", path)
        return value if key in PROTECTED or named else mask_arguments(value) if key == "arguments" else mask(value)
    if isinstance(value, list):
        return [redact(x, key if key == "required" else None, f"{path}.#") for x in value]
    if isinstance(value, dict):
        result = path == "messages.#" and value.get("role") in ("tool", "function")
        return {k: redact(x, k, "result.name" if result and k == "name" else f"{path}.{k}" if path else k) for k, x in value.items()}
    return value


def redacted(body: Column) -> Column:
    """A body's JSON with its texts masked; null for what is no JSON."""
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(redact(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return texts.map(one)

    return F.pandas_udf(run, "string")(body)


# ---------------------------------------------------------------- texts read in the driver


def parse_jsonc(text: str):
    """JSON with comments and commas at the end; an error names its line and column."""
    out, i = [], 0
    while i < len(text):
        if text[i] == '"':
            m = re.compile(r'"(?:[^"\\\n]|\\.)*"').match(text, i)
            if not m:
                break
            out.append(m[0])
            i = m.end()
        elif text.startswith("//", i):
            i = len(text) if (z := text.find("\n", i)) < 0 else z
        elif text.startswith("/*", i):
            z = text.find("*/", i + 2)
            z = len(text) if z < 0 else z + 2
            out.append(re.sub(r"[^\n]", " ", text[i:z]))
            i = z
        else:
            out.append(text[i])
            i += 1
    out.append(text[i:])
    plain = "".join(out)
    # outside of texts a comma before a closing bracket goes
    plain = re.sub(r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', lambda m: m[1] or " " + m[2], plain)
    try:
        return json.loads(plain)
    except json.JSONDecodeError as e:
        raise ValueError(f"{e.lineno}:{e.colno}: {e.msg}") from None


def message_pattern(message: str) -> str:
    """A pattern for messages like this one: numbers become groups, white space any run, the rest stands as it is."""
    return re.sub(r"(?:\\?\s)+", r"\\s+", re.sub(r"\d+", lambda m: r"(\d+)", re.escape(message.strip())))


def json_paths(value, path: str = "$") -> list[tuple[str, str]]:
    """(path, value) of every leaf, empty containers included."""
    if isinstance(value, dict) and value:
        return [x for k in sorted(value) for x in json_paths(value[k], f"{path}.{k}")]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in json_paths(v, f"{path}[{i}]")]
    return [(path, json.dumps(value, ensure_ascii=False))]


def leaves(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, path, value of the leaves of rows(json)."""

    def run(batches):
        for pdf in batches:
            out = [(*row, *leaf) for *row, text in pdf[[*keys, "json"]].itertuples(index=False) for leaf in json_paths(json.loads(text))]
            yield pd.DataFrame(out, columns=[*keys, "path", "value"])

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", path string, value string")


def json_differences(a: DataFrame, b: DataFrame, *keys: str, most: int = 20) -> DataFrame:
    """keys, path, a, b: the first paths at which the JSON of equal keys differs."""
    left, right = (leaves(d, *keys).withColumnRenamed("value", name) for d, name in ((a, "a"), (b, "b")))
    differ = left.join(right, [*keys, "path"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("path"))
    return differ.withColumn("n", n).where(F.col("n") <= most).drop("n")
