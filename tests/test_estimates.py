"""Short cuts of the token estimates against the whole patterns, and the parts that the token measure shares."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from turnloom.functions import templates, tokens
from turnloom.plans import learned


def test_short_cuts(spark):
    rnd = random.Random(9)
    parts = ['"', '"', "\\", "\\\"", " ", "a" * 19, "b" * 39, "c d", "\U0001f600" * 20, "é", "\n", ":", "x/y", "12 passed", "Tests: 3", "FAIL x", "{", "- "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(1500)] + ['"' + "a b" * n + '"' for n in range(10, 18)]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    text = F.col("text")
    units = F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "")
    literals = F.filter(F.regexp_extract_all(units, F.lit(tokens.JSON_LITERAL), F.lit(1)), lambda x: x.contains(" "))
    whole = F.aggregate(literals, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    rows = d.select(tokens.json_prose(text).alias("a"), whole.alias("b"), (tokens._any(text, *tokens.TALLY_WORDS) & text.rlike(tokens.TEST_TALLY)).alias("c"), text.rlike(tokens.TEST_TALLY).alias("d")).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in rows) and any(r["a"] for r in rows) and any(r["c"] for r in rows)


def test_measure_shares_its_estimates(spark, small):
    """x04 makes each text's class once and writes no log; its sums are those of the two measures apart."""
    names = [None, "run_tests", 'a"b', "é", "", "x y"]
    d = spark.createDataFrame([(r, c, n, a) for r in ("user", "assistant", "tool") for c in (None, "", "x y z", "1 passed") for n in names for a in (None, "", '{"a":"b c"}')], "role string, content string, name string, arguments string")
    cols = [F.col(c) for c in d.columns]
    got = d.select(templates.both(*cols).alias("x"), templates.measured(*cols).alias("tokens"), templates.generic(cols[1], F.lit(None).cast("string"), cols[3]).alias("generic"), templates._call(cols[2], cols[3]).alias("call"), F.to_json(F.array("name")).alias("n")).collect()
    assert all(tuple(r["x"]) == (r["tokens"], r["generic"]) for r in got)
    assert all(r["call"].startswith('{"name": ' + r["n"][1:-1] + ",") for r in got if r["n"] != "[null]")
    plan = learned.QUERIES["x04_measures"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("skipped|flaky") == 1 and "turnloom-inputs" not in plan
