"""Structure of a message log: head, units, boundaries, calls and results. Every function takes and returns DataFrames.

The log has one row per message, keyed by session_id and ordered by idx.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_order() -> WindowSpec:
    return Window.partitionBy("session_id").orderBy("idx")


def up_to() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def whole() -> WindowSpec:
    return Window.partitionBy("session_id")


#: Fixed value: a prior summary starts with it.
SUMMARY_HEADER = "The following is a summary of your previous actions (long observations omitted):"


def starts_unit(role: Column) -> Column:
    return role.isin("assistant", "user", "system", "developer")


def is_result(role: Column) -> Column:
    return role.isin("tool", "function")


def is_prior_summary(role: Column, content: Column) -> Column:
    return (role == "user") & F.coalesce(content, F.lit("")).startswith(SUMMARY_HEADER)


def with_head(log: DataFrame) -> DataFrame:
    """The log with n and h: the first assistant (or n), less the prior summaries right before it.

    Windows over the session alone, so that all that follows shares their one exchange.
    """
    first = F.min(F.when(F.col("role") == "assistant", F.col("idx"))).over(whole())
    marked = log.withColumns({"n": F.count(F.lit(1)).over(whole()), "a": first}).withColumn("a", F.coalesce("a", F.col("n")).cast("int"))
    # the last message of the head that is no summary ends it
    solid = F.max(F.when((F.col("idx") < F.col("a")) & ~is_prior_summary(F.col("role"), F.col("content")), F.col("idx") + 1))
    return marked.withColumn("h", F.coalesce(solid.over(whole()), F.lit(0)).cast("int")).drop("a")


def head_end(log: DataFrame) -> DataFrame:
    """session_id, n, h of each session."""
    return with_head(log).groupBy("session_id").agg(F.first("n").cast("long").alias("n"), F.first("h").alias("h"))


def units(log: DataFrame) -> DataFrame:
    """One row per unit behind the head: session_id, unit (from 1), start, stop (exclusive), kind."""
    body = with_head(log).where("idx >= h")
    opens = starts_unit(F.col("role")) | (F.col("idx") == F.col("h"))
    numbered = body.withColumn("unit", F.sum(opens.cast("int")).over(up_to()))
    kind = F.when(F.col("role") == "assistant", "assistant").when(starts_unit(F.col("role")), "user").otherwise("other")
    return numbered.groupBy("session_id", "unit").agg(
        F.min("idx").alias("start"), (F.max("idx") + 1).alias("stop"), F.min_by(kind, "idx").alias("kind")
    )


def with_kept_start(log: DataFrame, keep: int) -> DataFrame:
    """The log with its head and start: of the keep newest assistant units; of the oldest if there are fewer, else h."""
    body = with_head(log)
    opened = F.when((F.col("role") == "assistant") & (F.col("idx") >= F.col("h")), F.col("idx"))
    # assistants from a message on, counted from the end: a number a row, not a list
    newer = F.count(opened).over(Window.partitionBy("session_id").orderBy(F.desc("idx")))
    body = body.withColumns({"opened": opened, "newer": newer})
    kth = F.max(F.when(F.col("newer") == max(1, keep), F.col("opened"))).over(whole())
    return body.withColumn("start", F.coalesce(kth, F.min("opened").over(whole()), F.col("h"))).drop("opened", "newer")


def kept_start(log: DataFrame, keep: int) -> DataFrame:
    return with_kept_start(log, keep).groupBy("session_id").agg(F.first("start").alias("start"))


def boundaries(log: DataFrame) -> DataFrame:
    """session_id, b: where an assistant follows another role, and the end."""
    turn = log.withColumn("before", F.lag("role").over(in_order())).where("idx > 0 and role = 'assistant' and before <> 'assistant'")
    end = log.groupBy("session_id").agg((F.max("idx") + 1).alias("b"))
    return turn.select("session_id", F.col("idx").alias("b")).unionByName(end)


def calls(log: DataFrame, *more: str) -> DataFrame:
    """One row per call: session_id, idx, pos, id, tool_name, and further columns of its message."""
    ids = F.filter(F.array("call_id", "call_id2"), lambda c: c.isNotNull())
    return log.where("role = 'assistant'").select("session_id", "idx", "tool_name", *more, F.posexplode(ids).alias("pos", "id"))


def call_for(log: DataFrame) -> DataFrame:
    """Each tool result with the nearest assistant before it that made its call; a user's message ends the search.

    A backward as-of join as one running maximum: calls and results of a session meet in the order of their messages, by
    segment and id, where a segment ends at each message of a user, system or developer.
    """
    closed = F.sum(F.col("role").isin("user", "system", "developer").cast("int")).over(up_to())
    seg = log.withColumn("segment", closed)
    made = calls(seg, "segment").select("session_id", "segment", "id", "idx", F.struct("idx", "tool_name").alias("made"), F.lit(False).alias("asks"))
    asked = seg.where(is_result(F.col("role"))).select("session_id", "segment", F.col("call_id").alias("id"), "idx", F.lit(None).cast("struct<idx:int,tool_name:string>").alias("made"), F.lit(True).alias("asks"))
    before = Window.partitionBy("session_id", "segment", "id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    near = made.unionByName(asked).withColumn("near", F.max("made").over(before)).where("asks")
    return near.select("session_id", F.col("idx").alias("result_idx"), "id", F.col("near.idx").alias("call_idx"), F.col("near.tool_name").alias("tool_name"))


def pairing_defects(log: DataFrame) -> DataFrame:
    """session_id, kind, id, n: the multiset of orphan, dup and unanswered ids; only role tool answers."""
    seg = log.withColumn("segment", F.sum((F.col("role") != "tool").cast("int")).over(up_to())).withColumn("last", F.max("segment").over(whole()))
    sides = F.when(F.col("role") == "assistant", F.filter(F.array("call_id", "call_id2"), lambda c: c.isNotNull())).when(F.col("role") == "tool", F.array("call_id"))
    told = seg.select("session_id", "segment", "last", (F.col("role") == "tool").cast("int").alias("a"), F.explode(sides).alias("id"))
    t = told.groupBy("session_id", "segment", "last", "id").agg(F.sum(1 - F.col("a")).alias("c"), F.sum("a").alias("a"))
    found = F.array(
        F.struct(F.lit("orphan").alias("kind"), F.greatest(F.col("a") - F.col("c"), F.lit(0)).alias("n")),
        F.struct(F.lit("dup").alias("kind"), F.greatest(F.col("c") - 1, F.lit(0)).alias("n")),
        F.struct(F.lit("unanswered").alias("kind"), F.when(F.col("segment") < F.col("last"), F.greatest(F.col("c") - F.col("a"), F.lit(0))).otherwise(0).alias("n")),
    )
    rows = t.select("session_id", "id", F.explode(found).alias("d")).where("d.n > 0")
    return rows.groupBy("session_id", F.col("d.kind").alias("kind"), "id").agg(F.sum("d.n").cast("long").alias("n"))


def strict_defects(log: DataFrame) -> DataFrame:
    """session_id, idx, k, wanted, got where the k-th result behind an assistant is not the answer to its k-th call."""
    seg = log.withColumn("at", F.max(F.when(F.col("role") != "tool", F.col("idx"))).over(up_to()))
    asked = calls(log).select("session_id", F.col("idx").alias("at"), F.col("pos").alias("k"), F.col("id").alias("wanted"))
    k = F.row_number().over(Window.partitionBy("session_id", "at").orderBy("idx")) - 1
    given = seg.where("role = 'tool'").select("session_id", "at", k.alias("k"), F.col("call_id").alias("got"))
    pairs = asked.join(given, ["session_id", "at", "k"], "full")
    return pairs.where(~F.col("wanted").eqNullSafe(F.col("got"))).select("session_id", F.col("at").alias("idx"), "k", "wanted", "got")


def tool_runs(log: DataFrame) -> DataFrame:
    """Tool messages with flags for the first and last of a run."""
    flagged = log.withColumns({"prev": F.lag("role").over(in_order()), "next": F.lead("role").over(in_order())}).where("role = 'tool'")
    return flagged.select(
        "session_id", "idx", (~F.col("prev").eqNullSafe(F.lit("tool"))).alias("first"), (~F.col("next").eqNullSafe(F.lit("tool"))).alias("last")
    )


def superseded_snapshots(log: DataFrame) -> DataFrame:
    """Snapshot results older than the last unit that holds one."""
    numbered = log.withColumn("unit", F.sum(starts_unit(F.col("role")).cast("int")).over(up_to()))
    shots = numbered.where("role = 'tool' and tool_name = 'browser_snapshot'")
    return shots.withColumn("newest", F.max("unit").over(whole())).where("unit < newest").select("session_id", "idx")


def cut_walk(log: DataFrame, size: Column, limit: int) -> DataFrame:
    """session_id, cut: the start of the oldest unit such that it and all newer ones fit the limit."""
    body = with_head(log)
    newer = F.sum(size).over(Window.partitionBy("session_id").orderBy(F.desc("idx")))
    opens = (F.col("idx") >= F.col("h")) & (starts_unit(F.col("role")) | (F.col("idx") == F.col("h")))
    fits = F.min(F.when(opens & (F.col("sum") <= limit), F.col("idx")))
    return body.withColumn("sum", newer).groupBy("session_id").agg(F.coalesce(fits, F.first("n")).cast("int").alias("cut"))
