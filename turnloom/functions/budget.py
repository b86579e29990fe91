"""Budget arithmetic as Column expressions over integer columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the default configuration.
DEFAULTS = {"margin": 512, "margin_fraction": 0.01, "allowance": 7000, "output_max": 32000, "trigger": 1.0, "target": 0.35, "summary": 0.04, "summary_max": 0.25, "tail": 0.25}
CLAMP_FLOOR, TGI_OUTPUT = 1024, 1024


def fraction(x: Column, f: float) -> Column:
    """floor(x * f), safe against drift."""
    return F.floor(x * F.lit(f) + F.lit(1e-9)).cast("long")


def budget(window: Column, reply: Column, tighten: Column, max_prompt: Column, d: dict[str, float] = DEFAULTS) -> dict[str, Column]:
    """All amounts for a window, a planned reply, a tightening and a learned prompt limit (or null)."""
    margin = F.greatest(F.lit(int(d["margin"])), F.ceil(window * F.lit(d["margin_fraction"]) - F.lit(1e-9))).cast("long")
    room = F.least(window - reply - margin, max_prompt - margin) - tighten
    point = window - F.least(reply, F.lit(int(d["output_max"])))
    allowance = F.least(F.lit(int(d["allowance"])), F.floor(reply / 2)).cast("long")
    hard = F.least(room, point - allowance)
    trigger = F.least(fraction(hard, d["trigger"]), hard)
    target = F.least(fraction(trigger, d["target"]), trigger - 1)
    summary = F.greatest(F.lit(0), F.least(fraction(room, d["summary"]), fraction(room, d["summary_max"])))
    head_room = room - fraction(room, d["summary"]) - fraction(room, d["tail"])
    out = {"margin": margin, "budget": room, "client_point": point, "allowance": allowance, "hard": hard, "trigger": trigger, "target": target, "summary_budget": summary, "head_room": head_room}
    return {k: v.cast("long") for k, v in out.items()}


def mode(server: Column, counts_reply: Column) -> Column:
    """How a server counts: by its type, unless it is known whether the limit counts the reply."""
    return (
        F.when(counts_reply, F.when(server == "tgi", "tgi").otherwise("strict_total"))
        .when(~counts_reply, F.when(server == "ollama", "silent_truncate").otherwise("prompt_only"))
        .when(server.isin("llamacpp", "lmstudio"), "prompt_only")
        .when(server == "tgi", "tgi")
        .when(server == "ollama", "silent_truncate")
        .otherwise("strict_total")
    )


def server_fits(mode_: Column, count: Column, reply: Column, limit: Column) -> Column:
    return F.when(mode_ == "strict_total", count + reply <= limit).when(mode_ == "tgi", count + F.least(reply, F.lit(TGI_OUTPUT)) <= limit).otherwise(count <= limit)


def clamp_clause(mode_: Column, count: Column, limit: Column, allowance: Column, point: Column) -> Column:
    return (mode_ == "strict_total") & (count <= limit - CLAMP_FLOOR) & (count + allowance < point)


def forwarded_reply(mode_: Column, count: Column, reply: Column, limit: Column, clamped: Column, restore_to: Column) -> tuple[Column, Column]:
    """The reply limit sent on, and what was done to it: unchanged, fit, restore or clamp."""
    room = limit - count
    over = ((mode_ == "strict_total") & (count + reply > limit)) | ((mode_ == "tgi") & (count + F.least(reply, F.lit(TGI_OUTPUT)) > limit))
    raised = F.least(restore_to, room)
    restore = (reply < restore_to) & (raised > reply)
    kind = F.when(clamped, F.when(room < reply, "clamp").otherwise("unchanged")).when(over, "fit").when(restore, "restore").otherwise("unchanged")
    value = F.when(clamped, F.least(reply, room)).when(over, room).when(restore, raised).otherwise(reply)
    return value.cast("long"), kind


def corrected(raw: Column, percent: Column) -> Column:
    return F.when(percent == 100, raw).otherwise(F.floor((raw * percent + 99) / 100)).cast("long")


def uncorrected(count: Column, percent: Column) -> Column:
    return F.when(percent == 100, count).otherwise(F.ceil(count * 100 / percent)).cast("long")


def tightened(now: Column, budget0: Column, raw: Column, most: Column) -> Column:
    """After an overflow: up to the next 256 of what the budget exceeds 95% of the raw count by, never down."""
    excess = budget0 - F.floor(raw * F.lit(0.95) + F.lit(1e-9))
    return F.least(most, F.greatest(now, F.ceil(excess / 256) * 256)).cast("long")
