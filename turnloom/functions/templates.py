"""Chat templates: how a message is written into a prompt, and what that costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions import tokens
from turnloom.functions.let import let

#: Tokens of the glue that the templates write, images, and characters a token of other glue.
GLUE = {"\n": 1, "<|im_end|>\n": 2, "<|im_start|>user\n": 3, "<|im_start|>system\n": 3, "<|im_start|>assistant\n": 3, "\n<tool_call>\n": 3, "\n</tool_call>": 2, "<|im_start|>user\n<tool_response>\n": 6, "\n</tool_response><|im_end|>\n": 4}
GLUE_CHARS, IMAGE, GENERIC = 3, 1568, 8
#: Roles that a template takes.
KNOWN = ("system", "developer", "user", "assistant", "tool", "function")


def _call(name: Column, arguments: Column) -> Column:
    quoted = let(F.to_json(F.struct(name.alias("x"))), lambda x: x.substr(F.lit(6), F.length(x) - 6))
    # a plain name stands as it is in JSON
    quoted = F.when(name.rlike(r"\A[A-Za-z0-9_.-]+\z"), F.concat(F.lit('"'), name, F.lit('"'))).otherwise(quoted)
    return F.concat(F.lit('{"name": '), quoted, F.lit(', "arguments": '), F.coalesce(arguments, F.lit("null")), F.lit("}"))


def rendered(role: Column, content: Column, name: Column, arguments: Column) -> Column:
    """One message in chat markup: results are wrapped as the user's, calls follow the assistant's text; null for a role that no template takes."""
    text = F.coalesce(content, F.lit(""))
    call = F.when(name.isNotNull(), F.concat(F.lit("\n<tool_call>\n"), _call(name, arguments), F.lit("\n</tool_call>"))).otherwise("")
    return (
        F.when(role == "assistant", F.concat(F.lit("<|im_start|>assistant\n"), text, call, F.lit("<|im_end|>\n")))
        .when(role.isin("tool", "function"), F.concat(F.lit("<|im_start|>user\n<tool_response>\n"), text, F.lit("\n</tool_response><|im_end|>\n")))
        .when(role.isin("system", "developer", "user"), F.concat(F.lit("<|im_start|>"), F.when(role == "developer", "system").otherwise(role), F.lit("\n"), text, F.lit("<|im_end|>\n")))
    )


def glue_tokens(role: Column, name: Column) -> Column:
    """Tokens of what the template writes around a message."""
    call = F.when(name.isNotNull(), GLUE["\n<tool_call>\n"] + GLUE["\n</tool_call>"]).otherwise(0)
    return F.when(role == "assistant", F.lit(GLUE["<|im_start|>assistant\n"] + GLUE["<|im_end|>\n"]) + call).when(role.isin("tool", "function"), GLUE["<|im_start|>user\n<tool_response>\n"] + GLUE["\n</tool_response><|im_end|>\n"]).otherwise(GLUE["<|im_start|>user\n"] + GLUE["<|im_end|>\n"]).cast("long")


def measured(role: Column, content: Column, name: Column, arguments: Column, images: Column | None = None) -> Column:
    """Estimated tokens of a message: its text by class, its call as JSON, glue and images."""
    call = F.when(name.isNotNull(), tokens.estimate(_call(name, arguments), F.lit("json"))).otherwise(0)
    return (tokens.estimate(F.coalesce(content, F.lit(""))) + call + glue_tokens(role, name) + IMAGE * (F.lit(0) if images is None else images)).cast("long")


def generic(content: Column, reasoning: Column, arguments: Column) -> Column:
    """Without a template: a fixed share for the message, and all its texts."""
    part = lambda c, *cls: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, tokens.estimate(c, *cls)).otherwise(0)
    return (GENERIC + part(content) + part(reasoning) + part(arguments, F.lit("json"))).cast("long")


def both(role: Column, content: Column, name: Column, arguments: Column) -> Column:
    """tokens (measured) and generic of a message without images and reasoning, with its text estimated once."""
    text = tokens.estimate(F.coalesce(content, F.lit("")))
    call = F.when(name.isNotNull(), tokens.estimate(_call(name, arguments), F.lit("json"))).otherwise(0)
    own = F.when(F.coalesce(F.length(arguments), F.lit(0)) > 0, tokens.estimate(arguments, F.lit("json"))).otherwise(0)
    return let(text, lambda n: F.struct((n + call + glue_tokens(role, name)).cast("long").alias("tokens"), (GENERIC + n + own).cast("long").alias("generic")))


def fixed_chars(json: Column) -> Column:
    """The plain estimate: a quarter of the characters of the JSON."""
    return F.floor(F.length(json) / 4).cast("long")
