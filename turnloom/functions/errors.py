"""Classification of server error bodies by an ordered list of patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.wire import error_message

#: Fixed values (the servers' own messages), in the order of precedence: id, kind, statuses (empty: any), pattern with named numbers.
RULES: list[tuple[str, str, tuple[int, ...], str]] = [
    ("vllm.v018.total", "overflow_total", (), r"This model's maximum context length is (?<window>\d+) tokens\. However, you requested (?<completion>\d+) output tokens and your prompt contains (?<atLeast>at least )?(?<prompt>\d+) input tokens"),
    ("vllm.v018.chars", "overflow_total", (), r"This model's maximum context length is (?<window>\d+) tokens\. However, you requested (?<completion>\d+) output tokens and your prompt contains (?<chars>\d+) characters \(more than \d+ characters, which is the upper bound for (?<maxInput>\d+) input tokens\)"),
    ("vllm.v016.tokens", "overflow_total", (), r"You passed (?<prompt>\d+) input tokens and requested (?<completion>\d+) output tokens\. However, the model's context length is only (?<window>\d+) tokens, resulting in a maximum input length of (?<maxInput>\d+) tokens"),
    ("vllm.v016.chars", "overflow_total", (), r"You passed (?<chars>\d+) input characters and requested (?<completion>\d+) output tokens\. However, the model's context length is only (?<window>\d+) tokens"),
    ("vllm.v011.total", "overflow_total", (), r"'max_tokens' or 'max_completion_tokens' is too large: (?<completion>\d+)\. This model's maximum context length is (?<window>\d+) tokens and your request has (?<prompt>\d+) input tokens"),
    ("vllm.v011.prompt", "overflow_prompt", (), r"This model's maximum context length is (?<window>\d+) tokens\. However, your request has (?<prompt>\d+) input tokens"),
    ("vllm.legacy.total", "overflow_total", (), r"This model's maximum context length is (?<window>\d+) tokens\. However, you requested (?<total>\d+) tokens \((?<prompt>\d+) in the messages, (?<completion>\d+) in the completion\)"),
    ("vllm.legacy.prompt", "overflow_prompt", (), r"This model's maximum context length is (?<window>\d+) tokens\. However, you requested (?<prompt>\d+) tokens in the (?:messages|input)"),
    ("vllm.max_tokens_gt_window", "max_tokens_too_large", (), r"(?:max_tokens|max_completion_tokens)=(?<completion>\d+) cannot be greater than max_model_len=(?<window>\d+)"),
    ("vllm.engine.prompt", "overflow_prompt", (), r"The (?:decoder )?prompt \(length (?<prompt>\d+)\) (?:plus the number of requested output tokens \(at least 1\) )?is longer than the maximum model length of (?<window>\d+)"),
    ("vllm.any", "overflow_total", (), r"This model's maximum context length is (?<window>\d+) tokens"),
    ("sglang.total", "overflow_total", (), r"Requested token count exceeds the model's maximum context length of (?<window>\d+) tokens\. You requested a total of (?<total>\d+) tokens: (?<prompt>\d+) tokens from the input messages and (?<completion>\d+) tokens for the completion"),
    ("sglang.prompt", "overflow_prompt", (), r"The input \((?<prompt>\d+) tokens\) is longer than the model's context length \((?<window>\d+) tokens\)"),
    ("sglang.sched", "overflow_prompt", (), r"Input length \((?<prompt>\d+) tokens\) exceeds the maximum allowed length \((?<maxInput>\d+) tokens\)"),
    ("sglang.kv", "overflow_prompt", (), r"Request prompt exceeds the KV memory budget: input_len=(?<prompt>\d+)"),
    ("llamacpp.new", "overflow_prompt", (), r"request \((?<prompt>\d+) tokens\) exceeds the available context size \((?<window>\d+) tokens\)"),
    ("llamacpp.new.nosplit", "overflow_prompt", (), r"input \((?<prompt>\d+) tokens\) is larger than the max context size \((?<window>\d+) tokens\)"),
    ("llamacpp.old", "overflow_prompt", (), r"(?:the request exceeds the available context size|input is larger than the max context size)"),
    ("llamacpp.type", "overflow_prompt", (), r'"type"\s*:\s*"exceed_context_size_error"'),
    ("tgi.total", "overflow_total", (), r"`inputs` tokens \+ `max_new_tokens` must be <= (?<window>\d+)\. Given: (?<prompt>\d+) `inputs` tokens and (?<completion>\d+) `max_new_tokens`"),
    ("tgi.prompt", "overflow_prompt", (), r"`inputs` must have less than (?<maxInput>\d+) tokens\. Given: (?<prompt>\d+)"),
    ("lmstudio.keep", "overflow_prompt", (), r"Trying to keep the first (?<prompt>\d+) tokens when context the overflows\. However, the model is loaded with context length of only (?<window>\d+) tokens"),
    ("llamacpp.nkeep.legacy", "overflow_prompt", (), r"(?:The number of tokens to keep from the initial prompt is greater than the context length|n_keep: (?<prompt>\d+)\s*>= n_ctx: (?<window>\d+))"),
    ("ollama.prompt", "overflow_prompt", (), r"(?:the prompt is longer than the context length currently available to the model|input (?:after truncation )?exceeds (?:the )?maximum context length|the input length exceeds the context length)"),
    ("litellm.cwe", "overflow_unknown", (), r"(?:ContextWindowExceededError|litellm\._pre_call_checks: Context Window exceeded)"),
    ("openai.code", "overflow_unknown", (), "context_length_exceeded"),
    ("http.413", "payload_too_large", (413,), ""),
    ("gateway.5xx", "gateway_error", (502, 503, 504), ""),
    ("generic.suspect", "overflow_suspect", (400, 413, 422), r"(?i)context (?:length|window|size)|maximum context|too many tokens|prompt is too long|reduce the length|token limit"),
]
#: Bodies that are never an overflow.
EXCLUSIONS = [("rate_limit", r"(?i)rate limit|too many requests|throttl"), ("stream_options", r"Stream options can only be defined when `stream=True`")]
NUMBERS = ("window", "prompt", "completion", "total", "maxInput", "chars")
#: Rules whose prompt number is a lower bound, always or where the text says at least; rules with numbers in fields of the body.
LOWER_BOUND, AT_LEAST = ("vllm.v016.tokens", "lmstudio.keep"), ("vllm.v018.total",)
FIELDS = {r: {"prompt": "$.error.n_prompt_tokens", "window": "$.error.n_ctx"} for r in ("llamacpp.new", "llamacpp.new.nosplit", "llamacpp.old", "llamacpp.type")}


def groups(pattern: str) -> tuple[str, dict[str, int]]:
    """The pattern with plain groups, and the number of each named one."""
    names = re.findall(r"\(\?<(\w+)>", pattern)
    return re.sub(r"\(\?<\w+>", "(", pattern), {n: i for i, n in enumerate(names, 1)}


def _whole(text: Column) -> Column:
    return F.when(text.rlike(r"\A[0-9]{1,18}\z"), F.try_to_number(text, F.lit("9" * 18)).cast("long"))


def message_of(body: Column) -> Column:
    """The error's message: of a JSON body its own, of any other the whole."""
    return F.when(F.try_parse_json(body).isNull(), body).otherwise(error_message(body))


def classify(status: Column, body: Column, message: Column, rules: list = RULES, exclusions: list = EXCLUSIONS) -> dict[str, Column]:
    """rule, kind and the numbers of the first rule that fits; nulls if an exclusion or no rule does.

    Numbers in fields of a JSON body go before those of its text. lower_bound says that the prompt's number is one; in_message
    that the numbers stand in the error's message or in fields, not in some input that the body repeats. message is a column
    of its own, as every rule reads it.
    """
    none = F.lit(None)
    out: dict[str, Column] = {k: none.cast("string") for k in ("rule", "kind")} | {n: none.cast("long") for n in NUMBERS} | {"lower_bound": F.lit(False), "in_message": F.lit(False)}
    for rule, kind, statuses, pattern in reversed(rules):
        plain, named = groups(pattern)
        fits = body.rlike(plain) if plain else F.lit(True)
        if statuses:
            fits = fits & status.isin(*statuses)
        # where the message itself fits, its numbers count
        told = F.coalesce(message.rlike(plain), F.lit(False)) if plain else F.lit(False)
        text = F.when(told, message).otherwise(body)
        said = {n: _whole(F.regexp_extract(text, plain, named[n])) for n in NUMBERS if n in named}
        fields = {n: _whole(F.get_json_object(body, path)) for n, path in FIELDS.get(rule, {}).items()}
        numbers = {n: F.coalesce(*(d[n] for d in (fields, said) if n in d)) if n in said or n in fields else none.cast("long") for n in NUMBERS}
        some = F.coalesce(*numbers.values()).isNotNull()
        new = {"rule": F.lit(rule), "kind": F.lit(kind)} | numbers
        new["lower_bound"] = F.lit(rule in LOWER_BOUND) if rule not in AT_LEAST else F.regexp_extract(text, plain, named["atLeast"]) != ""
        new["in_message"] = some & (told | F.coalesce(*fields.values()).isNotNull()) if fields else some & told
        out = {k: F.when(fits, new[k]).otherwise(v) for k, v in out.items()}
    excluded = F.lit(False)
    for _, pattern in exclusions:
        excluded = excluded | body.rlike(pattern)
    return {k: F.when(~excluded, v) for k, v in out.items()}


def validated(c: dict[str, Column], configured: Column, raw: Column) -> dict[str, Column]:
    """Numbers of a classified body that may be believed, and why one is refused.

    Numbers outside the error's message count for nothing. A prompt's count must lie within 0.8 and 1.25 of our own count, or nothing of the body counts; a window must be lower
    than the configured one; a limit of the prompt (one less where the server says less than) at least a quarter of it.
    """
    prompt, window = c["prompt"], c["window"]
    limit = F.when(c["rule"] == "tgi.prompt", c["maxInput"] - 1).otherwise(c["maxInput"])
    bound, inside = F.coalesce(c["lower_bound"], F.lit(False)), F.coalesce(c["in_message"], F.lit(False))
    in_band = inside & (bound | F.coalesce((raw > 0) & (prompt >= 0.8 * raw) & (prompt <= 1.25 * raw), prompt.isNull()))
    window_ok, limit_ok = (window > 0) & (window < configured), (limit >= 0.25 * configured) & (limit < configured)
    refused = (
        F.when(~inside, F.when(window.isNotNull() | limit.isNotNull(), "echo")).when(~in_band, "prompt").when(window.isNotNull() & ~window_ok, "window").when(window.isNull() & limit.isNotNull() & ~limit_ok, "limit")
    )
    return {"window": F.when(in_band & window_ok, window), "max_prompt": F.when(in_band & window.isNull() & limit_ok, limit), "prompt_exact": F.when(in_band & ~bound, prompt), "prompt_least": F.when(inside & bound, prompt), "refused": refused}
