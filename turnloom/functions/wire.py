"""What travels between client and server: request bodies, response chunks, error bodies, and texts made for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of digits on which clients try again, so that no text of ours may hold them.
RETRY_RUNS = r"429|500|502|503|504|524"
LARGEST_SAFE = 9007199254740991
_STRING = r'"(?:[^"\\]|\\.)*+"'


def _kind(json: Column, path: str) -> Column:
    """What stands at the path: null, or the first letter of its JSON type (o, a, s, n, b, z for null)."""
    v = F.try_variant_get(F.try_parse_json(json), path, "variant")
    name = F.schema_of_variant(v)
    return (
        F.when(name.startswith("OBJECT"), "o").when(name.startswith("ARRAY"), "a").when(name == "STRING", "s").when(name == "BOOLEAN", "b").when(name == "VOID", "z").when(name.isNotNull(), "n")
    )


def has_unsafe_number(json: Column) -> Column:
    """A number beyond 2^53 - 1 in size, or beyond a double, outside of strings."""
    bare = F.regexp_replace(json, _STRING, '""')
    numbers = F.regexp_extract_all(bare, F.lit(r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"), F.lit(0))
    value = lambda n: n.try_cast("double")
    whole = lambda n: n.rlike(r"\A-?[0-9]+\z")
    digits = lambda n: F.regexp_replace(n, r"\A-?0*", "")
    beyond = lambda n: (F.length(digits(n)) > 16) | ((F.length(digits(n)) == 16) & (digits(n) > str(LARGEST_SAFE)))
    return F.exists(numbers, lambda n: F.when(whole(n), beyond(n)).otherwise((F.abs(value(n)) == float("inf")) | ((value(n) == F.floor(value(n))) & (F.abs(value(n)) > LARGEST_SAFE))))


def nesting_depth(json: Column) -> Column:
    """How deep objects and arrays nest in a JSON text; brackets within texts do not count."""
    brackets = F.regexp_replace(F.regexp_replace(json, _STRING, ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    return F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), start, step)["most"]


def unwrapped(json: Column) -> Column:
    """The chat body that a captured record holds: itself, or under body or request, as an object or as JSON text; else null."""
    is_chat = lambda j: F.coalesce(_kind(j, "$.messages") == "a", F.lit(False))
    inner = lambda k: F.get_json_object(json, f"$.{k}")
    return F.when(is_chat(json), json).when(is_chat(inner("body")), inner("body")).when(is_chat(inner("request")), inner("request"))


def body_defect(json: Column) -> Column:
    """Why a body is no chat request: invalid_json, not_an_object, no_messages, message_not_an_object; null if it is one."""
    messages = F.from_json(F.get_json_object(json, "$.messages"), "array<string>")
    return (
        F.when(F.try_parse_json(json).isNull(), "invalid_json")
        .when(~F.coalesce(_kind(json, "$") == "o", F.lit(False)), "not_an_object")
        .when(~F.coalesce(_kind(json, "$.messages") == "a", F.lit(False)), "no_messages")
        .when(F.exists(messages, lambda m: ~F.coalesce(F.ltrim(m).startswith("{"), F.lit(False))), "message_not_an_object")
    )


def legacy_prompts(json: Column) -> tuple[Column, Column]:
    """The prompts of a completion body, and why it has none: not_json, not_object, no_prompt, token_ids, unsupported."""
    kind, raw = _kind(json, "$.prompt"), F.get_json_object(json, "$.prompt")
    inside = F.regexp_replace(raw, _STRING, "s")
    all_texts, all_numbers = inside.rlike(r"\A\s*\[\s*s(?:\s*,\s*s)*\s*\]\s*\z"), inside.rlike(r"\A[\[\],\s0-9.eE+-]+\z")
    reason = (
        F.when(F.try_parse_json(json).isNull(), "not_json").when(~F.coalesce(_kind(json, "$") == "o", F.lit(False)), "not_object").when(kind.isNull(), "no_prompt").when(kind == "s", F.lit(None))
        .when(kind != "a", "unsupported").when(F.regexp_replace(raw, r"\s", "") == "[]", "no_prompt").when(all_texts, F.lit(None)).when(all_numbers, "token_ids").otherwise("unsupported")
    )
    prompts = F.when(kind == "s", F.array(raw)).when((kind == "a") & all_texts, F.from_json(raw, "array<string>"))
    return F.when(reason.isNull(), prompts), reason


def request_bytes(json: Column) -> Column:
    """UTF-8 bytes of messages and tools, and 512 for the rest."""
    size = lambda k: F.coalesce(F.octet_length(F.get_json_object(json, f"$.{k}")), F.lit(0))
    return (size("messages") + size("tools") + 512).cast("long")


def content_text(content: Column, ledger: bool = False) -> Column:
    """The text of a message's content, a JSON text or array of parts: text parts joined by line feeds; the ledger also reads bare strings, refusals and untyped parts."""
    parts = F.from_json(content, "array<string>")
    get = lambda p, k: F.get_json_object(p, f"$.{k}")
    is_object = lambda p: F.ltrim(p).startswith("{")
    kinds = ["text", "input_text", "output_text"] if ledger else ["text"]
    typed = lambda p: F.when(get(p, "type").isin(*kinds), get(p, "text"))
    wide = lambda p: F.when(~is_object(p), p).when(get(p, "type").isNull(), get(p, "text")).when(get(p, "type") == "refusal", get(p, "refusal")).otherwise(typed(p))
    texts = F.filter(F.transform(parts, wide if ledger else lambda p: F.when(is_object(p), typed(p))), lambda x: x.isNotNull())
    return F.when(F.ltrim(content).startswith("["), F.array_join(texts, "\n")).otherwise(F.coalesce(content, F.lit("")))


def image_count(content: Column) -> Column:
    parts = F.from_json(content, "array<string>")
    return F.when(F.ltrim(content).startswith("["), F.size(F.filter(parts, lambda p: F.get_json_object(p, "$.type").isin("image_url", "input_image", "image")))).otherwise(0).cast("long")


# ---------------------------------------------------------------- responses


def finish_reason(chunk: Column) -> Column:
    """The last finish reason among the choices that is a text."""
    reasons = F.filter(F.from_json(F.get_json_object(chunk, "$.choices"), "array<struct<finish_reason:string>>"), lambda c: c["finish_reason"].isNotNull())
    return F.try_element_at(reasons, F.lit(-1))["finish_reason"]


def usage(chunk: Column) -> Column:
    return F.when(_kind(chunk, "$.usage") == "o", F.from_json(F.get_json_object(chunk, "$.usage"), "prompt_tokens long, completion_tokens long"))


def usage_only(chunk: Column) -> Column:
    return F.coalesce(usage(chunk).isNotNull() & (F.regexp_replace(F.get_json_object(chunk, "$.choices"), r"\s", "") == "[]"), F.lit(False))


def is_error(chunk: Column) -> Column:
    return F.coalesce(~_kind(chunk, "$.error").isin("z"), F.lit(False))


def error_message(body: Column) -> Column:
    """error.message, an error that is a text, or message."""
    text = lambda path: F.when(_kind(body, path) == "s", F.get_json_object(body, path))
    return F.coalesce(text("$.error.message"), text("$.error"), text("$.message"))


def error_status(chunk: Column, http: Column) -> Column:
    """The status of an error within a stream: of the error, else of the chunk, else that of the response."""
    status = lambda path: F.when(F.trim(F.get_json_object(chunk, path)).rlike(r"\A[1-5][0-9]{2}\z"), F.trim(F.get_json_object(chunk, path)).cast("int"))
    return F.when(_kind(chunk, "$.error") == "o", F.coalesce(status("$.error.code"), status("$.error.http_status_code"), http)).otherwise(F.coalesce(status("$.code"), http))


def is_chat_path(method: Column, path: Column) -> Column:
    return (method == "POST") & F.regexp_replace(path, r"/+\z", "").endswith("/chat/completions")


def is_completion_path(method: Column, path: Column) -> Column:
    p = F.regexp_replace(path, r"/+\z", "")
    return (method == "POST") & p.endswith("/completions") & ~p.endswith("/chat/completions")


# ---------------------------------------------------------------- texts


def thousands(n: Column) -> Column:
    """About n in thousands with one decimal, such as 26.0k; where the whole part held a run that clients retry on, the largest lower value whose does not."""
    tenths = F.round(F.greatest(n, F.lit(0)) / 100).cast("long")
    whole = F.floor(tenths / 10).cast("long")

    def below(x: Column) -> Column:
        """The largest number below x whose digits up to the end of x's first run are others."""
        digits = x.cast("string")
        head = F.regexp_extract(digits, rf"\A(\d*?(?:{RETRY_RUNS}))", 1)
        return (head.cast("long") * F.pow(F.lit(10), F.length(digits) - F.length(head)).cast("long") - 1).cast("long")

    # a few runs follow one another (504, 503, 502), and a lower number may hold one further on
    best = F.aggregate(F.sequence(F.lit(1), F.lit(48)), whole, lambda x, _: F.when(x.cast("string").rlike(RETRY_RUNS), below(x)).otherwise(x))
    return F.concat(best.cast("string"), F.lit("."), F.when(best == whole, tenths - whole * 10).otherwise(9).cast("string"), F.lit("k"))


def too_large(need: Column, fit: Column, window: Column, reserve: Column) -> Column:
    """The body of an error: a conversation that does not fit even when compacted."""
    kept = F.when(reserve > 0, F.concat(F.lit(" after reserving "), thousands(reserve), F.lit(" for the reply"))).otherwise("")
    said = F.concat(F.lit("This conversation needs about "), thousands(need), F.lit(" tokens even after compaction, but at most "), thousands(F.greatest(fit, F.lit(0))), F.lit(" fit in this model's window ("), thousands(window), F.lit(")"), kept, F.lit(". The conversation must be compacted."))
    error = F.struct(said.alias("message"), F.lit("invalid_request_error").alias("type"), F.lit(None).cast("string").alias("param"), F.lit("context_length_exceeded").alias("code"))
    return F.to_json(F.struct(error.alias("error")), {"ignoreNullFields": "false"})


def without_quotes(text: Column) -> Column:
    """Quoted spans of one line become a space; a quote mark within a word is none."""
    out = text
    for a, z in ('""', "“”", "«»", "``", "''"):
        out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}]){a}[^{z}\n]*{z}(?![\p{{L}}\p{{N}}])", " ")
    return out


def natural_key(name: Column) -> Column:
    """Sorts names as people count: runs of digits by their number."""
    padded = F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0)), lambda p: F.when(p.rlike(r"\A\d"), F.lpad(F.regexp_replace(p, r"\A0+(?=\d)", ""), 20, "0")).otherwise(p))
    return F.array_join(padded, "")


#: Fillers by size in UTF-8; the first that a text does not hold itself stands for its characters.
POOLS = {1: "xyzwvu", 2: "éüøñ", 3: "一丁上下", 4: "😀😁😂😃"}


def placeholder(text: Column) -> Column:
    """As long as the text in characters, UTF-16 units, UTF-8 bytes and as JSON, with its line breaks; nothing else of it is left."""

    def filler(size: int) -> Column:
        out = F.lit(POOLS[size][-1])
        for c in reversed(POOLS[size][:-1]):
            out = F.when(~F.contains(text, F.lit(c)), c).otherwise(out)
        return out

    # control characters that never are in the result stand for the fillers until all else is replaced
    steps = ((r"[\x{00}-\x{07}\x{0B}\x{0E}-\x{1F}]", "\x01"), (r'[\t\x{08}\x{0C}"\\]', "\t"), (r"[\x{10000}-\x{10FFFF}]", "\x02"), (r"[\x{800}-\x{FFFF}]", "\x03"), (r"[\x{80}-\x{7FF}]", "\x04"), (r"[\x{20}-\x{7F}]", "\x05"))
    out = text
    for pattern, mark in steps:
        out = F.regexp_replace(out, pattern, mark)
    for mark, size in (("\x02", 4), ("\x03", 3), ("\x04", 2), ("\x05", 1)):
        out = F.replace(out, F.lit(mark), filler(size))
    return out
