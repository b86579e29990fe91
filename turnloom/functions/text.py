"""Column builders over strings. Lengths are UTF-16 units where the caps of a chat client count them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the JavaScript kind, as a character class body (fixed values).
SPACE = r"\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
JOIN = " […] "


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def collapse(text: Column) -> Column:
    """Each run of white space becomes one space; trimmed."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def head_units(text: Column, n: int) -> Column:
    """The longest head of at most n UTF-16 units that splits no surrogate pair."""
    short = F.substring(text, 1, n)
    # every character beyond the BMP takes two units: cut as many as needed, then one more if a pair straddles the cut
    return F.when(utf16_length(text) <= n, text).when(utf16_length(short) == F.length(short), short).otherwise(_cut(text, n))


def _cut(text: Column, n: int) -> Column:
    chars = F.regexp_extract_all(F.substring(text, 1, n), F.lit("(?s)."), F.lit(0))
    step = F.aggregate(
        chars,
        F.struct(F.lit("").alias("s"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("full")),
        lambda a, c: F.when(a["full"] | (a["n"] + utf16_length(c) > n), F.struct(a["s"].alias("s"), a["n"].alias("n"), F.lit(True).alias("full"))).otherwise(
            F.struct(F.concat(a["s"], c).alias("s"), (a["n"] + utf16_length(c)).alias("n"), F.lit(False).alias("full"))
        ),
    )
    return step["s"]


def _within(text: Column, n: int) -> Column:
    """At most n UTF-16 units; a character takes two at most."""
    return (F.length(text) <= n // 2) | (utf16_length(text) <= n)


def cap_head(text: Column, n: int) -> Column:
    return F.when(_within(text, n), text).otherwise(F.concat(F.regexp_replace(head_units(text, n), f"[{SPACE}]+\\z", ""), F.lit("…")))


def cap_head_tail(text: Column, n: int) -> Column:
    """Two thirds of the room from the head, one third from the tail; exact for texts within the BMP."""
    head = -(-2 * n // 3)
    left = F.regexp_replace(head_units(text, head), f"[{SPACE}]+\\z", "")
    right = F.regexp_replace(F.right(text, F.lit(n - head)), f"\\A[{SPACE}]+", "")
    return F.when(_within(text, n), text).otherwise(F.concat(left, F.lit(JOIN), right))


def visible(text: Column) -> Column:
    """The text behind the last closing think tag."""
    return F.substring_index(text, "</think>", -1)


def reasoning(text: Column) -> Column:
    """What stands between the last closing think tag and the opening one before it."""
    before = F.regexp_extract(text, r"(?s)\A(.*)</think>", 1)
    return F.when(text.contains("</think>"), F.trim(F.substring_index(before, "<think>", -1))).otherwise("")


def without_environment(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<environment_details>.*?</environment_details>", "")


def without_rules(text: Column) -> Column:
    """Lines that are exactly three dashes lose them."""
    return F.regexp_replace(text, r"(?m)^---$", "")


def sentences(text: Column) -> Column:
    """Trimmed sentences: cut behind . ! ? ; before white space, and at line feeds."""
    marked = F.regexp_replace(text, r"([.!?;])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "[\u0001\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def normal_sentence(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), r"[ .!?;:,]+\z", ""))


def content_words(text: Column, stop: list[str]) -> Column:
    words = F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)), lambda w: F.lower(w))
    return F.array_distinct(F.array_except(words, F.array(*map(F.lit, stop))))


def explicit_ids(text: Column) -> Column:
    """Upper-case dashed codes whose last segment holds a digit, between characters that are no letters or digits."""
    code = r"(?<![\p{L}\p{N}_])[A-Z]{2,}(?:-[A-Z0-9]+)*-[A-Z]*[0-9][A-Z0-9]*(?![\p{L}\p{N}_])"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(code), F.lit(0)))


def grouped(n: Column) -> Column:
    """Thousands separated by commas."""
    return F.format_number(n, 0)


def path_stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\A(?:\./)+", "")


def path_key(path: Column) -> Column:
    """The last two segments: equal for all spellings of one file."""
    return F.substring_index(path_stem(path), "/", -2)


def same_path(a: Column, b: Column) -> Column:
    x, y = path_stem(a), path_stem(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return (x == y) | (short.contains("/") & long.endswith(F.concat(F.lit("/"), short)))


def config_like(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(?:ya?ml|json|toml|ini|env|conf|cfg|properties)\z")


def glob_pattern(glob: str) -> str:
    """An anchored, case-insensitive pattern; * stands for any run."""
    import re

    return "(?is)\\A" + ".*".join(re.escape(p) for p in glob.split("*")) + "\\z"
