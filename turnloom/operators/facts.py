"""Facts of a message log and the ledger that a summary is written from.

Every extraction is an expression over one message; the ledger is their union, one row per item: session_id, id, category,
section, idx, rank, pos, line. A rank orders the items of a category (smaller stays longer), a pos those of a section; both are
arrays that compare element by element.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text as t
from turnloom.functions.let import bound as let
from turnloom.operators import structure as s
from turnloom.operators import supersede

#: Categories by priority, how many of them form the floor, sections in the order of the summary.
CATEGORIES = ("user", "decision", "todo", "file", "rest", "narrative1", "narrative2", "toolLog")
FLOOR = 6
SECTIONS = {
    "user": "## User instructions", "decisions": "## Decisions", "todos": "## Open points", "files": "## Files", "browser": "## Browser", "test": "## Last test run", "paths": "## Paths", "notes": "## Notes", "log": "## Tool log",
}
#: Caps of an item, of a call's arguments, of a user's text, of a message's narrative; excerpts of results.
ITEM, ARGUMENTS, USER, NARRATIVE = 300, 120, 4000, 600
VERBATIM, HEAD, TAIL = 300, 240, 160
#: Roles of tools, by globs on their names.
ROLES = {
    "snapshot": ["*browser_*"], "browserNavigate": ["*browser_navigate", "*browser_navigate_back", "*browser_tabs"], "todo": ["todowrite", "todo_write", "*update_todo_list"],
    "read": ["read", "*read_file", "view"], "edit": ["edit", "multiedit", "apply_patch", "*apply_diff"], "write": ["write", "*write_to_file"], "shell": ["bash", "shell", "*execute_command"],
}
#: Argument names that hold a path, and commands that run tests.
PATH_KEYS = ("filePath", "file_path", "path", "filename", "file")
TEST_COMMANDS = r"(?i)\b(?:playwright test|jest|vitest|pytest|go test|mvn\b.*\btest|gradle\b.*\btest|(?:npm|yarn|pnpm)(?: run)? test|cargo test)\b"
TAGS = {"DECISION": "decision", "TODO": "todo", "BLOCKED": "blocked", "NOTE": "note"}
#: Fixed value: an upper-case label with a colon.
LABEL = r"\b[A-Z][A-Z0-9]{2,}(?:[-_][A-Z0-9]+)*:"
#: Texts of clients that are no instruction of a user.
BOILERPLATE = ("Attached media from tool result:", "Continue if you have next steps")


def has_role(name: Column, role: str, roles: dict[str, list[str]] = ROLES) -> Column:
    return let(_plain(name), lambda n: _has(n, role, roles))


#: Case counts for nothing in A to Z.
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def _plain(name: Column) -> Column:
    return F.translate(name, _UPPER, _LOWER)


def _has(plain: Column, role: str, roles: dict[str, list[str]] = ROLES) -> Column:
    out = F.lit(False)
    for glob in roles[role]:
        text = glob.translate(str.maketrans(_UPPER, _LOWER)).strip("*")
        if "*" in text:
            fits = plain.rlike(t.glob_pattern(glob))
        elif glob.endswith("*"):
            fits = plain.contains(text) if glob.startswith("*") else plain.startswith(text)
        else:
            fits = plain.endswith(text) if glob.startswith("*") else plain == text
        out = out | fits
    return F.coalesce(out, F.lit(False))


def user_text(content: Column) -> Column:
    return F.trim(t.without_environment(F.coalesce(content, F.lit(""))))


def is_instruction(role: Column, text: Column, boilerplate: tuple[str, ...] = BOILERPLATE) -> Column:
    return (text != "") & ~text.isin(*boilerplate) & ~s.is_prior_summary(role, text)


def user_facts(log: DataFrame, boilerplate: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """session_id, idx, text, fact: what a user said, and whether it is an instruction."""
    text = user_text(F.col("content"))
    return log.where("role = 'user'").select("session_id", "idx", text.alias("text"), is_instruction(F.col("role"), text, boilerplate).alias("fact"))


def user_items(log: DataFrame, heads: int = 1) -> DataFrame:
    """session_id, idx, body, suffix of each instruction: its sentences that no later message replaces, and by which the others were.

    The first heads messages of a user are the task: what replaces a sentence of theirs amends it, and they stay whole.
    """
    # what was replaced is joined as one row a session, so that texts are not dealt out by message and sentence
    gone = supersede.superseded(log, heads).groupBy("session_id").agg(F.collect_list(F.struct("idx", "sentence", "by_idx", "rule")).alias("gone"))
    every = F.coalesce("gone", F.array().cast("array<struct<idx:int,sentence:int,by_idx:int,rule:string>>"))
    facts_ = user_facts(log).where("fact").join(gone, "session_id", "left").withColumn("gone", every)
    mine = F.filter("gone", lambda g: (g["idx"] == F.col("idx")) & (g["rule"] != "amends"))
    amends = F.when(F.exists("gone", lambda g: (g["by_idx"] == F.col("idx")) & (g["rule"] == "amends")), " (amends the task)").otherwise("")

    def item(mine: Column) -> Column:
        left = F.array_join(F.filter(t.sentences(F.col("text")), lambda x, n: ~F.exists(mine, lambda g: g["sentence"] == n)), " ")
        by = F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(mine, lambda g: g["by_idx"]))), lambda i: F.concat(F.lit("#"), i.cast("string"))), ", ")
        status = lambda x: F.when(x == "", F.concat(F.lit("(superseded by "), by, F.lit(")"))).otherwise(F.concat(F.lit("(part superseded by "), by, F.lit(")")))
        whole = F.struct(F.col("text").alias("body"), F.lit("").alias("status"))
        return F.when(F.size(mine) == 0, whole).otherwise(let(left, lambda x: F.struct(x.alias("body"), status(x).alias("status"))))

    per = facts_.where(F.size(t.sentences(F.col("text"))) > 0).select("session_id", "idx", let(mine, item).alias("x"), amends.alias("amends"))
    return per.select("session_id", "idx", F.col("x.body").alias("body"), F.trim(F.concat("x.status", "amends")).alias("suffix"))


#: What a path may be made of, and the longest run that is looked at.
PATH_RUN, MOST_RUN = r"(?<![\w@.:/-])(?:\.{1,2}/|/)?(?:[\w.@+-]+/)+[\w.@+-]*\.[A-Za-z0-9]{1,8}\b", 512


def output_paths(log: DataFrame, most: int = 3) -> DataFrame:
    """session_id, idx, path, place: files that a result names, but not its call's own: configurations first, then by place, few a result.

    Spellings of one file are one, at its first place and in its longest form; URLs and lists of bare paths name none.
    """
    r = log.where("role = 'tool' and content like '%/%'").select("session_id", "idx", "content")
    own = call_facts(log).where("path is not null").select("session_id", F.col("idx").alias("call_idx"), F.col("path").alias("own"))
    pair = s.call_for(log).select("session_id", F.col("result_idx").alias("idx"), "call_idx").join(own, ["session_id", "call_idx"])
    lines = F.filter(F.split("content", "\n"), lambda x: x.contains("/") & ~x.contains("Full output saved to:") & (F.length(x) > 0))
    full = F.filter(F.split("content", "\n"), lambda x: F.trim(x) != "")
    listing = F.size(F.filter(full, lambda x: x.rlike(r"\A\s*(?:[\w.@+-]+/)*[\w.@+-]+/?\s*\z") & x.contains("/"))) * 2 >= F.size(full)
    found = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(PATH_RUN), F.lit(0))))
    p = r.where((F.size(full) < 4) | ~listing).select("session_id", "idx", F.posexplode(found).alias("at", "path")).where(F.length("path") <= MOST_RUN)
    p = p.join(pair.select("session_id", "idx", "own"), ["session_id", "idx"], "left").where(F.col("own").isNull() | ~t.same_path(F.col("own"), F.col("path")))
    one = p.withColumn("key", t.path_key(F.col("path"))).groupBy("session_id", "idx", "key").agg(F.min("at").alias("at"), F.max(F.struct(F.length("path"), F.col("path"))).alias("m"))
    place = F.row_number().over(Window.partitionBy("session_id", "idx").orderBy(F.desc(t.config_like(F.col("m.path"))), "at"))
    return one.select("session_id", "idx", F.col("m.path").alias("path"), place.alias("place")).where(F.col("place") <= most)


def one_line(text: Column) -> Column:
    """Control characters as visible escapes."""
    out = F.replace(F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    for c in [*range(32), 127, 0x85, 0x2028, 0x2029]:
        if c not in (9, 10, 13):
            out = F.replace(out, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    return F.when(text.rlike(r"[\x{00}-\x{1F}\x{7F}\x{85}\x{2028}\x{2029}]"), out).otherwise(text)


#: Fixed value: what may stand before a tag in its line.
LEAD = r"\s*(?:[-*•>]\s+|\d+[.)]\s+)?(?:\*\*|__)?"


def said_parts(content: Column, tags: dict[str, str] = TAGS) -> Column:
    """What a message says, in order: line, ord, kind (a tag, label or rest), raw, of which said_text makes the item's text.

    A line with tagged sentences gives one item for each, up to the next; else a line with a label is one item; else it is
    part of the narrative. Bullets and emphasis in front of a tag do not count. A line is an item of one class only.
    """
    names = "|".join(tags)

    def kind(name: Column) -> Column:
        out = F.lit("")
        for k, tag in tags.items():
            out = F.when(name == k, tag).otherwise(out)
        return out

    def line(whole: Column, i: Column) -> Column:
        parts = F.split(whole, rf"(?<=[.!?;])\s+(?=(?:\*\*|__)?(?:{names}):)")
        item = lambda ord_, kind, raw: F.struct(i.alias("line"), ord_.alias("ord"), kind.alias("kind"), raw.alias("raw"))
        tagged = F.filter(F.transform(parts, lambda p: let(F.regexp_extract(p, rf"\A{LEAD}({names}):", 1), lambda n: F.struct(kind(n).alias("kind"), p.alias("raw")))), lambda x: x["kind"] != "")
        other = F.array(item(F.lit(0), F.when(whole.contains(":") & whole.rlike(LABEL), "label").otherwise("rest"), whole))
        some = F.lit(False)
        for name in tags:
            some = some | whole.contains(f"{name}:")
        return F.when(some, let(tagged, lambda t_: F.when(F.size(t_) > 0, F.transform(t_, lambda x, n: item(n, x["kind"], x["raw"]))).otherwise(other))).otherwise(other)

    return F.flatten(F.transform(F.split(t.visible(F.coalesce(content, F.lit(""))), "\n"), line))


def said_text(kind: Column, raw: Column, tags: dict[str, str] = TAGS) -> Column:
    open_ = F.regexp_replace(F.trim(raw), rf"\A{LEAD}((?:{'|'.join(tags)}):)(?:\*\*|__)?\s*", "$1 ")
    bare = let(open_, lambda x: F.when(x.endswith("**") | x.endswith("__"), F.regexp_replace(x, r"(?:\*\*|__)+\z", "")).otherwise(x))
    short = lambda x: let(t.collapse(x), lambda y: t.cap_head(y, ITEM))
    return F.when(kind == "rest", raw).when(kind == "label", short(raw)).otherwise(short(bare))


def said(log: DataFrame, tags: dict[str, str] = TAGS) -> DataFrame:
    """What assistants said, line by line (said_parts): session_id, idx, line, ord, kind, text."""
    # a plain explode would have the parts made anew in a filter before it
    parts = log.where("role = 'assistant'").select("session_id", "idx", F.explode_outer(said_parts(F.col("content"), tags)).alias("x"))
    return parts.select("session_id", "idx", "x.line", "x.ord", "x.kind", said_text(F.col("x.kind"), F.col("x.raw"), tags).alias("text"))


def narrative_text(parts: Column) -> Column:
    """The lines of said_parts that are no items, on one line; empty if there are none."""
    rest = F.transform(F.filter(parts, lambda x: x["kind"] == "rest"), lambda x: x["raw"])
    return let(F.trim(F.array_join(rest, "\n")), lambda x: t.collapse(t.cap_head_tail(x, NARRATIVE)))


def narrative(said_: DataFrame) -> DataFrame:
    """session_id, idx, text: the lines that are no items, on one line."""
    rest = said_.where("kind = 'rest'").groupBy("session_id", "idx").agg(F.array_sort(F.collect_list(F.struct("line", F.col("text").alias("raw"), "kind"))).alias("l"))
    return rest.select("session_id", "idx", narrative_text(F.col("l")).alias("text")).where("text <> ''")


def _argument(arguments: Column, key: str) -> Column:
    # a key that stands nowhere, and cannot be written with escapes, needs no parsing
    return F.when(arguments.contains(key) | arguments.contains("\\"), F.get_json_object(arguments, f"$.{key}"))


def call_path(arguments: Column) -> Column:
    return F.coalesce(*(let(F.trim(_argument(arguments, k)), lambda x: F.when(x != "", x)) for k in PATH_KEYS))


def call_command(arguments: Column) -> Column:
    return F.coalesce(_argument(arguments, "command"), _argument(arguments, "cmd"))


def file_action(name: Column) -> Column:
    return let(_plain(name), lambda n: F.when(_has(n, "read"), "read").when(_has(n, "edit"), "edit").when(_has(n, "write"), "write"))


def runs_tests(command: Column) -> Column:
    return F.coalesce(command.rlike(TEST_COMMANDS), F.lit(False))


def key_arguments(path: Column, url: Column, command: Column, arguments: Column) -> Column:
    cap = lambda x: let(t.collapse(x), lambda y: t.cap_head(y, ARGUMENTS))
    bare = let(F.coalesce(arguments, F.lit("")), lambda a: F.when(F.regexp_replace(a, r"\s", "") == "{}", "").otherwise(a))
    return F.when(path.isNotNull(), cap(path)).when(url.isNotNull(), cap(url)).when(command.isNotNull(), F.concat(F.lit("`"), cap(command), F.lit("`"))).otherwise(cap(bare))


def call_facts(log: DataFrame) -> DataFrame:
    """session_id, idx, name, key_args, path, action, url, command, test: the first call of each assistant message."""
    c = log.where("role = 'assistant' and call_id is not null").withColumn("name", F.coalesce("tool_name", F.lit("")))
    arguments = F.col("arguments")
    path, command, url = call_path(arguments), call_command(arguments), _argument(arguments, "url")
    return c.select("session_id", "idx", "call_id", "name", key_arguments(path, url, command, arguments).alias("key_args"), path.alias("path"), F.when(path.isNotNull(), file_action(F.col("name"))).alias("action"), url.alias("url"), command.alias("command"), runs_tests(command).alias("test"))


def todos(value: Column) -> Column:
    """Items (content, status) of a todo list: a JSON array of texts or objects, or a checklist in markdown; null if it is neither."""
    entry = F.regexp_extract_all(value, F.lit(r"(?m)^[^\S\n]*(?:[-*][^\S\n]*)?\[([ xX~-])\][^\S\n]*(?:\S.*)$"), F.lit(0))
    marks = F.transform(entry, lambda e: F.struct(F.trim(F.regexp_extract(e, r"\[[ xX~-]\](.*)$", 1)).alias("content"), F.regexp_extract(e, r"\[([ xX~-])\]", 1).alias("mark")))
    listed = F.transform(marks, lambda m: F.struct(m["content"].alias("content"), F.when(m["mark"] == " ", "pending").when(F.lower(m["mark"]) == "x", "completed").otherwise("in_progress").alias("status")))
    raw = F.from_json(value, "array<string>")
    get = lambda o, k: F.get_json_object(o, f"$.{k}")
    done = lambda o: F.when(get(o, "completed") == "true", "completed").otherwise("pending")
    objects = F.transform(raw, lambda o: F.when(o.startswith("{"), F.struct(F.coalesce(get(o, "content"), get(o, "text"), get(o, "title"), get(o, "task"), F.lit("")).alias("content"), F.lower(F.coalesce(get(o, "status"), done(o))).alias("status"))).otherwise(F.struct(o.alias("content"), F.lit("pending").alias("status"))))
    return F.when(F.trim(value).startswith("["), F.when(F.size(listed) > 0, listed).otherwise(objects)).when(F.size(listed) > 0, listed)


CLOSED = {"completed": "completed", "complete": "completed", "done": "completed", "cancelled": "cancelled", "canceled": "cancelled"}


def todo_closure(items: Column) -> Column:
    """How many items are closed, by state, completed ones first: '2 completed, 1 cancelled'; null if none is."""
    count = lambda name: F.size(F.filter(items, lambda i: i["status"].isin(*[k for k, v in CLOSED.items() if v == name])))
    part = lambda name: F.when(count(name) > 0, F.concat(count(name).cast("string"), F.lit(f" {name}")))
    text = F.concat_ws(", ", part("completed"), part("cancelled"))
    return F.when(text != "", text)


def patch_files(patch: Column) -> Column:
    """(path, action) of the headers of a patch: '*** Add File:' and its like, and '+++ b/path' of a diff."""
    head = F.regexp_extract_all(patch, F.lit(r"(?m)^\*\*\* (?:Add File|Update File|Delete File|Move to): .+$"), F.lit(0))
    named = F.transform(head, lambda h: F.struct(F.rtrim(F.regexp_extract(h, r": (.+)$", 1)).alias("path"), F.when(h.startswith("*** Add"), "write").when(h.startswith("*** Delete"), "delete").otherwise("edit").alias("action")))
    diff = F.transform(F.regexp_extract_all(patch, F.lit(r"(?m)^\+\+\+ (?:b/)?(\S+)"), F.lit(1)), lambda p: F.struct(p.alias("path"), F.lit("edit").alias("action")))
    return F.array_distinct(F.filter(F.concat(named, diff), lambda f: (f["path"] != "") & (f["path"] != "/dev/null")))


def open_tabs(text: Column) -> Column:
    """(index, current, title, url) of the lines below '### Open tabs', up to the next heading."""
    block = F.regexp_extract(text, r"(?s)### Open tabs[^\n]*\n(.*?)(?:\n### |\z)", 1)
    line = r"^\s*-\s*(\d+):\s*(\(current\)\s*)?\[(.*)\]\s*\(([^()\s]*(?:\([^()\s]*\)[^()\s]*)*)\)\s*$"
    rows = F.filter(F.split(block, "\n"), lambda x: x.rlike(line))
    return F.transform(rows, lambda x: F.struct(F.regexp_extract(x, line, 1).cast("int").alias("index"), (F.regexp_extract(x, line, 2) != "").alias("current"), F.regexp_extract(x, line, 3).alias("title"), F.regexp_extract(x, line, 4).alias("url")))


def saved_path(text: Column) -> Column:
    """Where a cut output was saved to, without punctuation behind it; null if it does not say."""
    path = F.regexp_replace(F.regexp_extract(text, r"Full output saved to:\s*(\S+)", 1), r"[.,;)]+\z", "")
    return F.when(path != "", path)


def result_kind(text: Column, name: Column, test: Column) -> Column:
    """snapshot, test or other. A file's text is a snapshot only by a line of its own, and no test run; name is null for an orphan."""
    counts = text.contains("passed") | text.contains("failed") | text.contains("Tests:")

    def runs(n: Column) -> Column:
        any_role = F.lit(False)
        for role in ROLES:
            any_role = any_role | _has(n, role)
        return n.isNull() | _has(n, "shell") | ~any_role

    counted = counts & text.rlike(r"(?m)\b\d+ (?:passed|failed)\b|^[^\S\n]*Tests:") & let(_plain(name), runs)
    return F.when(is_snapshot(text, name), "snapshot").when(counted | F.coalesce(test, F.lit(False)), "test").otherwise("other")


def is_snapshot(text: Column, name: Column) -> Column:
    # what costs little comes first: most texts hold none of these words
    page = text.contains("Page Snapshot:") | text.contains("Page URL:")
    file = lambda n: _has(n, "read") | _has(n, "edit") | _has(n, "write")
    return page & let(_plain(name), lambda n: ~file(n) | text.rlike(r"(?m)^[^\S\n]*- Page Snapshot:")) & (F.regexp_count(text, F.lit(r"\[ref=")) >= 10)


def tally(text: Column) -> Column:
    """The last line that counts tests; null if there is none."""
    lines = F.filter(F.split(text, "\n"), lambda x: (F.length(x) < 400) & x.rlike(r"(?i)\b\d+\s+(?:passed|failed|flaky|skipped|passing|failing|pending|errors?|did not run)\b|^\s*Tests?:\s"))
    return t.collapse(F.try_element_at(lines, F.lit(-1)))


def condensed(text: Column, kind: Column) -> Column:
    """A result on one line: a snapshot's page, a test run's tally, a short text whole, a long one's head and tail."""
    value = lambda key: F.trim(F.regexp_extract(text, rf"(?m)^[^\S\n]*- {key}:[ \t]*(.*)$", 1))
    page = F.concat(F.lit("page "), value("Page URL"), F.lit(" ("), value("Page Title"), F.lit("), "), F.regexp_count(text, F.lit(r"\[ref=")).cast("string"), F.lit(" refs"))
    long = lambda body: F.concat(F.rtrim(F.substring(body, 1, HEAD)), F.lit(" … "), (F.length(body) - HEAD - TAIL).cast("string"), F.lit(" characters … "), F.ltrim(F.right(body, F.lit(TAIL))))
    whole = let(t.collapse(text), lambda body: F.when(body == "", "(empty)").when(F.length(body) <= max(VERBATIM, HEAD + TAIL), body).otherwise(long(body)))
    return F.when(kind == "snapshot", page).when(kind == "test", let(tally(text), lambda x: F.coalesce(x, whole))).otherwise(whole)


def result_facts(log: DataFrame) -> DataFrame:
    """session_id, idx, call_idx, kind, condensed, saved of every result, with the call it answers."""
    r = log.where("role = 'tool'").select("session_id", "idx", F.coalesce("content", F.lit("")).alias("content"))
    pair = s.call_for(log).select("session_id", F.col("result_idx").alias("idx"), "call_idx", "tool_name")
    test = call_facts(log).select("session_id", F.col("idx").alias("call_idx"), "test")
    j = r.join(pair, ["session_id", "idx"]).join(test, ["session_id", "call_idx"], "left")
    j = j.withColumn("kind", result_kind(F.col("content"), F.col("tool_name"), F.col("test")))
    return j.select("session_id", "idx", "call_idx", "kind", condensed(F.col("content"), F.col("kind")).alias("condensed"), saved_path(F.col("content")).alias("saved"))


#: A message of a session's row, whose messages are in order.
FIELDS = ("idx", "role", "content", "call_id", "call_id2", "tool_name", "arguments")


def in_rows(log: DataFrame) -> DataFrame:
    """session_id, messages (FIELDS)."""
    return log.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("messages"))


def bounds(m: Column, keep: int) -> Column:
    """h, cut of a session's messages: the end of its head, the start of the keep newest units (structure.with_kept_start)."""
    opens = F.transform(F.filter(m, lambda x: x["role"] == "assistant"), lambda x: x["idx"])
    head = lambda o: F.filter(m, lambda x: (x["idx"] < F.coalesce(F.get(o, F.lit(0)), F.size(m))) & ~s.is_prior_summary(x["role"], x["content"]))
    end = lambda o: F.coalesce(F.array_max(F.transform(head(o), lambda x: x["idx"] + 1)), F.lit(0))
    cut = lambda h, o: F.coalesce(F.get(o, F.size(o) - max(1, keep)), F.get(o, F.lit(0)), h)
    return let(opens, lambda o: let(end(o), lambda h: F.struct(h.alias("h"), cut(h, F.filter(o, lambda i: i >= h)).alias("cut"))))


def _lists(m: Column) -> Column:
    """Calls and results of a session: calls (idx, at, first: its first result's content, asks, x: the assistant's message),
    results (idx, content, and name and arguments of the call that it answers), both in order. As structure.call_for has it, a
    result answers the nearest assistant before it that made its call; a user's message ends the search.

    Where each result answers the last message before it that is no result, no search is needed.
    """
    other = F.filter(m, lambda x: ~F.coalesce(x["role"] == "tool", F.lit(False)))
    tools = F.filter(F.transform(m, lambda x, p: F.struct(p.alias("p"), x.alias("x"))), lambda y: y["x"]["role"] == "tool")
    mine = lambda c, r: F.coalesce((c["role"] == "assistant") & (F.coalesce(c["call_id"] == r["call_id"], F.lit(False)) | F.coalesce(c["call_id2"] == r["call_id"], F.lit(False))), F.lit(False))
    placed = let(other, lambda o: F.transform(tools, lambda y, q: F.struct(F.get(o, y["p"] - q - 1).alias("c"), y["x"].alias("x"))))

    def near(pairs: Column) -> Column:
        results = F.transform(pairs, lambda y: _result(y["x"], y["c"]))
        made = F.filter(F.transform(m, lambda x, p: F.struct(p.alias("p"), x.alias("x"))), lambda y: (y["x"]["role"] == "assistant") & y["x"]["call_id"].isNotNull())
        first = lambda n: F.when(n["role"] == "tool", F.coalesce(n["content"], F.lit("")))
        calls = F.transform(made, lambda y: F.struct(y["x"]["idx"].alias("idx"), F.lit(0).alias("at"), first(F.get(m, y["p"] + 1)).alias("first"), F.lit(False).alias("asks"), y["x"].alias("x")))
        return F.struct(calls.alias("calls"), results.alias("results"))

    return let(placed, lambda pairs: F.when(F.forall(pairs, lambda y: mine(y["c"], y["x"])), near(pairs)).otherwise(_searched(m)))


def _result(x: Column, call: Column) -> Column:
    return F.struct(x["idx"].alias("idx"), F.coalesce(x["content"], F.lit("")).alias("content"), call["tool_name"].alias("name"), F.when(call["call_id"].isNotNull(), call["arguments"]).alias("arguments"))


def _searched(m: Column) -> Column:
    """_lists for any session: calls and results in the order of their ids, then of messages. The call before a result has as
    many calls before it as the result has, less one; a call's first result stands right behind it.
    """
    others = F.filter(F.transform(m, lambda x, p: F.struct(p.alias("p"), x.alias("x"))), lambda y: ~F.coalesce(y["x"]["role"].isin("user", "system", "developer"), F.lit(False)))
    none = F.array().cast("array<string>")

    def ids(x: Column) -> Column:
        return F.when(x["role"] == "assistant", F.filter(F.array(x["call_id"], x["call_id2"]), lambda c: c.isNotNull())).when(x["role"] == "tool", F.array(x["call_id"])).otherwise(none)

    def entry(y: Column, q: Column) -> Column:
        x = y["x"]
        # messages that end a search, before this one
        return F.transform(ids(x), lambda c: F.struct(c.alias("id"), x["idx"].alias("idx"), (x["role"] == "tool").alias("asks"), (y["p"] - q).alias("segment"), x.alias("x")))

    def paired(e: Column) -> Column:
        made = F.filter(e, lambda y: ~y["asks"])
        placed = F.filter(F.transform(e, lambda y, p: F.struct(p.alias("p"), y.alias("y"))), lambda z: z["y"]["asks"])
        same = lambda c, y: F.coalesce((c["id"] == y["id"]) & (c["segment"] == y["segment"]), F.lit(False))

        results = let(made, lambda c: F.transform(placed, lambda z, q: let(F.get(c, z["p"] - q - 1), lambda x: _result(z["y"]["x"], F.when(same(x, z["y"]), x["x"])))))
        # null stands before any place: a call without a result counts as answered last
        behind = F.transform(e, lambda y, p: let(F.get(e, p + 1), lambda n: F.struct(y["idx"].alias("idx"), F.when(n["asks"] & same(y, n), n["idx"]).otherwise(2**31 - 1).alias("at"), F.when(n["asks"] & same(y, n), F.coalesce(n["x"]["content"], F.lit(""))).alias("first"), y["asks"].alias("asks"), y["x"].alias("x"))))
        calls = let(F.sort_array(F.filter(behind, lambda y: ~y["asks"])), lambda b: F.filter(b, lambda y, i: ((i == 0) | (F.get(b, i - 1)["idx"] != y["idx"])) & y["x"]["call_id"].isNotNull()))
        return F.struct(calls.alias("calls"), F.sort_array(results).alias("results"))

    return let(F.sort_array(F.flatten(F.transform(others, entry))), paired)


#: What makes the line of an item, of texts that its ledger keeps: a, b and c.
_USER, _SAID, _PLAIN, _CALL, _FILE, _RESULT = range(6)


def _item(category: Column | str, section: Column | str, rank: Column | list, pos: Column | list, idx: Column, ident: Column, made: int, a: Column, b: Column | None = None, c: Column | None = None) -> Column:
    array = lambda v: v if isinstance(v, Column) else F.array(*(x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long") for x in v))
    number = lambda x, names: F.lit(list(names).index(x) + 1) if isinstance(x, str) else F.array_position(F.array(*map(F.lit, names)), x).cast("int")
    none = F.lit(None).cast("string")
    return F.struct(
        number(category, CATEGORIES).alias("category"), array(rank).alias("rank"), idx.alias("idx"), ident.alias("id"), number(section, SECTIONS).alias("section"), array(pos).alias("pos"),
        F.lit(made).alias("made"), a.alias("a"), (none if b is None else b).alias("b"), (none if c is None else c).alias("c"),
    )


def _line(x: Column) -> Column:
    """The line of an item."""
    place = F.concat(F.lit("- #"), x["idx"].cast("string"))
    mark = lambda text: F.concat(place, F.lit(": "), text)
    user = let(t.without_rules(x["a"]), lambda y: t.cap_head_tail(y, USER))
    arguments = x["b"]
    given = let(call_path(arguments), lambda p: let(_argument(arguments, "url"), lambda u: let(call_command(arguments), lambda c: key_arguments(p, u, c, arguments))))
    kind = lambda name, args: result_kind(x["c"], name, runs_tests(call_command(args)))
    said_ = F.when(x["c"].isNotNull(), let(kind(x["a"], arguments), lambda k: condensed(x["c"], k))).otherwise("(no result)")
    call = F.concat(place, F.lit(" "), F.when(x["a"] != "", one_line(x["a"])).otherwise("(unnamed)"), let(given, lambda g: F.when(g != "", F.concat(F.lit(" "), g)).otherwise("")), F.lit(" → "), said_)
    file = F.concat(F.lit("- "), let(let(x["a"], lambda y: t.cap_head_tail(y, ITEM)), one_line), F.lit(" ("), x["b"], F.lit(", #"), x["idx"].cast("string"), F.lit(")"))
    made = {_USER: mark(user), _SAID: mark(said_text(x["b"], x["a"])), _PLAIN: mark(x["a"]), _CALL: call, _FILE: file, _RESULT: mark(condensed(x["a"], x["b"]))}
    out = F.lit("")
    for n, line in made.items():
        out = F.when(x["made"] == n, line).otherwise(out)
    return out


def _files(calls: Column) -> Column:
    """path, idx, first, action: one entry a file: its longest spelling, its latest and first place, its latest action."""
    entry = lambda x: let(file_action(F.coalesce(x["tool_name"], F.lit(""))), lambda a: let(F.when(a.isNotNull(), call_path(x["arguments"])), lambda p: F.struct(t.path_key(p).alias("key"), F.length(p).alias("n"), p.alias("path"), x["idx"].alias("idx"), a.alias("action"))))
    named = F.sort_array(F.filter(F.transform(calls, lambda y: entry(y["x"])), lambda f: f["path"].isNotNull()))

    def group(g: Column) -> Column:
        long = F.element_at(g, -1)["path"]
        one = lambda g: let(F.array_max(F.transform(g, lambda f: F.struct(f["idx"], f["action"]))), lambda last: F.struct(long.alias("path"), last["idx"].alias("idx"), F.array_min(F.transform(g, lambda f: f["idx"])).alias("first"), last["action"].alias("action")))
        return let(F.filter(g, lambda f: t.same_path(f["path"], long)), one)

    def groups(n: Column) -> Column:
        ends = F.filter(F.transform(n, lambda f, i: F.when(F.coalesce(F.get(n, i + 1)["key"] != f["key"], F.lit(True)), i + 1)), lambda i: i.isNotNull())
        return let(ends, lambda e: F.transform(e, lambda z, g: let(F.coalesce(F.get(e, g - 1), F.lit(0)), lambda a: group(F.slice(n, a + 1, z - a)))))

    return let(named, groups)


def ledger(m: Column, keep: int) -> Column:
    """The items of a session's messages between the head and the keep newest units, by place; their lines are made by _line."""
    within = lambda i, b: (i >= b["h"]) & (i < b["cut"])
    text = lambda x: F.col(x) if isinstance(x, str) else x.cast("string")
    ident = lambda letter, *v: F.concat_ws(":", F.lit(letter) if isinstance(letter, str) else letter, *(text(x) for x in v))

    def users(b: Column) -> Column:
        said_ = F.transform(F.filter(m, lambda x: (x["role"] == "user") & within(x["idx"], b)), lambda x: F.struct(x["idx"].alias("idx"), x["role"].alias("role"), user_text(x["content"]).alias("text")))
        return F.transform(F.filter(said_, lambda x: is_instruction(x["role"], x["text"])), lambda x: _item("user", "user", [x["idx"]], [x["idx"]], x["idx"], ident("u", x["idx"]), _USER, x["text"]))

    def spoken(b: Column) -> Column:
        def tagged(i: Column, x: Column, n: Column) -> Column:
            k = x["kind"]
            note = k.isin("note", "label")
            category = F.when(k == "decision", "decision").when(k == "note", "rest").when(k == "label", "narrative1").otherwise("todo")
            section = F.when(k == "decision", "decisions").when(note, "notes").otherwise("todos")
            array = lambda *v: F.array(*(F.lit(y).cast("long") if isinstance(y, int) else y.cast("long") for y in v))
            rank = F.when(k == "decision", array(-i, n)).when(note, array(1, -i, n)).otherwise(array(-i, 1, n))
            pos = F.when(k == "note", array(0, i, n)).when(k == "label", array(1, i, n)).when(k == "decision", array(i, n)).otherwise(array(i, 1, n))
            return _item(category, section, rank, pos, i, ident(F.substring(k, 1, 1), i, n), _SAID, x["raw"], k)

        def message(i: Column, parts: Column) -> Column:
            of = lambda keep_: F.transform(F.filter(parts, keep_), lambda x, n: tagged(i, x, n))
            plain = let(narrative_text(parts), lambda v: F.filter(F.array(_item("narrative2", "notes", [-i, 0], [2, i, 0], i, ident("v", i), _PLAIN, v)), lambda x: x["a"] != ""))
            return F.concat(of(lambda x: ~x["kind"].isin("label", "rest")), of(lambda x: x["kind"] == "label"), plain)

        mine = F.filter(m, lambda x: (x["role"] == "assistant") & within(x["idx"], b))
        return F.flatten(F.transform(mine, lambda x: let(said_parts(x["content"]), lambda parts: message(x["idx"], parts))))

    def logged(calls: Column, b: Column) -> Column:
        call = lambda i, y: _item("toolLog", "log", [-i, 0], [i, 0], i, F.concat(ident("g", i), F.lit(":0")), _CALL, F.coalesce(y["x"]["tool_name"], F.lit("")), y["x"]["arguments"], y["first"])
        return F.transform(F.filter(calls, lambda y: within(y["idx"], b)), lambda y: call(y["idx"], y))

    def filed(calls: Column, b: Column) -> Column:
        return F.transform(F.filter(_files(calls), lambda f: within(f["idx"], b)), lambda f: _item("file", "files", [-f["idx"]], [f["first"]], f["idx"], F.concat(F.lit("f:"), f["path"]), _FILE, f["path"], f["action"]))

    def newest(results: Column, b: Column) -> Column:
        is_test = lambda r: result_kind(r["content"], r["name"], runs_tests(call_command(r["arguments"]))) == "test"

        def last(name: str, letter: str, section: str, fits: Callable[[Column], Column]) -> Column:
            # one behind the cut is newer than all before it: these are not looked at then
            behind = F.exists(results, lambda r: (r["idx"] >= b["cut"]) & fits(r))
            found = let(F.filter(results, lambda r: (r["idx"] < b["cut"]) & fits(r)), lambda f: F.slice(f, F.greatest(F.size(f), F.lit(1)), 1))
            some = F.filter(F.when(behind, F.slice(results, 1, 0)).otherwise(found), lambda r: within(r["idx"], b))
            return F.transform(some, lambda r: _item("rest", section, [0, -r["idx"]], [0], r["idx"], ident(letter, r["idx"]), _RESULT, r["content"], F.lit(name)))

        return F.concat(last("test", "x", "test", is_test), last("snapshot", "b", "browser", lambda r: is_snapshot(r["content"], r["name"])))

    every = lambda b: let(_lists(m), lambda l: F.sort_array(F.concat(users(b), spoken(b), filed(l["calls"], b), newest(l["results"], b), logged(l["calls"], b))))
    return let(bounds(m, keep), lambda b: F.when(b["cut"] > b["h"], every(b)))


def summary(items_: Column, budget: int, floor: bool = True) -> Column:
    """kept, dropped, text of a session's ledger (as kept and summaries have it); lines are made only as far as the budget goes."""
    protected = F.size(F.filter(items_, lambda x: x["category"] <= (FLOOR if floor else 1)))
    heading = lambda x: F.element_at(F.array(*map(F.lit, SECTIONS.values())), x["section"])
    block = lambda l: F.transform(l, lambda x, i: F.when(F.coalesce(F.get(l, i - 1)["section"] == x["section"], F.lit(False)), x["line"]).otherwise(F.concat(heading(x), F.lit("\n"), x["line"])))

    def written(lines: Column) -> Column:
        placed = F.sort_array(F.transform(lines, lambda line, i: let(F.get(items_, i), lambda x: F.struct(x["section"].alias("section"), x["pos"].alias("pos"), x["idx"].alias("idx"), x["id"].alias("id"), line.alias("line")))))
        text = F.concat(F.lit(s.SUMMARY_HEADER + "\n\n"), F.array_join(let(placed, block), "\n"))
        return F.struct(F.size(lines).cast("long").alias("kept"), (F.size(items_) - F.size(lines)).cast("long").alias("dropped"), text.alias("text"))

    def fitting(first: Column, n: Column) -> Column:
        """The lines that stay, and those of the rest that fit, each of which costs 1 at least."""
        state = lambda spent, lines: F.struct(spent.alias("spent"), lines.alias("lines"))
        began = state(F.aggregate(first, F.lit(0).cast("long"), lambda a, x: a + line_cost(x)), F.array().cast("array<string>"))
        add = lambda a, x: let(_line(x), lambda line: let(a["spent"] + line_cost(line), lambda c: state(c, F.when(c <= budget, F.concat(a["lines"], F.array(line))).otherwise(a["lines"]))))
        rest = F.slice(items_, n + 1, budget + 1)
        return F.concat(first, F.aggregate(rest, began, lambda a, x: F.when(a["spent"] > budget, a).otherwise(add(a, x)))["lines"])

    return let(protected, lambda n: let(F.transform(F.slice(items_, 1, n), _line), lambda first: let(fitting(first, n), written)))


def summed_up(sessions: DataFrame, keep: int, budget: int, floor: bool = True) -> DataFrame:
    """session_id, kept, dropped, text of sessions' rows, for those whose ledger has items."""
    items_ = F.col("items")
    made = F.when(F.size(items_) > 0, F.array(summary(items_, budget, floor)))
    # a filter on the summary would be moved before it and have it made anew
    return sessions.select("session_id", ledger(F.col("messages"), keep).alias("items")).select("session_id", F.explode_outer(made).alias("x")).where("x is not null").select("session_id", "x.kept", "x.dropped", "x.text")


def items(log: DataFrame, keep: int = 4) -> DataFrame:
    """The ledger of what lies between the head and the keep newest units."""
    return listed(in_rows(log), keep)


def listed(sessions: DataFrame, keep: int = 4) -> DataFrame:
    """The ledger of sessions' rows, one row per item."""
    rows = sessions.select("session_id", F.explode_outer(ledger(F.col("messages"), keep)).alias("x")).where("x is not null")
    name = lambda names, n: F.element_at(F.array(*map(F.lit, names)), n)
    return rows.select("session_id", "x.id", name(CATEGORIES, F.col("x.category")).alias("category"), name(SECTIONS, F.col("x.section")).alias("section"), "x.idx", "x.rank", "x.pos", let(F.col("x"), _line).alias("line"))


def category_order(category: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), category).cast("int")


def ordered(ledger: DataFrame) -> DataFrame:
    """The ledger with place: category, rank, message, id."""
    w = Window.partitionBy("session_id").orderBy(category_order(F.col("category")), "rank", "idx", "id")
    return ledger.withColumn("place", F.row_number().over(w).cast("long"))


def line_cost(line: Column) -> Column:
    return (F.floor(F.length(line) / 4) + 1).cast("long")


def kept(ledger: DataFrame, budget: int, floor: bool = True) -> DataFrame:
    """The longest prefix of the total order within the budget, by the sum of the lines' costs; users' items, and the floor where asked, stay."""
    w = Window.partitionBy("session_id").orderBy("place")
    protected = (category_order(F.col("category")) <= FLOOR) if floor else (F.col("category") == "user")
    return ordered(ledger).withColumn("spent", F.sum(line_cost(F.col("line"))).over(w)).withColumn("kept", protected | (F.col("spent") <= budget))


def summaries(ledger: DataFrame, budget: int, floor: bool = True) -> DataFrame:
    """session_id, kept, dropped, text: sections in their order, lines by place of first appearance."""
    chosen = kept(ledger, budget, floor)
    number = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")).cast("int")
    lines = chosen.where("kept").groupBy("session_id", number.alias("n")).agg(F.array_sort(F.collect_list(F.struct("pos", "idx", "id", "line"))).alias("l"))
    heading = F.element_at(F.array(*map(F.lit, SECTIONS.values())), F.col("n"))
    block = F.concat(heading, F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    text = lines.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("n", block.alias("block")))).alias("b"))
    counts = chosen.groupBy("session_id").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))
    body = F.concat(F.lit(s.SUMMARY_HEADER + "\n\n"), F.coalesce(F.array_join(F.transform("b", lambda x: x["block"]), "\n"), F.lit("")))
    return counts.join(text, "session_id", "left").select("session_id", "kept", "dropped", body.alias("text"))


def assembled(log: DataFrame, budget: int, keep: int = 4) -> DataFrame:
    """session_id, pos, origin, role, content: head, summary (origin -1) and the newest units, stale snapshots as stubs."""
    return put_together(in_rows(log), budget, keep)


def put_together(sessions: DataFrame, budget: int, keep: int = 4) -> DataFrame:
    """assembled, of sessions' rows."""
    m = F.col("messages")
    row = lambda pos, origin, role, content: F.struct(pos.alias("pos"), origin.alias("origin"), role.alias("role"), content.alias("content"))
    shots = F.filter(m, lambda x: (x["role"] == "tool") & (x["tool_name"] == "browser_snapshot"))
    # a snapshot is stale if a unit starts between it and the newest
    newest = F.array_max(F.transform(shots, lambda x: x["idx"]))
    start = let(newest, lambda z: F.array_max(F.transform(F.filter(m, lambda x: s.starts_unit(x["role"]) & (x["idx"] <= z)), lambda x: x["idx"])))

    def sent(b: Column, start: Column) -> Column:
        stale = lambda x: F.coalesce((x["role"] == "tool") & (x["tool_name"] == "browser_snapshot") & (x["idx"] < start), F.lit(False))
        pos = lambda x: F.when(x["idx"] < b["h"], x["idx"]).otherwise(b["h"] + 1 + x["idx"] - b["cut"])
        kept_ = F.filter(m, lambda x: (x["idx"] < b["h"]) | (x["idx"] >= b["cut"]))
        return F.transform(kept_, lambda x: row(pos(x), x["idx"], x["role"], F.when(stale(x), "[an older page snapshot was left out]").otherwise(x["content"])))

    items_, none = F.col("items"), F.array().cast("array<struct<pos:int,origin:int,role:string,content:string>>")
    told = lambda b: F.when(F.size(items_) > 0, F.array(row(b["h"], F.lit(-1), F.lit("user"), summary(items_, budget)["text"]))).otherwise(none)
    every = let(bounds(m, keep), lambda b: let(start, lambda z: F.concat(sent(b, z), told(b))))
    return sessions.select("session_id", "messages", ledger(m, keep).alias("items")).select("session_id", F.explode_outer(every).alias("x")).where("x is not null").select("session_id", "x.*")
