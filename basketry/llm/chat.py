"""Chat formatting with quotation linking, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.store import discard, staged

#: A line that announces a quotation.
ATTRIBUTION = r"(?:On\b.*\bwrote:|Am\b.*\bschrieb.*:|Le\b.*\ba écrit[ \t]*:|El\b.*\bescribió:|.{1,80}\b(?:wrote|said):)"
#: The marks before a quoted line, with spaces between them.
MARKS = r"^[ \t>]*>"
#: What an announcing line is replaced by; no text line has this character alone.
ANNOUNCED = "\x00"


def quote_level(line: Column) -> Column:
    """How many marks stand before a line: 0 for one's own words."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normal(line: Column) -> Column:
    """A line without quotation marks, case and differing white space."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"\s+", " ")))


def parsed_lines(text: Column) -> Column:
    """Each line as (at, level, line, own): own lines are neither quoted nor the announcement of a quotation.

    A line announces a quotation if it reads like one and the next line that isn't blank is quoted.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    told = F.regexp_replace(text, rf"(?md)^[ \t]*{ATTRIBUTION}[ \t\r]*$(?=[ \t\r\n]*+>)", ANNOUNCED)
    # Texts without a mark are one's own words throughout; only others are searched for announcements.
    quoted = F.transform(F.split(told, "\r?\n", -1), lambda x, i: F.struct(i.alias("at"), quote_level(x).alias("level"), x.alias("line"), ((quote_level(x) == 0) & (x != ANNOUNCED)).alias("own")))
    plain = F.transform(F.split(text, "\r?\n", -1), lambda x, i: F.struct(i.alias("at"), F.lit(0).alias("level"), x.alias("line"), F.lit(True).alias("own")))
    return F.when(F.contains(text, F.lit(">")), quoted).otherwise(plain)


def units(words: Column) -> Column:
    """The parts in which normalised lines can be quoted, as (kind, parts): lines that aren't blank, and sentences.

    Sentences are cut in the lines joined by spaces, so that a quotation in other line breaks has the same ones.
    """
    lines = F.filter(F.split(words, "\n"), lambda x: x != "")
    sentences = F.filter(F.split(F.array_join(lines, " "), r"(?<=[.!?])\s+"), lambda x: x != "")
    return F.array(F.struct(F.lit("line").alias("kind"), lines.alias("parts")), F.struct(F.lit("sentence").alias("kind"), sentences.alias("parts")))


def passages(text: Column) -> Column:
    """Quoted passages: runs of lines of one level, as (level, words), words being the run's normalised lines joined."""
    start = F.array().cast("array<struct<level:int,words:string>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        line = normal(x["line"])
        same = F.when(F.size(acc) > 0, last["level"] == x["level"]).otherwise(False)
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(x["level"].alias("level"), F.concat_ws("\n", last["words"], line).alias("words"))))
        return F.when(same, grown).otherwise(F.concat(acc, F.array(F.struct(x["level"].alias("level"), line.alias("words")))))

    # A blank own line ends a passage; level 0 runs are kept until the end for that.
    runs = F.aggregate(F.transform(parsed_lines(text), lambda x: F.struct(x["level"].cast("int").alias("level"), x["line"].alias("line"))), start, step)
    return F.when(F.contains(F.coalesce(text.cast("string"), F.lit("")), F.lit(">")), F.filter(runs, lambda r: (r["level"] > 0) & (F.trim(r["words"]) != ""))).otherwise(start)


def link_quotes(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations in the order of replies, without their quotations.

    Lines with `>` marks are quoted, as often as they have marks; runs of one level are passages. A message's own
    words are what is left without passages and the lines that announce them. A passage is looked up among the own
    words of the conversation by the hash of its normalised lines: all of them, blank ones apart, have to stand in a
    row in the original; or all of its sentences, which also finds passages in other line breaks and parts of a line.
    Runs are made of the lengths that a conversation's passages have, and only the least turn of each hash is kept, so
    a line that thousands of messages hold is one row. The original is the earliest message that holds the passage,
    and counts if it comes before the quoting one. A message replies to the latest original among its passages of the
    lowest level.

    Replies hang on what they reply to: `path` lists the turns from the first message of the thread, so sorting by
    (conv_col, path) gives a conversation in reply order. A message that quotes nothing begins a thread.

    Returns one row per row of messages: conv_col, turn_col, role_col, n_quotes (passages), n_linked (those with an
    original), reply_to (turn, null if none), depth (0 for the first of a thread), path (array of turns), body (own
    words, lines trimmed at the end, blank lines at either end dropped). Null texts have an empty body; messages with
    a null conversation or turn are not looked up and begin threads; messages of equal conversation and turn share
    their place; an empty table gives no row; other columns are ignored.
    """
    rows = messages.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.col(role_col).alias("role"), F.col(text_col).cast("string").alias("text"))
    own = F.transform(F.filter(parsed_lines(F.col("text")), lambda x: x["own"]), lambda x: F.rtrim(x["line"]))
    body = F.regexp_replace(F.array_join(own, "\n"), r"^\s*\n|\s+$", "")
    parsed = rows.select("c", "t", "role", passages(F.col("text")).alias("quotes"), body.alias("body"), F.monotonically_increasing_id().alias("row"))
    parsed = staged(parsed, "parsed")
    quotes = parsed.filter(F.size("quotes") > 0).select("row", "c", "t", F.posexplode("quotes").alias("q", "x"))
    quotes = quotes.select("row", "c", "t", "q", "x.level", F.explode(units(F.col("x.words"))).alias("u"))
    quotes = quotes.select("row", "c", "t", "q", "level", "u.kind", F.size("u.parts").alias("k"), F.sha2(F.array_join("u.parts", "\n"), 256).alias("hash"))
    # Runs of own words, of the lengths that passages of the conversation have: the earliest turn of each hash.
    asked = staged(quotes.select("c", "kind", "k").filter("k > 0").distinct(), "asked")
    heard = parsed.join(asked.select("c").distinct(), "c", "left_semi")
    own_units = units(F.array_join(F.transform(F.split("body", "\n"), normal), "\n"))
    heard = heard.select("c", "t", F.explode(own_units).alias("u")).select("c", "t", "u.kind", "u.parts")
    runs = F.transform(F.sequence(F.lit(0), F.size("parts") - F.col("k")), lambda i: F.sha2(F.array_join(F.slice("parts", i + 1, F.col("k")), "\n"), 256))
    told = heard.join(asked, ["c", "kind"]).filter(F.size("parts") >= F.col("k")).select("c", "t", "kind", "k", F.explode(F.array_distinct(runs)).alias("hash"))
    originals = staged(told.groupBy("c", "kind", "k", "hash").agg(F.min("t").alias("o")), "originals")
    discard(asked)
    found = quotes.join(originals, ["c", "kind", "k", "hash"], "left")
    found = found.groupBy("row", "q", "level").agg(F.min(F.when(F.col("o") < F.col("t"), F.col("o"))).alias("o"))
    nearest = F.max(F.when(F.col("o").isNotNull(), F.struct((-F.col("level")).alias("l"), F.col("o").alias("o"))))
    replies = staged(found.groupBy("row").agg(F.count("o").alias("n_linked"), nearest.alias("n")).select("row", "n_linked", F.col("n.o").alias("reply_to")), "replies")
    linked = staged(parsed.join(replies, "row", "left"), "linked")
    discard(originals)
    # Ancestors by doubling: up lists the turns above a message as far as known, top is where to go on.
    links = linked.filter("reply_to is not null").groupBy("c", "t").agg(F.max("reply_to").alias("top"))
    at = staged(links.select("c", "t", "top", F.array("top").alias("up")), "paths")
    while True:
        more = at.select("c", F.col("t").alias("top"), F.col("top").alias("top2"), F.col("up").alias("up2"))
        grown = at.join(more, ["c", "top"], "left")
        if grown.filter("top2 is not null").isEmpty():
            break
        grown = grown.select("c", "t", F.coalesce("top2", "top").alias("top"), F.concat(F.coalesce("up2", F.array().cast(at.schema["up"].dataType)), "up").alias("up"))
        old, at = at, staged(grown, "paths")
        discard(old)
    out = linked.join(at.select("c", "t", "up"), ["c", "t"], "left")
    up = F.coalesce("up", F.array().cast(at.schema["up"].dataType))
    return out.select(
        F.col("c").alias(conv_col),
        F.col("t").alias(turn_col),
        F.col("role").alias(role_col),
        F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.when(F.size(up) > 0, F.element_at(up, -1)).alias("reply_to"),
        F.size(up).cast("long").alias("depth"),
        F.concat(up, F.array("t")).alias("path"),
        "body",
    )


def chat_text(role: Column, body: Column, template: str = "<|{role}|>\n{body}\n") -> Column:
    """A message in a chat template; null roles are `user`."""
    before, _, rest = template.partition("{role}")
    middle, _, after = rest.partition("{body}")
    return F.concat(F.lit(before), F.coalesce(role, F.lit("user")), F.lit(middle), body, F.lit(after))
