"""Conversations from messages that quote each other.

Lines that begin with ``>`` marks are quoted; the number of marks is the
level. Each run of one level is a passage. Passages are normalised (marks
gone, white space collapsed, lower case) and hashed, whole, by paragraph and
by line, and joined to the hashes of what messages of the conversation say
themselves. A message replies to the earlier message from which the most
quoted characters of its lowest level come, then to the latest such; where no
text of a level is known, the next level decides. Every message that says a
text is a candidate. Replies are then ordered below what they answer and
written without quotes.

No conversation is gathered in a task: links are joins on (conversation,
hash) in blocks of at most HOT origins and HOT quotes, threads come from
pointer jumping, and places in a conversation from one sort by ranges and the
counts of each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.workdir import Workspace

MARKS = r"^[ \t]*((?:>[ \t]?)+)"
#: Between paragraphs.
BLANK = r"\n[\x20\x09-\x0D]*\n"
#: Origins, and quotes, of one text of a conversation that meet in one task.
HOT = 1000


def _lines(text: Column) -> Column:
    """Array of (level, said) of the lines of a text."""
    line = lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"),
        F.regexp_replace(x, MARKS, "").alias("said"),
    )
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), line)


def _norm(said: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(said), r"[\x20\x09-\x0D]+", " "))


def parse(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, body, own, passages, quote_levels): what a message says itself and what it quotes.

    ``passages`` holds (level, text) of each run of lines of one level,
    ``own`` the text between them where there are any.
    """
    lines = F.col("lines")
    rows = df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), _lines(F.col(text)).alias("lines"))
    own = F.array_join(F.transform(F.filter(lines, lambda x: x.level == 0), lambda x: x.said), "\n")
    start = F.array().cast("array<struct<level:int,said:string>>")

    def fold(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(x.level.alias("level"), F.concat_ws("\n", last.said, x.said).alias("said"))))
        return F.when((F.size(acc) > 0) & (last.level == x.level), grown).otherwise(F.array_append(acc, F.struct(x.level.alias("level"), x.said.alias("said"))))

    quoted = F.exists(lines, lambda x: x.level > 0)
    rows = rows.withColumn("runs", F.when(quoted, F.aggregate(lines, start, fold)).otherwise(start))
    runs = F.filter("runs", lambda x: x.level > 0)
    between = F.transform(F.filter("runs", lambda x: x.level == 0), lambda x: x.said)
    return rows.select("conv_id", "turn", "role", F.regexp_replace(F.regexp_replace(own, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "").alias("body"), between.alias("own"), runs.alias("passages"), F.aggregate(lines, F.lit(0), lambda a, x: F.greatest(a, x.level)).alias("quote_levels"))


def _keys(said: Column) -> Column:
    """Normalised forms of a text that can link: itself, its paragraphs and its lines."""
    parts = F.transform(F.concat(F.array(said), F.split(said, BLANK), F.split(said, "\n")), _norm)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def _quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, at, level, k, lines): the texts that can link of each quoted passage, and the lines each stands for."""
    rows = messages.where(F.size("passages") > 0).select("conv_id", F.col("turn").alias("at"), F.posexplode("passages").alias("p", "passage"))
    line = lambda j: lambda x, i: F.struct(_norm(x).alias("said"), F.struct(F.col("p"), j.alias("j"), i.alias("i"), F.length(_norm(x)).alias("n")).alias("line"))
    part = lambda x, j: F.struct(_norm(x).alias("said"), F.filter(F.transform(F.split(x, "\n"), line(j)), lambda y: y.said != "").alias("lines"))
    rows = rows.withColumn("parts", F.transform(F.split("passage.said", BLANK), part)).withColumn("lines", F.flatten("parts.lines"))
    whole = F.array(F.struct(_norm(F.col("passage.said")).alias("said"), F.col("lines.line").alias("lines")))
    parts = F.transform("parts", lambda x: F.struct(x.said.alias("said"), F.transform(x.lines, lambda y: y.line).alias("lines")))
    each = F.transform("lines", lambda x: F.struct(x.said.alias("said"), F.array(x.line).alias("lines")))
    keys = F.array_distinct(F.filter(F.concat(whole, parts, each), lambda x: x.said != ""))
    return rows.select("conv_id", "at", "passage.level", F.explode(keys).alias("k")).select("conv_id", "at", "level", _hashed(F.col("k.said")).alias("k"), "k.lines")


def _hashed(said: Column) -> Column:
    return F.struct(F.xxhash64(said).alias("h"), F.md5(said).alias("m"))


def reply_links(messages: DataFrame, space: Workspace) -> DataFrame:
    """(conv_id, turn, parent_turn): the message that each quoting message answers."""
    key = ["conv_id", "h", "m"]
    quotes = space.table(_quotes(messages).select("conv_id", "at", "level", "k.h", "k.m", "lines").distinct(), "chat-quotes")
    if quotes.isEmpty():
        return quotes.select("conv_id", F.col("at").alias("turn"), F.col("at").alias("parent_turn"))
    said = messages.select("conv_id", "turn", F.explode(F.transform(F.array_distinct(F.flatten(F.transform(F.concat(F.array("body"), "own"), _keys))), _hashed)).alias("k")).select("conv_id", "turn", "k.h", "k.m").distinct()
    said = space.table(said.join(quotes.select(key).distinct(), key, "left_semi"), "chat-origins")
    # a text said and quoted often is dealt out in blocks; no origin is left out
    count = lambda rows, name: rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias(name))
    blocks = count(said, "saying").join(count(quotes, "quoting"), key)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda by, c: F.pmod(F.xxhash64(by), F.col(c)).cast("int")
    one = said.join(blocks, key).select(*key, "turn", own("turn", "saying").alias("i"), every("quoting").alias("j"))
    two = quotes.join(blocks, key).select(*key, "at", "level", "lines", own("at", "quoting").alias("j"), every("saying").alias("i"))
    found = two.join(one, [*key, "i", "j"]).where("turn < at")
    # a line counts once for a candidate, by whatever texts it was found
    votes = found.groupBy("conv_id", "at", "level", "turn").agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("lines"))
    votes = votes.select("conv_id", "at", (-F.col("level")).alias("shallow"), F.aggregate("lines.n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), "turn")
    best = votes.groupBy("conv_id", "at").agg(F.max(F.struct("shallow", "n", "turn")).alias("best"))
    return best.select("conv_id", F.col("at").alias("turn"), F.col("best.turn").alias("parent_turn"))


def threads(links: DataFrame, space: Workspace) -> DataFrame:
    """(conv_id, turn, root_turn, depth) of every linked message, by pointer jumping."""
    at = space.table(links.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")), "chat-threads")
    while True:
        up = at.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("above"), F.col("depth").alias("more"))
        new = space.table(at.join(up, ["conv_id", "root_turn"], "left").select("conv_id", "turn", F.coalesce("above", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")), "chat-threads")
        at = new.drop("moved")
        if new.where("moved").isEmpty():
            return at


def placed(messages: DataFrame, order: list, space: Workspace, conv: str = "conv_id") -> DataFrame:
    """Messages with ``position``, their place from 0 in their conversation when sorted by ``order``.

    Rows are sorted by ranges; a row's place is its place within its range and
    the rows of its conversation in the ranges before, so a long conversation
    is spread over many tasks.
    """
    rows = messages.repartitionByRange(conv, *order).sortWithinPartitions(conv, *order)
    rows = space.table(rows.select("*", F.monotonically_increasing_id().alias("_n")), "chat-sorted").withColumn("_range", F.shiftrightunsigned("_n", 33))
    counts = rows.groupBy(F.col(conv).alias("_conv"), F.col("_range").alias("_at")).agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("_conv").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_conv", "_at", (before - F.col("_first")).alias("_shift"))
    out = rows.join(counts, F.col(conv).eqNullSafe(F.col("_conv")) & (F.col("_range") == F.col("_at")))
    return out.select(*messages.columns, F.when(F.col(conv).isNotNull(), F.col("_n") + F.col("_shift")).alias("position"))


def conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", space: Workspace | None = None) -> DataFrame:
    """Per message: conv_id, turn, role, position, parent_turn, root_turn, depth, quote_levels, n_passages, body, formatted.

    ``formatted`` in the order of ``position`` is the conversation without
    quotes. Positions follow (root_turn, turn), which puts every reply after
    what it answers and keeps threads together; messages without a turn come
    first, and those without a conversation have no position. A message that quotes
    nothing known starts a thread of its own: parent null, depth 0. Null text
    is empty; messages with a null conversation or turn link with nothing;
    rows repeated with their turn keep a row each and answer alike. Other
    columns are ignored.
    """
    space = space or Workspace(df.sparkSession)
    messages = space.table(parse(df, conv, turn, role, text), "chat-messages")
    links = space.table(reply_links(messages.where("conv_id IS NOT NULL AND turn IS NOT NULL"), space), "chat-links")
    found = threads(links, space).join(links, ["conv_id", "turn"]) if not links.isEmpty() else links.withColumn("root_turn", F.col("parent_turn")).withColumn("depth", F.lit(1).cast("long"))
    # null keys never match, so such messages stay as they are
    out = messages.join(found, ["conv_id", "turn"], "left")
    marked = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), "body", F.lit("\n<|end|>"))
    out = out.select("conv_id", "turn", "role", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "quote_levels", F.size("passages").alias("n_passages"), "body", marked.alias("formatted"))
    return placed(out, ["root_turn", "turn", "formatted"], space)
