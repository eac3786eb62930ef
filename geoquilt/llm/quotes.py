"""Quotation linking: messages without quotes, each with the message it answers.

Lines that begin with ``>`` marks quote, and the number of marks is the level.
Quoted passages and unquoted text are cut into normalised sentences and lines and
hashed, all levels of a message in one pass.  Only what is quoted somewhere is
looked up.  A quoted piece is joined to the earliest message that says it unquoted,
in its own conversation if there is one, else, if it is long enough, anywhere; both
originals are pre-aggregated, so a sentence that very many messages share is still
one row.  The message that says most of what is quoted at the lowest level is the
parent; trees of replies are conversations, numbered with parents before replies.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquilt.operators.components import components
from geoquilt.storage import broadcast_within, discard, stored

#: One character class: a repeated group would recurse once for each mark.
MARKS = r"^[ \t>]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shorter sentences and lines are too common to tell who said them in another conversation.
MIN_CHARS = 16
_PASSAGE, _LEVEL = "\u0001", "\u0002"
_SENTENCE = r"[^.!?\n]+[.!?]*"
#: Rows of a sorted partition are numbered from its number times this.
_STRIDE = 1 << 33


def parsed_lines(text: Column) -> Column:
    """The lines of a text as (level, body, line): the number of leading quote marks and the rest."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    prefix = lambda x: F.regexp_extract(x, MARKS, 0)
    return F.transform(
        lines,
        lambda x: F.struct(
            (F.length(prefix(x)) - F.length(F.replace(prefix(x), F.lit(">"), F.lit("")))).alias("level"),
            F.substring(x, F.length(prefix(x)) + 1, F.length(x)).alias("body"),
            x.alias("line"),
        ),
    )


def without_quotes(lines: Column) -> Column:
    """The unquoted lines of a text, unchanged."""
    return F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"]), "\n")


def pieces(lines: Column) -> Column:
    """(level, s, in_line) of all normalised sentences and lines; lines that follow each other at a level are one passage.

    ``in_line`` marks lines.  Each level's passages are cut where they are, so the
    work is one pass over the text however many levels it has.
    """
    # a break inside a body ends a sentence, as a line's end between passages does
    body = lambda x: F.translate(x["body"], _PASSAGE, "\n")
    begins = lambda x, i: F.coalesce(F.get(lines, i - 1)["level"], F.lit(-1)) != x["level"]
    head = lambda x: F.concat(F.lit(_PASSAGE), x["level"].cast("string"), F.lit(_LEVEL))
    joined = F.array_join(F.transform(lines, lambda x, i: F.concat(F.when(begins(x, i), head(x)).otherwise(" "), body(x))), "")
    passages = F.filter(F.split(_normal(joined), _PASSAGE), lambda p: p != "")
    level = lambda p: F.substring_index(p, _LEVEL, 1)
    told = lambda p: F.regexp_extract_all(F.substring(p, F.length(level(p)) + 2, F.length(p)), F.lit(_SENTENCE), F.lit(0))
    piece = lambda lv, s, line: F.struct(lv.cast("int").alias("level"), F.trim(s).alias("s"), F.lit(line).alias("in_line"))
    sentences = F.flatten(F.transform(passages, lambda p: F.transform(told(p), lambda s: piece(level(p), s, False))))
    whole = F.transform(lines, lambda x: piece(x["level"], _normal(x["body"]), True))
    return F.filter(F.concat(sentences, whole), lambda p: _tells(p["s"]))


def _normal(text: Column) -> Column:
    return F.translate(F.regexp_replace(text, r"[ \t\r]+", " "), UPPER, LOWER)


def _tells(piece: Column) -> Column:
    """Long enough, or not of signs alone."""
    return (F.length(piece) >= MIN_CHARS) | piece.rlike(r"[\p{L}\p{N}]")


def _hash(piece: Column) -> Column:
    return F.struct(F.xxhash64(piece).alias("a"), F.xxhash64(F.lit(1), piece).alias("b"))


def parents(messages: DataFrame) -> DataFrame:
    """(reply, parent) of the messages (conv_id, turn) that quote what another says; see ``link_quotes``."""
    keyed = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.struct("conv_id", "turn").alias("message"), "text")
    quoting = keyed.where(F.col("text").rlike(r"(?m)^[ \t]*>")).select("message", F.inline(pieces(parsed_lines(F.col("text"))))).where("level > 0")
    # a line that is also a sentence of its message's level counts as the sentence
    quoted = quoting.groupBy("message", "level", _hash(F.col("s")).alias("q"), F.length("s").alias("size")).agg(
        F.sum(F.when(~F.col("in_line"), 1).otherwise(0)).alias("told"), F.sum(F.when(F.col("in_line"), 1).otherwise(0)).alias("lined")
    )
    quoted = stored(quoted.select(
        "message", "level", "q", (F.col("told") * F.col("size")).alias("chars"),
        F.when(F.col("told") > 0, 0).otherwise(F.col("size")).cast("long").alias("line_chars"),
    ), "quoted")
    wanted = stored(quoted.select(F.col("q").alias("w")).distinct(), "quoted-hashes")
    if wanted.isEmpty():
        return quoted.select(F.col("message").alias("reply"), F.col("message").alias("parent"))
    said = keyed.select("message", F.inline(pieces(parsed_lines(F.col("text"))))).where("level = 0")
    said = said.select("message", _hash(F.col("s")).alias("h"), F.length("s").alias("size"))
    said = said.join(broadcast_within(wanted, 64), F.col("h") == F.col("w"), "left_semi")
    own = stored(said.groupBy("h", F.col("message.conv_id").alias("own_conv")).agg(F.min("message").alias("here"), F.max("size").alias("size")), "said")
    anywhere = own.where(F.col("size") >= MIN_CHARS).groupBy(F.col("h").alias("any_h")).agg(F.min("here").alias("there"))
    matched = (
        quoted.join(own, (F.col("q") == F.col("h")) & (F.col("message.conv_id") == F.col("own_conv")), "left")
        .join(stored(anywhere, "said-first"), F.col("q") == F.col("any_h"), "left")
        .withColumn("origin", F.coalesce(F.when(F.col("here") < F.col("message"), F.col("here")), F.when(F.col("there") < F.col("message"), F.col("there"))))
        .where("origin IS NOT NULL")
        .groupBy("message", "level", "origin")
        .agg(F.sum("chars").alias("chars"), F.sum("line_chars").alias("line_chars"))
        .groupBy(F.col("message").alias("reply"))
        .agg(F.max(F.struct((-F.col("level")).alias("by_level"), "chars", "line_chars", "origin"))["origin"].alias("parent"))
    )
    return stored(matched, "parents")


def depths(links: DataFrame) -> DataFrame:
    """(node, depth) of every reply of stored ``links(reply, parent)``, by doubling: log2 of the depth rounds."""
    up = stored(links.select(F.col("reply").alias("node"), F.col("parent").alias("up"), F.lit(1).alias("depth")), "ups")
    while True:
        above = up.select(F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        joined = up.join(above, F.col("up") == F.col("n2"), "left")
        far = stored(joined.select("node", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("n2").isNotNull().alias("more")), "ups")
        discard(up)
        up = far.drop("more")
        if far.where("more").isEmpty():
            return up.select("node", "depth")


def reply_numbers(links: DataFrame) -> DataFrame:
    """Stored (message, thread, depth, reply_no) of every message of a tree of ``links(reply, parent)``.

    Messages of a thread are numbered from 0 by depth, then (conv_id, turn), so
    that parents come before replies.  They are range-sorted, numbered within
    their partition and from the counts of those before, so that a thread of very
    many messages is spread over tasks.
    """
    trees = components(links.select(F.col("reply").alias("u"), F.col("parent").alias("v")))
    below = depths(links).withColumnRenamed("node", "deep")
    placed = trees.join(below, F.col("node") == F.col("deep"), "left").select("node", "component", F.coalesce("depth", F.lit(0)).alias("depth"))
    keys = ("component", "depth", "node")
    ranked = stored(placed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "reply-ranks")
    part = F.floor(F.col("at") / F.lit(_STRIDE))
    counts = ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("part", before.alias("start")))
    number = (F.col("start") + F.pmod("at", F.lit(_STRIDE))).alias("number")
    numbered = ranked.join(starts, part == F.col("part")).select("node", "component", "depth", number)
    first = numbered.groupBy(F.col("component").alias("c")).agg(F.min("number").alias("first"))
    out = numbered.join(stored(first, "thread-starts"), F.col("component") == F.col("c"))
    return stored(out.select(F.col("node").alias("message"), F.col("component").alias("thread"), F.col("depth").cast("long").alias("depth"), (F.col("number") - F.col("first")).alias("reply_no")), "replies")


def link_quotes(messages: DataFrame) -> DataFrame:
    """Rows of ``messages(conv_id, turn, role, text)`` with quotes cut off and their places in conversations.

    Returns conv_id, turn, role, body (the text without quoted lines), n_quoted
    (quoted lines), max_level, parent_conv and parent_turn (null if nothing that
    is quoted was said before), thread_conv and thread_turn (the first message of
    the tree of replies, itself if it answers none), depth (replies above it) and
    reply_no (its place in the thread, parents before replies).  A parent comes
    before its message in the order of (conv_id, turn); of several that say equally
    much the one with most in lines, then the latest is taken.  Sentences and lines
    of fewer than 16 characters tell nothing about other conversations.  A null
    text is empty; a row with a null conv_id or turn is kept and linked to
    nothing; rows with the same conv_id and turn are one message for linking, and
    each keeps its own body.  Texts and lines of any length and any number of
    marks are read whole; other columns are not looked at.
    """
    links = parents(messages)
    places = reply_numbers(links)
    linked = links.select(F.col("reply").alias("r"), "parent")
    lines = F.col("__lines")
    levels = F.transform(lines, lambda x: x["level"])
    message = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.struct("conv_id", "turn"))
    rows = messages.select("conv_id", "turn", "role", parsed_lines(F.col("text")).alias("__lines"), message.alias("m"))
    rows = rows.select("conv_id", "turn", "role", "m", without_quotes(lines).alias("body"), F.size(F.filter(levels, lambda v: v > 0)).cast("long").alias("n_quoted"), F.array_max(levels).alias("max_level"))
    out = rows.join(linked, F.col("m") == F.col("r"), "left").join(places, F.col("m") == F.col("message"), "left")
    return out.select(
        "conv_id", "turn", "role", "body", "n_quoted", "max_level",
        F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"),
        F.coalesce("thread.conv_id", "conv_id").alias("thread_conv"), F.coalesce("thread.turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("reply_no", F.lit(0)).cast("long").alias("reply_no"),
    )


def reply_order(linked: DataFrame) -> DataFrame:
    """Conversations in reply order: trees in the order of their first message, parents before replies."""
    keys = ("thread_conv", "thread_turn", "reply_no", "conv_id", "turn")
    return linked.repartitionByRange(*keys).sortWithinPartitions(*keys)
