"""Chat formatting by quotation linking.

A line's quote level is the number of ``>`` marks it begins with.  Neighbouring
lines of one level are a passage, empty lines aside; empty lines part it into
paragraphs.  Passages, paragraphs and lines are the units of a message; they
are normalised (marks off, lower case, runs of white space as one space) and
hashed.  Quoted units are joined by hash to the units of earlier messages of
the same conversation that stand there at a lower level, and the normalised
texts are compared.  A quoted line is found in a message if the line, its
paragraph or its passage is.  A message replies to the message it quotes most
of: by characters of level-1 lines; then of lines that stand one level lower
there (what that message quoted itself); then of lines at any lower level; ties: the
latest turn.  A quote that starts or ends inside a line, or that wraps a part
of a paragraph anew, is not found.

Replies are followed to the message that starts the thread, by doubling.
``thread`` and ``turn`` order a conversation by replies: each opening
message, then all that answers it, directly or not, in time.  ``body`` is the
message without quotes, ``chat`` the body under its role.  Rows stay rows, so
a conversation with a third of all messages is not gathered anywhere.

Skew: units are joined on conversation, hash and text together, and only
quoted ones are kept.  For the most frequent unit of a turn only the latest
earlier message is looked up, so a line that many messages share makes no
pairs, unless a turn quotes several such lines.  Only DataFrame functions are used.

Defined results: a null text has no passages and an empty body; a null role is
formatted as ``unknown``.  Messages with null conv_id or turn stay, start
their own thread and are never quoted.  Rows that repeat a (conv_id, turn)
are one message in several parts: their quotes count together.  An empty table
gives no rows.  Result columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimtext.llm.common import SPACE, checkpointed, fresh, quoted, without

_MARKS = r"^(?:[\x20\t]*>)+[\x20\t]?"


def _lines(text: Column) -> Column:
    """Array of (level, raw line without marks), for the lines of text."""
    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, _MARKS, 0)
        level = F.length(marks) - F.length(F.translate(marks, ">", ""))
        return F.struct(level.alias("level"), F.substring(x, F.length(marks) + 1, F.length(x)).alias("line"))

    return F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "\r?\n"), line)


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, f"{SPACE}+", " ")))


def _spans(ends: Column) -> Column:
    """Array of (first, end) for the ends of neighbouring runs."""
    return F.transform(ends, lambda end, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("first"), end.alias("end")))


def units(messages: DataFrame, text: str = "text") -> DataFrame:
    """(conv_id, turn, part, level, unit, hash, covers): each passage, paragraph and line of a message once.

    unit is normalised; covers has the place and length of its lines; part tells rows of one turn apart.
    """
    known = messages.where("conv_id is not null and turn is not null").select(
        "conv_id", "turn", F.monotonically_increasing_id().alias("part"),
        F.transform(_lines(quoted(text)), lambda x: F.struct(x["level"], normalised(x["line"]).alias("line"))).alias("all"))
    full = known.select("conv_id", "turn", "part", F.explode_outer(F.array(F.filter(F.transform(
        "all", lambda x, i: F.struct(x["level"], x["line"], F.coalesce(F.get(F.col("all"), i - 1)["line"] == "", F.lit(False))
                                     .alias("gap"))), lambda x: x["line"] != ""))).alias("l"))
    lines = F.col("l")

    def ends(broken) -> Column:
        """The places after which the next line is broken off."""
        return F.filter(F.transform(lines, lambda x, i: F.when(
            F.coalesce(broken(x, F.get(lines, i + 1)), F.lit(True)), i + 1)), lambda x: x.isNotNull())

    full = full.withColumn("passages", ends(lambda x, y: x["level"] != y["level"]))
    full = full.withColumn("paragraphs", ends(lambda x, y: (x["level"] != y["level"]) | y["gap"]))
    each = F.transform(lines, lambda x, i: F.struct(i.alias("first"), (i + 1).alias("end")))
    full = full.withColumn("spans", F.array_distinct(F.concat(_spans(F.col("passages")), _spans(F.col("paragraphs")), each)))

    def unit(span: Column) -> Column:
        own = F.slice(lines, span["first"] + 1, span["end"] - span["first"])
        return F.struct(F.get(lines, span["first"])["level"].alias("level"),
                        F.array_join(F.transform(own, lambda x: x["line"]), " ").alias("unit"),
                        F.transform(own, lambda x, i: F.struct((span["first"] + i).alias("at"), F.length(x["line"]).alias("n")))
                        .alias("covers"))

    return (full.select("conv_id", "turn", "part", F.explode(F.transform("spans", unit)).alias("u"))
            .select("conv_id", "turn", "part", "u.level", "u.unit", F.xxhash64("u.unit").alias("hash"), "u.covers"))


KEY = ["conv_id", "hash", "unit"]
BROADCAST_TALKS = 100_000  # conversations with a quote whose ids are broadcast


def _latest(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): for each asked (KEY, turn, level) the latest earlier turn at each lower level.

    Turns are cut into stretches, so a unit of very many turns is not one window.
    """
    key = [*KEY, "held"]
    levels = held.select(key).distinct()
    asks = asked.join(levels, KEY).where("held < level").select(*key, "turn").distinct()
    whole = dict(held.dtypes)["parent"] in ("tinyint", "smallint", "int", "bigint")
    events = asks.withColumn("parent", F.lit(None).cast(held.schema["parent"].dataType)).unionByName(
        held.select(*key, F.col("parent").alias("turn"), "parent"))
    events = events.withColumn("stretch", F.shiftright(F.col("turn").cast("long"), 10) if whole else F.lit(0).cast("long"))
    # an ask sorts before an original of its own turn
    before = (Window.partitionBy(*key, "stretch").orderBy("turn", F.col("parent").isNotNull())
              .rowsBetween(Window.unboundedPreceding, -1))
    near = events.withColumn("near", F.max("parent").over(before)).where("parent is null").drop("parent")
    earlier = Window.partitionBy(*key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    far = (events.groupBy(*key, "stretch").agg(F.max("parent").alias("most"))
           .withColumn("far", F.max("most").over(earlier)).drop("most"))
    return (near.join(far, [*key, "stretch"]).select("conv_id", "turn", F.coalesce("near", "far").alias("parent"))
            .where("parent is not null"))


def links(messages: DataFrame, text: str = "text") -> DataFrame:
    """(conv_id, turn, parent, quoted_chars): the earlier message that each quoting message replies to."""
    quoting = messages.where(quoted(text).cast("string").rlike("(?:^|\n)[\\x20\\t]*>"))
    quotes = checkpointed(units(quoting, text).where("level > 0"))
    talks = checkpointed(quotes.select("conv_id").distinct())
    if talks.count() <= BROADCAST_TALKS:  # else the units of all conversations are shuffled
        messages = messages.join(F.broadcast(talks), "conv_id", "left_semi")
    held = checkpointed(units(messages, text).select(*KEY, F.col("turn").alias("parent"), F.col("level").alias("held"))
                        .join(quotes.select(KEY).distinct(), KEY, "left_semi").distinct())
    # Candidates: all earlier messages with a unit of the turn, but for its most frequent unit only the latest:
    # a message that has nothing but that unit is never better than the latest such message.
    frequent = held.groupBy(KEY).agg(F.count("*").alias("times"))
    asked = quotes.select("conv_id", "turn", "level", "hash", "unit").distinct().join(frequent, KEY)
    widest = asked.groupBy("conv_id", "turn").agg(F.max(F.struct("times", "hash", "unit", "level")).alias("w"))
    asked = checkpointed(asked.join(widest, ["conv_id", "turn"]).withColumn(
        "wide", (F.col("w.hash") == F.col("hash")) & (F.col("w.unit") == F.col("unit")) & (F.col("w.level") == F.col("level")))
        .drop("w", "times"))
    pairs = (asked.where("not wide").join(held, KEY).where("parent < turn and held < level")
             .select("conv_id", "turn", "parent"))
    candidates = pairs.union(_latest(asked.where("wide").drop("wide"), held)).distinct()
    lines = (candidates.join(quotes, ["conv_id", "turn"]).join(held, [*KEY, "parent"]).where("held < level")
             .select("conv_id", "turn", "parent", "part", "level", "held", F.explode("covers").alias("c"))
             .groupBy("conv_id", "turn", "parent", "part", "level", "c")
             .agg(F.max(F.col("held") == F.col("level") - 1).alias("direct")))
    n = F.col("c.n")
    scored = lines.groupBy("conv_id", "turn", "parent").agg(
        F.sum(F.when(F.col("level") == 1, n).otherwise(0)).alias("top"),
        F.sum(F.when(F.col("direct"), n).otherwise(0)).alias("direct"), F.sum(n).alias("quoted_chars"))
    return scored.groupBy("conv_id", "turn").agg(
        F.max(F.struct("top", "direct", "quoted_chars", "parent")).alias("best")).select(
        "conv_id", "turn", F.col("best.parent").alias("parent"), F.col("best.quoted_chars").alias("quoted_chars"))


def threads(found: DataFrame) -> DataFrame:
    """links → (conv_id, turn, parent, thread, depth); parents are earlier, so doubling ends after log(depth) rounds."""
    state = checkpointed(found.select("conv_id", "turn", "parent", F.col("parent").alias("thread"), F.lit(1).alias("depth")))
    while True:
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        step = state.join(up, ["conv_id", "thread"], "left")
        moved = checkpointed(step.select("conv_id", "turn", "parent", F.coalesce("next", "thread").alias("thread"),
                                         (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                                         F.col("next").isNotNull().alias("moved")))
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return state


def body(text: Column) -> Column:
    """The text without quoted lines; blank ends off."""
    own = F.transform(F.filter(_lines(text), lambda x: x["level"] == 0), lambda x: x["line"])
    return F.regexp_replace(F.array_join(own, "\n"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def conversations(messages: DataFrame, text: str = "text", role: str = "role") -> DataFrame:
    """messages (conv_id, turn, role, text, ...) with thread, depth, parent, n_quoted, body and chat."""
    out = ["thread", "depth", "parent", "n_quoted", "body", "chat"]
    messages = without(messages, *[c for c in out if c not in (text, role)])
    names = fresh(messages, "conv", "turn", "parent", "thread", "depth")
    linked = threads(links(messages, text)).select("conv_id", "turn", "parent", "thread", "depth").toDF(*names)
    conv, turn, parent, thread, depth = names
    n_quoted = F.size(F.filter(_lines(quoted(text)), lambda x: x["level"] > 0))
    full = messages.join(linked, (quoted("conv_id") == F.col(conv)) & (quoted("turn") == F.col(turn)), "left")
    own = body(quoted(text))
    head = F.concat(F.lit("<|"), F.coalesce(quoted(role).cast("string"), F.lit("unknown")), F.lit("|>\n"))
    return full.select(*[quoted(c) for c in messages.columns], F.coalesce(F.col(thread), quoted("turn")).alias("thread"),
                       F.coalesce(F.col(depth), F.lit(0)).cast("long").alias("depth"), F.col(parent).alias("parent"),
                       n_quoted.cast("long").alias("n_quoted"), own.alias("body"), F.concat(head, own).alias("chat"))
