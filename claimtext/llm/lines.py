"""Line dedup over content-defined chunks of lines.

A text is split at \\n; lines of white space alone are left out until the end.
Each line has a 64-bit hash, and a rolling hash runs over each two lines in
succession.  A chunking puts a boundary before each pair of lines whose
rolling hash is a local minimum and one behind the pair; what lies between two
such pairs is cut every ``MAX_LINES`` lines.  So chunks have 1 to ``MAX_LINES``
lines, and a boundary depends on four lines around it alone: it shifts with
inserted or removed lines.  A passage that is shorter than the distance of
two boundaries may hold no chunk, so a text has one chunking by the minima and
one by the maxima of each of ``SEEDS`` rolling hashes.

Chunks of two lines or more are grouped over all documents by two 64-bit
hashes of their line hashes; a chunk that also starts earlier (smaller id,
then smaller text hash, or same text and smaller line) is a match with the
earliest one.  Each match is grown line by line into both its neighbours, up
to ``GROW`` lines, as long as the lines are equal.  The lines of the grown
matches are removed.  Each has an equal line at an earlier place, so one of
each line stays.

Equal means equal bytes: in one aggregation, which combines before the
shuffle, the bytes of all lines of one hash are compared.  A line whose hash
other bytes have too is never removed.  So groups, matches and growth need the
hashes alone (8 bytes a line); the texts are shuffled once, in the last join.
A chunk that a third of all documents share is one row for each task in the
grouping; its matches meet one row of its earliest place.  Only DataFrame
functions are used.

Defined results: a null text stays null, an empty one empty.  Lines of white
space go with the line before if the line behind them goes as well, and those
at the start with the first line; a text of such lines alone stays.  A single
line that stands elsewhere stays unless a match grows over it.  Null ids sort
last.  Rows with equal id and text are one document seen twice: they lose the
same lines.  An empty table gives no rows.  Result columns replace input
columns of the same name.  ``n_chunks`` and ``n_removed_chunks`` (all lines
gone) count the first chunking.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimtext.llm.common import NOT_SPACE, checkpointed, computed, fresh, quoted, remove_folder, without
from claimtext.session import ensure_checkpoint_dir

SEEDS = (1, 2)
MIN_LINES = 2
MAX_LINES = 4
GROW = 8
CODE = 8  # a chunk is coded as first line * CODE + lines

NO_INTS = "cast(array() as array<int>)"


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that stays where it is computed (see common.computed)."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def _not_null(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def _split(df: DataFrame, text: str, lines: str, places: str) -> DataFrame:
    """df with the lines of a text (null for a null one) and the places of those with a word."""
    df = pinned(df, lines, F.split(quoted(text).cast("string"), "\n"))
    return pinned(df, places, _not_null(F.transform(lines, lambda x, i: F.when(x.rlike(NOT_SPACE), i))))


def _hashes(lines: str, places: str) -> Column:
    return F.transform(places, lambda i: line_hash(F.get(F.col(lines), i)))


def _with_starts(df: DataFrame, h: str, starts: str, seed: int, low: bool) -> DataFrame:
    """df with the first lines of the chunks of one chunking, in order."""
    rolled, picked = fresh(df, "rolled", "picked")
    m = F.size(h)

    def rolling(x: Column, i: Column) -> Column:
        both = F.xxhash64(F.lit(seed), x, F.get(F.col(h), i + 1))
        return both if low else F.bitwise_not(both)  # turns the order round

    df = pinned(df, rolled, F.transform(F.slice(F.col(h), 1, F.greatest(m - 1, F.lit(0))), rolling))
    r = F.col(rolled)
    least = lambda x, i: F.coalesce(x < F.get(r, i - 1), F.lit(True)) & F.coalesce(x <= F.get(r, i + 1), F.lit(True))
    df = pinned(df, picked, _not_null(F.transform(r, lambda x, i: F.when(least(x, i), i))))
    pairs = F.col(picked)

    def up_to(pair: Column, i: Column) -> Column:
        """Pieces from the end of the pair before, and the pair's own first line."""
        end = F.coalesce(F.get(pairs, i - 1) + 2, F.lit(0))
        between = F.when(end < pair, F.sequence(end, pair - 1, F.lit(MAX_LINES))).otherwise(F.expr(NO_INTS))
        return F.concat(between, F.array(pair))

    every = F.flatten(F.transform(F.concat(pairs, F.array(m)), up_to))
    return pinned(df, starts, F.filter(every, lambda s: s < m)).drop(rolled, picked)


def chunk_codes(df: DataFrame, h: str, codes: str) -> DataFrame:
    """df with the distinct chunks of all chunkings of at least MIN_LINES lines, coded."""
    names = fresh(df, *[f"starts{k}" for k in range(2 * len(SEEDS))])
    for k, name in enumerate(names):
        df = _with_starts(df, h, name, SEEDS[k // 2], k % 2 == 0)

    def coded(name: str) -> Column:
        starts = F.col(name)
        return F.transform(starts, lambda s, i: s.cast("long") * CODE + F.coalesce(F.get(starts, i + 1), F.size(h)) - s)

    found = F.array_distinct(F.flatten(F.array(*[coded(n) for n in names])))
    return pinned(df, codes, F.filter(found, lambda c: c % CODE >= MIN_LINES)).drop(*names)


def _chunks(docs: DataFrame) -> DataFrame:
    """(id, tag, first, n, h1, h2) of the chunks of (id, tag, h)."""
    def chunk(code: Column) -> Column:
        first, n = (code / CODE).cast("int"), (code % CODE).cast("int")
        own = F.slice(F.col("h"), first + 1, n)
        return F.struct(first.alias("first"), n.alias("n"), F.xxhash64(own).alias("h1"), F.xxhash64(F.lit(7), own).alias("h2"))

    coded = chunk_codes(docs, "h", "codes")
    return coded.select("id", "tag", F.inline(F.transform("codes", chunk)))


def _before(h: str, first: Column) -> Column:
    """The hashes of up to GROW lines before, the nearest first."""
    n = F.least(first, F.lit(GROW))
    return F.reverse(F.slice(F.col(h), first - n + 1, n))


def _alike(a: Column, b: Column) -> Column:
    """How many lines of two arrays are equal from the start on."""
    other = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    return F.when(other > 0, other - 1).otherwise(F.size(a)).cast("int")


def _clashes(docs: DataFrame, text: str) -> DataFrame:
    """(h): the hashes that lines of different bytes share; all lines are compared."""
    line = docs.select(F.explode(F.split(quoted(text).cast("string"), "\n")).alias("line")).where(F.col("line").rlike(NOT_SPACE))
    distinct = line.select(line_hash(F.col("line")).alias("h"), "line").groupBy("h", "line").agg(F.lit(1).alias("one"))
    return distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")


def _gone(slim: DataFrame, text: str, clashes: DataFrame) -> DataFrame:
    """(id, tag, gone): the lines (counted without blank ones) of (id, tag, text) that go."""
    hashed = _split(slim, text, "lines", "places").select("id", "tag", _hashes("lines", "places").alias("h"))
    docs = checkpointed(hashed.where(F.size("h") >= MIN_LINES).distinct())
    chunk = _chunks(docs)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "tag", "first")
    groups = chunk.groupBy("h1", "h2", "n").agg(F.count("*").alias("copies"), F.min(place).alias("e"))
    repeats = groups.where("copies > 1").groupBy(F.col("e.id").alias("e_id"), F.col("e.tag").alias("e_tag")).agg(
        F.collect_list(F.struct("h1", "h2", "n", "e")).alias("all"))  # at most the chunks of one text

    def around(c: Column) -> Column:
        first = c["e"]["first"]
        return F.struct(c["h1"].alias("h1"), c["h2"].alias("h2"), c["e"].alias("e"), _before("h", first).alias("before"),
                        F.slice(F.col("h"), first + c["n"] + 1, GROW).alias("behind"))

    of_first = repeats.join(docs, F.col("e_id").eqNullSafe(F.col("id")) & (F.col("e_tag") == F.col("tag")))
    earliest = checkpointed(of_first.select(F.inline(F.transform("all", around))))
    later = chunk.join(earliest, ["h1", "h2"]).where(place > F.col("e"))
    matches = later.groupBy(F.col("id").alias("m_id"), F.col("tag").alias("m_tag")).agg(
        F.collect_list(F.struct("first", "n", "before", "behind")).alias("matches"))  # at most the chunks of one text

    def grown(x: Column) -> Column:
        end = x["first"] + x["n"]
        left = _alike(x["before"], _before("h", x["first"]))
        right = _alike(x["behind"], F.slice(F.col("h"), end + 1, GROW))
        return F.sequence(x["first"] - left, end + right - 1)

    met = docs.join(matches, F.col("m_id").eqNullSafe(F.col("id")) & (F.col("m_tag") == F.col("tag")))
    met = pinned(met, "gone", F.array_distinct(F.flatten(F.transform("matches", grown))))
    one = met.select("id", "tag", F.inline(F.transform("gone", lambda k: F.struct(k.alias("k"), F.get(F.col("h"), k).alias("h")))))
    return one.join(clashes, "h", "left_anti").groupBy("id", "tag").agg(F.sort_array(F.collect_list("k")).alias("gone"))


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with kept_text, n_lines, n_chunks, n_removed_chunks and n_removed_lines."""
    out = ["kept_text", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines"]
    docs = without(docs, *[c for c in out if c != text])
    key, tag, lines, places, gone, g_id, g_tag = fresh(docs, "id", "tag", "lines", "places", "gone", "g_id", "g_tag")
    keyed = docs.select("*", quoted(id).alias(key), F.xxhash64(quoted(text).cast("string")).alias(tag))
    slim = keyed.select(F.col(key).alias("id"), F.col(tag).alias("tag"), quoted(text).alias("text"))
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/clashes-{uuid.uuid4().hex}"
    _clashes(slim, "text").write.parquet(folder)  # as files, Spark knows their size and mostly need not move the lines that go
    of_doc = checkpointed(_gone(slim, "text", spark.read.schema("h long").parquet(folder))).select(F.col("id").alias(g_id), F.col("tag").alias(g_tag), F.col("gone").alias(gone))
    remove_folder(spark, folder)
    joined = keyed.join(of_doc, F.col(key).eqNullSafe(F.col(g_id)) & F.col(tag).eqNullSafe(F.col(g_tag)), "left")
    full = _split(joined, text, lines, places)
    h, starts, flags, rest = fresh(full, "h", "starts", "flags", "rest")
    full = _with_starts(pinned(full, h, _hashes(lines, places)), h, starts, SEEDS[0], True)
    m, away = F.size(places), F.coalesce(gone, F.expr(NO_INTS))

    def flagged(k: Column, i: Column) -> Column:
        """False for the lines since the one that went before, true for this one."""
        since = k - F.coalesce(F.get(away, i - 1), F.lit(-1)) - 1
        return F.concat(F.array_repeat(F.lit(False), since), F.array(F.lit(True)))

    full = pinned(full, flags, F.flatten(F.transform(F.concat(away, F.array(m)), flagged)))  # one more, true, for the end

    def piece(at: Column, k: Column) -> Column:
        """A line and the blank ones behind it, as far as they stay."""
        end = F.coalesce(F.get(F.col(places), k + 1), F.size(lines))
        skip = F.when(~F.get(F.col(flags), k), 0).when(F.get(F.col(flags), k + 1), end - at).otherwise(1)
        return F.slice(F.col(lines), at + skip + 1, end - at - skip)

    head = F.when(m == 0, F.size(lines)).when(F.get(F.col(flags), 0), 0).otherwise(F.get(F.col(places), 0))
    stays = F.concat(F.slice(F.col(lines), 1, head), F.flatten(F.transform(places, piece)))
    kept = pinned(full, rest, stays)

    def whole(s: Column, i: Column) -> Column:
        end = F.coalesce(F.get(F.col(starts), i + 1), m)
        return F.when(F.forall(F.slice(F.col(flags), s + 1, end - s), lambda x: x), s)

    null = F.col(lines).isNull()
    return computed(kept, {
        "kept_text": F.when(~null, F.array_join(rest, "\n")),
        "n_lines": F.when(null, 0).otherwise(F.size(lines)).cast("long"),
        "n_chunks": F.when(null, 0).otherwise(F.size(starts)).cast("long"),
        "n_removed_chunks": F.when(null, 0).otherwise(F.size(_not_null(F.transform(starts, whole)))).cast("long"),
        "n_removed_lines": F.when(null, 0).otherwise(F.size(lines) - F.size(rest)).cast("long"),
    }, *[quoted(c) for c in docs.columns])
