"""Code hierarchy from an ordered chapter listing.

H1 classifies each line with one regex (range line / 3-character code /
4-character code).  H2 carries the current category and sub-category
forward and looks one line ahead -- an ordered scan per listing.  The scan
is a *segmented* window: rows are cut into fixed-size chunks of the order
key, each chunk is scanned on its own (bounded sort, many tasks even when
one listing holds most rows) and a small per-chunk summary supplies the
carry-in from earlier chunks and the first line of the next chunk.
H3 attaches every code-table row whose code contains the node code, as an
equi-join on the substrings of the code (a hash join, not a nested loop).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimtext import constants as K
from claimtext.functions import text as TX

DEFAULT_CHUNK = 1_000_000

# FIXED VALUES: lengths of node codes produced by the listing classes
# (3-character and 4-character code lines).
LISTING_CODE_LENGTHS = (3, 4)


# --- H1 ----------------------------------------------------------------------------

def classify_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Add ``cat``, ``sub``, ``subsub`` (the three alternatives, '' when absent)
    and ``matched`` (whether any alternative matched)."""
    pat = K.HIERARCHY_LINE_PATTERN
    c = F.col(line_col)
    return (lines.withColumn("cat", F.regexp_extract(c, pat, 1))
                 .withColumn("sub", F.regexp_extract(c, pat, 2))
                 .withColumn("subsub", F.regexp_extract(c, pat, 3))
                 .withColumn("matched", (F.col("cat") != "") | (F.col("sub") != "") | (F.col("subsub") != "")))


# --- segmented ordered scan ---------------------------------------------------------

def ordered_fill(df: DataFrame, keys: list[str], order: str, fill: dict, ahead: dict,
                 chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Forward fill and one-row lookahead within ``keys`` ordered by ``order``.

    ``fill``: name -> Column that is null where there is nothing to carry;
    the output column holds the last non-null value up to and including the
    row.  ``ahead``: name -> Column; the output holds that value on the next
    row (null on the last row).  ``order`` must be numeric; rows are cut into
    chunks of ``chunk`` consecutive order values so that no window
    partition is larger than a chunk.
    """
    x = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))
    for name, c in {**fill, **ahead}.items():
        x = x.withColumn(f"_v_{name}", c)
    part = [*keys, "_chunk"]
    w_run = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_next = Window.partitionBy(*part).orderBy(order)
    for name in fill:
        x = x.withColumn(f"_l_{name}", F.last(f"_v_{name}", ignorenulls=True).over(w_run))
    for name in ahead:
        x = x.withColumn(f"_l_{name}", F.lead(f"_v_{name}").over(w_next))
    # one summary row per chunk: its last non-null fill values, its first lookahead values
    aggs = [F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct(F.col(order), F.col(f"_v_{n}").alias("v"))))["v"]
            .alias(f"_s_{n}") for n in fill]
    aggs += [F.min(F.struct(F.col(order), F.col(f"_v_{n}").alias("v")))["v"].alias(f"_f_{n}") for n in ahead]
    aggs.append(F.max(order).alias("_last"))
    summ = x.groupBy(*part).agg(*aggs)
    w_prev = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    w_c = Window.partitionBy(*keys).orderBy("_chunk")
    sel = [*part, "_last"]
    sel += [F.last(f"_s_{n}", ignorenulls=True).over(w_prev).alias(f"_c_{n}") for n in fill]
    sel += [F.lead(f"_f_{n}").over(w_c).alias(f"_n_{n}") for n in ahead]
    carry = summ.select(*sel)
    y = x.join(carry, part, "left")
    out = [F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in fill]
    out += [F.when(F.col(order) == F.col("_last"), F.col(f"_n_{n}")).otherwise(F.col(f"_l_{n}")).alias(n)
            for n in ahead]
    keep = [c for c in df.columns if c not in fill and c not in ahead]
    return y.select(*keep, *out)


# --- H2 --------------------------------------------------------------------------------

def hierarchy_nodes(lines: DataFrame, listing_col: str = "chapter", order_col: str = "line_no",
                    line_col: str = "line", chunk: int = DEFAULT_CHUNK) -> tuple[DataFrame, DataFrame]:
    """(nodes, rejects) of ordered listing lines.

    nodes: (listing, line_no, Categorie, Sous_Categorie, Sous_Sous_Categorie).
    A 4-character line is always a node; a 3-character line is a node
    (sub-sub '') only when a next line exists and is not a 4-character line
    -- so a 3-character line at the very end is lost.  The sub-category is
    not reset by a new category.  Lines matching no class are returned as
    rejects and are not part of the lookahead.
    """
    c = classify_lines(lines, line_col)
    rejects = c.filter(~F.col("matched")).select(listing_col, order_col, line_col)
    ok = c.filter(F.col("matched")).select(listing_col, order_col, "cat", "sub", "subsub")
    filled = ordered_fill(
        ok, [listing_col], order_col,
        fill={"cat_f": F.when(F.col("cat") != "", F.col("cat")),
              "sub_f": F.when((F.col("cat") == "") & (F.col("sub") != ""), F.col("sub"))},
        ahead={"next_is_4": (F.col("cat") == "") & (F.col("sub") == "") & (F.col("subsub") != "")},
        chunk=chunk)
    is3 = (F.col("cat") == "") & (F.col("sub") != "")
    is4 = (F.col("cat") == "") & (F.col("sub") == "") & (F.col("subsub") != "")
    nodes = (filled.filter(is4 | (is3 & (F.col("next_is_4") == F.lit(False))))
             .select(listing_col, order_col,
                     F.coalesce("cat_f", F.lit("")).alias("Categorie"),
                     F.when(is3, F.col("sub")).otherwise(F.coalesce("sub_f", F.lit(""))).alias("Sous_Categorie"),
                     F.when(is3, F.lit("")).otherwise(F.col("subsub")).alias("Sous_Sous_Categorie")))
    return nodes, rejects


# --- H3-H5 -------------------------------------------------------------------------------

def node_code(sub: Column, subsub: Column) -> Column:
    """Sub-sub code if present, else sub code: the text before the first space."""
    src = F.when(subsub != "", subsub).otherwise(sub)
    return F.substring_index(src, " ", 1)


def substrings(s: Column, lengths: Column) -> Column:
    """Distinct substrings of ``s`` of the given lengths (array<int>)."""
    n = F.length(s)
    return F.array_distinct(F.flatten(F.transform(lengths, lambda L: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(n - L + 1, F.lit(1))), lambda p: p + L - 1 <= n),
        lambda p: F.substr(s, p, L)))))


def attach_codes(nodes: DataFrame, codes: DataFrame, chapter_num: str, chapter_name: str,
                 num_col: str = "diagnostic_num", label_col: str = "diagnostic",
                 code_lengths=None, few_codes: bool = False) -> DataFrame:
    """H3/H4: every code row whose code contains the node code, in the output layout.

    ``nodes`` has Categorie, Sous_Categorie, Sous_Sous_Categorie (+ any order
    columns, kept).  Containment is found by exploding each code into its
    distinct substrings of the node-code lengths and equi-joining them to
    the node codes, which keeps the join a hash join at any size.
    ``code_lengths``: the possible node-code lengths when known (nodes from
    ``hierarchy_nodes`` have ``LISTING_CODE_LENGTHS``); otherwise they are
    read from the nodes with a one-row subquery.

    Spark takes an exploded table to be as small as the table it comes from,
    and would broadcast the substrings of millions of codes.  So those that
    are node codes are kept by a semi join, and each of them meets its nodes
    in a left join, where the nodes alone can be broadcast; all have a match,
    so it gives the rows of the inner join.  ``few_codes``: the code table is
    known to be small beside the nodes, and either side may be broadcast.
    """
    n = nodes.withColumn("_code", node_code(F.col("Sous_Categorie"), F.col("Sous_Sous_Categorie")))
    if code_lengths is not None:
        lengths = F.array(*[F.lit(int(x)) for x in code_lengths])
    else:
        lengths = n.select(F.length("_code").alias("L")).filter(F.col("L") > 0).agg(F.collect_set("L")).scalar()
    c = codes.select(F.col(num_col).alias("diagnostic_num"), F.col(label_col).alias("diagnostic"))
    # the length set is a one-row subquery; bind it to a column before the array functions use it
    cx = (c.withColumn("_lens", lengths)
           .select("diagnostic_num", "diagnostic",
                   F.explode_outer(substrings(F.col("diagnostic_num"), F.col("_lens"))).alias("_code"))
           .filter(F.col("_code").isNotNull()))
    if few_codes:
        j = n.join(cx, "_code")
    else:
        j = cx.join(n.select("_code").distinct(), "_code", "left_semi").join(n, "_code", "left")
    extra = [x for x in nodes.columns if x not in ("Categorie", "Sous_Categorie", "Sous_Sous_Categorie")]
    return j.select(*extra, F.lit(chapter_num).alias("Chapitre_num"), F.lit(chapter_name).alias("Chapitre_nom"),
                    "Categorie", F.lit("").alias("Sous_Categorie"),
                    F.col("Sous_Categorie").alias("Sous_Sous_Categorie"),
                    F.col("Sous_Sous_Categorie").alias("Sous_Sous_Sous_Categorie"),
                    "diagnostic_num", "diagnostic")


# --- P16 / P19 ---------------------------------------------------------------------------

# Columns concatenated into one retrieval document, the fifth one twice.
DOC_COLUMNS = ["Chapitre_num", "Chapitre_nom", "Categorie", "Sous_Categorie", "Sous_Sous_Categorie",
               "Sous_Sous_Categorie", "Sous_Sous_Sous_Categorie", "diagnostic_num"]


def hierarchy_document(columns=None, empty_as_null: bool = False) -> Column:
    """Hierarchy columns joined by spaces, missing values written 'nan'.

    ``empty_as_null`` treats '' as missing, as a spreadsheet round trip does.
    """
    cols = columns or DOC_COLUMNS
    parts = []
    for c in cols:
        v = F.col(c).cast("string")
        if empty_as_null:
            v = F.when(v != "", v)
        parts.append(F.coalesce(v, F.lit("nan")))
    return F.concat_ws(" ", *parts)


def hierarchy_corpus(h: DataFrame, remove_duplicate: bool = False, stem=None, columns=None,
                     empty_as_null: bool = False) -> Column:
    """P16 then the P13 chain; with ``remove_duplicate`` P14 again on the result."""
    doc = TX.process_string(hierarchy_document(columns, empty_as_null), stem=stem)
    if remove_duplicate:
        doc = TX.process_string_distinct(doc, stem=stem)
    return doc
