"""Query catalogue: named Spark queries over the driver's tables and, where
SQL can state them, the equivalent DuckDB SQL (the correctness oracle).

Every query reads whole tables and whole texts.  Computed columns carry the
same alias on both sides; token lists are compared as strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimtext import constants as K
from claimtext.functions import text as TX
from claimtext.functions.patterns import Lexicon, member_and_side
from claimtext.functions.patterns import members_from_columns as member_list
from claimtext.operators import extract as EX
from claimtext.plans import sql as S
from claimtext.plans.stem_sql import stem_ctes
from claimtext.plans import views as V

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# Text cleaning
# ---------------------------------------------------------------------------

_CLEAN_SQL = (f"SELECT doc_id, "
              f"{S.apostrophe(S.punct('lower(' + S.numbers('text') + ')'))} AS cleaned FROM documents")


@register("clean_text", _CLEAN_SQL)
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    d = V.read(spark, sf, "documents")
    return d.select("doc_id", TX.remove_apostrophe(TX.remove_punctuation(TX.lower(TX.remove_numbers("text"))))
                    .alias("cleaned"))


@register("fold_text", f"SELECT doc_id, {S.fold('text')} AS folded FROM documents")
def fold_text(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", TX.fold("text").alias("folded"))


_TOKEN_SQL = f"""
SELECT doc_id, n_raw_tokens, array_to_string(kept, ' ') AS kept, len(kept)::BIGINT AS n_kept
FROM (SELECT doc_id, len({S.raw_tokens('text')})::BIGINT AS n_raw_tokens,
             {S.drop_stop(S.ws_tokens(S.punct('lower(text)')))} AS kept
      FROM documents)
WHERE n_raw_tokens > 1
"""


@register("token_filter", _TOKEN_SQL)
def token_filter(spark, sf):
    d = V.read(spark, sf, "documents")
    kept = TX.remove_stop_words(TX.ws_tokens(TX.remove_punctuation(TX.lower("text"))))
    return (d.select("doc_id", F.size(TX.raw_tokens("text")).cast("long").alias("n_raw_tokens"), kept.alias("k"))
             .filter(F.col("n_raw_tokens") > 1)
             .select("doc_id", "n_raw_tokens", F.array_join("k", " ").alias("kept"),
                     F.size("k").cast("long").alias("n_kept")))


@register("process_string_nostem",
          f"SELECT doc_id, {S.joined(S.process_tokens('text'))} AS processed FROM documents")
def process_string_nostem(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", TX.process_string("text").alias("processed"))


@register("process_distinct_nostem",
          f"SELECT doc_id, array_to_string(list_sort({S.process_tokens('text', distinct=True)}), ' ') AS tokens, "
          f"len({S.process_tokens('text', distinct=True)})::BIGINT AS n_tokens FROM documents")
def process_distinct_nostem(spark, sf):
    t = TX.process_tokens("text", distinct=True)
    return (V.read(spark, sf, "documents").select("doc_id", t.alias("t"))
            .select("doc_id", F.array_join(F.array_sort("t"), " ").alias("tokens"),
                    F.size("t").cast("long").alias("n_tokens")))


# ---------------------------------------------------------------------------
# Claims table and extraction
# ---------------------------------------------------------------------------

_FLAG_NAMES = [n for n, _m in V.CLAIM_FLAGS]


@register("drop_null_and_index",
          f"SELECT claim_id, length(description)::BIGINT AS n_chars, {', '.join(_FLAG_NAMES)} "
          f"FROM ({V.claims_sql()}) WHERE description IS NOT NULL")
def drop_null_and_index(spark, sf):
    # the spreadsheet's index column, dropped as P1 does
    c = V.claims(spark, sf).withColumn("Unnamed: 0", F.col("claim_id"))
    c = c.drop("Unnamed: 0").na.drop(subset=["description"])
    flags = c.columns[2:-1]          # the columns after the description, minus the free text
    return c.select("claim_id", F.length("description").cast("long").alias("n_chars"), *flags)


def _flag_member_sql(names=_FLAG_NAMES):
    return [(n, *member_and_side(n)) for n in names]


# M1 and M2 stated over the list of column names
_FLAG_COUNTS_SQL = f"""
UNPIVOT (SELECT {', '.join(f'count(*) FILTER (WHERE {n}) AS {n}' for n in _FLAG_NAMES)} FROM ({V.claims_sql()}))
ON {', '.join(_FLAG_NAMES)} INTO NAME col_name VALUE n_claims"""

_MEMBER_COUNTS_SQL = f"""
SELECT col_name, n_claims,
       CASE WHEN contains(c, 'gauche') THEN split_part(c, 'gauche', 1) WHEN contains(c, 'droit') THEN split_part(c, 'droit', 1)
            WHEN c = 'autrepartiecorps' THEN 'Autre partie: ' ELSE c END AS member,
       CASE WHEN contains(c, 'gauche') THEN 'gauche' WHEN contains(c, 'droit') THEN 'droit' ELSE 'inconnu' END AS side
FROM (SELECT col_name, n_claims, regexp_replace(lower(col_name), '^.*indlesion', '') AS c FROM ({_FLAG_COUNTS_SQL}))"""

_MEMBER_LIST_SQL = f"""
SELECT lower(name) AS member, sum(n_claims)::BIGINT AS n_flags
FROM (SELECT n_claims, split_part(split_part(regexp_replace(col_name, '^.*IndLesion', ''), 'Gauche', 1), 'Droit', 1) AS name
      FROM ({_FLAG_COUNTS_SQL}))
WHERE name NOT IN ('Cuissse', 'AutrePartieCorps') GROUP BY 1"""


@register("member_list", _MEMBER_LIST_SQL)
def members_of_claims(spark, sf):
    """M1: the members that the columns name, each with how often a claim flags it."""
    c = V.claims(spark, sf)
    columns = c.columns[2:]  # those after the description
    flags = EX.flags_long(c, "claim_id", "description")
    return (flags.where(F.col("member").isin(member_list(columns)))
            .groupBy("member").agg(F.count(F.lit(1)).alias("n_flags")))


@register("members_from_columns", _MEMBER_COUNTS_SQL)
def members_from_columns(spark, sf):
    """M1/M2: member and side named by every flag column, with its claim count."""
    c = V.claims(spark, sf)
    specs = [(n, *member_and_side(n)) for n in c.columns if n.startswith(K.FLAG_PREFIX)]
    aggs = [F.count(F.when(F.col(n), 1)).alias(n) for n, *_ in specs]
    counts = c.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("col_name"), F.lit(m).alias("member"), F.lit(s).alias("side"),
                              F.col(n).alias("n_claims")) for n, m, s, _o in specs])
    return counts.select(F.inline(rows))


_FLAGS_LONG_SQL = " UNION ALL ".join(
    f"SELECT claim_id, {i}::INTEGER AS col_pos, {S.q(n)} AS col_name, "
    + ("'Autre partie: ' || coalesce(PrecisionLesionAutrePartieCorps, 'nan')" if other else S.q(m))
    + f" AS member FROM ({V.claims_sql()}) WHERE {n}"
    for i, (n, m, _s, other) in enumerate(_flag_member_sql()))


@register("flags_long", _FLAGS_LONG_SQL)
def flags_long(spark, sf):
    return EX.flags_long(V.claims(spark, sf), "claim_id", "description")


def _prep_sql(names=_FLAG_NAMES, claims=None):
    return f"""
SELECT claim_id, {S.extraction_line('description')} AS line,
       coalesce(PrecisionLesionAutrePartieCorps, 'nan') AS prec, {', '.join(names)},
       ({" + ".join(f"{n}::INTEGER" for n in names)}) AS n_flags,
       list_filter([{', '.join(f"CASE WHEN {n} THEN {S.q(m)} END" for n, m, _s, o in _flag_member_sql(names) if not o)}],
                   lambda x: x IS NOT NULL) AS mems
FROM ({claims or V.claims_sql()})
WHERE description IS NOT NULL AND len({S.raw_tokens('description')}) > 1
"""


@register("route_counts", f"""
SELECT CASE WHEN n_flags = 1 THEN 1 WHEN n_flags > 1 THEN 2 ELSE 3 END AS route, count(*) AS n_claims
FROM ({_prep_sql()}) GROUP BY 1""")
def route_counts(spark, sf):
    p = EX.prepare(V.claims(spark, sf), "claim_id", "description")
    return p.groupBy(EX.route(F.size("hits")).alias("route")).agg(F.count(F.lit(1)).alias("n_claims"))


def _extract_sql(routes=(1, 2, 3), keep_unknown: bool = False, lex=None, names=_FLAG_NAMES, claims=None,
                 all_members=None) -> str:
    lex = lex or V.test_lexicon()
    flag_members = sorted({m for _n, m, _s, o in _flag_member_sql(names) if not o})
    all_members = all_members or member_list(names + ["PrecisionLesionAutrePartieCorps"])
    parts = []
    if 1 in routes:
        ph, mb, sd = S.match_by_name("line", "mems[1]", flag_members, lex)
        parts.append(f"""
SELECT claim_id, 0 AS i, 0 AS sub,
       CASE WHEN IndLesionAutrePartieCorps THEN line ELSE {ph} END AS phrase,
       CASE WHEN IndLesionAutrePartieCorps THEN 'Autre partie: ' || prec ELSE {mb} END AS member,
       CASE WHEN IndLesionAutrePartieCorps THEN 'inconnu' ELSE {sd} END AS side
FROM prep WHERE n_flags = 1""")
    if 2 in routes:
        ph, mb, sd = S.match_by_name("rest", "mems[i + 1]", flag_members, lex)
        ph2, mb2, sd2 = S.match_by_name("line", "mems[i]", flag_members, lex)
        parts.append(f"""
SELECT claim_id, i, 0 AS sub, ph AS phrase, mb AS member, sd AS side FROM fold WHERE i > 0
UNION ALL
SELECT claim_id, i, 1 AS sub, {ph2} AS phrase, {mb2} AS member, {sd2} AS side FROM fold WHERE i > 0 AND rest = ''""")
        fold_cte = f""",
fold AS (
  SELECT claim_id, line, mems, 0 AS i, line AS rest, NULL::VARCHAR AS ph, NULL::VARCHAR AS mb, NULL::VARCHAR AS sd
  FROM prep WHERE n_flags > 1
  UNION ALL
  SELECT claim_id, line, mems, i + 1 AS i, replace(rest, ph, '') AS rest, ph, mb, sd
  FROM (SELECT claim_id, line, mems, i, rest, {ph} AS ph, {mb} AS mb, {sd} AS sd
        FROM fold WHERE i < len(mems))
)"""
    else:
        fold_cte = ""
    if 3 in routes:
        for k, m in enumerate(all_members):
            ph, mb, sd = S.match_columns("line", m, lex)
            parts.append(f"SELECT claim_id, 0 AS i, {k} AS sub, {ph} AS phrase, {mb} AS member, {sd} AS side "
                         f"FROM prep WHERE n_flags = 0")
    body = "\nUNION ALL\n".join(parts)
    keep = "" if keep_unknown else f"WHERE phrase <> {S.q(K.UNKNOWN)}"
    return f"""
WITH RECURSIVE prep AS ({_prep_sql(names, claims)}){fold_cte},
allt AS ({body}),
numbered AS (SELECT claim_id, (row_number() OVER (PARTITION BY claim_id ORDER BY i, sub) - 1)::BIGINT AS seq,
                    phrase, member, side FROM allt)
SELECT claim_id, seq, phrase, member, side FROM numbered {keep}
"""


def _extract(spark, sf, routes=None, keep_unknown=False):
    out = EX.extract_tuples(V.claims(spark, sf), "claim_id", "description", lexicon=V.test_lexicon(),
                            keep_unknown=keep_unknown, routes=routes)
    return out.withColumn("seq", F.col("seq").cast("long"))


@register("match_one", _extract_sql(routes=(1,), keep_unknown=True))
def match_one(spark, sf):
    return _extract(spark, sf, routes=[1], keep_unknown=True)


@register("match_sequential", _extract_sql(routes=(2,), keep_unknown=True))
def match_sequential(spark, sf):
    return _extract(spark, sf, routes=[2], keep_unknown=True)


@register("match_all", _extract_sql(routes=(3,), keep_unknown=True))
def match_all(spark, sf):
    return _extract(spark, sf, routes=[3], keep_unknown=True)


@register("extract_tuples", _extract_sql())
def extract_tuples(spark, sf):
    return _extract(spark, sf)


# the members that the columns of the body claims name, "Cuissse" left out, the hip without an entry
_BODY_MEMBERS = sorted([*K.DEFAULT_LEXICON, "hanche"])


@register("extract_default_lexicon", _extract_sql(
    lex=Lexicon.default(), names=[n for n, _m in V.BODY_FLAGS], claims=V.body_claims_sql(), all_members=_BODY_MEMBERS))
def extract_default_lexicon(spark, sf):
    """E9 with the default lexicon and sides on claims that name every member."""
    out = EX.extract_tuples(V.body_claims(spark, sf), "claim_id", "description")
    return out.withColumn("seq", F.col("seq").cast("long"))


@register("extract_member_side_counts", f"""
SELECT member, side, count(*) AS n_tuples, count(DISTINCT claim_id) AS n_claims
FROM ({_extract_sql()}) GROUP BY member, side""")
def extract_member_side_counts(spark, sf):
    """Flagship: which body part and side does each description mention?"""
    return (_extract(spark, sf).groupBy("member", "side")
            .agg(F.count(F.lit(1)).alias("n_tuples"), F.countDistinct("claim_id").alias("n_claims")))


# ---------------------------------------------------------------------------
# Vocabularies and the vocabulary filter
# ---------------------------------------------------------------------------

from claimtext.operators import prune as PR  # noqa: E402
from claimtext.operators import retrieve as RT  # noqa: E402
from claimtext.operators import vocab as VO  # noqa: E402


def _vocab_words_sql(text: str, table: str) -> str:
    s = S.punct(S.numbers(f"lower({text})"))
    t = S.ws_tokens(S.apostrophe(f"array_to_string({S.drop_stop(S.ws_tokens(s))}, ' ')"))
    return f"SELECT DISTINCT w AS word FROM (SELECT unnest({t}) AS w FROM {table})"


_KEPT_WORD = f"length(word) > 2 AND NOT list_contains({S.stop_list()}, word)"


def _vocab_sql(text: str, table: str) -> str:
    return f"SELECT word FROM ({_vocab_words_sql(text, table)}) WHERE {_KEPT_WORD}"


def _stem_or_stop(st: str = "st") -> str:
    """A word's stem from the table st; a stop word stays as it is."""
    return f"CASE WHEN list_contains({S.stop_list()}, {st}.word) THEN {st}.word ELSE {st}.stem END"


def _stem_vocab_sql(words: str, st: str = "st") -> str:
    return (f"SELECT DISTINCT word FROM (SELECT {_stem_or_stop(st)} AS word FROM {words} JOIN {st} USING (word)) "
            f"WHERE {_KEPT_WORD}")


def _unstemmed_tokens(x: str) -> str:
    """The tokens that P13 and P14 stem."""
    t = S.drop_stop(S.ws_tokens(S.punct(f"lower({S.numbers(S.fold(x))})")))
    return S.ws_tokens(S.apostrophe(f"array_to_string({t}, ' ')"))


@register("vocabulary_nostem", _vocab_sql("text", "documents"))
def vocabulary_nostem(spark, sf):
    return VO.vocabulary(V.read(spark, sf, "documents"), "text", stem=False)


@register("vocabulary_stem", f"""
WITH words AS ({_vocab_words_sql('text', 'documents')}), {stem_ctes('words')}
{_stem_vocab_sql('words')}""")
def vocabulary_stem(spark, sf):
    """P17 with stemming."""
    return VO.vocabulary(V.read(spark, sf, "documents"), "text", stem=True)


@register("abbreviation_vocabulary",
          f"SELECT DISTINCT unnest({S.raw_tokens('lower(text)')}) AS word FROM benchmark")
def abbreviation_vocabulary(spark, sf):
    return VO.abbreviation_vocabulary(V.read(spark, sf, "benchmark"), "text")


@register("stem_dictionary", f"""
WITH words AS (SELECT DISTINCT unnest({S.process_tokens('text')}) AS word FROM documents), {stem_ctes('words')}
SELECT word AS token, {_stem_or_stop()} AS stem FROM st""")
def stem_dictionary(spark, sf):
    """Every distinct cleaned token of the corpus and its stem."""
    d = V.read(spark, sf, "documents").select(TX.process_tokens("text").alias("t"))
    return VO.stem_dictionary(d, "t", ignore_stopwords=True)


def _bench_vocab(spark, sf):
    """Distinct tokens of the prepared benchmark lines."""
    b = V.read(spark, sf, "benchmark")
    return b.select(F.explode_outer(TX.ws_tokens(TX.extraction_line("text"))).alias("word")).dropna().distinct()


_BENCH_VOCAB_SQL = (f"SELECT DISTINCT unnest({S.ws_tokens(S.extraction_line('text'))}) AS word FROM benchmark")


@register("vocabulary_filter", f"""
WITH docs AS (SELECT doc_id, {S.extraction_line('text')} AS line FROM documents),
vocab AS ({_BENCH_VOCAB_SQL}),
toks AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS pos
         FROM (SELECT doc_id, {S.ws_tokens('line')} AS t FROM docs)),
kept AS (SELECT doc_id, string_agg(w || ' ', '' ORDER BY pos) AS filtered
         FROM toks WHERE lower(w) IN (SELECT word FROM vocab) GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.filtered, '') AS filtered FROM docs d LEFT JOIN kept k USING (doc_id)""")
def vocabulary_filter(spark, sf):
    d = V.read(spark, sf, "documents").select("doc_id", TX.extraction_line("text").alias("line"))
    out = VO.vocabulary_filter(d, ["doc_id"], "line", _bench_vocab(spark, sf), stem=False, out_col="filtered")
    return out.select("doc_id", "filtered")


@register("vocabulary_filter_stem", f"""
WITH docs AS (SELECT doc_id, {S.extraction_line('text')} AS line FROM documents),
toks AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS pos
         FROM (SELECT doc_id, {S.ws_tokens('line')} AS t FROM docs)),
bwords AS ({_vocab_words_sql('text', 'benchmark')}),
words AS (SELECT word FROM bwords UNION SELECT lower(w) FROM toks), {stem_ctes('words')},
vocab AS ({_stem_vocab_sql('bwords')}),
kept AS (SELECT doc_id, string_agg(w || ' ', '' ORDER BY pos) AS filtered
         FROM toks JOIN st ON st.word = lower(w) WHERE stem IN (SELECT word FROM vocab) GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.filtered, '') AS filtered FROM docs d LEFT JOIN kept k USING (doc_id)""")
def vocabulary_filter_stem(spark, sf):
    """V1 with stems on both sides."""
    d = V.read(spark, sf, "documents").select("doc_id", TX.extraction_line("text").alias("line"))
    vocab = VO.vocabulary(V.read(spark, sf, "benchmark"), "text", stem=True)
    out = VO.vocabulary_filter(d, ["doc_id"], "line", vocab, stem=True, out_col="filtered")
    return out.select("doc_id", "filtered")


# ---------------------------------------------------------------------------
# TF-IDF retrieval
# ---------------------------------------------------------------------------

TOP_K = 5


def _corpus(spark, sf):
    """Documents cleaned with the P13 chain (no stemming); label = source."""
    return V.read(spark, sf, "documents").select("doc_id", TX.process_string("text").alias("clean"),
                                                  F.col("doc_id").alias("code"), F.col("source").alias("label"))


def _model(spark, sf):
    return RT.fit(_corpus(spark, sf), "doc_id", "clean")


def _tfidf_cte(corpus_sql: str) -> str:
    """Fit CTEs over ``corpus(doc_id, clean, label)``."""
    return f"""
corpus AS ({corpus_sql}),
post AS (SELECT doc_id, term, count(*) AS tf
         FROM (SELECT doc_id, unnest(regexp_extract_all(lower(clean), {S.q(K.TERM_PATTERN)})) AS term FROM corpus)
         GROUP BY doc_id, term),
ndocs AS (SELECT count(*) AS n FROM corpus),
idf AS (SELECT term, ln((1 + any_value(ndocs.n)) / (1 + count(*))) + 1 AS idf FROM post, ndocs GROUP BY term),
w0 AS (SELECT doc_id, term, tf * idf AS w0 FROM post JOIN idf USING (term)),
w AS (SELECT doc_id, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY doc_id)) AS weight FROM w0)"""


_TFIDF_CTE = _tfidf_cte(f"SELECT doc_id, {S.joined(S.process_tokens('text'))} AS clean, source AS label FROM documents")


def _query_weights_cte(qtable: str) -> str:
    return f"""
qpost AS (SELECT query_id, term, count(*) AS tf
          FROM (SELECT query_id, unnest(regexp_extract_all(lower(qclean), {S.q(K.TERM_PATTERN)})) AS term FROM {qtable})
          GROUP BY query_id, term),
qw0 AS (SELECT query_id, term, tf * idf AS w0 FROM qpost JOIN idf USING (term)),
qw AS (SELECT query_id, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY query_id)) AS weight FROM qw0),
scores AS (SELECT query_id, doc_id, sum(qw.weight * w.weight) AS score FROM qw JOIN w USING (term) GROUP BY 1, 2),
allpairs AS (SELECT qs.query_id, d.doc_id, coalesce(s.score, 0.0) AS score
             FROM (SELECT DISTINCT query_id FROM {qtable}) qs CROSS JOIN (SELECT doc_id FROM corpus) d
             LEFT JOIN scores s ON s.query_id = qs.query_id AND s.doc_id = d.doc_id),
ranked AS (SELECT query_id, doc_id, score,
                  row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id DESC) AS rank
           FROM allpairs),
topk AS (SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= {TOP_K})"""


@register("tfidf_weights", f"WITH {_TFIDF_CTE} SELECT doc_id, term, round(weight, 6) AS weight FROM w")
def tfidf_weights(spark, sf):
    m = _model(spark, sf)
    return m.weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


_BENCH_Q = f"SELECT item_id AS query_id, text, {S.joined(S.process_tokens('text', distinct=True))} AS qclean FROM benchmark"


def _bench_queries(spark, sf):
    return V.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text",
                                                 TX.process_string_distinct("text").alias("qclean"))


@register("tfidf_query_weights",
          f"WITH {_TFIDF_CTE}, bq AS ({_BENCH_Q}), {_query_weights_cte('bq')} "
          f"SELECT query_id, term, round(weight, 6) AS weight FROM qw")
def tfidf_query_weights(spark, sf):
    qw = RT.transform(_model(spark, sf), _bench_queries(spark, sf), "query_id", "qclean")
    return qw.select("query_id", "term", F.round("weight", 6).alias("weight"))


@register("topk_similar", f"WITH {_TFIDF_CTE}, bq AS ({_BENCH_Q}), {_query_weights_cte('bq')} SELECT * FROM topk")
def topk_similar(spark, sf):
    m = _model(spark, sf)
    q = _bench_queries(spark, sf)
    qw = RT.transform(m, q, "query_id", "qclean")
    return RT.top_k(m, RT.score(m, qw), q.select("query_id"), TOP_K)


@register("topk_pruned", f"WITH {_TFIDF_CTE}, bq AS ({_BENCH_Q}), {_query_weights_cte('bq')} SELECT * FROM topk")
def topk_pruned(spark, sf):
    """The rows of ``topk_similar`` from the pairs that can still reach the k-th score."""
    m = _model(spark, sf)
    q = _bench_queries(spark, sf)
    qw = RT.transform(m, q, "query_id", "qclean")
    return RT.top_k(m, PR.candidates(m, qw, TOP_K), q.select("query_id"), TOP_K)


@register("topk_stored_model", f"WITH {_TFIDF_CTE}, bq AS ({_BENCH_Q}), {_query_weights_cte('bq')} SELECT * FROM topk")
def topk_stored_model(spark, sf):
    """A model stored for the even ids, the other documents added to it, opened and queried."""
    import uuid

    from claimtext.session import ensure_checkpoint_dir
    from claimtext.sources import bundle as BU
    root, c = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}", _corpus(spark, sf)
    labels = c.select("doc_id", F.col("code").cast("string").alias("code"), "label")
    first = RT.save_model(c.where(F.col("doc_id") % 2 == 0), root, "doc_id", "clean", labels=labels)
    second = RT.save_model(c, root, "doc_id", "clean", labels=labels, before=BU.load_bundle(spark, root, first))
    m = RT.open_model(BU.load_bundle(spark, root, second, verify=True))
    q = _bench_queries(spark, sf)
    return RT.top_k(m, RT.score(m, RT.transform(m, q, "query_id", "qclean")), q.select("query_id"), TOP_K)


def _labels_sql(qtable_cte: str, diag: str, tfidf_cte: str = _TFIDF_CTE) -> str:
    return f"""WITH {tfidf_cte}, {qtable_cte}, {_query_weights_cte('bq')},
lab AS (SELECT t.query_id, string_agg(c.doc_id::VARCHAR || ' - ' || c.label, ' | ' ORDER BY t.rank) AS codes
        FROM topk t JOIN corpus c USING (doc_id) GROUP BY t.query_id)
SELECT bq.query_id, {diag} AS Diagnostic, coalesce(lab.codes, '') AS CIM10s
FROM bq LEFT JOIN lab USING (query_id)"""


def _vocab_filter_sql(table: str, id_col: str, text_expr: str, tokens_fn) -> str:
    return f"""
src AS (SELECT {id_col} AS query_id, {text_expr} AS raw FROM {table}),
vocab AS ({_vocab_sql('text', 'documents')}),
vtoks AS (SELECT query_id, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM (SELECT query_id, {tokens_fn('raw')} AS t FROM src)),
vkept AS (SELECT query_id, string_agg(w || ' ', '' ORDER BY pos) AS kept
          FROM vtoks WHERE lower(w) IN (SELECT word FROM vocab) GROUP BY query_id),
filtered AS (SELECT s.query_id, s.raw, coalesce(k.kept, '') AS kept FROM src s LEFT JOIN vkept k USING (query_id))"""


_TOPK_LABELS_SQL = _labels_sql(
    _vocab_filter_sql("benchmark", "item_id", "text", S.raw_tokens).lstrip()
    + f",\nbq AS (SELECT query_id, raw, {S.joined(S.process_tokens('kept', distinct=True))} AS qclean FROM filtered)",
    "bq.raw")


def _flat_codes(df):
    return df.select("query_id", "Diagnostic", F.array_join("CIM10s", " | ").alias("CIM10s"))


@register("topk_labels", _TOPK_LABELS_SQL)
def topk_labels(spark, sf):
    """R8 per benchmark item: vocabulary filter (raw tokens) -> P14 -> TF-IDF top k -> 'code - label'."""
    b = V.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    vocab = VO.vocabulary(V.read(spark, sf, "documents"), "text", stem=False)
    f = VO.vocabulary_filter(b, ["query_id"], "text", vocab, tokenizer="raw", stem=False, out_col="kept",
                             keep_original=True)
    c = _corpus(spark, sf)
    res = RT.retrieve(RT.fit(c, "doc_id", "clean"), f, c.select("doc_id", "code", "label"), TOP_K,
                      query_id="query_id", text_col="kept", diagnostic_col="text")
    return _flat_codes(res)


def _topk_labels_stem_sql() -> str:
    """Stems of the vocabulary and the raw query words (fs), then of the cleaned corpus and query tokens (st)."""
    head = f"""
vwords AS ({_vocab_words_sql('text', 'documents')}),
rtoks AS (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS pos
          FROM (SELECT item_id, {S.raw_tokens('text')} AS t FROM benchmark)),
fwords AS (SELECT word FROM vwords UNION SELECT lower(w) FROM rtoks), {stem_ctes('fwords', 'fs')},
vocab AS ({_stem_vocab_sql('vwords', 'fs')}),
rkept AS (SELECT item_id, string_agg(w || ' ', '' ORDER BY pos) AS kept
          FROM rtoks JOIN fs ON fs.word = lower(w) WHERE stem IN (SELECT word FROM vocab) GROUP BY item_id),
qtoks AS (SELECT item_id, unnest({_unstemmed_tokens('kept')}) AS word FROM rkept),
dtoks AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos
          FROM (SELECT doc_id, {_unstemmed_tokens('text')} AS t FROM documents)),
words AS (SELECT word FROM qtoks UNION SELECT word FROM dtoks), {stem_ctes('words')},
dstems AS (SELECT doc_id, pos, {_stem_or_stop()} AS word FROM dtoks JOIN st USING (word)),
dclean AS (SELECT doc_id, string_agg(word || ' ', '' ORDER BY pos) AS clean FROM dstems WHERE {_KEPT_WORD} GROUP BY doc_id),
qstems AS (SELECT DISTINCT item_id, {_stem_or_stop()} AS word FROM qtoks JOIN st USING (word)),
qclean AS (SELECT item_id, string_agg(word || ' ', '' ORDER BY word) AS clean FROM qstems WHERE {_KEPT_WORD} GROUP BY item_id),"""
    corpus = "SELECT d.doc_id, coalesce(c.clean, '') AS clean, d.source AS label FROM documents d LEFT JOIN dclean c USING (doc_id)"
    bq = ("bq AS (SELECT b.item_id AS query_id, b.text AS raw, coalesce(q.clean, '') AS qclean "
          "FROM benchmark b LEFT JOIN qclean q USING (item_id))")
    return _labels_sql(bq, "bq.raw", head + _tfidf_cte(corpus))


@register("topk_labels_stem", _topk_labels_stem_sql())
def topk_labels_stem(spark, sf):
    """R8 on the reference's default path: stemmed vocabulary filter, stemmed
    query cleaning, stemmed corpus."""
    b = V.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    vocab = VO.vocabulary(V.read(spark, sf, "documents"), "text", stem=True)
    f = VO.vocabulary_filter(b, ["query_id"], "text", vocab, tokenizer="raw", stem=True, out_col="kept",
                             keep_original=True)
    docs = V.read(spark, sf, "documents")
    c = VO.process_strings(docs.select("doc_id", F.col("text").alias("clean")), "doc_id", "clean", "clean")
    labels = docs.select("doc_id", F.col("doc_id").alias("code"), F.col("source").alias("label"))
    res = RT.retrieve(RT.fit(c, "doc_id", "clean", docs=docs.select("doc_id")), f, labels, TOP_K,
                      query_id="query_id", text_col="kept", diagnostic_col="text", stem=True)
    return _flat_codes(res)


def _tuple_queries(spark, sf):
    t = _extract(spark, sf)
    vocab = VO.vocabulary(V.read(spark, sf, "documents"), "text", stem=False)
    f = VO.vocabulary_filter(t, ["claim_id", "seq"], "phrase", vocab, stem=False)
    return f.select(F.concat_ws("-", "claim_id", "seq").alias("query_id"), F.col("phrase").alias("Diagnostic"),
                    RT.query_text_from_tuple("phrase", "member", "side").alias("qtext"))


def _retrieve_tuples_sql() -> str:
    ext = _extract_sql()
    src = (f"SELECT claim_id::VARCHAR || '-' || seq::VARCHAR AS query_id, phrase AS raw, member, side "
           f"FROM ({ext})")
    vf = _vocab_filter_sql(f"({src})", "query_id", "raw", S.ws_tokens).replace(
        "src AS (SELECT query_id AS query_id, raw AS raw FROM", "src AS (SELECT query_id, raw, member, side FROM", 1)
    vf = vf.replace("filtered AS (SELECT s.query_id, s.raw, coalesce(k.kept, '') AS kept",
                    "filtered AS (SELECT s.query_id, s.member, s.side, coalesce(k.kept, '') AS kept", 1)
    qt = ("concat_ws('', CASE WHEN kept <> 'inconnu' THEN kept || ' ' END, "
          "CASE WHEN member <> 'inconnu' THEN member || ' ' END, CASE WHEN side <> 'inconnu' THEN side || ' ' END)")
    bq = (f",\nbq AS (SELECT query_id, kept AS raw, "
          f"{S.joined(S.process_tokens(qt, distinct=True))} AS qclean FROM filtered)")
    return _labels_sql(vf.lstrip() + bq, "bq.raw")


@register("retrieve_from_tuples", _retrieve_tuples_sql())
def retrieve_from_tuples(spark, sf):
    """Extracted tuples -> vocabulary filter -> query text -> TF-IDF top k."""
    q = _tuple_queries(spark, sf)
    c = _corpus(spark, sf)
    res = RT.retrieve(RT.fit(c, "doc_id", "clean"), q, c.select("doc_id", "code", "label"), TOP_K,
                      query_id="query_id", text_col="qtext", diagnostic_col="Diagnostic")
    return _flat_codes(res)


# ---------------------------------------------------------------------------
# Code hierarchy
# ---------------------------------------------------------------------------

from claimtext.operators import hierarchy as HI  # noqa: E402
from claimtext.sources import html as HT  # noqa: E402

# FIXED VALUES: chapter number and name written on every hierarchy row.
CHAPTER_NUM = "19"
CHAPTER_NAME = "Lésions traumatiques, empoisonnements et certaines autres conséquences de causes externes"

# FIXED VALUES: event type -> listing line class for the derived listing view.
EVENT_LEVELS = {"signup": 1, "error": 1, "purchase": 2, "view": 2, "click": 3}


def _listing(spark, sf, levels=None):
    """Every event as one line of a per-user listing ordered by event_id.

    Category events become range lines ``E<user>-E<event> <type>``, level-2
    events 3-character lines ``S<2 digits> <type> <event>``, level-3 events
    4-character lines ``S<3 digits> <type>``; other types stay unmatched.
    """
    levels = levels or EVENT_LEVELS
    e = V.read(spark, sf, "events")
    eid = F.col("event_id").cast("string")
    lvl = F.col("event_type")
    cat = [k for k, v in levels.items() if v == 1]
    sub = [k for k, v in levels.items() if v == 2]
    sub2 = [k for k, v in levels.items() if v == 3]
    line = (F.when(lvl.isin(cat), F.concat(F.lit("E"), F.col("user_id").cast("string"), F.lit("-E"), eid,
                                           F.lit(" "), lvl))
            .when(lvl.isin(sub), F.concat(F.lit("S"), F.lpad(F.right(eid, F.lit(2)), 2, "0"), F.lit(" "), lvl,
                                          F.lit(" "), eid))
            .when(lvl.isin(sub2), F.concat(F.lit("S"), F.lpad(F.right(eid, F.lit(3)), 3, "0"), F.lit(" "), lvl))
            .otherwise(F.concat(F.lit("unmatched "), lvl)))
    return e.select(F.col("user_id").alias("chapter"), F.col("event_id").alias("line_no"), line.alias("line"))


def _listing_sql(levels=None) -> str:
    levels = levels or EVENT_LEVELS

    def ins(level):
        return ", ".join(S.q(k) for k, v in levels.items() if v == level) or "NULL"
    return f"""SELECT user_id AS chapter, event_id AS line_no,
  CASE WHEN event_type IN ({ins(1)}) THEN 'E' || user_id::VARCHAR || '-E' || event_id::VARCHAR || ' ' || event_type
       WHEN event_type IN ({ins(2)}) THEN 'S' || lpad(right(event_id::VARCHAR, 2), 2, '0') || ' ' || event_type || ' ' || event_id::VARCHAR
       WHEN event_type IN ({ins(3)}) THEN 'S' || lpad(right(event_id::VARCHAR, 3), 3, '0') || ' ' || event_type
       ELSE 'unmatched ' || event_type END AS line
FROM events"""


def _levels_sql(levels=None) -> str:
    pat = S.q(K.HIERARCHY_LINE_PATTERN)
    return f"""
WITH l AS ({_listing_sql(levels)}),
c AS (SELECT chapter, line_no, regexp_extract(line, {pat}, 1) AS cat, regexp_extract(line, {pat}, 2) AS sub,
             regexp_extract(line, {pat}, 3) AS subsub FROM l),
m AS (SELECT * FROM c WHERE cat <> '' OR sub <> '' OR subsub <> ''),
f AS (SELECT *,
        last_value(CASE WHEN cat <> '' THEN cat END IGNORE NULLS) OVER w AS cat_f,
        last_value(CASE WHEN cat = '' AND sub <> '' THEN sub END IGNORE NULLS) OVER w AS sub_f,
        lead(cat = '' AND sub = '' AND subsub <> '') OVER (PARTITION BY chapter ORDER BY line_no) AS next_is_4
      FROM m WINDOW w AS (PARTITION BY chapter ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT chapter, line_no, coalesce(cat_f, '') AS Categorie,
       CASE WHEN sub <> '' THEN sub ELSE coalesce(sub_f, '') END AS Sous_Categorie,
       CASE WHEN sub <> '' THEN '' ELSE subsub END AS Sous_Sous_Categorie
FROM f
WHERE cat = '' AND ((sub = '' AND subsub <> '') OR (sub <> '' AND next_is_4 = false))"""


@register("hierarchy_levels", _levels_sql())
def hierarchy_levels(spark, sf):
    nodes, _rejects = HI.hierarchy_nodes(_listing(spark, sf), "chapter", "line_no", "line")
    return nodes


@register("hierarchy_levels_chunked", _levels_sql())
def hierarchy_levels_chunked(spark, sf):
    """H2 with small scan chunks, so that carries cross chunk boundaries."""
    nodes, _rejects = HI.hierarchy_nodes(_listing(spark, sf), "chapter", "line_no", "line", chunk=97)
    return nodes


# FIXED VALUES: listing variant in which error events are lines of no class.
EVENT_LEVELS_WITH_REJECTS = {"signup": 1, "purchase": 2, "view": 2, "click": 3}


@register("hierarchy_rejects", f"""
SELECT chapter, line_no, line FROM ({_listing_sql(EVENT_LEVELS_WITH_REJECTS)})
WHERE regexp_extract(line, {S.q(K.HIERARCHY_LINE_PATTERN)}, 0) = ''""")
def hierarchy_rejects(spark, sf):
    """Lines of no class are diverted (the reference would fail on them)."""
    _nodes, rejects = HI.hierarchy_nodes(_listing(spark, sf, EVENT_LEVELS_WITH_REJECTS), "chapter", "line_no", "line")
    return rejects


@register("hierarchy_levels_with_rejects", _levels_sql(EVENT_LEVELS_WITH_REJECTS))
def hierarchy_levels_with_rejects(spark, sf):
    """H2 when some lines match no class: they are left out of the lookahead."""
    nodes, _rejects = HI.hierarchy_nodes(_listing(spark, sf, EVENT_LEVELS_WITH_REJECTS), "chapter", "line_no", "line",
                                         chunk=211)
    return nodes


def _part_nodes(spark, sf):
    """Distinct first words of part names as sub-category nodes."""
    p = V.read(spark, sf, "part")
    return (p.select(F.substring_index("p_name", " ", 1).alias("node")).distinct()
             .select("node", F.lit("parts").alias("Categorie"), F.col("node").alias("Sous_Categorie"),
                     F.lit("").alias("Sous_Sous_Categorie")))


_CODES_SQL = f"""
WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS node FROM part),
c AS (SELECT p_name AS diagnostic_num, p_brand AS diagnostic FROM part)
SELECT n.node, {S.q(CHAPTER_NUM)} AS Chapitre_num, {S.q(CHAPTER_NAME)} AS Chapitre_nom, 'parts' AS Categorie,
       '' AS Sous_Categorie, n.node AS Sous_Sous_Categorie, '' AS Sous_Sous_Sous_Categorie,
       c.diagnostic_num, c.diagnostic
FROM n JOIN c ON contains(c.diagnostic_num, n.node)"""


def _codes(spark, sf):
    p = V.read(spark, sf, "part").select(F.col("p_name").alias("diagnostic_num"), F.col("p_brand").alias("diagnostic"))
    return HI.attach_codes(_part_nodes(spark, sf), p, CHAPTER_NUM, CHAPTER_NAME)


@register("hierarchy_codes", _CODES_SQL)
def hierarchy_codes(spark, sf):
    return _codes(spark, sf)


def _event_codes(spark, sf):
    """Code table from events: 'S' + the last four digits of the event id, labelled by event type."""
    e = V.read(spark, sf, "events")
    code = F.concat(F.lit("S"), F.lpad(F.right(F.col("event_id").cast("string"), F.lit(4)), 4, "0"))
    return e.groupBy(code.alias("diagnostic_num")).agg(F.min("event_type").alias("diagnostic"))


@register("hierarchy_full", f"""
WITH nodes AS ({_levels_sql()}),
codes AS (SELECT 'S' || lpad(right(event_id::VARCHAR, 4), 4, '0') AS diagnostic_num, min(event_type) AS diagnostic
          FROM events GROUP BY 1)
SELECT n.chapter, n.line_no, {S.q(CHAPTER_NUM)} AS Chapitre_num, {S.q(CHAPTER_NAME)} AS Chapitre_nom,
       n.Categorie, '' AS Sous_Categorie, n.Sous_Categorie AS Sous_Sous_Categorie,
       n.Sous_Sous_Categorie AS Sous_Sous_Sous_Categorie, c.diagnostic_num, c.diagnostic
FROM nodes n JOIN codes c
  ON contains(c.diagnostic_num, split_part(CASE WHEN n.Sous_Sous_Categorie <> '' THEN n.Sous_Sous_Categorie
                                                ELSE n.Sous_Categorie END, ' ', 1))""")
def hierarchy_full(spark, sf):
    """H1-H5 end to end: ordered listing -> nodes -> every code containing the node code."""
    nodes, _rejects = HI.hierarchy_nodes(_listing(spark, sf), "chapter", "line_no", "line")
    return HI.attach_codes(nodes, _event_codes(spark, sf), CHAPTER_NUM, CHAPTER_NAME,
                           code_lengths=HI.LISTING_CODE_LENGTHS, few_codes=True)


def _doc_sql(alias: str) -> str:
    cols = [f"coalesce({c}::VARCHAR, 'nan')" for c in HI.DOC_COLUMNS]
    return f"concat_ws(' ', {', '.join(cols)}) AS {alias}"


@register("concat_columns", f"""
SELECT node, diagnostic_num, doc, {S.joined(S.process_tokens('doc'))} AS processed,
       array_to_string(list_sort({S.process_tokens(S.joined(S.process_tokens('doc')), distinct=True)}), ' ')
         AS processed_distinct
FROM (SELECT node, diagnostic_num, {_doc_sql('doc')} FROM ({_CODES_SQL}))""")
def concat_columns(spark, sf):
    """Hierarchy rows as retrieval documents (P13, and P13 then P14).

    The P14 tokens are a set (their order is arbitrary); they are compared sorted.
    """
    h = _codes(spark, sf)
    return h.select("node", "diagnostic_num", HI.hierarchy_document().alias("doc"),
                    HI.hierarchy_corpus(h).alias("processed"),
                    F.array_join(F.array_sort(TX.process_tokens(HI.hierarchy_corpus(h), distinct=True)), " ")
                    .alias("processed_distinct"))


# ---------------------------------------------------------------------------
# Web pages
# ---------------------------------------------------------------------------

# FIXED VALUES: character references that occur in the pages, for the oracle ("&amp;" last).
_REFERENCES = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def _references_sql(txt: str) -> str:
    for ref, ch in _REFERENCES:
        txt = f"replace({txt}, {S.q(ref)}, {S.q(ch)})"
    return txt


def _html_sql(cls: str) -> str:
    pat = S.q(f'(?s)<div[^>]*\\sclass\\s*=\\s*"(?:[^"]*\\s)?{cls}(?:\\s[^"]*)?"[^>]*>(.*?)</div>')
    txt = _references_sql(f"regexp_replace(regexp_extract(html, {pat}, 1), '<[^>]*>', '', 'g')")
    return (f"SELECT page_id, url, CASE WHEN regexp_matches(html, {pat}) THEN {txt} || ' ' END AS container_text "
            f"FROM pages")


@register("html_container_text", _html_sql("ad"))
def html_container_text(spark, sf):
    p = V.read(spark, sf, "pages")
    return p.select("page_id", "url", HT.container_text("html", "ad").alias("container_text"))


_OUTER_SQL = ("SELECT page_id, url, " + _references_sql("regexp_replace(html, '<[^>]*>', '', 'g')")
              + " || ' ' AS container_text FROM pages")


@register("html_container_text_nested", _OUTER_SQL)
def html_container_text_nested(spark, sf):
    """S7 on containers that really nest: each whole page inside an outer container, its own div inside."""
    p = V.read(spark, sf, "pages")
    outer = F.concat(F.lit("<body><div id='o' class='main outer'>"), "html", F.lit("</div>tail</body>"))
    return p.select("page_id", "url", HT.container_text(outer, "outer").alias("container_text"))


# --- repeated queries: the shape of real claim diagnoses ------------------------------

def _part_doc_sql() -> str:
    return "concat_ws(' ', p_name, p_type, p_brand)"


_PART_TFIDF = _tfidf_cte(f"SELECT p_partkey AS doc_id, {S.joined(S.process_tokens(_part_doc_sql()))} AS clean, "
                         f"p_brand AS label FROM part")


@register("retrieve_repeated_queries", _labels_sql(
    f"bq AS (SELECT p_partkey AS query_id, p_name AS raw, {S.joined(S.process_tokens('p_name', distinct=True))} "
    f"AS qclean FROM part)", "bq.raw", _PART_TFIDF))
def retrieve_repeated_queries(spark, sf):
    """R5-R8 where queries repeat (part names: few distinct values), against a
    corpus of part rows as hierarchy-like documents (name, type, brand)."""
    p = V.read(spark, sf, "part")
    corpus = p.select(F.col("p_partkey").alias("doc_id"),
                      TX.process_string(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("clean"),
                      F.col("p_partkey").alias("code"), F.col("p_brand").alias("label"))
    q = p.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"))
    res = RT.retrieve(RT.fit(corpus, "doc_id", "clean"), q, corpus.select("doc_id", "code", "label"), TOP_K,
                      text_col="text", diagnostic_col="text")
    return _flat_codes(res)


# ---------------------------------------------------------------------------
# Through files and back
# ---------------------------------------------------------------------------

from claimtext import jobs as J  # noqa: E402
from claimtext.sources import bundle as BN  # noqa: E402
from claimtext.sources import tables as TB  # noqa: E402
from claimtext.sources import text_files as TF  # noqa: E402


def _new_folder(spark, name: str) -> str:
    import uuid

    from claimtext.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("appended_lines", r"""
SELECT line, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line FROM documents)
WHERE trim(line) <> '' GROUP BY line""")
def appended_lines(spark, sf):
    """The texts of each language appended by a named run, one of them twice; the lines read back and counted."""
    root, d = _new_folder(spark, "lines"), V.read(spark, sf, "documents")
    french = F.coalesce(F.col("lang") == "fr", F.lit(False))
    for run, part in (("fr", d.where(french)), ("other", d.where(~french)), ("fr", d.where(french))):
        TF.append_text(part, root, "text", run=run)
    return TF.read_lines(spark, root).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


LISTING_FILES = 16


@register("ordered_lines", f"""
SELECT chapter % {LISTING_FILES} AS file_no, line,
       row_number() OVER (PARTITION BY chapter % {LISTING_FILES} ORDER BY chapter, line_no) - 1 AS line_no
FROM ({_listing_sql()})""")
def ordered_lines(spark, sf):
    """S1 in order: the listings written to files, read back in splits, each line with its number in its file."""
    root, rows = _new_folder(spark, "listing"), _listing(spark, sf).withColumn("file_no", F.col("chapter") % LISTING_FILES)
    (rows.repartition("file_no").sortWithinPartitions("file_no", "chapter", "line_no").select("file_no", "line")
     .write.partitionBy("file_no").text(root))
    got = TF.read_lines(spark, f"{root}/*", ordered=True)
    return got.select(F.regexp_extract("file", r"file_no=(\d+)/", 1).cast("long").alias("file_no"), "line", "line_no")


@register("hierarchy_csv", "SELECT {} FROM ({})".format(
    ", ".join(f"nullif({c}::VARCHAR, '') AS {c}" for c in K.HIERARCHY_COLUMNS), _CODES_SQL))
def hierarchy_csv(spark, sf):
    """The hierarchy written as CSV with a header and read back under its schema; an empty cell is missing, as P16 takes it."""
    path = _new_folder(spark, "hierarchy")
    TB.write_csv(_codes(spark, sf).select(*K.HIERARCHY_COLUMNS), path)
    return J.read_hierarchy(spark, path, "csv")


@register("detection_bundle", f"""
SELECT t.*, (SELECT count(*) FROM ({_MEMBER_COUNTS_SQL}) c WHERE c.member = t.member) AS n_columns,
       (SELECT count(*) FROM ({_MEMBER_LIST_SQL}) m WHERE m.member = t.member) AS n_members
FROM ({_extract_sql()}) t""")
def detection_bundle(spark, sf):
    """Members, columns and sides saved with the tuples as a bundle, checked at load, and met with the tuples."""
    root = _new_folder(spark, "bundle")
    tables = J.detection_variables(spark, V.claims(spark, sf).columns[2:])
    BN.save_bundle({**tables, "tuples": _extract(spark, sf)}, root)
    got = BN.load_bundle(spark, root, verify=True)
    columns = got["columns"].groupBy("member").agg(F.count(F.lit(1)).alias("n_columns"))
    members = got["members"].groupBy("member").agg(F.count(F.lit(1)).alias("n_members"))
    return got["tuples"].join(columns, "member", "left").join(members, "member", "left").na.fill(0, ["n_columns", "n_members"])


_BOUND_WORDS_SQL = r"SELECT DISTINCT '\b' || unnest(string_split(p_name, ' ')) || '\b' AS pattern FROM part"


@register("boundary_words", rf"""
SELECT pattern, replace(pattern, '\b', '') AS word FROM ({_BOUND_WORDS_SQL})""")
def boundary_words(spark, sf):
    """M5: the words of part names written as patterns between word boundaries, and the words without these."""
    words = V.read(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    patterns = words.select(F.concat(F.lit("\\b"), "w", F.lit("\\b")).alias("pattern"))
    return patterns.select("pattern", TX.remove_boundary_tags("pattern").alias("word"))
