"""The published French stemming rules as SQL, for the DuckDB oracle.

The steps are a chain of common table expressions over a table of distinct
words.  Regions are prefix lengths found by regular expressions; a suffix is
the leftmost match of an alternation at the end of the word (or of its RV
region), hence the longest; every step is one CASE.  No code is shared
with the Python stemmer.
"""

from __future__ import annotations

# FIXED VALUES: vowels and suffixes of the published description; capitals are marked as no vowels.
V = "aeiouyâàëéêèïîôûù"
STEP_1 = ("issements|issement|ements|ement|amment|emment|ments|ment|atrices|atrice|ateurs|ateur|ations|ation|logies|"
          "logie|usions|usion|utions|ution|ances|ance|iqUes|iqUe|ismes|isme|ables|able|istes|iste|eux|ences|ence|ités|"
          "ité|ifs|if|ives|ive|eaux|aux|euses|euse")
STEP_2A = ("îmes|ît|îtes|i|ie|ies|ir|ira|irai|iraIent|irais|irait|iras|irent|irez|iriez|irions|irons|iront|is|issaIent|"
           "issais|issait|issant|issante|issantes|issants|isse|issent|isses|issez|issiez|issions|issons|it")
STEP_2B_PLAIN = "é|ée|ées|és|èrent|er|era|erai|eraIent|erais|erait|eras|erez|eriez|erions|erons|eront|ez|iez"
STEP_2B_E = "âmes|ât|âtes|a|ai|aIent|ais|ait|ant|ante|antes|ants|as|asse|assent|asses|assiez|assions"
STEP_4 = "ion|ier|ière|Ier|Ière|e|ë"


def stem_ctes(src: str, p: str = "st") -> str:
    """CTEs over the table ``src(word)`` that end in ``{p}(word, stem)``."""
    def vowel(x: str) -> str:
        return f"({x} <> '' AND contains('{V}', {x}))"

    mark = (f"CASE WHEN x[1] = 'u' AND right(acc, 1) = 'q' THEN 'U' "
            f"WHEN x[1] IN ('u', 'i') AND {vowel('right(acc, 1)')} AND {vowel('x[2]')} THEN upper(x[1]) "
            f"WHEN x[1] = 'y' AND ({vowel('right(acc, 1)')} OR {vowel('x[2]')}) THEN 'Y' ELSE x[1] END")
    after = f"'^[^{V}]*[{V}]+[^{V}]'"
    return f"""
{p}_mark AS MATERIALIZED (
  SELECT word, list_reduce(list_concat([''], list_transform(range(1, length(word) + 1), lambda i: substr(lower(word), i, 2))),
                           lambda acc, x: acc || {mark}) AS w
  FROM (SELECT DISTINCT word FROM {src} WHERE word IS NOT NULL)),
{p}_one AS (SELECT word, w, length(w) AS n, length(regexp_extract(w, {after})) AS to_r1,
            length(regexp_extract(w, '^.[^{V}]*[{V}]')) AS to_rv FROM {p}_mark),
{p}_two AS (SELECT word, w, n, CASE WHEN to_r1 = 0 THEN n ELSE to_r1 END AS r1,
            CASE WHEN left(w, 3) IN ('par', 'col', 'tap') OR regexp_matches(w, '^[{V}][{V}]') THEN least(3, n)
                 WHEN to_rv = 0 THEN n ELSE to_rv END AS rv FROM {p}_one),
{p}_reg AS (SELECT *, r1 + CASE WHEN regexp_extract(substr(w, r1 + 1), {after}) = '' THEN n - r1
                               ELSE length(regexp_extract(substr(w, r1 + 1), {after})) END AS r2 FROM {p}_two),
{p}_suf AS (SELECT *, regexp_extract(w, '({STEP_1})$') AS s FROM {p}_reg),
{p}_cut AS (SELECT *, left(w, n - length(s)) AS b, n - length(s) AS k FROM {p}_suf),
{p}_s1 AS MATERIALIZED (SELECT word, w, rv, r1, r2, s IN ('amment', 'emment', 'ment', 'ments') AS ment, CASE
  WHEN s = '' THEN w
  WHEN regexp_matches(s, '^(ance|iqUe|isme|able|iste)s?$') OR s = 'eux' THEN CASE WHEN k >= r2 THEN b ELSE w END
  WHEN regexp_matches(s, '^(atrice|ateur|ation)s?$') THEN CASE WHEN k < r2 THEN w WHEN NOT ends_with(b, 'ic') THEN b
       WHEN k - 2 >= r2 THEN left(b, k - 2) ELSE left(b, k - 2) || 'iqU' END
  WHEN s IN ('logie', 'logies') THEN CASE WHEN k >= r2 THEN b || 'log' ELSE w END
  WHEN regexp_matches(s, '^u[st]ions?$') OR regexp_matches(s, '^utions?$') THEN CASE WHEN k >= r2 THEN b || 'u' ELSE w END
  WHEN s IN ('ence', 'ences') THEN CASE WHEN k >= r2 THEN b || 'ent' ELSE w END
  WHEN s IN ('ement', 'ements') THEN CASE WHEN k < rv THEN w
       WHEN ends_with(b, 'ativ') AND k - 4 >= r2 THEN left(b, k - 4)
       WHEN ends_with(b, 'iv') THEN CASE WHEN k - 2 >= r2 THEN left(b, k - 2) ELSE b END
       WHEN ends_with(b, 'eus') THEN CASE WHEN k - 3 >= r2 THEN left(b, k - 3)
                                          WHEN k - 3 >= r1 THEN left(b, k - 3) || 'eux' ELSE b END
       WHEN ends_with(b, 'abl') OR ends_with(b, 'iqU') THEN CASE WHEN k - 3 >= r2 THEN left(b, k - 3) ELSE b END
       WHEN ends_with(b, 'ièr') OR ends_with(b, 'Ièr') THEN CASE WHEN k - 3 >= rv THEN left(b, k - 3) || 'i' ELSE b END
       ELSE b END
  WHEN s IN ('ité', 'ités') THEN CASE WHEN k < r2 THEN w
       WHEN ends_with(b, 'abil') THEN left(b, k - 4) || CASE WHEN k - 4 >= r2 THEN '' ELSE 'abl' END
       WHEN ends_with(b, 'ic') THEN left(b, k - 2) || CASE WHEN k - 2 >= r2 THEN '' ELSE 'iqU' END
       WHEN ends_with(b, 'iv') AND k - 2 >= r2 THEN left(b, k - 2) ELSE b END
  WHEN s IN ('if', 'ive', 'ifs', 'ives') THEN CASE WHEN k < r2 THEN w
       WHEN ends_with(b, 'at') AND k - 2 >= r2 THEN
         CASE WHEN ends_with(b, 'icat') THEN left(b, k - 4) || CASE WHEN k - 4 >= r2 THEN '' ELSE 'iqU' END
              ELSE left(b, k - 2) END
       ELSE b END
  WHEN s = 'eaux' THEN b || 'eau'
  WHEN s = 'aux' THEN CASE WHEN k >= r1 THEN b || 'al' ELSE w END
  WHEN s IN ('euse', 'euses') THEN CASE WHEN k >= r2 THEN b WHEN k >= r1 THEN b || 'eux' ELSE w END
  WHEN s IN ('issement', 'issements') THEN CASE WHEN k >= r1 AND regexp_matches(b, '[^{V}]$') THEN b ELSE w END
  WHEN s = 'amment' THEN CASE WHEN k >= rv THEN b || 'ant' ELSE w END
  WHEN s = 'emment' THEN CASE WHEN k >= rv THEN b || 'ent' ELSE w END
  ELSE CASE WHEN regexp_matches(substr(b, rv + 1), '[{V}]$') THEN b ELSE w END END AS x
  FROM {p}_cut),
{p}_in AS (SELECT word, rv, r1, r2, x, x <> w AND NOT ment AS changed, substr(x, rv + 1) AS v FROM {p}_s1),
{p}_a AS (SELECT *, CASE WHEN changed THEN '' ELSE regexp_extract(v, '({STEP_2A})$') END AS sa FROM {p}_in),
{p}_b AS (SELECT *, sa <> '' AND regexp_matches(left(v, length(v) - length(sa)), '[^{V}]$') AS did_a FROM {p}_a),
{p}_c AS (SELECT *, CASE WHEN changed OR did_a THEN '' ELSE regexp_extract(v, '({STEP_2B_PLAIN}|{STEP_2B_E}|ions)$') END AS sb
          FROM {p}_b),
{p}_s2 AS MATERIALIZED (SELECT word, rv, r2, changed, x, CASE
  WHEN did_a THEN left(x, length(x) - length(sa))
  WHEN sb = '' OR (sb = 'ions' AND length(x) - 4 < r2) THEN x
  WHEN regexp_matches(sb, '^({STEP_2B_E})$') AND ends_with(left(v, length(v) - length(sb)), 'e')
       THEN left(x, length(x) - length(sb) - 1)
  ELSE left(x, length(x) - length(sb)) END AS y FROM {p}_c),
{p}_s4 AS (SELECT word, rv, r2, changed OR x <> y AS altered, y, regexp_replace(y, '([^aiouès])s$', '\\1') AS z FROM {p}_s2),
{p}_t4 AS (SELECT *, regexp_extract(substr(z, rv + 1), '({STEP_4})$') AS s FROM {p}_s4),
{p}_s5 AS (SELECT word, CASE
  WHEN altered THEN regexp_replace(regexp_replace(y, 'Y$', 'i'), 'ç$', 'c')
  WHEN s = 'ion' THEN CASE WHEN length(z) - 3 >= r2 AND regexp_matches(substr(z, rv + 1), '[st]ion$')
                           THEN left(z, length(z) - 3) ELSE z END
  WHEN s IN ('ier', 'ière', 'Ier', 'Ière') THEN left(z, length(z) - length(s)) || 'i'
  WHEN s = 'e' OR (s = 'ë' AND ends_with(z, 'guë')) THEN left(z, length(z) - 1)
  ELSE z END AS u FROM {p}_t4),
{p}_s6 AS (SELECT word, regexp_replace(u, '(en|on|et|el|eil)([ntl])$', CASE WHEN regexp_matches(u, '(enn|onn|ett|ell|eill)$')
           THEN '\\1' ELSE '\\0' END) AS u FROM {p}_s5),
{p} AS MATERIALIZED (SELECT word, translate(regexp_replace(u, '[éè]([^{V}]+)$', 'e\\1'), 'IUY', 'iuy') AS stem FROM {p}_s6)"""
