"""Quality rules: a table of thresholds compiled into DataFrame expressions.

Words are runs without ASCII white space; a null text has none.  Measures of
a whole text: ``n_words``, ``word_chars`` (code points in words),
``n_symbols`` (characters of ``#*$%&|<>``), ``n_lines`` (\\n-split lines with a
word), ``n_dup_lines`` (those equal to an earlier one), ``n_repeat_words``
(words in 3-word windows found twice or more, the first included; windows are
told apart by 64-bit hashes inside their text), ``n_letters`` (characters
that are no ASCII white space, digit or punctuation), ``n_ascii_letters``,
``n_stop`` (words of the stop list, by lower case).

``base_failed``: fewer than 50 words, or more than half of them in repeated
windows.  ``kept``: not base_failed, and every rule of ``RULES`` holds.  Rules
compare a ratio of two measures with a lowest and a highest value; they are
one projection of built-in functions.  The limits are wide: they refuse symbol
runs, menus, shouted lines and repeated lines, and pass prose.  Stop words are
listed for some languages in Latin letters, so their rule is only meant for
texts with at least half of their letters in ASCII, and prose in other
languages is spared: texts with at least two different function words of one
further language (``OTHER_WORDS``), as many as the rule asks for; and, for languages
without a list, texts in sentences (two words end in ``.``, ``!`` or ``?``)
with three short words that each come twice or more and make a tenth of the
words together.  The measures do not tell this, only ``kept`` does.

Defined results: a null, empty or blank text has zero measures, fails the base
and is not kept.  Rows are judged alone, so ties, copies and repeated rows get
equal verdicts.  An empty table gives no rows.  Result columns replace input
columns of the same name; other columns pass through.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimtext.llm.common import NOT_SPACE, SPACE, SPACE_CHARS, computed, fresh, quoted, without

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters",
            "n_ascii_letters", "n_stop"]
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
SYMBOLS = "#*$%&|<>"
ASCII_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_OTHER = SPACE_CHARS + "0123456789" + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# FIXED VALUES: (measure, per, lowest, highest, only): lowest * per <= measure <= highest * per, None is no
# limit; ``only`` (measure, per, lowest) says for which texts the rule is meant.
RULES = [
    ("word_chars", "n_words", 1.5, 40.0, None),
    ("n_symbols", "n_words", None, 0.3, None),
    ("n_letters", "word_chars", 0.7, None, None),
    ("n_dup_lines", "n_lines", None, 0.5, None),
    ("n_stop", "n_words", 0.03, None, ("n_ascii_letters", "n_letters", 0.5)),
]

# FIXED VALUES: frequent function words of some languages in Latin letters.
STOP_WORDS = ("the of and to in is that for it as was with be by on not he his but at are this have from or had an "
              "they which you were all we her she there been one their has would le la les de des du et un une en que "
              "qui est dans pour pas sur au par il elle ne se ce plus ou mais avec der die das und den von zu mit sich "
              "auf ist ein eine dem nicht als auch es an werden aus er hat dass sie nach wird bei el los las y del se "
              "lo su con una al para como más o pero sus si no ha è di che per non sono della do os ao uma não com "
              "het een van voor dat niet zijn").split()

# FIXED VALUES: frequent function words of further languages in Latin letters; they spare a text from the stop-word rule.
OTHER_WORDS = {k: v.split() for k, v in {
    "sv": "och att det som en på är av för den till inte om har de med var jag ett han men så vi kan från när eller",
    "da": "og at det som en på er af for den til ikke om har de med var jeg et han men så vi kan fra når eller",
    "nb": "og at det som en på er av for den til ikke om har de med var jeg et han men så vi kan fra når eller",
    "is": "og að í á sem er það til um við með fyrir en ekki var hann hún þeir frá af eru hafa þegar eða",
    "fi": "ja on ei se että oli hän mutta kun ovat myös tai niin kuin joka jos vain sen minä mitä ole hänen ne",
    "et": "ja on ei see et oli ta aga kui ka või nii mis kes ning seda tema olid oma pole kuid siis",
    "lv": "un ir no uz ar kas par ka tas bet pie arī to lai vai kā viņš bija nav pēc",
    "lt": "ir yra kad į iš su bet tai kaip nuo apie jis buvo ar kai po jo arba ne už",
    "pl": "i w na z się nie do to że jest o jak ale po co za od przez są był dla czy tym oraz",
    "cs": "a se v na je že s z o do to i ve jako pro ale by si jsou tak po byl které který nebo",
    "sk": "a sa v na je že s z o do to aj vo ako pre ale by si sú tak po bol ktoré ktorý alebo",
    "sl": "in je v na se da za so z ki pa ne s bi kot po od tudi ali ni ko iz pri",
    "hr": "i je u na se da za su od s ne a koji što kao to će iz o ali bio po nije ili",
    "hu": "a az és hogy nem is egy van volt ez meg csak de már ha mint vagy azt ki még el",
    "ro": "și si în in de la cu a nu pe o că ca din este pentru un care mai sunt sau dar se fost",
    "sq": "e të në dhe që një për me nga është si i nuk ka se më do por ishte kjo u",
    "tr": "ve bir bu da de için ile çok ama daha gibi o ne en kadar sonra olarak olan her var değil ki",
    "az": "və bir bu da də üçün ilə çox amma daha kimi o ki ən qədər sonra olaraq olan hər var deyil",
    "uz": "va bir bu bilan uchun ham edi u esa deb bo'lgan kerak lekin har yoki shu o'z emas keyin",
    "id": "yang dan di itu dengan untuk tidak ini dari dalam akan pada juga saya ke karena ada mereka sudah oleh atau bisa",
    "ms": "yang dan di itu dengan untuk tidak ini dari dalam akan pada juga saya ke kerana ada mereka sudah oleh atau boleh",
    "jv": "ing lan sing iku kanthi kanggo ora iki saka ana karo marang uga wis dadi nalika utawa",
    "su": "jeung nu di ka ti anu dina pikeun téh ieu éta teu aya ku oge sareng kana",
    "tl": "ang ng sa na mga at ay si niya ko ito ni hindi kung para may siya nang ako pero kanyang",
    "ceb": "ang sa nga mga ug si kini dili kung alang siya niya iyang apan usa ni kang",
    "vi": "và của là có được trong cho không một người với các để này những đã khi từ ở đến cũng như về ra",
    "sw": "ya wa na kwa ni katika la za kuwa cha hii kama si vya huo lakini pia wake hiyo yake au sana hivyo",
    "ha": "da a na ta ya wa ba ne ce shi su cikin don ga kuma ko amma yana suka daga",
    "yo": "ni ti si ń tí ní àti sí fún kan náà ó awọn àwọn kò bí wọn pé jẹ fi",
    "ig": "na nke ya ka bụ ndị ma n'ime a site ga dị maka onye ha o ọ nwere",
    "so": "oo ka ku waa iyo in la ay u uu waxaa ee soo si ayaa lagu aan kale laakiin",
    "zu": "ukuthi futhi noma kodwa ngoba uma lapho ngo ke na njengoba kanye nje yena bona kakhulu lokhu",
    "xh": "ukuba kwaye okanye kodwa kuba xa apho ke na njengoko kunye nje yena bona kakhulu oku",
    "af": "die en van in is het nie wat te vir met dat op sy hy aan as om was maar ek ons",
    "rw": "mu na ku no ya wa ba ni kandi ko cyangwa ariko nk' uyu muri kuri mbere iyo",
    "mg": "ny sy dia ho fa tsy amin'ny izay no ao an'ny eo ary misy ireo na izany raha",
    "ca": "i de la el que en a per amb un una és les els no del al com més va però són o",
    "gl": "e de a o que en un unha non do da os as para con por é como máis pero na no foi",
    "eu": "eta da ez bat du dira zen hau baina ere dute izan zuen hori egin oso edo baino den bere",
    "cy": "y yr a o i yn ar ei mae ac am gan wedi oedd bod ond eu hyn roedd i'r gyda",
    "ga": "an na agus ar a i go is le bhí sé don tá ag ach as nach sin leis níl sí nó",
    "lb": "an de vun d' déi e mat op fir net den ass et zu ass hunn si awer och eng sinn",
    "mt": "il u li ta' fil ma għal biex minn dan huwa kien din mal aktar jew lil iżda hija fuq",
    "eo": "la de kaj en estas al ke ne por li mi kun sur estis pri sed kiel ĝi ili aŭ",
    "la": "et in est non ad ut cum qui quod sed ex si de esse per quae ab sunt atque aut",
    "ht": "nan yo ak pou li ki te pa sa a gen yon se ou ka men nou mwen fè sou",
    "ku": "û li bi ji di ku de ya yên ne ev jî ew bo yê ên xwe lê ser her",
}.items()}


def _texts(docs: DataFrame, text: str) -> Column:
    return F.coalesce(quoted(text).cast("string"), F.lit(""))


def _removed(text: Column, characters: str) -> Column:
    """How many code points of text are among characters."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measures(docs: DataFrame, text: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """docs with the measures, under other names where ``names`` says so."""
    name = _name(names)
    docs = without(docs, *[n for n in name.values() if n.lower() != text.lower()])
    words, lines, grams, dealt = fresh(docs, "words", "lines", "grams", "dealt")
    t = _texts(docs, text)
    split = docs.select("*", F.filter(F.split(t, f"{SPACE}+"), lambda w: w != "").alias(words),
                        F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE)).alias(lines))
    w = F.col(words)
    gram = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
                       lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    hashed = split.select("*", gram.alias(grams))
    g, n_lines = F.col(grams), F.size(lines)
    # only texts that repeat a window need its places in order
    placed = F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(
        F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("at")))))
    sorted_ = hashed.select("*", placed.alias(dealt))
    d = F.col(dealt)
    twice = F.filter(d, lambda x, i: F.coalesce(F.get(d, i - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(d, i + 1)["h"] == x["h"], F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["at"]))
    start = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
    repeated = F.aggregate(places, start, lambda a, at: F.struct(
        at.alias("at"), (a["n"] + F.least(F.lit(3), at - a["at"])).alias("n")), lambda a: a["n"])
    spaced = _texts(docs, text)
    out = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(spaced).cast("long") - _removed(spaced, SPACE_CHARS),
        "n_symbols": _removed(spaced, SYMBOLS),
        "n_lines": n_lines.cast("long"),
        "n_dup_lines": (n_lines - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(repeated, F.lit(0).cast("long")),
        "n_letters": F.length(F.translate(spaced, ASCII_OTHER, "")).cast("long"),
        "n_ascii_letters": _removed(spaced, ASCII_LETTERS),
        "n_stop": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
    }
    return computed(sorted_, {name[m]: out[m] for m in MEASURES}, *[quoted(c) for c in docs.columns])


def _name(names: dict[str, str] | None) -> dict[str, str]:
    return {m: (names or {}).get(m, m) for m in MEASURES}


def base_failed(names: dict[str, str] | None = None) -> Column:
    name = _name(names)
    n, repeated = F.col(name["n_words"]), F.col(name["n_repeat_words"])
    return (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n)


def spared(text: Column, least: float) -> Column:
    """Whether text is prose in a language without stop words; looked at only where the rule refuses."""
    words = F.filter(F.transform(F.split(text, f"{SPACE}+"), lambda w: F.regexp_replace(
        F.lower(w), r"^[\p{P}\p{S}&&[^']]+|[\p{P}\p{S}&&[^.!?']]+$", "")), lambda w: w != "")

    def listed(w: Column) -> Column:
        def of(language: list[str]) -> Column:
            own = F.filter(w, lambda x: x.isin(language))
            return (F.size(own) >= F.lit(float(least)) * F.size(w)) & (F.size(F.array_distinct(own)) >= 2)
        return reduce(or_, [of(v) for v in OTHER_WORDS.values()])

    def in_sentences(w: Column) -> Column:
        ends = F.size(F.filter(w, lambda x: x.rlike("[.!?]$")))
        short = F.sort_array(F.filter(w, lambda x: x.rlike(r"^\p{L}[\p{L}\p{M}]{0,3}$")))
        return (ends >= 2) & F.exists(F.array(short), lambda s: F.exists(F.array(F.filter(s, lambda x, i: (
            F.coalesce(F.get(s, i - 1) == x, F.lit(False)) | F.coalesce(F.get(s, i + 1) == x, F.lit(False))))),
            lambda again: (10 * F.size(again) >= F.size(w)) & (F.size(F.array_distinct(again)) >= 3)))

    return F.exists(F.array(words), lambda w: listed(w) | in_sentences(w))


def compiled(rules: list = RULES, names: dict[str, str] | None = None, text: Column | None = None) -> Column:
    """One condition for the table of rules; ratios are compared as products, so nothing is divided.

    With text, the stop-word rule spares prose in other languages.
    """
    name = _name(names)
    tests = [F.lit(True)]
    for measure, per, low, high, only in rules:
        a, b = F.col(name[measure]), F.col(name[per])
        ok = F.lit(True)
        if low is not None:
            ok = ok & (a >= F.lit(float(low)) * b)
        if high is not None:
            ok = ok & (a <= F.lit(float(high)) * b)
        if only is not None:
            x, y, least = only
            ok = ok | ~(F.col(name[x]) >= F.lit(float(least)) * F.col(name[y]))
        if measure == "n_stop" and low is not None and text is not None:
            ok = ok | ((b >= MIN_WORDS) & spared(text, low))
        tests.append(ok)
    return reduce(and_, tests)


def judge(docs: DataFrame, rules: list = RULES, text: str = "text") -> DataFrame:
    """docs with the measures, base_failed and kept."""
    docs = without(docs, *[c for c in ("base_failed", "kept") if c != text])
    return (measures(docs, text).withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & compiled(rules, text=_texts(docs, text))))


def keep(docs: DataFrame, rules: list = RULES, text: str = "text") -> DataFrame:
    """docs without the rows that the base or a rule refuses."""
    name = dict(zip(MEASURES, fresh(docs, *MEASURES)))
    measured = measures(docs, text, name)
    return measured.where(~base_failed(name) & compiled(rules, name, _texts(docs, text))).select(*[quoted(c) for c in docs.columns])
