"""Fixed values.

Everything in this module is a constant whose exact value decides results:
character sets, the French stop-word list, the side words, the default
body-part lexicon and the regex skeleton.  They are stated once, in natural
order, and every operator and every oracle query reads them from here.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: text cleaning
# ---------------------------------------------------------------------------

# Characters replaced one-for-one by a space when removing punctuation.
# The apostrophe, carriage return and tab are deliberately NOT in the set.
PUNCTUATION = "!\"#$%&()*+-./:;<=>?@[\\]^_`{|}~\n,\xa0®"

# Characters turned into a space by the apostrophe pass.
APOSTROPHES = "'’"

DIGITS = "0123456789"

# French stop words (the list Spark ships for StopWordsRemover, 156 words).
FRENCH_STOP_WORDS = (
    "au aux avec ce ces dans de des du elle en et eux il je la le les leur lui "
    "ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui "
    "sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n "
    "s t y été étée étées étés étant étante étants étantes suis es est sommes "
    "êtes sont serai seras sera serons serez seront serais serait serions seriez "
    "seraient étais était étions étiez étaient fus fut fûmes fûtes furent sois "
    "soit soyons soyez soient fusse fusses fût fussions fussiez fussent ayant "
    "ayante ayantes ayants eu eue eues eus ai as avons avez ont aurai auras aura "
    "aurons aurez auront aurais aurait aurions auriez auraient avais avait avions "
    "aviez avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse "
    "eusses eût eussions eussiez eussent"
).split()

# Tokens shorter than or equal to this length are dropped with the stop words.
MIN_TOKEN_LEN_EXCLUSIVE = 2

# ASCII folding: characters whose transliteration is not "the base letter
# without its accent".  Single accented letters are derived by rule in
# ``claimtext.functions.fold`` (Unicode decomposition), this table holds
# only the exceptions.
FOLD_EXCEPTIONS = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE",
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D",
    "ł": "l", "Ł": "L", "ı": "i", "þ": "th", "Þ": "Th", "ĸ": "q",
    "\xa0": " ", "’": "'", "‘": "'", "“": '"', "”": '"',
    "«": "<<", "»": ">>", "–": "-", "—": "--",
    "…": "...", "®": "(r)", "©": "(c)", "°": "deg",
    "¡": "!", "¿": "?", "×": "x", "÷": "/",
    "µ": "u", "¹": "1", "²": "2", "³": "3", "¼": "1/4", "½": "1/2", "¾": "3/4", "€": "EUR",
}

# Raw tokeniser (word tokens keep inner apostrophes, dots and hyphens; every
# other non-space symbol is its own token).  Same text in Java and RE2.
RAW_TOKEN_PATTERN = r"[\p{L}\p{N}]+(?:['’.-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"

# The same tokens in Java's engine: possessive, so that a token of many joined
# pieces is matched in a loop and not by recursion on the thread's stack.
RAW_TOKEN_PATTERN_JAVA = r"[\p{L}\p{N}]++(?:['’.-][\p{L}\p{N}]++)*+|[^\s\p{L}\p{N}]"

# TF-IDF term pattern: maximal runs of at least two word characters.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"

# ---------------------------------------------------------------------------
# FIXED VALUES: extraction
# ---------------------------------------------------------------------------

# Character class that must precede a body-part term (at least one of them).
WORD_CLASS = "[a-zA-Zèéùêëçîïûôœö\\d]"

# Side words, as patterns, in the order they are alternated.
LEFT_SIDE_PATTERNS = ["\\bgauche\\b", "\\bg\\b", "\\bgch\\b", "\\bgche\\b", "\\bleft\\b"]
RIGHT_SIDE_PATTERNS = ["\\bdroit\\b", "\\bdroite\\b", "\\bd\\b", "\\bdt\\b", "\\bdte\\b", "\\bright\\b"]

SIDE_LEFT = "gauche"
SIDE_RIGHT = "droit"
SIDE_BOTH = "droit/gauche"
UNKNOWN = "inconnu"
OTHER_PART_PREFIX = "Autre partie: "

# Column-name conventions of a claims table.
FLAG_PREFIX = "IndLesion"
LEFT_SUFFIX = "Gauche"
RIGHT_SUFFIX = "Droit"           # also covers "Droite"
OTHER_PART_COLUMN = "IndLesionAutrePartieCorps"
OTHER_TEXT_COLUMN = "PrecisionLesionAutrePartieCorps"
# Names removed (one occurrence each, before lower-casing) from the member list.
MEMBER_LIST_REMOVALS = ["Cuissse", "AutrePartieCorps", "PrecisionLesionAutrePartieCorps"]

# Default variation lexicon: member key -> (label, patterns).  Members whose
# key is absent are matched literally and labelled with their own name.
DEFAULT_LEXICON = {
    "abdomen": ("abdomen", [
        "\\babdo\\b", "\\babdomen\\b", "\\babdominal\\b", "\\babdominaux\\b", "\\binguinal hernia\\b",
        "\\bhernie(s)? inguinale(s)?\\b", "\\bgastro(-| )?enterite(s)?\\b", "\\benterite(s)?\\b", "\\bgastro\\b",
        "\\bcostale(s)?\\b", "\\bombilicale(s)?\\b"]),
    "avantbras": ("avant bras", [
        "\\bavant(s| |-)?bras\\b", "\\bav bras\\b", "\\bmembre(s)? superieur(s)?\\b", "\\bsupinator(-| )?muscle(s)?\\b",
        "\\bsupinateur\\b", "\\bepicondylite(s)?\\b", "\\bcervico(-| )?brachialgie(s)?\\b", "\\bbrachialgie\\b",
        "\\bepicondylien(s)?\\b", "\\bforearm\\b"]),
    "bassin": ("bassin", [
        "\\bbassin(s)?\\b", "\\bcoccyx\\b", "\\bfesse(s)?\\b", "\\bischion(s)?\\b", "\\bsacro(-| )?iliaque(s)?\\b",
        "\\bsacro-ileite(s)?\\b", "\\bsacrum\\b", "\\bpiriforme\\b", "\\bpsoas\\b"]),
    "bras": ("bras", [
        "\\bbras\\b", "\\bbrachialgi(e)?(s)?\\b", "\\btrapez(e)?(s)?\\b", "\\bbrachial(e)?(s)?\\b", "\\btriceps\\b",
        "\\bbiceps\\b", "\\bmembre(s)? superieur(s)?\\b", "\\bcoiffe(des| |-)?rotateur(s)?\\b"]),
    "cervical": ("cervical", [
        "\\bcervical(e)?(s)?\\b", "\\bcervico(s)?\\b", "\\bcervico(-| )?dorsale(s)?\\b", "\\btcc(l)?\\b",
        "\\bcervicalgie(s)?\\b", "\\bcervico(-| )?brachialgie(s)?\\b", "\\bcephale(e)(s)?\\b", "\\bcervicogene(s)?\\b"]),
    "cheville": ("cheville", [
        "\\bcheville(s)?\\b", "\\bchevlle\\b", "\\bmalleole(s)?\\b", "\\btallon(s)?\\b", "\\btendon(s| )?achille(s)?\\b"]),
    "coude": ("coude", [
        "\\bocude\\b", "\\bcoude(s)?\\b", "\\bepicondylite(s)?\\b", "\\bepicondilitis\\b"]),
    "crane": ("crane", [
        "\\bcrane(s)?\\b", "\\bcerebral(e)?\\b", "\\bcephale(e)(s)?\\b", "\\bfront(al)?(e)?(s)?\\b", "\\borbite(s)?\\b",
        "\\bhead\\b", "\\btete(s)?\\b", "\\bcranien(ne)?(nes)?(s)?\\b", "\\bcranio\\b", "\\btcc(l)?\\b",
        "\\bmenton(s)?\\b", "\\bcommotion(s| )?cerebrale(s)?\\b"]),
    "cuisse": ("cuisse", [
        "\\bcuisse(s)?\\b", "ischio(-| )?jambier(s)?\\b", "\\bmembre(s)?(-| )?inferieur(s)?\\b",
        "\\btrochanterien(ne)?(s)?\\b", "\\bfemur(s)?\\b", "\\bhamstring(s)?\\b", "\\bquadricep(s)?\\b",
        "\\bsciatalgie(s)?\\b", "\\bsciatique(s)?\\b", "\\blombo(-| )?sciatique(s)?\\b", "\\blombo(-| )?sciatalgie(s)?\\b"]),
    "dents": ("dents", [
        "\\bdent(s)?\\b", "\\bincisive(s)?\\b", "\\bmachoire(s)?\\b", "\\bmollaire(s)?\\b", "\\bdentaire(s)?\\b",
        "\\bcanine(s)?\\b"]),
    "doigtsmain": ("doigt", [
        "\\bdoigt(s)?\\b", "\\bongle(s)?\\b", "\\bdoigtsmain\\b", "\\bpouce(s)?\\b", "\\bindex\\b",
        "\\bannulaire(s)?\\b", "\\bauriculaire(s)?\\b", "\\bfinger(s)?\\b"]),
    "dorsal": ("dorsal", [
        "\\bdorsal(e)?(s)?", "\\bdorso\\b", "\\bdorsalgie(s)?\\b", "\\bdorso(-| )?lombaire(s)?\\b", "\\brhomboide(s)?\\b",
        "\\bcervico(-| )?dorsale(s)?\\b", "\\btrapeze(s)?\\b", "\\bparadorsale(s)?\\b", "\\bdorsal(-| )?lumbar\\b"]),
    "epaule": ("epaule", [
        "\\bepaule(s)?\\b", "\\btrapeze(s)?\\b", "\\bplexus(-| )?brachial\\b", "\\bcervico(-| )?brachialgie\\b",
        "\\brotateur(s)?\\b", "\\bshoulder(s)?\\b", "\\bdeltoide(s)?\\b"]),
    "genou": ("genou", [
        "\\bgenou(x)?\\b"]),
    "jambe": ("jambe", [
        "\\bjambe(s)?\\b", "\\bperone(s)?\\b", "\\btibia(le)?(s)?\\b", "\\bmollet(s)?\\b", "\\bgastrocnemien(s)?\\b",
        "\\bsolaire(s)?\\b", "\\bplantaire(s| )?grele(s)?\\b"]),
    "lombaire": ("lombaire", [
        "\\bdorso(-| )?lombaire\\b", "\\bdorsal(-| )?lumbar\\b", "\\blombaire(s)?\\b", "\\blumbar(s)?\\b",
        "\\bbas(du| )?dos\\b", "\\bhernie(s| )?discale(s)?\\b"]),
    "main": ("main", [
        "\\btunnel(s)? carpien(s)?\\b", "\\bmain\\b", "\\bphalange(s)?\\b", "\\bphalangienne(s)?\\b",
        "\\bphalange(s)? distale(s)?\\b", "\\bphalange(s)? intermediaire(s)?\\b", "\\bphalange(s)? proximal(e)?(s)?\\b",
        "\\bmetacarpe(s)?\\b", "\\bmetacarpo(s)?\\b", "\\bcarpe(s)?\\b", "\\bcarpo(s)?\\b"]),
    "oreilles": ("oreille", [
        "\\boreille(s)?\\b", "\\bsurdite(s)?\\b", "\\bacouphene(s)?\\b", "\\bperte(s)? auditive(s)?\\b",
        "\\batteinte(s)? auditive(s)?\\b"]),
    "orteilspied": ("orteil", [
        "\\borteil(s)?\\b", "\\borteilspied(s)?\\b"]),
    "pied": ("pied", [
        "\\bpied(s)?\\b", "talon(s)?", "\\bplantaire(s)?\\b"]),
    "poignet": ("poignet", [
        "\\b(de)?quervain\\b", "\\bpoignet(s)?\\b", "\\bstyloide(s)? cubitale(s)?\\b", "\\bcubitale(s)?\\b"]),
    "sacre": ("sacre", [
        "\\blombo(-| )?sacre(e)?(s)?\\b", "\\bsacro\\b", "\\bsacre(e)?\\b", "\\bsacrum\\b"]),
    "thorax": ("thorax", [
        "\\bthorax\\b", "\\bthoracique(s)?\\b", "\\bhemithorax\\b", "\\bcostale(s)?\\b"]),
    "visage": ("visage", [
        "\\bvisage\\b", "\\bfacial\\b", "\\bnez\\b", "\\barcade(s)? sourcilliere(s)?\\b", "\\barcade(s)? sourcil(s)?\\b\\b",
        "\\bjoue(s)?\\b", "\\bsourcil(s)?\\b", "\\bnasale(s)?\\b"]),
    "yeux": ("yeux", [
        "\\byeux\\b", "\\boeil\\b", "\\bocculaire(s)?\\b", "\\beye(s)?\\b"]),
}

# The hip list exists but is only reachable when ``fix_hanche=True``: by
# default member "hanche" is matched as the bare literal word.
HANCHE_ENTRY = ("hanche", [
    "\\bhanche(s)?\\b", "\\badducteur(s)?\\b", "\\binguinal(-| )?hernia\\b", "\\bhernie(s)?(-| )?inguinal(e)?(s)?\\b",
    "\\bligament(s)?(-| )?inguinal(e)?(s)?\\b", "\\btrochanterien(ne)?(s)?\\b", "\\baine(s)?\\b"])

# ---------------------------------------------------------------------------
# FIXED VALUES: code hierarchy
# ---------------------------------------------------------------------------

# Line classes of a chapter listing: range line, 3-character code line,
# 4-character code line; the first alternative that matches wins.
HIERARCHY_LINE_PATTERN = r"([A-Z]\d+\-[A-Z]\d+.*)|([A-Z]\d\d .*)|([A-Z]\d\d\d .*)"

HIERARCHY_COLUMNS = [
    "Chapitre_num", "Chapitre_nom", "Categorie", "Sous_Categorie",
    "Sous_Sous_Categorie", "Sous_Sous_Sous_Categorie", "diagnostic_num", "diagnostic",
]

# Code label separator in retrieval results.
LABEL_SEPARATOR = " - "

# ---------------------------------------------------------------------------
# FIXED VALUES: web pages
# ---------------------------------------------------------------------------

# Class of the div whose text is kept from each dictionary page.
PAGE_CONTAINER_CLASS = "screenContainer"
