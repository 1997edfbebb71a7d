"""Text of a container element of web pages.

The reference fetched pages with a headless browser and kept the text of
one ``div`` by class.  Here pages are a table ``(page_id, url, html)`` and
the extraction is one column expression of built-in functions: comments are
dropped, the page is split once at the first opening ``div`` whose class list
has the name, the rest is cut into tags (quoted attribute values are stepped
over) and texts, a fold over these finds the ``</div>`` that closes the
container, and the texts before it are joined, with character references
decoded and one trailing space.  Nested ``div`` elements are kept whole; a
container that is never closed reaches to the end of the page.  A page without
the container (or a null page) gives null.
"""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimtext.functions.text import let


# FIXED VALUES: what stands inside a tag, quoted values whole; a tag (one with a lone quote ends at its first >);
# a page's pieces: tags, runs of text, and < that begins no tag.
_INSIDE = r"""(?:[^>"']|"[^"]*+"|'[^']*+')"""
_TAG = f"<[a-zA-Z/!?]{_INSIDE}*+>|<[a-zA-Z/!?][^>]*+>"
_PIECES = f"{_TAG}|[^<]++|<"


def opening_pattern(cls: str) -> str:
    """The opening tag of a div whose class list has cls; any quotes, any attribute order, quoted values stepped over."""
    c = re.escape(cls)
    quoted = "|".join(f"{q}(?:[^{q}]*\\s)?{c}(?:\\s[^{q}]*)?{q}" for q in "\"'")
    return f"<[dD][iI][vV](?=\\s){_INSIDE}*?\\s[cC][lL][aA][sS][sS]\\s*=\\s*(?:{quoted}|{c}(?=[\\s>])){_INSIDE}*+>"


def _code_point(number: Column) -> Column:
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    safe = F.when(valid, number).otherwise(F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def decode_references(text: Column) -> Column:
    """Decode ``&name;``, ``&#123;`` and ``&#x7B;``; anything else stays."""
    names = F.from_json(F.lit(json.dumps({n[:-1]: v for n, v in html5.items() if n.endswith(";")})),
                        "map<string,string>")

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, r"^&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);", 1)
        char = (F.when(name == "", F.lit(None).cast("string"))
                .when(name.rlike("^#[xX]"), _code_point(F.conv(F.substr(name, F.lit(3)), 16, 10).cast("long")))
                .when(name.startswith("#"), _code_point(F.substr(name, F.lit(2)).cast("long"))))
        for common in ("amp", "nbsp", "lt", "gt", "quot", "eacute", "egrave"):  # a map is searched from its start
            char = char.when(name == common, html5[f"{common};"])
        char = char.otherwise(names[name])
        return F.when(char.isNull(), p).otherwise(F.concat(char, F.substr(p, F.length(name) + 3)))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "(?=&)"), piece), "")
                  ).otherwise(text)


def container_text(html, cls: str) -> Column:
    h = F.col(html) if isinstance(html, str) else html

    def inside(pieces: Column) -> Column:
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

        def step(a: Column, x: Column) -> Column:
            depth = a["depth"] + F.when(x.rlike("^<[dD][iI][vV][\\s/>]"), 1).when(x.rlike("^</[dD][iI][vV][\\s>]"), -1).otherwise(0)
            return F.struct(depth.alias("depth"), (a["at"] + 1).alias("at"),
                            F.when((a["end"] < 0) & (depth == 0), a["at"]).otherwise(a["end"]).alias("end"))

        closed = F.aggregate(pieces, start, step, lambda a: a["end"])
        own = F.slice(pieces, F.lit(1), F.when(closed < 0, F.size(pieces)).otherwise(closed))
        return F.array_join(F.filter(own, lambda x: (x == "<") | ~F.startswith(x, F.lit("<"))), "")

    # comments go first, so that a container inside one is not found
    h = F.when(F.contains(h, F.lit("<!--")), F.regexp_replace(h, "(?s)<!--.*?-->", "")).otherwise(h)
    after = F.get(F.split(h, opening_pattern(cls), 2), F.lit(1))
    pieces = F.regexp_extract_all(after, F.lit(_PIECES), 0)
    # bound, so that a page is split once however often its text is used
    return let(pieces, lambda p: let(inside(p), lambda t: F.concat(decode_references(t), F.lit(" "))))
