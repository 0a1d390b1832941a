"""Names, colours and small formats as column expressions; none leaves the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and their plain forms, by Unicode's own decomposition.
_MARKED = [c for c in map(chr, range(0xC0, 0x250)) if unicodedata.decomposition(c) and len(b := "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))) == 1 and b.isascii()]
_PLAIN = "".join(next(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)) for c in _MARKED)

# Generic words that names are compared without.
GENERIC_WORDS = ["station", "metro", "métro", "underground", "subway", "bahnhof", "u-bahn", "estación", "estacion", "stazione", "gare"]

# Colour names of route tags.
ROUTE_COLOURS = {
    "red": "#e4002b", "blue": "#0072bc", "green": "#009b48", "yellow": "#ffd400", "orange": "#f7941d", "purple": "#8e258d",
    "violet": "#8e258d", "pink": "#e6007e", "brown": "#a0522d", "black": "#111111", "grey": "#8c8c8c", "gray": "#8c8c8c",
    "silver": "#a8a9ad", "gold": "#d4a017", "lime": "#6cc24a", "cyan": "#00b2a9", "teal": "#00838f", "navy": "#003688",
    "magenta": "#e6007e", "white": "#f2f2f2", "turquoise": "#00b2a9", "lightblue": "#00a7e1", "darkgreen": "#006400",
}

# Colours of lines without one, in turn.
FALLBACK_COLOURS = [
    "#e4002b", "#0072bc", "#009b48", "#f7941d", "#8e258d", "#00a7e1", "#ffd400", "#a0522d",
    "#e6007e", "#6cc24a", "#003688", "#ff6f61", "#00b2a9", "#d4a017", "#5d3a9b", "#8c8c8c",
]

# Colour names of drawings.
DRAWING_COLOURS = {"black": "#000000", "white": "#ffffff", "red": "#ff0000", "blue": "#0000ff", "green": "#008000", "yellow": "#ffff00", "orange": "#ffa500", "purple": "#800080", "gray": "#808080", "grey": "#808080"}

# Abbreviations on maps, in the order in which they are expanded.
ABBREVIATIONS = [
    (r"(?i)\bPhila\.?(?=\s|$)", "Philadelphia"),
    (r"\bN\.\s*(?=[A-Z])", "North "),
    (r"\bS\.\s*(?=[A-Z])", "South "),
    (r"\bE\.\s*(?=[A-Z])", "East "),
    (r"\bW\.\s*(?=[A-Z])", "West "),
    (r"(?i)\bTrans\.?\s*Ctr\.?", "Transportation Center"),
    (r"\bT\.?\s?C\.?(?=\s|$)", "Transportation Center"),
    (r"(?i)\bSta\.?(?=\s|$)", "Station"),
    (r"\bSt\.(?=\s|$)", "Street"),
    (r"(?i)\bAve\.?(?=\s|$)", "Avenue"),
    (r"(?i)\bRd\.?(?=\s|$)", "Road"),
    (r"(?i)\bJct\.?(?=\s|$)", "Junction"),
    (r"(?i)\bCtr\.?(?=\s|$)", "Center"),
    (r"(?i)\bPkwy\.?(?=\s|$)", "Parkway"),
    (r"(?i)\bMt\.?(?=\s)", "Mount"),
    (r"(?i)\bTerm\.?(?=\s|$)", "Terminal"),
    (r"(?i)\bTerms?\.?(?=\s|$)", "Terminals"),
    (r"(?i)\bIntl\.?(?=\s|$)", "International"),
    (r"(?i)\bSq\.?(?=\s|$)", "Square"),
    (r"(?i)\bBlvd\.?(?=\s|$)", "Boulevard"),
    (r"(?i)\bLn\.?(?=\s|$)", "Lane"),
    (r"(?i)\bHwy\.?(?=\s|$)", "Highway"),
    (r"(?i)\bPl\.?(?=\s|$)", "Place"),
    (r"(?i)\bDr\.?(?=\s|$)", "Drive"),
]


def fold_accents(c: Column) -> Column:
    """Latin letters without their marks; combining marks go."""
    return F.regexp_replace(F.translate(c, "".join(_MARKED), _PLAIN), "[̀-ͯ]", "")


def normalize_name(c: Column) -> Column:
    """Names as they are compared: no accents, case, generic words, spaces or punctuation."""
    plain = F.lower(fold_accents(c))
    alternatives = "|".join(GENERIC_WORDS)
    # Word edges are those between ASCII word characters and others.
    bare = F.regexp_replace(plain, rf"(?<![a-z0-9_])({alternatives})(?![a-z0-9_])", " ")
    return F.regexp_replace(bare, r"[^\p{L}\p{N}]+", "")


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("x"))


def ref_family(c: Column) -> Column:
    """The letters of a short reference such as B2; others as they are."""
    t = F.trim(c)
    return F.lower(F.when(t.rlike(r"^[A-Za-z]{1,3}\s?-?\d{1,2}$"), F.regexp_extract(t, "^[A-Za-z]+", 0)).otherwise(t))


def _hex2(n: Column) -> Column:
    h = F.lower(F.hex(n.cast("long")))
    return F.when(F.length(h) < 2, F.lpad(h, 2, "0")).otherwise(h)


def _hex_forms(s: Column) -> tuple[Column, Column, Column]:
    six = F.concat(F.lit("#"), F.ltrim(s, F.lit("#")))
    three = F.concat(F.lit("#"), F.regexp_replace(F.ltrim(s, F.lit("#")), "(.)", "$1$1"))
    rgb = F.concat(F.lit("#"), *[_hex2(F.regexp_extract(s, r"^rgb\((\d+),\s*(\d+),\s*(\d+)\)$", i)) for i in (1, 2, 3)])
    return six, three, rgb


def normalize_colour(c: Column, fallback: Column, names: dict[str, str] = ROUTE_COLOURS) -> Column:
    """#rrggbb of a colour name, hex form or rgb(); else the fallback."""
    s = F.lower(F.trim(c))
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), s)
    six, three, rgb = _hex_forms(s)
    return F.when(c.isNull() | (c == ""), fallback).otherwise(
        F.coalesce(known, F.when(s.rlike("^#?[0-9a-f]{6}$"), six).when(s.rlike("^#?[0-9a-f]{3}$"), three).when(s.rlike(r"^rgb\(\d+,\s*\d+,\s*\d+\)$"), rgb).otherwise(fallback))
    )


def drawing_colour(c: Column) -> Column:
    """As normalize_colour, with the names of drawings; null where there is none."""
    return F.when(F.lower(F.trim(c)).isin("none", "transparent"), F.lit(None).cast("string")).otherwise(normalize_colour(c, F.lit(None).cast("string"), DRAWING_COLOURS))


def colour_parts(c: Column) -> list[Column]:
    return [F.conv(F.substring(c, i, 2), 16, 10).cast("long") for i in (2, 4, 6)]


def colour_distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum((F.pow((x - y).cast("double"), 2) for x, y in zip(colour_parts(a), colour_parts(b), strict=True)), F.lit(0.0)))


def expand_abbreviations(c: Column) -> Column:
    s = F.regexp_replace(c, r"\s*\([^)]*\)\s*", " ")
    s = F.trim(F.regexp_replace(F.replace(s, F.lit(","), F.lit(" ")), r"\s+", " "))
    for pattern, full in ABBREVIATIONS:
        s = F.regexp_replace(s, pattern, full)
    return F.regexp_replace(s, r"\s*/\s*", "-")


def text_keys(name: Column) -> Column:
    """Keys of a station name: the whole, and its parts around slashes; first occurrences, none empty."""
    parts = F.concat(F.array(name), F.split(name, r"\s*/\s*"))
    return F.array_distinct(F.filter(F.transform(parts, normalize_name), lambda x: x != ""))


def decode_entities(c: Column) -> Column:
    """The five named entities, ampersands first, so doubly escaped text is decoded twice."""
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def format_duration(sec: Column) -> Column:
    """1d 2h 3m; minutes are rounded half up and may read 60m; a dash where there is no time."""
    d, h = F.floor(sec / 86400), F.floor((sec % 86400) / 3600)
    m = F.floor((sec % 3600) / 60 + 0.5)
    parts = F.concat_ws(" ", F.when(d > 0, F.concat(d.cast("string"), F.lit("d"))), F.when((h > 0) | (d > 0), F.concat(h.cast("string"), F.lit("h"))), F.concat(m.cast("string"), F.lit("m")))
    return F.when(sec.isNull(), "—").otherwise(parts)


def farm_spec(c: Column) -> Column:
    """id:n,id:n as an array of (id, n); n is 1 where it is missing, and 1 at least."""
    items = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")

    def one(x: Column) -> Column:
        p = F.split(x, ":")
        n = F.coalesce(F.try_to_number(F.trim(F.get(p, 1)), F.lit("999999")).cast("int"), F.lit(1))
        return F.struct(F.trim(F.get(p, 0)).alias("id"), F.greatest(F.lit(1), n).alias("n"))

    return F.transform(items, one)


def wikitext_station_count(c: Column) -> Column:
    """The largest |stations = N in the first 20,000 characters of an article (the feature's own bound)."""
    return F.array_max(F.transform(F.regexp_extract_all(F.substring(c, 1, 20000), F.lit(r"(?i)\|\s*stations\s*=\s*(\d+)"), F.lit(1)), lambda x: x.cast("long")))


def css_rules(c: Column) -> Column:
    """The (selector, property, value, ord) entries of a style sheet, comma selectors apart."""
    blocks = F.regexp_extract_all(c, F.lit(r"[^{}]+\{[^}]*\}"), F.lit(0))

    def block(b: Column, i: Column) -> Column:
        sel = F.transform(F.split(F.substring_index(b, "{", 1), ","), lambda x: F.trim(x))
        body = F.filter(F.split(F.rtrim(F.substring_index(b, "{", -1), F.lit("}")), ";"), lambda x: F.contains(x, F.lit(":")))
        decl = F.transform(body, lambda x, j: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("property"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value"), j.alias("j")))
        return F.flatten(F.transform(sel, lambda s: F.transform(decl, lambda p: F.struct(s.alias("selector"), p["property"].alias("property"), p["value"].alias("value"), (i * 1000 + p["j"]).alias("ord")))))

    return F.flatten(F.transform(blocks, block))


def decode_entities(c: Column) -> Column:
    """Character entities as their characters: the five named ones in this order, then decimal and hexadecimal numbers. Numbers that are no character stay."""
    for name, to in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        c = F.replace(c, F.lit(name), F.lit(to))

    def numbered(s: Column, pattern: str, base: int) -> Column:
        def put(acc: Column, item: Column) -> Column:
            n = F.conv(F.regexp_extract(item, "([0-9a-fA-F]+);$", 1), base, 10).try_cast("long")
            fits = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
            return F.replace(acc, item, F.when(fits, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(item))

        return F.aggregate(F.array_distinct(F.regexp_extract_all(s, F.lit(pattern), F.lit(0))), s, put)

    return F.when(F.contains(c, F.lit("&#")), numbered(numbered(c, "&#[0-9]+;", 10), "&#[xX][0-9a-fA-F]+;", 16)).otherwise(c)


def encode_entities(c: Column) -> Column:
    """Text as it stands in markup, also inside quoted attributes."""
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(name))
    return c
