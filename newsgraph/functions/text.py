"""Scalar text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsgraph.functions.json_ld import article_bodies

# What matching ignores. White space of ECMAScript, the zero-width and no-break spaces,
# dashes, the middle dot, quotes and brackets.
IGNORED = r"[\x{0009}-\x{000D}\x{0020}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}\x{FEFF}\-\x{2013}\x{2014}_/\x{00B7}|\x{0022}\x{0027}\x{201C}\x{201D}\x{2018}\x{2019}!?,()\[\]{}]+"
# Two SARA E typed for SARA AE.
DOUBLE_E, AE = "เเ", "แ"
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
AMPERSAND = "\ue026"
INVISIBLE = r"[\x{00A0}\x{200B}\x{200C}\x{FEFF}]"
# Named character references that are decoded; all others stay as they are.
ENTITIES = {
    "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'",
    "&nbsp;": " ", "&ldquo;": "“", "&rdquo;": "”", "&lsquo;": "‘", "&rsquo;": "’", "&hellip;": "…",
}


def squeeze_for_match(text: Column) -> Column:
    """Text as terms are matched in it: typos mended, separators gone, lower case."""
    return F.lower(F.regexp_replace(F.replace(text, F.lit(DOUBLE_E), F.lit(AE)), IGNORED, ""))


def first_hit(text: Column, terms: tuple[str, ...]) -> Column:
    """The first term of the list that the text contains; null if none."""
    return F.coalesce(*[F.when(F.contains(text, squeeze_for_match(F.lit(t))), squeeze_for_match(F.lit(t))) for t in terms], F.lit(None).cast("string"))


def without(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda c, t: F.replace(c, squeeze_for_match(F.lit(t)), F.lit("")), terms, text)


def ascii_digits(text: Column) -> Column:
    """Thai digits as ASCII; commas go where exactly three digits follow."""
    return F.regexp_replace(F.translate(text, THAI_DIGITS, "0123456789"), r"([0-9]),(?=[0-9]{3}(?![0-9]))", "$1")


def clean_for_numbers(text: Column) -> Column:
    return ascii_digits(F.regexp_replace(F.replace(text, F.lit(DOUBLE_E), F.lit(AE)), INVISIBLE, " "))


def is_cut_short(title: Column) -> Column:
    return F.rtrim(title).rlike(r"(\x{2026}|\.\.\.)$")


def search_key(text: Column) -> Column:
    """Only Thai letters, digits and ASCII letters and digits."""
    return F.regexp_replace(text, r"[^\x{0E01}-\x{0E59}a-zA-Z0-9]", "")


def ages(title: Column) -> Column:
    """Ages named before the word for years, 1 to 110, each once, in order."""
    found = F.regexp_extract_all(ascii_digits(title), F.lit(r"([0-9]{1,3})\s*ปี"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda a: a.cast("int")), lambda a: (a >= 1) & (a <= 110)))


def host_of(url: Column) -> Column:
    """Host without www.; null where the url has none."""
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "")


def unwrapped_link(url: Column, host_suffix: str = "bing.com", parameter: str = "url") -> Column:
    """The target of a redirect link, taken from its query; any other link as it is."""
    target = F.url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(parameter)))
    return F.when(F.try_parse_url(url, F.lit("HOST")).endswith(host_suffix), F.coalesce(target, url)).otherwise(url)


def decode_entities(text: Column) -> Column:
    """Named references of the list, in any case, and decimal ones; each once, so nothing is decoded twice. Others stay.

    References to the ampersand wait as a private character until all others are decoded.
    """
    low = [e for e in ENTITIES if not e.startswith("&#") and e != "&amp;"]
    named = reduce(lambda c, e: F.regexp_replace(c, f"(?i){e}", F.lit(ENTITIES[e])), low, F.regexp_replace(text, "(?i)&amp;", AMPERSAND))
    codes = F.array_distinct(F.regexp_extract_all(named, F.lit("&#([0-9]{1,7});"), F.lit(1)))

    def one(decoded: Column, code: Column) -> Column:
        point, whole = code.cast("long"), F.concat(F.lit("&#"), code, F.lit(";"))
        letter = F.when(point == 38, F.lit(AMPERSAND)).when(point <= 0x10FFFF, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise(whole)
        return F.replace(decoded, whole, letter)

    return F.replace(F.aggregate(codes, named, one), F.lit(AMPERSAND), F.lit("&"))


def strip_html(html: Column, most: int) -> Column:
    """Visible text: scripts and styles dropped, tags as spaces, white space collapsed, cut to length."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    out = decode_entities(F.regexp_replace(out, r"<[^>]+>", " "))
    return F.substring(F.trim(F.regexp_replace(out, r"[ \t\n\r\f\x{000B}\x{00A0}]+", " ")), 1, most)


def meta_content(html: Column, name: str) -> Column:
    """Content of a meta tag by property or name, attributes in either order."""
    forward = F.regexp_extract(html, rf"(?is)<meta[^>]+(?:property|name)=[\x22\x27]{name}[\x22\x27][^>]+content=[\x22\x27]([^\x22\x27]*)[\x22\x27]", 1)
    back = F.regexp_extract(html, rf"(?is)<meta[^>]+content=[\x22\x27]([^\x22\x27]*)[\x22\x27][^>]+(?:property|name)=[\x22\x27]{name}[\x22\x27]", 1)
    return F.coalesce(F.nullif(forward, F.lit("")), F.nullif(back, F.lit("")))


def paragraphs(html: Column, least: int = 40) -> Column:
    """Stripped paragraphs of the article element (or the whole page), those longer than ``least``."""
    scope = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)</article>", 1), F.lit("")), html)
    scope = F.regexp_replace(scope, r"(?is)<figure\b.*?</figure>", " ")
    found = F.regexp_extract_all(scope, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    return F.filter(F.transform(found, lambda p: strip_html(p, 1_000_000)), lambda p: F.length(p) > least)


def article_body(html: Column, most: int = 2500) -> Column:
    """struct(text, via): JSON-LD body, else paragraphs after the description, else the description, else null."""
    ld = F.get(F.filter(F.transform(article_bodies(html), lambda b: strip_html(b, most)), lambda t: F.length(t) > 160), F.lit(0))
    og = strip_html(meta_content(html, "og:description"), most)
    joined = F.array_join(paragraphs(html), " ")
    lead = F.substring(F.concat_ws(" ", og, joined), 1, most)
    pick = lambda text, via: F.struct(text.alias("text"), F.lit(via).alias("via"))
    return F.when(ld.isNotNull(), pick(ld, "jsonld")).when(F.length(joined) > 160, pick(lead, "paragraphs")).when(F.length(og) > 60, pick(og, "og"))


def bigrams(text: Column) -> Column:
    """Letter pairs of the text, lower-cased; none for fewer than two letters."""
    low = F.lower(text)
    return F.when(F.length(low) >= 2, F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substring(low, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def numbered_bigrams(text: Column) -> Column:
    """Letter pairs of the text, each with the number of times that it stood before, so that repeats are members of a set."""
    once = F.transform(F.array(bigrams(text)), lambda grams: F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, 1, i), lambda x: x == g)).cast("string"))))
    return once[0]


def dice_of_numbered(a: Column, b: Column, a_length: Column, b_length: Column) -> Column:
    """``dice`` of two texts, given their numbered letter pairs and their lengths."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((a_length < 2) | (b_length < 2), F.lit(0.0)).otherwise(2.0 * shared / (a_length + b_length - 2))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared letter pairs, counted with repeats, over all pairs; 0 where either has none."""
    count = lambda grams, g: F.size(F.filter(grams, lambda x: x == g))
    shared = F.aggregate(F.array_distinct(bigrams(a)), F.lit(0), lambda n, g: n + F.least(count(bigrams(a), g), count(bigrams(b), g)))
    return F.when((F.length(a) < 2) | (F.length(b) < 2), F.lit(0.0)).otherwise(2.0 * shared / (F.length(a) + F.length(b) - 2))


def trigrams(key: Column) -> Column:
    """Distinct letter triples of one word, padded with two spaces before and one after."""
    padded = F.concat(F.lit("  "), F.lower(key), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigrams_of_long(key: Column) -> Column:
    """The same as ``trigrams``, in time linear in the length: letters are split once and then taken by place."""
    letters = F.split(F.concat(F.lit("  "), F.lower(key), F.lit(" ")), "")
    triple = lambda c: lambda i: F.concat(F.element_at(c, i), F.element_at(c, i + 1), F.element_at(c, i + 2))
    once = F.transform(F.array(letters), lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(c) - 2), triple(c))))
    return F.element_at(once, 1)


def set_similarity(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays of distinct values, in single precision."""
    both = F.size(F.array_intersect(a, b))
    return (both / (F.size(a) + F.size(b) - both)).cast("float")
