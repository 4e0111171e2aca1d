"""Text functions of corpus preparation, as columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from html.entities import name2codepoint
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import HEADINGS, NOISE_LINES

# Shapes of headings, glyphs of old fonts, dates and month names.
HEADING_SHAPE = r"^(?:\d{1,2}(?:\.\d{1,2})*[.)]?\s+)?(?:[A-Z][A-Z0-9 ,&/\-()'%.:]{6,120}|[A-Z][A-Za-z0-9 ,&/\-()':.\-]{4,120})\s*$"
HEADING_NUMBER = r"^\d{1,2}(?:\.\d{1,2})*[.)]?\s+[A-Z]"
GLYPHS = {"\uf06c": "-", "\uf0b7": "-", "\uf0d8": "-", "\uf020": " ", "\u00a0": " "}
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: Formats of days in turn, and the shape that any text of the format has: what fails to be parsed is an exception, which takes longer than all else of a row.
DATE_FORMATS = {
    "yyyy-M-d": r"^[+-]?\d{4,}-\d+-\d+$", "d-M-yyyy": r"^\d+-\d+-[+-]?\d{4,}$", "d/M/yyyy": r"^\d+/\d+/[+-]?\d{4,}$", "M/d/yyyy": r"^\d+/\d+/[+-]?\d{4,}$",
    "d MMM yyyy": r"^\d+ [^\d ]{3} [+-]?\d{4,}$", "MMMM d, yyyy": r"^[^\d ]{3,} \d+, [+-]?\d{4,}$", "MMM yyyy": r"^[^\d ]{3} [+-]?\d{4,}$", "MMMM yyyy": r"^[^\d ]{3,} [+-]?\d{4,}$",
}


#: What strip() takes from both ends.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is evaluated once however often f uses it.

    f stays out of the code that is generated for the row: of many long expressions that becomes one method, which the JVM doesn't compile beyond 8000 bytes.
    """
    return F.transform(F.array(c), f)[0]


def strip(c: Column) -> Column:
    """No white space at both ends. btrim looks at each character; the first and last byte tell of most texts that there is nothing to do."""
    raw = c.cast("binary")
    first, last = (F.substring(raw, at, 1).between(F.lit(b"\x21"), F.lit(b"\x7e")) for at in (1, -1))
    return F.when(first & last, c).otherwise(F.btrim(c, F.lit(WHITE)))


def squeeze(c: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    """Line ends, hard blanks, control characters and private glyphs made plain; blanks squeezed in lines, two line feeds at most in a row."""
    control = "\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f"
    for sign in dict.fromkeys(GLYPHS.values()):  # expressions: translate looks up each character of the text
        c = F.regexp_replace(c, f"[{''.join(g for g, x in GLYPHS.items() if x == sign)}]", sign)
    c = _where(["\r"], c, "\r\n?", "\n")
    c = F.regexp_replace(c, f"[ \\t{control}]{{2,}}+|[\\t{control}]", " ")
    c = _where([" \n", "\n "], c, " \n ?|\n ", "\n")
    return F.btrim(_where(["\n\n\n"], c, "\n{3,}", "\n\n"), F.lit(" \n"))


def _where(needles: list[str], c: Column, shape: str, by: str) -> Column:
    """c with what has the shape replaced, if c has one of the needles: a plain search, as nothing else has the shape."""
    return once(c, lambda t: F.when(reduce(or_, map(t.contains, needles)), F.regexp_replace(t, shape, by)).otherwise(t))


_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"


def unescape(c: Column) -> Column:
    """Entities resolved, each once: by number, or by the names of HTML 4 and &apos;. What is no entity stays."""
    names = F.create_map(*(F.lit(x) for name, point in sorted([*name2codepoint.items(), ("apos", 39)]) for x in (name, chr(point))))

    def sign(m: Column) -> Column:
        hexed = F.when(m.rlike("^&#[xX]"), F.substring(m, F.lit(4), F.length(m) - 4)).otherwise(F.hex(F.regexp_extract(m, "[0-9]+", 0).cast("long")))
        point = F.conv(hexed, 16, 10).cast("long")
        good = m.startswith("&#") & point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        return F.coalesce(F.when(good, F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")), names[F.substring(m, F.lit(2), F.length(m) - 2)], m)

    signs = F.transform(F.regexp_extract_all(c, F.lit(_ENTITY), F.lit(0)), sign)
    parts = F.zip_with(F.split(c, _ENTITY, -1), signs, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(c.contains("&"), F.array_join(parts, "")).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Text of a page: scripts, styles and noscripts with their bodies go, ends of blocks become line feeds, other tags vanish; entities resolved, lines trimmed, empty ones dropped, wide gaps broken."""
    c = F.regexp_replace(c, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    c = F.regexp_replace(c, r"(?i)</(?:p|div|li|h[1-6]|tr)>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    c = unescape(c)
    c = F.regexp_replace(c, "[ \t\r\u00a0]*[\r\n][ \t\r\u00a0]*", "\n")
    c = F.regexp_replace(F.regexp_replace(c, "\n{2,}", "\n"), "[ \t]{2,}", "\n")
    return F.regexp_replace(c, "^[ \t\n\u00a0]+|[ \t\n\u00a0]+$", "")


def question_hash(c: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(c)), 256), 1, 16)


def source_id(source: Column, file_name: Column, raw_date: Column) -> Column:
    """src_ and 12 hex digits of the given id, or else of file name and raw date."""
    basis = F.when(F.coalesce(source, F.lit("")) != "", source).otherwise(F.concat_ws("|", F.coalesce(file_name, F.lit("")), F.coalesce(raw_date, F.lit(""))))
    return F.concat(F.lit("src_"), F.substring(F.sha1(basis), 1, 12))


def preview(c: Column, n: int = 300) -> Column:
    return F.substring(c, 1, n)


def sentence_count(c: Column) -> Column:
    """Parts between terminators that white space follows."""
    return F.size(F.filter(F.split(strip(c), r"[.!?]+\s"), lambda s: strip(s) != ""))


def stem_title(file_name: Column, kind: Column) -> Column:
    """The stem with blanks for dashes and underscores, and the type after it."""
    return F.concat_ws(" ", F.translate(F.regexp_replace(file_name, r"\.[^.]*$", ""), "_-", "  "), F.nullif(kind, F.lit("")))


def parse_date(c: Column) -> Column:
    """By eight formats in turn (month names in any case), then the first of a named month and year within the text; null if none."""

    def whole(t: Column) -> Column:
        return F.coalesce(*(F.when(t.rlike(shape), F.try_to_date(t, f)) for f, shape in DATE_FORMATS.items()))

    def within(x: Column) -> Column:
        named = F.regexp_extract(x, rf"({'|'.join(MONTHS)})\s+(\d{{4}})", 0)
        return F.try_to_date(F.when(named != "", F.concat(F.lit("1 "), F.regexp_replace(named, r"\s+", " "))), "d MMMM yyyy")

    return once(c, lambda x: F.coalesce(once(F.trim(x), whole), within(x)))


_MONTH_NAMES = "|".join([*MONTHS, *(m[:3] for m in MONTHS[:4]), "Jun", "Jul", "Aug", "Sept", "Sep", "Oct", "Nov", "Dec"])
_FULL = rf"(?i)({_MONTH_NAMES})\s+(\d{{1,2}}),?\s+(\d{{4}})"
_SHORT = rf"(?i)({_MONTH_NAMES})\s+(\d{{2,4}})"


def date_in_name(c: Column) -> Column:
    """yyyy-MM-dd of a month name, day and year in a file name, or of month name and year (the first of the month); years 2015 to 2035; the empty string if none."""

    def number(name: Column) -> Column:
        return F.lpad(F.array_position(F.array(*(F.lit(m[:3].lower()) for m in MONTHS)), F.lower(F.substring(name, 1, 3))).cast("string"), 2, "0")

    def parts(x: Column, shape: str, groups: int) -> Column:
        return F.struct(*(F.regexp_extract(x, shape, k).alias(n) for n, k in (("month", 1), ("day", 2), ("year", groups))))

    def full(p: Column) -> Column:
        return F.concat_ws("-", p["year"].try_cast("int").cast("string"), number(p["month"]), F.lpad(p["day"], 2, "0"))

    def short(p: Column) -> Column:
        y = p["year"].try_cast("int")
        return once(F.when(y < 100, y + 2000).otherwise(y), lambda z: F.when(z.between(2015, 2035), F.concat_ws("-", z.cast("string"), number(p["month"]), F.lit("01"))).otherwise(""))

    return once(c, lambda x: once(parts(x, _FULL, 3), lambda p: F.when(p["year"].try_cast("int").between(2015, 2035) & p["day"].try_cast("int").between(1, 31), full(p)).otherwise(once(parts(x, _SHORT, 2), short))))


def last_updated(raw: Column) -> Column:
    """Month and year of three parts between dashes; else the first ten characters; 'recently updated' if empty. Month 00 counts as December."""

    def said(r: Column) -> Column:
        parts = F.split(r, "-", -1)
        m = F.try_element_at(parts, F.lit(2)).try_cast("int")
        name = F.element_at(F.array(*map(F.lit, MONTHS)), F.when(m == 0, 12).when(m.between(1, 12), m).otherwise(1))
        good = (F.size(parts) == 3) & m.between(0, 12)
        return F.when(F.coalesce(r, F.lit("")) == "", "recently updated").when(good, F.concat_ws(" ", name, F.element_at(parts, 1))).otherwise(r)

    return once(F.substring(raw, 1, 10), said)


def without_urls(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)https?://\S+", ""), r"\s{2,}", " "))


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "‘’“”", "''\"\"")


def is_noise(line: Column, patterns: list[str] = NOISE_LINES) -> Column:
    """Blank, a page number, or begins like a running header."""
    low = F.lower(F.trim(line))
    out = (low == "") | line.rlike(r"(?i)^\s*(page\s*)?[-–—|]?\s*\d{1,4}\s*[-–—|]?\s*$")
    return out | low.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else out


def is_heading(line: Column, known: list[str] = HEADINGS) -> Column:
    return _heading(F.trim(line), F.lower(F.trim(line)), known)


def _heading(s: Column, low: Column, known: list[str]) -> Column:
    n = F.length(s)
    shaped, numbered = s.rlike(HEADING_SHAPE), s.rlike(HEADING_NUMBER)
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    loud = (letters > 0) & (upper > 0.75 * letters)
    listed = F.lit(False)
    for h in known:
        listed = listed | low.startswith(h) | (low.contains(h) & (n <= len(h) + 25))
    words = F.size(F.split(s, r"\s+"))
    return (n > 3) & (n <= 140) & ~s.rlike(r"[.,;]$") & (words <= 10) & (listed | (shaped & (numbered | loud | ((n <= 60) & ~s.contains(":")))))


def marked_lines(lines: Column, headings: list[str] = HEADINGS) -> Column:
    """An array of lines as structs of line_no, line, trimmed and heading; each line is trimmed once."""
    plain = F.transform(lines, lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), F.trim(x).alias("trimmed")))
    heading = lambda s: (F.length(s) <= 140) & once(F.lower(s), lambda low: _heading(s, low, headings))
    return F.transform(plain, lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), x["trimmed"].alias("trimmed"), heading(x["trimmed"]).alias("heading")))


def tokens(c: Column) -> Column:
    """Distinct lower-case words of more than two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda t: F.length(t) > 2))


def packed(words: Column) -> Column:
    """Words (of tokens()) as one string, a third of the array's size in a shuffle; unpacked() gives them back."""
    return F.array_join(words, " ")


def unpacked(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


def expanded(question: Column, topic: Column, expansions: dict[str, str]) -> Column:
    """The question, and its topic's expansion unless three or more of the expansion's longer terms are in it."""
    out, low = None, F.lower(question)
    for name, text in expansions.items():
        terms = [t for t in text.split() if len(t) > 4]
        seen = sum((F.when(low.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
        new = F.when(seen >= 3, question).otherwise(F.concat(question, F.lit(f" {text}")))
        out = F.when(topic == name, new) if out is None else out.when(topic == name, new)
    return question if out is None else out.otherwise(question)


def scoped(question: Column, scheme: Column) -> Column:
    """The question with the scheme's name, unless it has it."""
    return F.when(scheme.isNull() | (scheme == "") | F.lower(question).contains(F.lower(scheme)), question).otherwise(F.concat_ws(" ", question, scheme))
