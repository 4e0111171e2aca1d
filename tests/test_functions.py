"""Column functions over hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from fathomline.functions import intent, personal, rules, text
from fathomline.plans import lifecycle


def over(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalize(spark):
    got = over(spark, text.normalize, ["a\xa0b\r\n c \x00 d\n\n\n\ne  ", "\uf0b7 x", None, ""])
    assert got == ["a b\nc d\n\ne", "- x", None, ""]


def test_html(spark):
    got = over(spark, text.html_to_text, ["<p>a &amp; b</p><script>x<p></script><div> c<br>d</div>", "<style>q</style>  &lt;t&gt;", None])
    assert got == ["a & b\ncd", "<t>", None]


def test_dates(spark):
    d = datetime.date
    assert over(spark, text.parse_date, ["2024-05-06", "06-05-2024", "06/05/2024", "5/26/2024", "6 may 2024", "May 6, 2024", "Nov 2024", "November 2024", "as of November 2024", "soon", None, ""]) == [d(2024, 5, 6)] * 3 + [d(2024, 5, 26), d(2024, 5, 6), d(2024, 5, 6), d(2024, 11, 1), d(2024, 11, 1), d(2024, 11, 1), None, None, None]
    assert over(spark, text.date_in_name, ["SID November 21, 2025.pdf", "Fact July 2026", "July 26", "Sept 2024", "May 99", "May 1 1999", "x", "june 5 2014"]) == ["2025-11-21", "2026-07-01", "2026-07-01", "2024-09-01", "", "", "", ""]
    assert over(spark, text.last_updated, ["2024-05-06", "2024-13-01", "2024-00-01", "May 2024", "", None]) == ["May 2024", "2024-13-01", "December 2024", "May 2024", "recently updated", "recently updated"]


def test_headings(spark):
    lines = ["Exit Load", "2.3 Exit load", "RISK FACTORS AND MORE", "ends with a stop.", "Short Title", "this is lower case text", "A: B c", "abc", "One two three four five six seven eight nine ten eleven", "the benchmark is"]
    assert over(spark, text.is_heading, lines) == [True, True, True, False, True, False, False, False, False, True]
    assert over(spark, text.is_noise, ["", "Page 3", "- 12 -", "Disclaimer: x", "Text", "12 apples"]) == [True, True, True, True, False, False]


def test_personal(spark):
    got = over(spark, personal.categories, ["ABCDE1234F", "1234 5678 9012", "1234 5678 9012 3456", "aadhaarX", "my otp", "a@b.co", "+91 98765 43210", "9876543210", "account is 123456789", "folio no 123456/78", "What is a Folio number?", "password-protected", "password: x", "show my holdings", "my other units", None])
    assert got == [["pan"], ["aadhaar"], [], ["aadhaar"], ["otp"], ["email"], [], ["phone"], ["bank_account"], ["folio"], [], [], ["credential"], ["account_request"], ["account_request"], []]
    assert over(spark, personal.scrubbed, ["a@b.co 4111 1111 1111 1111 x", "y" * 300]) == ["[redacted] [redacted] x", "y" * 200]


def test_intents(spark):
    cases = {
        "Should I invest in this fund?": "ADVICE", "Will this fund deliver returns?": "PERFORMANCE_PREDICTION", "Compare returns of these funds": "PERFORMANCE_COMPARISON", "Is it a good time to invest?": "MARKET_TIMING", "Price of bitcoin": "OUT_OF_SCOPE",
        "How do I download the statement?": "FACTUAL_OPERATIONAL", "What is stamp duty?": "FACTUAL_REGULATORY", "What is the exit load?": "AMBIGUOUS", "Exit load of the flexi cap fund": "FACTUAL_SCHEME", "Show my balance": "PII_ACCOUNT", "My PAN is ABCDE1234F": "PII_ACCOUNT",
        "How long before the date should I cancel?": "FACTUAL_OPERATIONAL", "historical performance of the fund": "HISTORICAL_PERFORMANCE", "hello": "AMBIGUOUS",
    }
    df = spark.createDataFrame([(q,) for q in cases], "question string")
    got = {r["question"]: r for r in lifecycle.classified(df).collect()}
    assert {q: r["intent"] for q, r in got.items()} == cases
    assert got["What is the exit load?"]["topic"] == "exit_load" and got["Exit load of the flexi cap fund"]["scheme"] == "HDFC FlexiCap Fund" and got["historical performance of the fund"]["topic"] == "performance_reported"
    assert over(spark, intent.topic, ["lock-in of it", "riskometer", "minimum lump sum", "nothing"]) == ["lock_in", "riskometer", "minimum_investment", None]
    branded = spark.createDataFrame([("through acme please",)], "question string")
    assert lifecycle.classified(branded, brand="ACME", brand_hints=("acme",)).first()["intent"] == "FACTUAL_ACME"


def test_small_functions(spark):
    assert over(spark, text.sentence_count, ["A. B! C?", "", "one", "a.b"]) == [3, 0, 1, 1]
    assert over(spark, text.without_urls, ["see https://x.y/z  now", " a "]) == ["see now", "a"]
    assert over(spark, text.squeeze, [" a \xa0 b\n", ""]) == ["a b", ""]
    assert over(spark, lambda c: text.stem_title(c, F.lit("SID")), ["my_file-x.pdf"]) == ["my file x SID"]
    assert over(spark, lambda c: rules.first_needle(c, rules.DOCUMENT_TYPES, "OTHER"), ["Latest KIM form", "water", "zzz"]) == ["KIM", "TER_DATA", "OTHER"]
    assert over(spark, lambda c: text.scoped(c, F.lit("Abc Fund")), ["of abc fund?", "load"]) == ["of abc fund?", "load Abc Fund"]
    rows = over(spark, lambda c: text.source_id(F.lit(""), c, F.lit("d")), ["f"])
    import hashlib

    assert rows == ["src_" + hashlib.sha1(b"f|d").hexdigest()[:12]]


@pytest.mark.parametrize("word", ["a+b", "p&l", "today's"])
def test_bounded_quotes(spark, word):
    assert over(spark, lambda c: c.rlike(rules.bounded(word)), [f"x {word} y", f"x{word}y"]) == [True, False]


def test_keywords_equal_their_search_one_by_one(spark):
    """The automaton against the built-in functions, on texts full of near hits, overlaps, other scripts and odd words."""
    import random

    from fathomline.functions import keywords
    from fathomline.functions import rules as r_

    r = random.Random(12)
    rules = {"a": ["sip", "a a", "exit load", "ñu"], "b": ["sip", "load", "c++", "x"], "c": ["exit-load fee", "日本", "no.", "٣"], "d": [" lump sum ", "e"]}
    pieces = ["sip", "SIP", "a", " ", " ", "a a a", "exit load", "exit-load", "exit load fee", "load_", "loads", "c++", "c+", "x", "ñu", "é", "日本", "日", "no.", "٣", "1", "_", "-", "\n", "lump sum", "e", "😀", "ß"]
    texts = ["".join(r.choice(pieces) + r.choice(["", " ", "."]) for _ in range(r.randrange(14))) for _ in range(600)] + [None, "", " "]
    df = spark.createDataFrame([(k, t, r.choice(texts)) for k, t in enumerate(texts)], "id long, t string, h string")
    low, hint = F.lower("t"), F.lower("h")
    got = df.select("id", keywords.elected(low, rules, "none", hint).alias("a"), keywords.elected(low, rules).alias("b"), keywords.first_alias(F.col("t"), rules, "z").alias("c"))
    want = df.select("id", F.when(F.col("t").isNull(), "none").otherwise(r_.elected(low, rules, "none", F.coalesce(hint, F.lit("")))).alias("a"), r_.elected(low, rules).alias("b"), r_.first_alias(F.col("t"), rules, "z").alias("c"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {x["a"] for x in got.collect()} >= {"a", "b", "c", "d", "none"}
    one = df.limit(1)
    assert one.select(keywords.elected(F.col("t"), {}, "q"), keywords.first_alias(F.col("t"), {"n": [""]}, "q")).first()[:] == ("q", "n")


def test_white_space_at_ends(spark):
    """strip over each of its characters, others beside ASCII, and texts without any."""
    odd = ["", " ", "a", "é", " é", "a\u3000", "\x85a b\xa0", "\x00a", "a\x7f", "\u2028", None, *(w + "a b" for w in text.WHITE), *("a" + w for w in text.WHITE)]
    for r in spark.createDataFrame([(t,) for t in odd], "t string").select("t", text.strip(F.col("t")).alias("s")).collect():
        assert r.s == (None if r.t is None else r.t.strip(text.WHITE))


def test_normalize_all_shapes(spark):
    texts = {"a\u00a0b\uf0b7\uf020 c": "a b- c", "a\rb\r\nc": "a\nb\nc", "a \n b\n c \n\n\n\nd": "a\nb\nc\n\nd", "a\x01b\t\tc  d": "a b c d", " \n": "", "a": "a"}
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", text.normalize(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == texts | {None: None}


def test_dates_are_compiled(spark, small):
    """No method of the code that Spark generates for all dates is longer than the JVM compiles (8000 bytes)."""
    import contextlib
    import io
    import re

    from fathomline.queries import QUERIES

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES["dates"](spark, small).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert sizes and max(sizes) <= 8000


def test_dates_of_odd_shapes(spark):
    d = datetime.date
    said = {"06 MAY 2024": d(2024, 5, 6), "SEPTEMBER 2024": d(2024, 9, 1), "may 6, 2024": d(2024, 5, 6), " 2024-5-6 ": d(2024, 5, 6), "31/2/2024": None, "6-May-2024": None, "May, 2024": None, "as of May  2024 x": d(2024, 5, 1)}
    assert over(spark, text.parse_date, list(said)) == list(said.values())
