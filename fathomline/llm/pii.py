"""Personal data in texts, in DataFrame operations alone and without a shuffle.

Regular expressions propose spans; checksums (Luhn, mod 97) and other bounds confirm them; words near a span raise its score. Spans of the base
kinds stay whatever their score; those of the added kinds (account and social security numbers, local phones, access keys, secrets that a text
assigns) need LEAST_SCORE.

Account numbers (IBAN) are looked ahead for: a candidate may take in words behind it, and the longest part of it that has its country's length
and passes mod 97 is the span.

Positions come from the pieces that a text falls into at the matches, so no text is searched again for each of its spans. The expressions are
possessive and start where a run starts (or where the last match ended), which finds what greedy ones find, in linear time.

Nulls and edge cases: a null text is the empty one, without spans; repeated rows are each searched; an empty table gives no rows; a null doc_id
stays; extra columns are left out by op1 and pass through with_spans().
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table, text_of

LEAST_SCORE = 0.6
CONTEXT_BONUS = 0.4
#: Characters before and after a span in which context words count.
BEFORE, AFTER = 40, 20
_BLOCK = 64
_SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap condition without which there is no match.
    hint: str
    score: float
    context: str
    base: bool
    #: Where group 1 looks ahead for a candidate: the characters of the text that a match itself takes.
    taken: int = 0


# The shapes of the kinds and the words that speak for them.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|e-mail|contact|write", True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", r"[0-9]\.[0-9]", 0.6, "ip|host|server|address|client", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){15,}+", r"[0-9](?:[\x20-]?[0-9]){15}", 0.8, "card|visa|mastercard|credit|debit|amex", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, "phone|tel|call|mobile|fax", True),
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?+))[A-Z]{2}[0-9]{2}", r"[A-Z]{2}[0-9]{2}", 0.7, "iban|account|bank|konto|cuenta|compte", False, 4),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", 0.4, "ssn|social security", False),
    Kind("access_key", r"(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])", r"A[KS]IA[0-9A-Z]{16}", 0.8, "key|aws|secret|credential", False),
    Kind("secret", r"(?<![A-Za-z0-9])(?i:password|passwd|passphrase|secret|token|api[_-]?key)\x20?[=:]\x20?[^\s,;]{8,}+", r"(?i:ord|wd|phrase|secret|token|key)\x20?[=:]", 0.7, "login|user|account|credential", False),
    Kind("local_phone", r"(?<![0-9+-]|\+[0-9]{1,3}[\x20-])\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])", r"[0-9][.-][0-9]{4}", 0.3, "phone|tel|call|mobile|fax", False),
)

#: Characters of an account number by country. Where a country isn't listed, any from 15 to 34 will do.
IBAN_LENGTH = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(number)

    def value(i: Column) -> Column:
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number (without blanks, in upper case) leaves 1."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(s: Column, i: Column) -> Column:
        v = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(v >= 65, (s * 100 + v - 55) % 97).otherwise((s * 10 + v - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def account(candidate: Column) -> Column:
    """The longest part of an IBAN's candidate that ends at a word's end, has its country's length and passes mod 97; null if none does.

    A candidate may run on into the words behind the account, and has one character more where its own last word goes on.
    """

    def bare(c: Column) -> Column:
        return F.replace(c, F.lit(" "), F.lit(""))

    cut = candidate.rlike("[a-z]$") | (F.length(bare(candidate)) > 34)
    words = F.split(candidate, " ")
    n = F.size(words) - cut.cast("int")
    parts = F.transform(F.filter(F.sequence(F.lit(1), F.size(words)), lambda j: j <= n), lambda j: F.array_join(F.slice(words, F.lit(1), j), " "))
    country, size = F.left(candidate, F.lit(2)), F.lit(None).cast("int")
    for length, names in IBAN_LENGTH.items():
        size = F.when(country.isin(*names.split()), length).otherwise(size)
    good = F.filter(parts, lambda p: F.when(F.length(bare(p)).between(F.coalesce(size, F.lit(15)), F.coalesce(size, F.lit(34))), mod97(bare(p))).otherwise(False))
    return F.try_element_at(good, F.lit(-1))


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    if kind == "card":
        # an endless run of digits is never cut into substrings
        return F.when(F.length(digits(match)).between(16, 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    if kind == "iban":
        return match.isNotNull()
    if kind == "secret":  # what follows the sign is no word
        return match.rlike(r"[=:]\x20?[^=:]*[0-9]")
    return F.lit(True)


def running(steps: Column) -> Column:
    """Running sums of an array, a block at a time: appending to an array copies it."""
    zero = F.lit(0).cast("int")
    none = F.array().cast("array<int>")

    def sums(a: Column, first: Column) -> Column:
        start = F.struct(none.alias("out"), first.alias("sum"))
        return F.aggregate(a, start, lambda s, x: F.struct(F.concat(s["out"], F.array(s["sum"] + x)).alias("out"), (s["sum"] + x).alias("sum")), lambda s: s["out"])

    blocks = F.transform(F.sequence(F.lit(1), F.size(steps), F.lit(_BLOCK)), lambda i: F.slice(steps, i, F.lit(_BLOCK)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, x: s + x))
    before = F.concat(F.array(zero), sums(totals, zero))
    return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, first: sums(b, first)))


def with_spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, least: float = LEAST_SCORE) -> DataFrame:
    """docs (text) with a column spans: array of struct(kind, start, end (exclusive), score, base), by kind as listed, then by start."""
    names = docs.columns
    text = free_name(docs, "_text")
    out = docs.withColumn(text, text_of(docs))
    matches, pieces, starts = ({k.name: free_name(docs, f"_{what}_{k.name}") for k in kinds} for what in ("matches", "pieces", "starts"))
    hints = {k.name: F.col(text).contains(k.hint) if k.hint == "@" else F.col(text).rlike(k.hint) for k in kinds}
    out = out.select("*", *(F.when(hints[k.name], F.regexp_extract_all(F.col(text), F.lit(k.pattern), F.lit(int(k.taken > 0)))).otherwise(F.array().cast("array<string>")).alias(matches[k.name]) for k in kinds))
    out = out.select("*", *(F.when(F.size(matches[k.name]) > 0, F.split(F.col(text), k.pattern, -1)).alias(pieces[k.name]) for k in kinds))
    out = out.drop(text)

    def steps(k: Kind) -> Column:
        m, p = F.col(matches[k.name]), F.col(pieces[k.name])
        if k.taken:
            return F.transform(F.slice(p, F.lit(1), F.size(m)), lambda a, i: F.length(a) + F.when(i > 0, k.taken).otherwise(0))
        return F.zip_with(F.slice(p, F.lit(1), F.size(m)), F.slice(F.concat(F.array(F.lit("")), m), F.lit(1), F.size(m)), lambda a, b: F.length(a) + F.length(b))

    out = out.select("*", *(F.when(F.col(pieces[k.name]).isNotNull(), running(steps(k))).alias(starts[k.name]) for k in kinds))
    out = out.withColumns({matches[k.name]: F.transform(matches[k.name], account) for k in kinds if k.taken})

    def spans(k: Kind) -> Column:
        m, p, s = F.col(matches[k.name]), F.col(pieces[k.name]), F.col(starts[k.name])

        def one(match: Column, i: Column) -> Column:
            after = F.substring(F.element_at(p, i + 2), F.length(match) - k.taken + 1, F.lit(AFTER)) if k.taken else F.left(F.element_at(p, i + 2), F.lit(AFTER))
            near = F.concat_ws(" ", F.right(F.element_at(p, i + 1), F.lit(BEFORE)), after)
            score = k.score + F.when(near.rlike(rf"(?i)(?<![a-z])(?:{k.context})"), CONTEXT_BONUS).otherwise(0.0)
            start = F.element_at(s, i + 1)
            return F.struct(F.lit(k.name).alias("kind"), start.alias("start"), (start + F.length(match)).alias("end"), F.least(score, F.lit(1.0)).alias("score"), F.lit(k.base).alias("base"), confirmed(k.name, match).alias("good"))

        kept = F.filter(F.transform(m, one), lambda x: x["good"] & (x["base"] | (x["score"] >= least)))
        bare = F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"), x["base"].alias("base")))
        return F.when(s.isNotNull(), bare).otherwise(F.array().cast(_SPANS))

    def apart(found: Column) -> Column:
        """Without spans that begin within the one before."""
        start = F.struct(F.array().cast(_SPANS).alias("out"), F.lit(0).alias("end"))
        return F.aggregate(found, start, lambda s, x: F.when(x["start"] < s["end"], s).otherwise(F.struct(F.concat(s["out"], F.array(x)).alias("out"), x["end"].alias("end"))), lambda s: s["out"])

    every = F.concat(*(apart(spans(k)) if k.taken else spans(k) for k in kinds))
    return out.select(*(F.col(f"`{c}`") for c in names), every.alias("spans" if "spans" not in names else free_name(docs, "spans")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans."""
    docs = table(spark, sf_dir, "documents")
    found = with_spans(docs.select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k.name) for k in KINDS if k.base), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans"))
