"""Screening of questions for personal data, by rule tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import contains_any

# Patterns in the order in which categories are reported, and phrases of account requests.
PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
AADHAAR = r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"
AADHAAR_WORD = r"(?i)\baadhaar|aadhar\b"
OTP = r"(?i)\b(otp|one[\s-]?time\s*password|verification\s*code)\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+?91[\s-]?)?\b[6-9]\d{2}[\s-]?\d{3}[\s-]?\d{4}\b|\b0[6-9]\d{2}[\s-]?\d{3}[\s-]?\d{4}\b"
BANK_ACCOUNT = r"(?i)\b(?:account|acct|a\/c|bank)\b[\w\s]{0,15}?(?:is|:|-|#)?[\s.:-]{0,4}(\d{9,18})\b"
FOLIO = r"(?i)\b(?:folio|follio)\b(?:[\s:.:-]{0,3}(?:no|number|num|#|is)\b)*[\s:.:-]{0,3}(?=[A-Za-z0-9/\-]*\d)([A-Za-z0-9][A-Za-z0-9/\-]{5,20})\b"
CARD = r"\b(?:\d{4}[\s-]?){3}\d{1,7}\b"
CREDENTIAL = r"(?i)\b(password|passcode|username|login id|user id|pin)\b[\s:=]+\S+"
ACCOUNT_PHRASES = ["my balance", "my holdings", "my portfolio", "my account", "my statement", "show my", "check my", "my folio", "my pan", "my investment status", "order status for my", "units held by me", "my nav", "account number", "fund balance", "show me my", "tell me my"]
ACCOUNT_NOUN = r"(?i)\b(my|mine|me)\b[^.?!]{0,40}\b(balance|holdings|portfolio|statement|folio|account|investments|units)\b"
HARD = ["pan", "aadhaar", "otp", "email", "phone", "bank_account", "folio", "card", "credential"]
CLIENT = {"pan": PAN, "aadhaar": AADHAAR, "email": EMAIL, "phone": r"\b(?:\+?91[\s-]?)?[6-9]\d{9}\b", "otp": r"(?i)\botp\b"}
#: Keys that a log may hold.
LOGGED = ["question_hash", "intent", "source_id", "scheme", "topic", "count", "file_name"]
MARK = "[redacted]"


def rule_categories(c: Column, rules: dict[str, str]) -> Column:
    """Names of the rules whose pattern is in the text, in order."""
    return F.array_compact(F.array(*(F.when(c.rlike(p), name) for name, p in rules.items())))


def categories(c: Column) -> Column:
    """What a question gives away, in fixed order. Twelve digits are an identity number unless they belong to a card's. The text is evaluated once a row.

    An expression runs only over texts with something that it can't match without: a plain search, or one joint test of digits, comes before it.
    """

    def found(x: Column) -> Column:
        t, low, digits = x["text"], x["low"], x["digits"]
        has = lambda *words: contains_any(low, list(words))
        like = lambda hint, pattern: hint & F.regexp_like(t, F.lit(pattern))
        request = F.exists(F.array(*map(F.lit, ACCOUNT_PHRASES)), lambda p: low.contains(p)) | like(has("balance", "holdings", "portfolio", "statement", "folio", "account", "investments", "units"), ACCOUNT_NOUN)
        twelve = x["many"] & F.regexp_like(F.regexp_replace(t, "[A-Za-z]", ""), F.lit(AADHAAR)) & ~F.regexp_like(t, F.lit(CARD))
        rules = [
            ("pan", like(digits, PAN)), ("aadhaar", like(has("aadhaar", "aadhar"), AADHAAR_WORD) | twelve), ("otp", like(has("otp", "password", "verification"), OTP)), ("email", like(t.contains("@"), EMAIL)), ("phone", like(digits, PHONE)),
            ("bank_account", like(digits & has("account", "acct", "a/c", "bank"), BANK_ACCOUNT)), ("folio", like(has("folio", "follio"), FOLIO)), ("credential", like(has("password", "passcode", "username", "login id", "user id", "pin"), CREDENTIAL)), ("account_request", request),
        ]
        return F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules)))

    # four digits in a row, and twelve digits in all: letters may stand between the latter
    once = F.array(F.struct(c.alias("text"), F.lower(c).alias("low"), F.regexp_like(c, F.lit("[0-9]{4}")).alias("digits"), F.regexp_like(c, F.lit("[0-9](?:[^0-9]*+[0-9]){11}")).alias("many")))
    return F.transform(once, found)[0]


def client_blocked(c: Column, rules: dict[str, str] = CLIENT) -> Column:
    """Whether a client keeps the text back before it is sent: any of its own, coarser patterns."""
    return F.size(rule_categories(c, rules)) > 0


def loggable(fields: Column, allowed: list[str] = LOGGED) -> Column:
    """A map without the keys that a log may not hold."""
    return F.map_filter(fields, lambda k, v: k.isin(allowed))


def is_hard(found: Column) -> Column:
    return F.arrays_overlap(found, F.array(*map(F.lit, HARD)))


def scrubbed(c: Column, n: int = 200) -> Column:
    """Identifiers replaced by a mark, the first n characters kept."""
    for p in (PAN, EMAIL, CARD, r"\b\d{12}\b", PHONE):
        c = F.regexp_replace(c, p, MARK.replace("[", "\\[").replace("]", "\\]"))
    return F.substring(c, 1, n)
