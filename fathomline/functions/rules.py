"""Rule data of the fund-document domain. Every function that uses it takes its rules as a parameter, so another domain needs other data only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, aliases, keywords, patterns, weights and limits that results depend on, in the order that decides ties.
QUERY_SCHEMES = {
    "HDFC FlexiCap Fund": ["flexicap", "flexi cap", "flexi-cap"],
    "HDFC Small Cap Fund": ["small cap fund", "smallcap", "small-cap"],
    "HDFC Large and Mid Cap Fund": ["large and mid cap", "large & mid cap", "large-mid cap", "large midcap"],
    "HDFC Index Fund - Nifty 50 Plan": ["index fund nifty 50", "nifty 50 plan", "nifty50 index fund", "nifty 50 index fund"],
    "HDFC ELSS Tax Saver Fund": ["elss tax saver", "tax saver fund", "elss fund", "hdfc elss"],
}
DOCUMENT_SCHEMES = {
    "HDFC FlexiCap Fund": ["flexi cap", "flexicap", "hdfc flexi"],
    "HDFC Small Cap Fund": ["small cap", "smallcap", "hdfc small"],
    "HDFC Large and Mid Cap Fund": ["large and mid cap", "large & mid cap", "large-mid", "hdfc large and mid"],
    "HDFC Index Fund - Nifty 50 Plan": ["nifty 50 index", "nifty50 index", "index fund - nifty 50", "hdfc nifty 50"],
    "HDFC ELSS Tax Saver Fund": ["elss tax saver", "elss", "taxsaver", "hdfc elss"],
}
ORGANIZATIONS = {"SEBI": ["sebi"], "AMFI": ["amfi"]}
DEFAULT_ORGANIZATION = "HDFC Mutual Fund"
DOCUMENT_TYPES = [
    ("sid", "SID"), ("kim", "KIM"), ("fund facts", "FACTSHEET"), ("factsheet", "FACTSHEET"), ("leaflet", "LEAFLET"), ("presentation", "PRESENTATION"), ("latestnav", "NAV_DATA"), ("nav report", "NAV_DATA"),
    ("average aum", "AUM_DATA"), ("aum", "AUM_DATA"), ("faq", "FAQ_DATASET"), ("ter", "TER_DATA"), ("total expense", "TER_DATA"), ("addendum", "ADDENDUM"), ("form", "FORM"),
]
QUERY_TOPICS = {
    "expense_ratio": ["expense ratio", "ter", "total expense", "management fee", "recurring expense", "charges for managing", "direct vs regular ter"],
    "exit_load": ["exit load", "exit charge", "redemption charge", "cdsc"],
    "benchmark": ["benchmark", "index tracked", "tier i benchmark"],
    "minimum_investment": ["minimum sip", "minimum lump", "minimum investment", "minimum application", "minimum purchase", "minimum amount"],
    "fund_manager": ["fund manager", "who manages", "managed by", "fund management"],
    "tracking_error": ["tracking error", "tracking difference"],
    "asset_allocation": ["asset allocation", "allocation pattern", "equity exposure", "how much in equity", "small cap allocation"],
    "investment_objective": ["investment objective", "objective of", "aim of the fund", "what is the fund for"],
    "investment_strategy": ["investment strategy", "investment approach", "how does the fund invest", "where does it invest"],
    "lock_in": ["lock-in", "lock in period", "locked in", "withdraw before 3 years", "redeem before 3 years", "3-year lock"],
    "plans_options": ["direct plan", "regular plan", "growth option", "idcw", "dividend option", "payout option", "plans and options"],
    "replication": ["replication", "sampling method", "full replication"],
    "riskometer": ["riskometer", "risk-o-meter", "risk o meter", "risk meter", "risk level of", "very high risk"],
    "sip": ["sip", "systematic investment plan", "start a sip", "stop a sip", "cancel sip", "pause sip", "modify sip", "sip date"],
    "redemption": ["redeem", "redemption", "withdraw money", "withdrawal", "sell units", "swp"],
    "purchase": ["lump sum", "purchase", "buy units", "subscribe", "invest amount"],
    "switch": ["switch", "switching"],
    "cutoff_time": ["cut-off", "cutoff", "nav applicability", "applicable nav", "what time"],
    "folio_statement": ["account statement", "cas", "consolidated account statement", "statement of account", "capital gains statement", "tax certificate", "folio number forgotten", "forgot my folio"],
    "tax_capital_gains": ["capital gains tax", "ltcg", "stcg", "tax on mutual funds", "taxation"],
    "tax_80c": ["80c", "tax saving", "tax benefit", "section 80c"],
    "stamp_duty": ["stamp duty", "stt", "transaction charge"],
    "elss": ["elss", "equity linked savings"],
    "categorization": ["sebi categorization", "scheme category", "open ended", "closed ended", "multi cap", "flexi cap fund category"],
    "scores": ["scores", "grievance", "complaint against amc", "ogms"],
    "charges_fees": ["charges", "fees", "costs", "levies", "commission", "platform fee"],
    "orders": ["order status", "order history", "transaction history", "where can i see my orders"],
    "payment": ["payment methods", "upi", "netbanking", "net banking", "payment options"],
    "performance_reported": ["historical performance reported", "returns reported", "performance reported in", "factsheet show", "as per factsheet", "as per sid"],
    "aum": ["aum", "assets under management"],
    "nav_value": ["current nav", "latest nav", "today's nav"],
}
CHUNK_TOPICS = {
    "investment_objective": ["investment objective", "objective of the scheme"],
    "investment_strategy": ["investment strategy", "investment approach", "where will the scheme invest", "portfolio strategy"],
    "asset_allocation": ["asset allocation", "indicative asset allocation", "pattern of allocation"],
    "minimum_investment": ["minimum application amount", "minimum amount", "minimum purchase", "minimum investment"],
    "sip": ["systematic investment plan", "sip", "sip facility", "sip details", "starting an sip", "modifying an sip"],
    "expense_ratio": ["total expense ratio", "ter", "expense ratio", "recurring expenses", "management fees"],
    "exit_load": ["exit load", "exit charge", "contingent deferred sales charge", "cdsc", "load structure", "type of load"],
    "benchmark": ["benchmark", "tier i benchmark", "tier ii benchmark"],
    "riskometer": ["riskometer", "risk-o-meter", "risk o meter", "scheme riskometer", "potential risk class"],
    "fund_manager": ["fund manager", "fund management team", "managed by", "name of the fund manager"],
    "tracking_error": ["tracking error", "tracking difference"],
    "replication": ["replication", "sampling", "full replication"],
    "lock_in": ["lock-in", "lock in period", "locked-in"],
    "plans_options": ["plans and options", "options offered", "growth option", "idcw", "direct plan", "regular plan", "plans & options"],
    "nav": ["net asset value", "nav applicability", "applicable nav"],
    "aum": ["assets under management", "aum"],
    "redemption": ["redemption", "repurchase", "withdrawal", "swp", "systematic withdrawal"],
    "purchase": ["purchase", "subscription", "lump sum", "application amount"],
    "switch": ["switch", "switching"],
    "cutoff_time": ["cut-off timing", "cutoff timing", "cut off timing", "cut-off time", "business day"],
    "folio_statement": ["folio", "account statement", "consolidated account statement", "cas", "statement of account"],
    "tax_capital_gains": ["capital gains", "capital gain", "taxation", "tax treatment", "tds"],
    "tax_80c": ["section 80c", "80c", "tax benefit", "income tax act"],
    "stamp_duty": ["stamp duty", "stt", "securities transaction tax"],
    "elss": ["elss", "equity linked savings", "tax saver"],
    "categorization": ["categorization", "categorisation", "sebi circular", "scheme categorization"],
    "scores": ["scores", "grievance redressal", "complaint", "ogms"],
    "charges_fees": ["charges", "fees", "load structure", "transaction charges", "statutory levy"],
    "performance": ["performance", "returns since inception", "cagr", "absolute return", "compound annualized return"],
}
SCHEME_TOPICS = ["expense_ratio", "exit_load", "benchmark", "minimum_investment", "fund_manager", "tracking_error", "asset_allocation", "investment_objective", "investment_strategy", "lock_in", "plans_options", "replication", "riskometer"]
REGULATORY_HINTS = ["sebi", "amfi", "regulation", "categorization", "riskometer definition", "what is cas", "stamp duty", "80c", "elss lock-in", "scores", "direct vs regular", "growth vs idcw", "what is idcw", "idcw meaning", "capital gains tax", "ltcg", "stcg", "tax rate"]
OPERATIONAL_HINTS = ["how do i", "how can i", "process to", "steps to", "download", "statement", "cut-off", "when will nav apply", "settlement", "documents required", "will i receive", "track my", "how long before", "how many days before"]
ADVICE = (
    r"\b(should i|which fund|which one|best fund|best scheme|safest|recommend|suggest me|for my (goal|retirement|child|future)|good investment for me|choose for|invest in\?|better than|top fund|ideal fund|suitable for me|"
    r"which\s+hdfc\s+mutual\s+fund|mutual fund is best|is best for me|best (platform|broker|app)|better (platform|broker|app)|which platform)\b"
)
PREDICTION = r"\b(will .{0,40}(return|give|deliver|yield)|next year|future return|expected return|predict|forecast|how much (will|can) i (make|earn)|15%|20%|doubles? by)\b"
COMPARISON = (
    r"\b(which|what).{0,60}\b(performed best|perform(ed)? better|highest return|best past|compare.{0,30}(returns?|funds?|schemes?)|ranking|rank the|versus each other|vs each other)\b"
    r"|\b(calculate|compute).{0,40}(compare|comparison|which.{0,30}better)|\bcompare\b.{0,60}\b(returns?|funds?|schemes?)\b|highest returns?\b"
)
MARKET_TIMING = r"\b(market is down|market is up|market falls|market crash|good time to invest|right time to|time the market|because the market|is now a good time|should i stop|should i start.*(now|today))\b"
HISTORICAL = r"\b(historical performance|returns? (reported|shown|published)|what (returns|performance).{0,40}(report|show|publish|state)|(factsheet|fact sheet|sid|kim).{0,40}(return|performance|cagr))\b"
OUT_OF_SCOPE = r"\b(stocks?|shares?|trading|crypto|bitcoin|insurance|term plan|fd rates?|fixed deposit|loan|credit card|demat charges|ipo|commodity|gold price|weather|cricket|movie)\b"
OPERATIONAL_TIMING = r"how (?:long|many days)\s+(?:before|prior|in advance)"
NOISE_LINES = [r"^disclaimer.*", r"^mutual fund investments are subject to market risks.*", r"^read all scheme related documents carefully.*", r"^visit us at .*", r"^www\.hdfcfund\.com.*", r"^customer service.*", r"^toll free.*", r"^\s*cin:.*", r"^registered office.*", r"^hdfc mutual fund.*hdfc house.*", r"^continued\s*\.{3,}$"]
HEADINGS = [
    "investment objective", "investment strategy", "asset allocation pattern", "asset allocation", "exit load", "total expense ratio", "benchmark", "riskometer", "fund manager", "fund managers", "lock-in", "plans and options", "options available",
    "minimum application amount", "redemption", "switch", "taxation", "load structure", "fundamentals of the scheme", "features of the scheme", "scheme information", "constitution of hdfc mutual fund", "due diligence", "definition of terms",
    "transaction details", "general information", "how to apply", "rights of unitholders", "significant accounting policies", "risk factors", "special considerations", "portfolio disclosure", "computational methodology", "fees and expenses", "indian taxation",
]
PREFERRED = {
    "FACTUAL_SCHEME": (["HDFC Mutual Fund"], ["SID", "KIM", "FACTSHEET", "TER_DATA", "NAV_DATA", "AUM_DATA", "LEAFLET"]),
    "HISTORICAL_PERFORMANCE": (["HDFC Mutual Fund"], ["FACTSHEET", "PRESENTATION", "SID"]),
    "FACTUAL_REGULATORY": (["SEBI", "AMFI"], ["FAQ_DATASET", "REGULATORY_FAQ", "TER_DATA"]),
    "FACTUAL_OPERATIONAL": (["HDFC Mutual Fund", "AMFI"], ["SID", "FAQ_DATASET", "KIM"]),
    "AMBIGUOUS": (["SEBI"], ["FAQ_DATASET"]),
}
RELATED_TOPICS = {"minimum_investment": ["sip", "purchase"], "sip": ["minimum_investment", "purchase"], "purchase": ["minimum_investment", "sip"]}
ORGANIZATION_RANK = {"HDFC Mutual Fund": 0.9, "SEBI": 0.8, "AMFI": 0.7}
WEIGHTS = {"similarity": 0.55, "scheme": 0.18, "topic": 0.14, "source": 0.08, "freshness": 0.05, "overlap": 0.10}
STOPWORDS = ["what", "which", "who", "whose", "when", "where", "why", "how", "is", "are", "was", "were", "the", "for", "and", "with", "does", "do", "did", "can", "could", "will", "would", "this", "that", "these", "those", "its", "it", "their", "there", "about", "into", "from"]
EXPANSIONS = {
    "asset_allocation": "stated asset allocation pattern equity debt securities money market instruments percentage of net assets",
    "riskometer": "risk-o-meter six levels of risk low to moderate moderate high very high product labeling cycle",
    "aum": "average assets under management AUM AMFI monthly average crore folio count",
    "minimum_investment": "minimum application amount lump sum purchase minimum investment",
    "lock_in": "lock-in period statutory lock-in redemption of units",
    "expense_ratio": "total expense ratio TER direct plan regular plan recurring expenses",
    "exit_load": "entry load exit load load structure contingent deferred sales charge",
    "tax_capital_gains": "capital gains statement download tax P&L realised gains report",
    "folio_statement": "folio number consolidated account statement CAS download",
    "stamp_duty": "stamp duty applicable on purchase SIP installment transaction",
    "tax_80c": "section 80C income tax deduction ELSS tax saving limit",
    "sip": "systematic investment plan SIP installment cancel modify pause",
    "redemption": "redemption withdrawal payout settlement bank account",
}
#: A disclosure that lists one scheme a line: its file, the token of its rows, and header, section and topic of their chunks.
ROW_DISCLOSURE = {
    "file": "riskometer", "token": "HDFC", "header": "HDFC Mutual Fund Annual Disclosure of Risk-o-meters as at March 31, 2026 (Risk-o-meter levels as per SEBI Master Circular)",
    "title": "Risk-o-meter Disclosure", "topic": "riskometer",
}
NO_EVIDENCE = (
    r"(?i)could(?:n'?t| not) (?:be )?(?:found|determined)|could(?:n'?t| not) (?:find|locate)|not (?:available|contained|mentioned|provided|disclosed|specified|stated) in|"
    r"do(?:es)? not (?:specify|state|mention|include)|isn'?t available in|no (?:information|evidence|details)|information you'?re looking for"
)


def lookup(mapping: dict, key: Column) -> Column:
    """mapping[key], null where it has none."""
    if not mapping:
        return F.lit(None)
    return F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))[key]


def contains_any(text: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


def first_alias(text: Column, rules: dict[str, list[str]], default: str | None = None) -> Column:
    """The first name one of whose aliases the lower-case text contains."""
    low, out = F.lower(text), None
    for name, aliases in rules.items():
        hit = contains_any(low, aliases)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def organization(text: Column, rules: dict[str, list[str]] = ORGANIZATIONS, default: str = DEFAULT_ORGANIZATION) -> Column:
    return first_alias(text, rules, default)


def first_needle(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    low, out = F.lower(text), None
    for needle, name in rules:
        hit = low.contains(needle)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def quoted(word: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in word)


def bounded(word: str) -> str:
    """A pattern for word between characters that belong to no word. The word comes first, so places where it isn't are left at once."""
    q = quoted(word)
    return rf"{q}(?<![\p{{L}}\p{{N}}_]{q})(?![\p{{L}}\p{{N}}_])"


def votes(text: Column, rules: dict[str, list[str]], hint: Column | None = None) -> Column:
    """Array of struct(score, tie, topic): bounded keyword hits, three times as many where one is in the hint too.

    The rules are data of one narrow expression, whose size doesn't grow with them; text and hint are evaluated once a row. No shuffle.
    """
    table = F.array(*(
        F.struct(F.lit(-k).alias("tie"), F.lit(topic).alias("topic"), F.array(*(F.struct(F.lit(w).alias("word"), F.lit(bounded(w)).alias("shape")) for w in (x.strip().replace("-", " ") for x in words))).alias("words"))
        for k, (topic, words) in enumerate(rules.items())
    ))

    def over(t: Column, h: Column | None) -> Column:
        def one(rule: Column) -> Column:
            # most words aren't in most texts, which a plain search tells sooner than an expression
            hits = F.aggregate(rule["words"], F.lit(0).cast("long"), lambda s, x: s + F.when(t.contains(x["word"]), F.regexp_count(t, x["shape"])).otherwise(0))
            if h is not None:
                hits = hits * F.when(F.exists(rule["words"], lambda x: h.contains(x["word"]) & F.regexp_like(h, x["shape"])), 3).otherwise(1)
            return F.struct(hits.alias("score"), rule["tie"].alias("tie"), rule["topic"].alias("topic"))

        return F.transform(table, one)

    if hint is None:
        return F.transform(F.array(text), lambda t: over(t, None))[0]
    return F.transform(F.array(F.struct(text.alias("t"), hint.alias("h"))), lambda x: over(x["t"], x["h"]))[0]


def elected(text: Column, rules: dict[str, list[str]], default: str | None = None, hint: Column | None = None) -> Column:
    """The topic with most hits, the first of equals; default if there is no hit."""
    best = F.array_max(votes(text, rules, hint))
    return F.when(best["score"] > 0, best["topic"]).otherwise(F.lit(default))
