"""Intent of a question: an ordered cascade of rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .keywords import elected

REFUSED = ["PII_ACCOUNT", "MARKET_TIMING", "PERFORMANCE_COMPARISON", "PERFORMANCE_PREDICTION", "ADVICE", "OUT_OF_SCOPE"]


def topic(question: Column, topics: dict[str, list[str]] = R.QUERY_TOPICS) -> Column:
    """Minimum-amount questions first, then the vote; hyphens count as blanks on both sides."""
    low = F.concat(F.lit(" "), F.replace(F.lower(question), F.lit("-"), F.lit(" ")), F.lit(" "))
    amount = low.contains("minimum") & R.contains_any(low, [" lump sum ", "purchase amount", "application amount", "investment amount"])
    return F.when(amount & F.lit("minimum_investment" in topics), "minimum_investment").otherwise(elected(low, topics))


def scheme(question: Column, schemes: dict[str, list[str]] = R.QUERY_SCHEMES) -> Column:
    return R.first_alias(question, schemes)


def classified(question: Column, hard: Column, soft: Column, scheme_: Column, topic_: Column, brand: str = "PLATFORM", brand_hints: tuple[str, ...] = (), scheme_topics: list[str] = R.SCHEME_TOPICS) -> Column:
    """struct(intent, scheme, topic); hard and soft: whether an identifier or an account request was found."""
    low = F.lower(question)

    def hit(pattern: str) -> Column:
        return question.rlike("(?i)" + pattern)

    operational = R.contains_any(low, R.OPERATIONAL_HINTS)
    regulatory = R.contains_any(low, R.REGULATORY_HINTS)
    branded = R.contains_any(low, list(brand_hints))
    has_scheme = scheme_.isNotNull()
    intent = (
        F.when(hard, "PII_ACCOUNT")
        .when(hit(R.MARKET_TIMING), "MARKET_TIMING")
        .when(hit(R.COMPARISON), "PERFORMANCE_COMPARISON")
        .when(hit(R.PREDICTION), "PERFORMANCE_PREDICTION")
        .when(hit(R.ADVICE) & ~hit(R.OPERATIONAL_TIMING), "ADVICE")
        .when(hit(R.OUT_OF_SCOPE) & ~has_scheme & ~operational, "OUT_OF_SCOPE")
        .when(hit(R.HISTORICAL), "HISTORICAL_PERFORMANCE")
        .when(branded & ~soft, f"FACTUAL_{brand}")
        .when(regulatory & ~has_scheme, "FACTUAL_REGULATORY")
        .when(operational, "FACTUAL_OPERATIONAL")
        .when(soft, "PII_ACCOUNT")
        .when(has_scheme, "FACTUAL_SCHEME")
        .when(topic_.isin(scheme_topics), "AMBIGUOUS")
        .when(topic_.isNotNull(), "FACTUAL_REGULATORY")
        .otherwise("AMBIGUOUS")
    )
    default = F.when(intent == "HISTORICAL_PERFORMANCE", F.coalesce(topic_, F.lit("performance_reported"))).when(intent == f"FACTUAL_{brand}", F.coalesce(topic_, F.lit(f"{brand.lower()}_operations"))).otherwise(topic_)
    return F.struct(intent.alias("intent"), scheme_.alias("scheme"), default.alias("topic"))
