"""Conversations: carry-over of entities, gates, evidence, answers, follow-ups, admission."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import straight_quotes, without_urls
from ..sources.shared import ship

TTL_S, THRESHOLD, EVIDENCE, COOLDOWN, PER_MINUTE = 1800, 0.35, 4, 5, 30


def carried(turns: DataFrame, session: str = "session_id", order: str = "turn", ts: str | None = None, ttl: int = TTL_S, value: str = "scheme", remembered: str = "remembered", wants: Column | None = None) -> DataFrame:
    """Adds <value>_used: a turn's own value, or where it has none (and wants one) the last remembered one of its session.

    With a time the memory lasts ttl seconds after the turn that last refreshed it (a gap of exactly ttl still counts); turns that don't refresh
    don't prolong it. Times count to the nearest second, halves to the even one. Each remembered turn refreshes; one without a value keeps what was there.
    Windows are by session.
    """
    w = Window.partitionBy(session).orderBy(*([ts] if ts else []), order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    lead = turns
    if ts:
        seconds = F.rint(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).cast("long")
        at = F.when(F.col(remembered), seconds)
        lead = lead.withColumn("_at", at).withColumn("_last", F.last("_at", True).over(before))
        # a new memory begins where the last refresh is too old
        lead = lead.withColumn("_new", (F.coalesce(seconds - F.col("_last") > ttl, F.lit(False))).cast("int")).withColumn("_memory", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        before = Window.partitionBy(session, "_memory").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    held = F.last(F.when(F.col(remembered), F.nullif(F.col(value), F.lit(""))), True).over(before)
    own = F.nullif(F.col(value), F.lit(""))
    want = F.lit(True) if wants is None else wants
    return lead.withColumn(f"{value}_used", F.coalesce(own, F.when(want, held))).select(*turns.columns, f"{value}_used")


def gated(ranked: DataFrame, query_key: str = "query_id", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each query: whether its first row by rank, not its nearest, passes the threshold."""
    best = ranked.groupBy(query_key).agg(F.min_by("similarity", "rank").alias("top_similarity"))
    return best.withColumn("has_evidence", F.col("top_similarity") >= threshold)


def evidence(ranked: DataFrame, query_key: str = "query_id", scheme: str = "scheme", query_scheme: str = "q_scheme", n: int = EVIDENCE) -> DataFrame:
    """Of the first n by rank those of the query's scheme, then those of none; place 1 is cited."""
    own = F.nullif(F.col(scheme), F.lit(""))
    top = ranked.where(F.col("rank") <= n)
    kept = top.where(F.col(query_scheme).isNull() | own.isNull() | (own == F.col(query_scheme)))
    neutral = F.when(F.col(query_scheme).isNull(), F.lit(False)).otherwise(own.isNull())
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(query_key).orderBy(neutral, "rank")))


def citation(title: Column, section: Column, url: Column, page: Column, source: Column) -> Column:
    return F.struct(F.coalesce(F.nullif(title, F.lit("")), section).alias("title"), url.alias("url"), page.alias("page"), source.alias("source_id"))


def contexts(found: DataFrame, query_key: str = "query_id", text: str = "chunk_text", title: str = "title", page: str = "page_number") -> DataFrame:
    """query -> context: its evidence (a handful of chunks) in order, each headed by title and page."""
    piece = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" (page "), F.coalesce(F.col(page).cast("string"), F.lit("None")), F.lit(")\n"), F.coalesce(F.col(text), F.lit("")))
    items = F.array_sort(F.collect_list(F.struct("place", piece.alias("t"))))
    return found.groupBy(query_key).agg(F.array_join(F.transform(items, lambda x: x["t"]), "\n\n---\n\n").alias("context"))


def not_found(answer: Column, pattern: str = R.NO_EVIDENCE) -> Column:
    return straight_quotes(answer).rlike(pattern)


def outcome(intent: Column, hard: Column, refused_intents: list[str], has_evidence: Column, mismatch: Column, answer: Column, failed: Column | None = None, gone: Column | None = None) -> Column:
    """struct(refused, refusal_type, cited, remembered) of a turn, first rule that holds. failed: whether what the answer depends on failed (ERROR, a row like any other); gone: not_found(answer), where it is known already."""
    failed = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    refused = hard | intent.isin(refused_intents)
    none = F.lit(None).cast("string")
    ambiguous = intent == "AMBIGUOUS"
    gone = not_found(F.coalesce(answer, F.lit(""))) if gone is None else F.coalesce(gone, F.lit(False))

    def row(r, kind, cited, kept) -> Column:
        return F.struct(F.lit(r).alias("refused"), (kind if isinstance(kind, Column) else F.lit(kind)).cast("string").alias("refusal_type"), F.lit(cited).alias("cited"), F.lit(kept).alias("remembered"))

    return (
        F.when(refused, row(True, F.when(hard, "PII_ACCOUNT").otherwise(intent), False, True))
        .when(failed, row(False, "ERROR", False, False))
        .when(~has_evidence, row(False, "NO_EVIDENCE", False, False))
        .when(mismatch, row(False, "SCHEME_MISMATCH", False, False))
        .when(gone & ambiguous, row(False, "NO_EVIDENCE", False, False))
        .otherwise(row(False, none, True, True))
    )


def smoke_status(refused: Column, refusal_type: Column, answer: Column, url: Column) -> Column:
    """What a smoke run reports of a response, by its first 180 characters; a null answer failed."""
    said = F.lower(F.substring(answer, 1, 180))
    return (
        F.when(answer.isNull(), "FAILED")
        .when(refused, F.concat(F.lit("REFUSED/"), F.coalesce(refusal_type, F.lit("None"))))
        .when(said.contains("couldn"), "NOT_FOUND")
        .when(F.coalesce(url, F.lit("")) != "", "OK")
        .otherwise("NO-SOURCE")
    )


def generated(context: Column, question: Column, call: Callable[[str, str, str], str], models: list[str], attempts: int = 3, longest_wait: float = 20.0, at_once: int = 8) -> Column:
    """struct(answer, model, error) by an outside generator, call(model, context, question), in Arrow batches, so many rows of a task at once, each in a thread.

    Models are tried in order. A RateLimited is tried again up to so many times after the wait it asks for, clamped to longest_wait; any other exception
    ends that row with the exception's name in error, and no answer: failures are rows, not failed jobs. For many rows see generated_in_rounds.
    """
    ship()

    @F.pandas_udf("answer string, model string, error string")
    def ask(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for contexts_, questions in parts:
                found = pool.map(lambda c, q: _asked(call, models, c, q, attempts, longest_wait), contexts_, questions)
                yield pd.DataFrame(list(found), columns=["answer", "model", "error"])

    return ask(context, question)


def generated_in_rounds(rows: DataFrame, key: str, call: Callable[[str, str, str], str], models: list[str], path: str, attempts: int = 3, longest_wait: float = 20.0, at_once: int = 8, rounds: int | None = None) -> DataFrame:
    """rows (key, context, question) -> key, answer, model, error, by the generator of generated(), asked in rounds whose results are kept at path.

    A round asks each row that is still open once: with the first model, or, where that was limited `attempts` times, the next. What it answers, or what
    fails otherwise than by a limit, is done; its rows are written before the next round, so no loss and no new start asks them again: a call with the path of an
    earlier one goes on where that ended. No task waits; between rounds the driver waits as long as was asked for, at most longest_wait. rounds: how
    many to make at most (by default all that may be needed); rows that are open then, or have no model left, have the error RateLimited.
    """
    spark = rows.sparkSession
    ship(spark)
    out = f"{key} {dict(rows.dtypes)[key]}, answer string, model string, error string, wait double, tries int"

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(k, context, question, tries) -> tuple:
            model = models[tries // attempts]
            try:
                return k, call(model, context, question), model, None, None, tries + 1
            except RateLimited as x:
                return k, None, model, "RateLimited", max(float(x.wait), 0.0), tries + 1
            except Exception as x:
                return k, None, model, type(x).__name__, None, tries + 1

        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                yield pd.DataFrame(list(pool.map(one, pdf[key], pdf["context"], pdf["question"], pdf["_tries"])), columns=[key, "answer", "model", "error", "wait", "tries"])

    most, made = attempts * len(models), 0
    kept = rows.select(key, "context", "question")

    def state() -> DataFrame:
        """The last that is known of each row that was asked."""
        try:
            said = spark.read.schema(out).parquet(path)
        except AnalysisException as x:
            if x.getCondition() != "PATH_NOT_FOUND":
                raise
            said = spark.createDataFrame([], out)
        return said.groupBy(key).agg(F.max_by(F.struct("answer", "model", "error", "wait", "tries"), "tries").alias("s")).select(key, "s.*")

    while rounds is None or made < rounds:
        known = state()
        limited = (F.col("error") == "RateLimited") & (F.col("tries") < most)
        open_ = kept.join(known.select(key, "error", "wait", "tries"), key, "left").where(F.col("tries").isNull() | limited)
        count, wait = open_.agg(F.count("*"), F.max("wait")).first()
        if not count:
            break
        if wait:
            time.sleep(min(wait, longest_wait))
        open_.select(key, "context", "question", F.coalesce("tries", F.lit(0)).alias("_tries")).mapInPandas(ask, out).write.mode("append").parquet(path)
        made += 1
    done = state().select(key, "answer", F.when(F.col("answer").isNotNull() | (F.col("error") != "RateLimited"), F.col("model")).alias("model"), "error")
    return kept.select(key).join(done, key, "left").withColumn("error", F.when(F.col("answer").isNull(), F.coalesce("error", F.lit("RateLimited"))))


class RateLimited(Exception):
    """Raised by a generator that wants to be asked again after `wait` seconds."""

    def __init__(self, wait: float = 1.0):
        super().__init__(wait)
        self.wait = wait


def _asked(call, models: list[str], context: str, question: str, attempts: int, longest_wait: float) -> tuple:
    error = "no model"
    for model in models:
        for _ in range(attempts):
            try:
                return call(model, context, question), model, None
            except RateLimited as x:
                error = "RateLimited"
                time.sleep(min(max(x.wait, 0.0), longest_wait))
            except Exception as x:
                return None, model, type(x).__name__
    return None, None, error


def cleaned_answer(answer: Column) -> Column:
    return without_urls(answer)


# Questions to offer by topic, and the sentence before them.
TEMPLATES = {
    "expense_ratio": "What is the expense ratio of {scheme}?", "exit_load": "Do you want to know about the exit load of {scheme}?", "benchmark": "What is the benchmark of {scheme}?", "minimum_investment": "What is the minimum investment for {scheme}?",
    "fund_manager": "Who is the fund manager of {scheme}?", "tracking_error": "What is the tracking error of {scheme}?", "asset_allocation": "What is the asset allocation of {scheme}?", "investment_objective": "What is the investment objective of {scheme}?",
    "investment_strategy": "What is the investment strategy of {scheme}?", "lock_in": "What is the lock-in period of {scheme}?", "plans_options": "What plans and options does {scheme} offer?", "replication": "Does {scheme} use full replication?", "riskometer": "What is the riskometer level of {scheme}?",
}
TEMPLATE, INVITATION = "Tell me about {scheme}", "You could also ask about a specific scheme:"


def suggestions(topic: Column, templates: dict[str, str] = TEMPLATES, schemes: list[str] | None = None, default: str = TEMPLATE, n: int = 3) -> Column:
    """An invitation and one question for each of the first n schemes, by the topic's template."""
    names = (list(R.QUERY_SCHEMES) if schemes is None else schemes)[:n]
    template = F.coalesce(R.lookup(templates, topic), F.lit(default))
    return F.concat_ws("\n", F.lit(INVITATION), *(F.concat(F.lit("- "), F.replace(template, F.lit("{scheme}"), F.lit(s))) for s in names))


def follow_ups(answers: DataFrame, clicks: DataFrame, offers: DataFrame, session: str = "session_id", cooldown: int = COOLDOWN, n: int = 3) -> DataFrame:
    """offers (scheme, position, topic, question) for each session's last scheme and topic: not its current topic, none clicked until cooldown answers followed, the click's own first.

    answers: session_id, turn, scheme, topic, is_error; clicks: session_id, turn, question.
    """
    now = answers.where("not is_error").groupBy(session).agg(F.max_by(F.struct("scheme", "topic"), "turn").alias("now")).select(session, "now.scheme", F.col("now.topic").alias("_topic"))
    # clicks and answers of a session in one order, answers behind the clicks of their turn: a click's answers are those from it to the end
    both = answers.where("not is_error").select(session, "turn", F.lit(None).cast("string").alias("question"), F.lit(1).alias("_answer")).unionByName(clicks.select(session, "turn", "question", F.lit(0).alias("_answer")))
    onward = Window.partitionBy(session).orderBy("turn", "_answer").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    hidden = both.withColumn("_n", F.sum("_answer").over(onward)).where((F.col("_answer") == 0) & (F.col("_n") < cooldown)).select(session, "question").distinct()
    open_ = now.join(offers, "scheme").where(~F.col("topic").eqNullSafe(F.col("_topic"))).join(hidden, [session, "question"], "left_anti")
    return open_.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy("position"))).where(F.col("place") <= n).drop("_topic")


def admitted(requests: DataFrame, client: str, ts: str, order: str, limit: int = PER_MINUTE) -> DataFrame:
    """Adds minute and admitted: the first `limit` requests of each client and minute. Windows are by client and minute."""
    minute = F.date_trunc("minute", F.col(ts))
    out = requests.withColumn("minute", minute)
    return out.withColumn("admitted", F.row_number().over(Window.partitionBy(client, "minute").orderBy(ts, order)) <= limit)
