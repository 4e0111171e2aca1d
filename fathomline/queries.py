"""Queries over the driver's tables, one or more for each operator, with the DuckDB SQL of the same result.

The tables' prose is invented, so rule tables of the fund domain match nothing there: queries over them take the vocabulary below. Questions of the
fund domain are a fixture of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import intent as I
from .functions import keywords
from .functions import personal as P
from .functions import rules as R
from .functions import text as X
from .operators import converse, corpus, evaluate, rerank, retrieve
from .sources import files
from .sources.shared import scratch
from .streaming import session

TOPICS = {"english": ["the", "that", "with"], "french": ["de", "la", "les"], "german": ["der", "die", "und"], "license": ["license", "licensed"]}
SCHEMES = {"Alpha": ["licensed", "copyright"], "Beta": ["the "], "Gamma": ["de la", "des "], "Delta": ["und "]}
TYPES = [("gnu", "GPL"), ("apache", "APACHE"), ("password", "SECRET"), ("the", "ENGLISH"), ("der", "GERMAN"), ("la", "ROMANCE")]
PERSONAL = {"email": P.EMAIL, "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "number": r"\b[0-9]{16}\b", "phone": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "secret": r"(?i)\b(password|token)\s*=\s*\S+"}
QUESTIONS = [
    "What is the expense ratio of the flexi cap fund?", "Should I invest in the small cap fund now?", "Which fund performed best last year?", "Will this fund double by next year?", "How do I download my capital gains statement?", "What is the weather today?",
    "My PAN is ABCDE1234F, show holdings", "What is the exit load?", "What is the lock-in of the ELSS tax saver?", "Is it a good time to invest?", "How long before my SIP date should I cancel the SIP?", "What is stamp duty?", "Show my balance", "What is the minimum lump sum purchase amount?",
    "What does SEBI say on riskometer definition?", "Are historical performance figures in the factsheet?", "Hello there", "Can I pay by UPI?", "Compare the returns of two schemes", "What is a folio number?", "Who manages the nifty 50 index fund?", "Do I need crypto?", "Tell me my units", "password: hunter2 what is my nav",
]
AS_OF = "2024-01-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case(rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {quote(name)}" for cond, name in rules) + f" ELSE {default} END"


# ---- retrieval

UNITS = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings"
SIM = "round(list_cosine_similarity(a.e, b.e), 6)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id")


def _first_vector(v: DataFrame) -> list[float]:
    return v.where("chunk_id = 0").first()["embedding"]


@query(f"WITH u AS ({UNITS}) SELECT a.vec_id AS chunk_id, a.label, {SIM} AS similarity FROM u a, u b WHERE b.vec_id = 0 AND list_cosine_similarity(a.e, b.e) >= 0 ORDER BY list_cosine_similarity(a.e, b.e) DESC, chunk_id LIMIT 8")
def knn_exact(spark, d):
    v = _vectors(spark, d)
    return retrieve.knn(v, _first_vector(v)).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH u AS ({UNITS}) SELECT a.vec_id AS chunk_id, a.label, {SIM} AS similarity FROM u a, u b WHERE b.vec_id = 0 AND a.label = b.label AND list_cosine_similarity(a.e, b.e) >= 0 ORDER BY list_cosine_similarity(a.e, b.e) DESC, chunk_id LIMIT 8")
def knn_filtered(spark, d):
    v = _vectors(spark, d)
    first = v.where("chunk_id = 0").first()
    return retrieve.knn(v, first["embedding"], filters={"label": first["label"]}).withColumn("similarity", F.round("similarity", 6))


RANKED = f"""WITH u AS ({UNITS}), s AS (SELECT b.vec_id AS query_id, a.vec_id AS chunk_id, list_cosine_similarity(a.e, b.e) AS sim FROM u a, u b WHERE b.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM s WHERE sim >= 0)"""


def _queries(v: DataFrame) -> DataFrame:
    """The stated query set: rows whose id is divisible by 100."""
    return v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec"), F.col("label").alias("q_label"))


@query(RANKED + " SELECT query_id, chunk_id, round(sim, 6) AS similarity, rank FROM r WHERE rank <= 8")
def knn_batch_topk(spark, d):
    v = _vectors(spark, d)
    return retrieve.knn_batch(v, _queries(v).select("query_id", "qvec")).withColumn("similarity", F.round("similarity", 6)).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH u AS (SELECT *, CASE WHEN vec_id % 7 <> 3 THEN 's' || label END AS scheme FROM ({UNITS})), s AS (SELECT b.vec_id AS query_id, a.vec_id AS chunk_id, a.scheme, CASE WHEN b.vec_id % 300 <> 0 THEN 's' || b.label END AS q_scheme, list_cosine_similarity(a.e, b.e) AS sim FROM u a, u b WHERE b.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS x, CASE WHEN scheme = q_scheme THEN row_number() OVER (PARTITION BY query_id, scheme = q_scheme ORDER BY sim DESC, chunk_id) END AS y FROM s WHERE sim >= 0)
SELECT query_id, chunk_id, round(sim, 6) AS similarity, CASE WHEN x <= 36 THEN 1 ELSE 2 END AS pass FROM r WHERE (x <= 36 OR y <= 36) AND (q_scheme IS NULL OR scheme IS NULL OR scheme = q_scheme)""")
def two_pass_merge(spark, d):
    """Rows without a scheme and queries without one are among them."""
    v, q = _schemed(spark, d)
    return retrieve.two_pass(v, q, retrieve.overfetch(6)).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "pass")


@query(ORACLES["two_pass_merge"])
def two_pass_laid_out(spark, d):
    """The same over rows laid out in a folder for each scheme, of which the second pass opens those that occur among the queries."""
    v, q = _schemed(spark, d)
    rows = retrieve.laid_out(v, scratch(spark, "by-scheme"))
    return retrieve.two_pass(rows, q, retrieve.overfetch(6)).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "pass")


@query(f"WITH u AS ({UNITS}), s AS (SELECT b.vec_id AS query_id, a.vec_id AS chunk_id, list_cosine_similarity(a.e, b.e) AS sim FROM u a, u b WHERE b.vec_id % 100 = 0) SELECT query_id, arg_max(chunk_id, (sim, -chunk_id)) AS chunk_id, k FROM s, (VALUES (0), (-1), (NULL)) AS t(k) GROUP BY query_id, k")
def knn_least(spark, d):
    """k of 0, below, or none gives one row for each query."""
    v = _vectors(spark, d)
    found = [retrieve.knn_batch(v, _queries(v).select("query_id", "qvec"), k).select("query_id", "chunk_id", F.lit(k).cast("int").alias("k")) for k in (0, -1, None)]
    return found[0].unionAll(found[1]).unionAll(found[2])


def _schemed(spark, d):
    v = _vectors(spark, d)
    q = _queries(v).select("query_id", "qvec", F.when(F.col("query_id") % 300 != 0, F.concat(F.lit("s"), "q_label")).alias("q_scheme"))
    return v.select("chunk_id", "embedding", F.when(F.col("chunk_id") % 7 != 3, F.concat(F.lit("s"), "label")).alias("scheme")), q


# what the rows and queries of the scores below have besides their vectors, by their ids
_ORGS, _KINDS, _ASKED = ["HDFC Mutual Fund", "SEBI", "AMFI", "Other"], ["SID", "FAQ_DATASET", "FORM", "KIM", "FACTSHEET"], ["what is the minimum lock-in period", "which exit load applies to units", "the fund and its risk"]
_SAID, _TOPIC_NAMES, _INTENTS = ["the lock in period of units is long", "exit load applies, minimum one percent", "risk"], ["sip", "purchase", "benchmark", "minimum_investment"], list(R.PREFERRED)


def _pick(values: list[str], sql: str) -> str:
    return f"[{', '.join(map(quote, values))}][1 + ({sql}) % {len(values)}]"


def _choice(values: list[str], c):
    return F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))


def _listed(mapping: dict[str, list[str]], key: str, value: str) -> str:
    return "coalesce(CASE " + " ".join(f"WHEN {key} = {quote(k)} THEN {value} IN ({', '.join(map(quote, v))})" for k, v in mapping.items()) + " END, false)"


_SOURCE = f"""CASE WHEN {_listed({k: v[0] for k, v in R.PREFERRED.items()}, 'intent', 'org')} THEN 1.0 ELSE coalesce({case([(f'org = {quote(k)}', str(v)) for k, v in R.ORGANIZATION_RANK.items()], 'NULL').replace("'0.9'", '0.9').replace("'0.8'", '0.8').replace("'0.7'", '0.7')}, 0.4) END + CASE WHEN {_listed({k: v[1] for k, v in R.PREFERRED.items()}, 'intent', 'kind')} THEN 0.25 ELSE 0 END"""
_WORDS = r"list_distinct(list_filter(string_split_regex(lower({0}), '\s+'), lambda t: length(t) > 2))"


@query(RANKED + f""", h AS (SELECT r.*, CASE WHEN a.vec_id % 7 <> 3 THEN 's' || a.label END AS scheme, CASE WHEN b.vec_id % 300 <> 0 THEN 's' || b.label END AS q_scheme FROM r JOIN u a ON a.vec_id = chunk_id JOIN u b ON b.vec_id = query_id WHERE rank <= 48),
t AS (SELECT *, {_pick(_TOPIC_NAMES, 'chunk_id')} AS topic, CASE WHEN query_id % 400 <> 0 THEN {_pick(_TOPIC_NAMES, 'query_id // 100')} END AS q_topic, {_pick(_ORGS, 'chunk_id')} AS org, {_pick(_KINDS, 'chunk_id')} AS kind, {_pick(_INTENTS, 'query_id // 100')} AS intent,
 CASE WHEN chunk_id % 9 <> 4 THEN DATE '2024-03-01' - (chunk_id * 3 % 2000)::INT END AS day, {_WORDS.format(_pick(_ASKED, 'query_id // 100'))} AS asked, {_WORDS.format(_pick(_SAID, 'chunk_id'))} AS said FROM h),
f AS (SELECT *, list_distinct(list_filter(flatten(list_transform(list_filter(asked, lambda x: NOT list_contains([{', '.join(map(quote, R.STOPWORDS))}], x)), lambda x: string_split(x, '-'))), lambda x: x <> '')) AS terms, {_SOURCE} AS src,
 CASE WHEN q_topic = topic THEN 1.0 WHEN {_listed(R.RELATED_TOPICS, 'q_topic', 'topic')} THEN 0.8 ELSE 0.2 END AS ts, CASE WHEN q_scheme = scheme THEN 1.0 WHEN q_scheme IS NOT NULL AND scheme IS NOT NULL THEN -0.5 ELSE 0.3 END AS ss,
 CASE WHEN day IS NULL THEN 0.4 ELSE greatest(1 - greatest(DATE '2024-01-01' - day, 0) / 1095.0, 0) END AS fresh FROM t)
SELECT query_id, chunk_id, round(0.55 * sim + 0.18 * ss + 0.14 * ts + 0.08 * least(src, 1.25) / 1.25 + 0.05 * fresh + 0.10 * CASE WHEN len(terms) > 0 THEN len(list_intersect(terms, said)) / len(terms) ELSE 0 END, 4) AS rerank_score FROM f""")
def rerank_scores(spark, d):
    """All factors vary: equal, other and no schemes, equal, related and other topics, preferred and other sources, dates of all ages and none, words in common."""
    v, q = _schemed(spark, d)
    hits = retrieve.knn_batch(v, q.select("query_id", "qvec"), 48).join(v.select("chunk_id", "scheme"), "chunk_id").join(q.drop("qvec"), "query_id")
    c, n = F.col("chunk_id"), F.floor(F.col("query_id") / 100)
    day = F.when(c % 9 != 4, F.date_format(F.date_sub(F.lit("2024-03-01").cast("date"), (c * 3 % 2000).cast("int")), "yyyy-MM-dd"))
    value = rerank.score(
        F.col("similarity"), F.col("scheme"), F.col("q_scheme"), _choice(_TOPIC_NAMES, c), F.when(F.col("query_id") % 400 != 0, _choice(_TOPIC_NAMES, n)), _choice(_ORGS, c), _choice(_KINDS, c), _choice(_INTENTS, n), day,
        F.lit(AS_OF).cast("date"), _choice(_ASKED, n), _choice(_SAID, c),
    )
    return hits.select("query_id", "chunk_id", value.alias("rerank_score"))


@query(RANKED + """, t AS (SELECT r.*, CASE WHEN a.vec_id % 7 <> 3 THEN 's' || a.label % 3 END AS scheme, CASE WHEN b.vec_id % 300 <> 0 THEN 's' || b.label % 3 END AS q_scheme FROM r JOIN u a ON a.vec_id = chunk_id JOIN u b ON b.vec_id = query_id WHERE rank <= 12)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY q_scheme IS NOT NULL AND scheme IS NULL, rank) AS place FROM t WHERE q_scheme IS NULL OR scheme IS NULL OR scheme = q_scheme""")
def evidence_top4(spark, d):
    """Of the first twelve those of the query's scheme, then those of none."""
    v = _vectors(spark, d)
    q = _queries(v)
    hits = retrieve.knn_batch(v, q.select("query_id", "qvec"), 12).join(v.select("chunk_id", "label"), "chunk_id").join(q.select("query_id", "q_label"), "query_id")
    hits = hits.withColumn("scheme", F.when(F.col("chunk_id") % 7 != 3, F.concat(F.lit("s"), F.col("label") % 3))).withColumn("q_scheme", F.when(F.col("query_id") % 300 != 0, F.concat(F.lit("s"), F.col("q_label") % 3)))
    return converse.evidence(hits, n=12).select("query_id", "chunk_id", F.col("place").cast("long").alias("place"))


@query(RANKED + " SELECT query_id, round(max(sim) FILTER (rank = 1), 6) AS top_similarity, max(sim) FILTER (rank = 1) >= 0.35 AS has_evidence FROM r GROUP BY query_id")
def evidence_gate(spark, d):
    v = _vectors(spark, d)
    return converse.gated(retrieve.knn_batch(v, _queries(v).select("query_id", "qvec"))).withColumn("top_similarity", F.round("top_similarity", 6))


# ---- text


@query("""SELECT doc_id, substr(sha256(lower(trim(text, ' '))), 1, 16) AS question_hash, 'src_' || substr(sha1(source || '|' || lang), 1, 12) AS source_id, substr(text, 1, 300) AS preview FROM documents""")
def text_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", X.question_hash(F.col("text")).alias("question_hash"), X.source_id(F.lit(""), F.col("source"), F.col("lang")).alias("source_id"), X.preview(F.col("text")).alias("preview"))


_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+', ''), '[ \n]+$', '')"


@query(f"SELECT doc_id, sha256({_NORMAL}) AS normal_sha256 FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.normalize(F.col("text")), 256).alias("normal_sha256"))


#: The entities that the pages have, the ampersand last.
ENTITIES = [("&nbsp;", chr(160)), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&eacute;", "é"), ("&copy;", "©"), ("&middot;", "·"), ("&euro;", "€"), ("&amp;", "&")]


def _entities(sql: str) -> str:
    for entity, sign in ENTITIES:
        sql = f"replace({sql}, {quote(entity)}, {quote(sign)})"
    return sql


_HTML = "html"
for _tag in ("script", "style", "noscript"):
    _HTML = f"regexp_replace({_HTML}, '<{_tag}[^>]*>.*?</{_tag}>', ' ', 'gis')"
_HTML = rf"regexp_replace({_HTML}, '</(?:p|div|li|h[1-6]|tr)>', chr(10), 'gi')"
_HTML = _entities(f"regexp_replace({_HTML}, '<[^>]+>', '', 'g')")
_HTML = rf"regexp_replace(regexp_replace(regexp_replace({_HTML}, '[ \t\r\x{{a0}}]*[\r\n][ \t\r\x{{a0}}]*', chr(10), 'g'), '\n{{2,}}', chr(10), 'g'), '[ \t]{{2,}}', chr(10), 'g')"
_HTML = rf"regexp_replace({_HTML}, '^[ \t\n\x{{a0}}]+|[ \t\n\x{{a0}}]+$', '', 'g')"


@query(f"SELECT page_id, {_HTML} AS text FROM pages")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query(f"WITH t AS (SELECT page_id, url, {_HTML} AS text FROM pages) SELECT url, text FROM t WHERE length(text) >= 300 AND page_id % 5 <> 0 AND url NOT IN (SELECT url FROM pages WHERE contains(url, '/fr/'))")
def fetched_pages(spark, d):
    pages = table(spark, d, "pages").withColumn("status", F.when(F.col("page_id") % 5 == 0, 404).otherwise(200))
    return files.fetched_pages(pages, pages.where(F.col("url").contains("/fr/")))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '[.!?]+\s'), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(13)) <> '')) AS n FROM documents")
def sentence_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.sentence_count(F.col("text")).cast("long").alias("n"))


@query(f"SELECT doc_id, {', '.join(f'regexp_matches(text, {quote(p)}) AS {n}' for n, p in PERSONAL.items())} FROM documents")
def personal_flags(spark, d):
    return table(spark, d, "documents").select("doc_id", *(F.col("text").rlike(p).alias(n) for n, p in PERSONAL.items()))


def _screened(column: str) -> dict[str, str]:
    """Each category's condition. RE2 has no look-ahead: of a folio's candidates one must hold a digit."""

    def rx(pattern: str, text: str = column) -> str:
        flags = ", 'i'" if pattern.startswith("(?i)") else ""
        return f"regexp_matches({text}, {quote(pattern.removeprefix('(?i)'))}{flags})"

    folio = P.FOLIO.removeprefix("(?i)").replace(r"(?=[A-Za-z0-9/\-]*\d)", "")
    bare = f"regexp_replace({column}, '[A-Za-z]', '', 'g')"
    return {
        "pan": rx(P.PAN), "aadhaar": f"({rx(P.AADHAAR_WORD)} OR ({rx(P.AADHAAR, bare)} AND NOT {rx(P.CARD)}))", "otp": rx(P.OTP), "email": rx(P.EMAIL), "phone": rx(P.PHONE), "bank_account": rx(P.BANK_ACCOUNT),
        "folio": f"len(list_filter(regexp_extract_all({column}, {quote(folio)}, 1, 'i'), lambda x: regexp_matches(x, '[0-9]'))) > 0", "credential": rx(P.CREDENTIAL),
        "account_request": "(" + " OR ".join([*(f"contains(lower({column}), {quote(p)})" for p in P.ACCOUNT_PHRASES), rx(P.ACCOUNT_NOUN)]) + ")",
    }


def _categories_sql(column: str) -> str:
    return f"list_filter([{', '.join(f'CASE WHEN {cond} THEN {quote(name)} END' for name, cond in _screened(column).items())}], lambda x: x IS NOT NULL)"


#: What users might give away: appended to the tables' texts, one to each.
GIVEN = ["my pan is ABCDE1234F", "1234 5678 9012", "card 1234 5678 9012 3456", "my aadhaar", "the one time password", "mail a.b@c.co", "call +91 98765 43210", "98765-43210 or 9876543210", "account number is 123456789012", "folio no 12345678/90", "what is a folio number?", "password: hunter2", "show my holdings", "tell me of my other units", "nothing at all", "a/c - 1234567890"]
_GIVEN = f"text || ' ' || {_pick(GIVEN, 'doc_id')}"


@query(f"WITH t AS (SELECT doc_id, {_GIVEN} AS t FROM documents) SELECT doc_id, array_to_string({_categories_sql('t')}, ',') AS categories, len(list_filter({_categories_sql('t')}, lambda x: x <> 'account_request')) > 0 AS hard FROM t")
def personal_categories(spark, d):
    found = table(spark, d, "documents").select("doc_id", P.categories(F.concat_ws(" ", "text", _choice(GIVEN, F.col("doc_id")))).alias("c"))
    return found.select("doc_id", F.array_join("c", ",").alias("categories"), P.is_hard(F.col("c")).alias("hard"))


@query(f"WITH t AS (SELECT doc_id, {_GIVEN} AS t FROM documents) SELECT doc_id, {' OR '.join(f'regexp_matches(t, {quote(p)})' for p in P.CLIENT.values())} AS blocked FROM t")
def client_check(spark, d):
    return table(spark, d, "documents").select("doc_id", P.client_blocked(F.concat_ws(" ", "text", _choice(GIVEN, F.col("doc_id")))).alias("blocked"))


_SCRUB = "text"
for _p in (P.PAN, P.EMAIL, P.CARD, r"\b\d{12}\b", P.PHONE):
    _SCRUB = f"regexp_replace({_SCRUB}, {quote(_p)}, '[redacted]', 'g')"


@query(f"SELECT doc_id, substr({_SCRUB}, 1, 200) AS clipped, sha256({_SCRUB}) AS scrubbed_sha256 FROM documents")
def scrubbed(spark, d):
    return table(spark, d, "documents").select("doc_id", P.scrubbed(F.col("text")).alias("clipped"), F.sha2(P.scrubbed(F.col("text"), 1 << 30), 256).alias("scrubbed_sha256"))


_HAY = r"('  ' || regexp_replace(lower(replace(text, '-', ' ')), '[^\p{L}\p{N}_]', '  ', 'g') || '  ')"


def _vote_sql(topics: dict[str, list[str]], hay: str) -> list[tuple[str, str]]:
    return [(t, " + ".join(f"(len(string_split({hay}, ' {w} ')) - 1)" for w in words)) for t, words in topics.items()]


_VOTES = _vote_sql(TOPICS, "hay")
_BEST = f"greatest({', '.join(f'({e})' for _, e in _VOTES)})"


@query(f"WITH h AS (SELECT doc_id, {_HAY} AS hay FROM documents) SELECT doc_id, {case([(f'{_BEST} = 0', 'general'), *((f'({e}) = {_BEST}', t) for t, e in _VOTES)], 'NULL')} AS topic FROM h")
def topic_votes(spark, d):
    low = F.replace(F.lower("text"), F.lit("-"), F.lit(" "))
    return table(spark, d, "documents").select("doc_id", keywords.elected(low, TOPICS, "general").alias("topic"))


@query(ORACLES["topic_votes"])
def topic_votes_by_word(spark, d):
    """The same by built-in functions, one word after another."""
    low = F.replace(F.lower("text"), F.lit("-"), F.lit(" "))
    return table(spark, d, "documents").select("doc_id", R.elected(low, TOPICS, "general").alias("topic"))


_HINTED = [(t, f"({e}) * CASE WHEN {' OR '.join(f'contains(hint, {quote(f" {w} ")})' for w in TOPICS[t])} THEN 3 ELSE 1 END") for t, e in _VOTES]
_BEST3 = f"greatest({', '.join(f'({e})' for _, e in _HINTED)})"


@query(f"""WITH p AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS body FROM documents), q AS (SELECT doc_id, title || chr(10) || substr(body, 1, 1500) AS text, title FROM p),
h AS (SELECT doc_id, {_HAY} AS hay, {_HAY.replace('text', 'title')} AS hint FROM q) SELECT doc_id, {case([(f'{_BEST3} = 0', 'general'), *((f'{e} = {_BEST3}', t) for t, e in _HINTED)], 'NULL')} AS topic FROM h""")
def chunk_topics(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", corpus.chunk_topic(F.col("text"), F.element_at(F.split("text", "\n"), 1), TOPICS).alias("topic"))


@query(f"SELECT doc_id, {case([(' OR '.join(f'contains(lower(text), {quote(a)})' for a in names), s) for s, names in SCHEMES.items()], 'NULL')} AS scheme, {case([(f'contains(lower(text), {quote(n)})', t) for n, t in TYPES], quote('OTHER'))} AS document_type FROM documents")
def entity_detection(spark, d):
    return table(spark, d, "documents").select("doc_id", keywords.first_alias(F.col("text"), SCHEMES).alias("scheme"), R.first_needle(F.col("text"), TYPES, "OTHER").alias("document_type"))


def _any(column: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quote(n)})" for n in needles) + ")"


def _rx(pattern: str) -> str:
    return f"regexp_matches(q, {quote(pattern)}, 'i')"


#: A question of the list, what a user gives away, and the turn's own text, for every user turn.
_ASK = f"SELECT conv_id * 1000 + turn AS id, {_pick(QUESTIONS, 'conv_id + turn')} || ' ' || {_pick(['', '', '', *GIVEN], 'conv_id * 7 + turn')} || ' ' || text AS q FROM conversations WHERE role = 'user'"


BRAND_HINTS = ["upi", "folio number?"]


def _question_votes() -> str:
    """Bounded counts of keywords of several words: blanks are doubled in the text, so a keyword's are too."""
    parts = []
    for t, words in R.QUERY_TOPICS.items():
        each = [f"(len(string_split(hay, {quote(' ' + '  '.join(w.replace('-', ' ').replace(chr(39), ' ').split(' ')) + ' ')})) - 1)" for w in words]
        parts.append((t, " + ".join(each)))
    best = f"greatest({', '.join(f'({e})' for _, e in parts)})"
    amount = "contains(low, 'minimum') AND (contains(low, ' lump sum ') OR contains(low, 'purchase amount') OR contains(low, 'application amount') OR contains(low, 'investment amount'))"
    return case([(amount, "minimum_investment"), (f"{best} = 0", "-"), *((f"({e}) = {best}", t) for t, e in parts)], "NULL")


_LISTED_BRAND = f" WHEN {_any('lq', BRAND_HINTS)} AND NOT soft THEN 'FACTUAL_UPI'"
_INTENT = f"""WITH v AS ({_ASK}), l AS (SELECT id, q, {_categories_sql('q')} AS cats, lower(q) AS lq, ' ' || replace(lower(q), '-', ' ') || ' ' AS low, '  ' || regexp_replace(replace(lower(q), '-', ' '), '[^\\p{{L}}\\p{{N}}_]', '  ', 'g') || '  ' AS hay FROM v),
t AS (SELECT *, nullif({_question_votes()}, '-') AS topic, {case([(_any('lq', a), s) for s, a in R.QUERY_SCHEMES.items()], 'NULL')} AS scheme,
 len(list_filter(cats, lambda x: x <> 'account_request')) > 0 AS hard, list_contains(cats, 'account_request') AS soft FROM l)
SELECT id, topic, scheme, CASE WHEN hard THEN 'PII_ACCOUNT' WHEN {_rx(R.MARKET_TIMING)} THEN 'MARKET_TIMING' WHEN {_rx(R.COMPARISON)} THEN 'PERFORMANCE_COMPARISON' WHEN {_rx(R.PREDICTION)} THEN 'PERFORMANCE_PREDICTION'
 WHEN {_rx(R.ADVICE)} AND NOT {_rx(R.OPERATIONAL_TIMING)} THEN 'ADVICE' WHEN {_rx(R.OUT_OF_SCOPE)} AND scheme IS NULL AND NOT {_any('lq', R.OPERATIONAL_HINTS)} THEN 'OUT_OF_SCOPE' WHEN {_rx(R.HISTORICAL)} THEN 'HISTORICAL_PERFORMANCE'
{_LISTED_BRAND} WHEN {_any('lq', R.REGULATORY_HINTS)} AND scheme IS NULL THEN 'FACTUAL_REGULATORY' WHEN {_any('lq', R.OPERATIONAL_HINTS)} THEN 'FACTUAL_OPERATIONAL' WHEN soft THEN 'PII_ACCOUNT' WHEN scheme IS NOT NULL THEN 'FACTUAL_SCHEME'
 WHEN topic IN ({', '.join(map(quote, R.SCHEME_TOPICS))}) THEN 'AMBIGUOUS' WHEN topic IS NOT NULL THEN 'FACTUAL_REGULATORY' ELSE 'AMBIGUOUS' END AS intent FROM t"""


def _questions(spark: SparkSession, d: str) -> DataFrame:
    turns, n = table(spark, d, "conversations").where("role = 'user'"), F.col("conv_id") + F.col("turn")
    given = _choice(["", "", "", *GIVEN], F.col("conv_id") * 7 + F.col("turn"))
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(_choice(QUESTIONS, n), F.lit(" "), given, F.lit(" "), F.col("text")).alias("question"))


def _classified(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    found = _questions(spark, d).withColumn("categories", P.categories(q)).withColumn("scheme", I.scheme(q)).withColumn("topic", I.topic(q)).withColumn("hard", P.is_hard(F.col("categories")))
    got = I.classified(q, F.col("hard"), F.array_contains("categories", "account_request"), F.col("scheme"), F.col("topic"), brand="UPI", brand_hints=tuple(BRAND_HINTS))
    return found.withColumn("intent", got["intent"])


@query(_INTENT)
def intent_cascade(spark, d):
    return _classified(spark, d).select("id", "topic", "scheme", "intent")


#: Answers, one to each question, some of which say that there is none.
ANSWERS = ["The load is 1 %.", "It couldn’t be found.", "This is not mentioned in the documents.", "No details."]
_ANSWERED = f"SELECT i.*, {_pick(ANSWERS, 'i.id')} AS answer, i.id % 3 <> 0 AS has_evidence, i.id % 5 = 0 AS mismatch, i.id % 11 = 0 AS failed FROM i"
_GONE = rf"regexp_matches(replace(answer, '’', chr(39)), {quote(R.NO_EVIDENCE.removeprefix('(?i)'))}, 'i')"


@query(f"""WITH i AS ({_INTENT.replace('SELECT id, topic, scheme, CASE WHEN hard', 'SELECT id, topic, scheme, hard, CASE WHEN hard')}), a AS ({_ANSWERED}) SELECT id, intent, hard OR intent IN ({', '.join(map(quote, I.REFUSED))}) AS refused,
CASE WHEN hard THEN 'PII_ACCOUNT' WHEN intent IN ({', '.join(map(quote, I.REFUSED))}) THEN intent WHEN failed THEN 'ERROR' WHEN NOT has_evidence THEN 'NO_EVIDENCE' WHEN mismatch THEN 'SCHEME_MISMATCH' WHEN {_GONE} AND intent = 'AMBIGUOUS' THEN 'NO_EVIDENCE' END AS refusal_type,
NOT (hard OR intent IN ({', '.join(map(quote, I.REFUSED))}) OR failed OR NOT has_evidence OR mismatch OR ({_GONE} AND intent = 'AMBIGUOUS')) AS cited, {_GONE} AS not_found FROM a""")
def outcomes(spark, d):
    n, answer = F.col("id"), _choice(ANSWERS, F.col("id"))
    o = converse.outcome(F.col("intent"), F.col("hard"), I.REFUSED, n % 3 != 0, n % 5 == 0, answer, n % 11 == 0)
    return _classified(spark, d).select("id", "intent", o["refused"].alias("refused"), o["refusal_type"].alias("refusal_type"), o["cited"].alias("cited"), converse.not_found(answer).alias("not_found"))


@query(f"""WITH i AS ({_INTENT}) SELECT id, {quote(converse.INVITATION)} || {' || '.join(f"chr(10) || '- ' || replace(CASE {' '.join(f'WHEN topic = {quote(t)} THEN {quote(x)}' for t, x in converse.TEMPLATES.items())} ELSE {quote(converse.TEMPLATE)} END, '{{scheme}}', {quote(s)})" for s in list(R.QUERY_SCHEMES)[:3])} AS suggestion FROM i""")
def suggestions(spark, d):
    return _questions(spark, d).select("id", converse.suggestions(I.topic(F.col("question"))).alias("suggestion"))


def _expand_sql() -> str:
    rules = []
    for t, text in R.EXPANSIONS.items():
        seen = " + ".join(f"contains(lower(q), {quote(w)})::INT" for w in text.split() if len(w) > 4)
        rules.append(f"WHEN topic = {quote(t)} THEN CASE WHEN {seen} >= 3 THEN q ELSE q || {quote(' ' + text)} END")
    return "CASE " + " ".join(rules) + " ELSE q END"


@query(f"WITH i AS ({_INTENT}), j AS (SELECT i.*, q FROM i JOIN ({_ASK}) USING (id)) SELECT id, {_expand_sql()} AS expanded FROM j")
def query_expansion(spark, d):
    q = F.col("question")
    return _questions(spark, d).withColumn("topic", I.topic(q)).select("id", X.expanded(q, F.col("topic"), R.EXPANSIONS).alias("expanded"))


#: Formats that days are written in, for DuckDB and for Spark, and what surrounds them.
_WRITTEN = [("%Y-%m-%d", "yyyy-MM-dd"), ("%d-%m-%Y", "dd-MM-yyyy"), ("%d/%m/%Y", "dd/MM/yyyy"), ("%d %b %Y", "dd MMM yyyy"), ("%B %d, %Y", "MMMM dd, yyyy"), ("%b %Y", "MMM yyyy"), ("%B %Y", "MMMM yyyy")]
_OF_MONTH = "date_trunc('month', day)::DATE"
_SHAPES = len(_WRITTEN) + 2


@query(f"""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_orderkey % {_SHAPES} AS shape, strftime(o_orderdate, '%Y-%m-%d') AS raw FROM orders),
u AS (SELECT *, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN left(raw, 5) || '13' || right(raw, 3) WHEN 2 THEN left(raw, 5) || '00' || right(raw, 3) WHEN 3 THEN strftime(day, '%B %Y') ELSE raw END AS given FROM o)
SELECT o_orderkey, CASE WHEN shape IN (5, 6, 7) THEN {_OF_MONTH} WHEN shape < 5 THEN day END AS parsed,
 CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN year(day) BETWEEN 2015 AND 2035 THEN raw WHEN day(day) BETWEEN 15 AND 35 THEN '20' || strftime(day, '%d-%m') || '-01' ELSE '' END WHEN year(day) BETWEEN 2015 AND 2035 THEN strftime(day, '%Y-%m') || '-01' ELSE '' END AS named,
 CASE WHEN given = '' THEN 'recently updated' WHEN o_orderkey % 6 = 1 THEN given WHEN o_orderkey % 6 = 2 THEN 'December ' || year(day) WHEN o_orderkey % 6 = 3 THEN left(given, 10) ELSE strftime(day, '%B %Y') END AS updated,
 CASE WHEN o_orderkey % 6 IN (0, 1, 2, 3) THEN 0.4 ELSE round(greatest(1 - greatest(DATE '1997-01-01' - day, 0) / 1095.0, 0), 6) END AS freshness FROM u""")
def dates(spark, d):
    """All shapes of days that are read, within sentences too, and some that aren't; names of files; what answers say of a document's age."""
    day, n = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    raw = F.date_format(day, "yyyy-MM-dd")
    text = F.element_at(F.array(*(F.date_format(day, f) for _, f in _WRITTEN), F.concat(F.lit("as of "), F.date_format(day, "MMMM yyyy"), F.lit(" edition")), F.lit("soon")), (n % _SHAPES + 1).cast("int"))
    name = F.concat(F.lit("report_"), F.when(n % 2 == 0, F.date_format(day, "MMMM dd yyyy")).otherwise(F.date_format(day, "MMM yyyy")), F.lit(".pdf"))
    given = F.when(n % 6 == 0, "").when(n % 6 == 1, F.concat(F.left(raw, F.lit(5)), F.lit("13"), F.right(raw, F.lit(3)))).when(n % 6 == 2, F.concat(F.left(raw, F.lit(5)), F.lit("00"), F.right(raw, F.lit(3)))).when(n % 6 == 3, F.date_format(day, "MMMM yyyy")).otherwise(raw)
    return table(spark, d, "orders").select(n, X.parse_date(text).alias("parsed"), X.date_in_name(name).alias("named"), X.last_updated(given).alias("updated"), F.round(rerank.freshness(given, F.lit("1997-01-01").cast("date")), 6).alias("freshness"))


# ---- corpus

PAGED = "SELECT doc_id, ((i - 1) // 5)::INT AS page, ((i - 1) % 5)::INT AS line_no, lines[i] AS line, ((i - 1) // 5) % 4 = 3 AS is_table FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS t(i)"


def _paged(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages of five lines; every fourth page has a table."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", F.floor(F.col("i") / 5).cast("int").alias("page"), (F.col("i") % 5).alias("line_no"), "line", (F.floor(F.col("i") / 5) % 4 == 3).alias("is_table"))


@query(f"""WITH p AS ({PAGED}), f AS (SELECT doc_id, page, line_no, trim(line, ' ') AS line FROM p WHERE trim(line, ' ') <> ''),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no DESC) AS b FROM f),
s AS (SELECT doc_id, line, 'top' AS side FROM e WHERE a <= 2 AND length(line) BETWEEN 11 AND 119 UNION ALL SELECT doc_id, line, 'bottom' FROM e WHERE b <= 2 AND length(line) BETWEEN 11 AND 119),
c AS (SELECT doc_id, line, side, count(*) AS n FROM s GROUP BY ALL), g AS (SELECT doc_id, count(DISTINCT page) AS pages FROM p GROUP BY 1 HAVING count(DISTINCT page) >= 5)
SELECT DISTINCT doc_id, line FROM c JOIN g USING (doc_id) WHERE n >= greatest(3, floor(0.4 * pages))""")
def boilerplate_lines(spark, d):
    return corpus.boilerplate(_paged(spark, d))


HEADS = ["licensed under", "copyright"]
def _heading_sql(known: list[str]) -> str:
    listed = " OR ".join(f"starts_with(low, {quote(h)}) OR (contains(low, {quote(h)}) AND length(s) <= {len(h) + 25})" for h in known)
    shape, number = (x.replace("'", "''") for x in (X.HEADING_SHAPE, X.HEADING_NUMBER))
    letters, upper = (f"length(regexp_replace(s, '[^\\p{{{c}}}]', '', 'g'))" for c in ("L", "Lu"))
    return f"""length(s) > 3 AND length(s) <= 140 AND NOT regexp_matches(s, '[.,;]$') AND len(string_split_regex(s, '\\s+')) <= 10 AND ({listed} OR (regexp_matches(s, '{shape}') AND (regexp_matches(s, '{number}')
 OR ({letters} > 0 AND {upper} > 0.75 * {letters}) OR (length(s) <= 60 AND NOT contains(s, ':')))))"""


_HEADING = _heading_sql(HEADS)


@query(f"WITH p AS ({PAGED}), s AS (SELECT *, trim(line, ' ') AS s, lower(trim(line, ' ')) AS low FROM p) SELECT doc_id, page, line_no, {_HEADING} AS heading FROM s")
def heading_flags(spark, d):
    return _paged(spark, d).select("doc_id", "page", "line_no", X.is_heading(F.col("line"), HEADS).alias("heading"))


def _flags_sql(lines: str, heading: str) -> str:
    return f"WITH p AS ({lines}), s AS (SELECT *, trim(line, ' ') AS s, lower(trim(line, ' ')) AS low FROM p), f AS (SELECT *, NOT is_table AND ({heading}) AS head FROM s), n AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY page, line_no) AS section_no FROM f)"


_FLAGS = _flags_sql(PAGED, _HEADING)


@query(_FLAGS + """ SELECT doc_id, section_no::BIGINT AS section_no, coalesce(max(s) FILTER (head), 'Preamble') AS title, min(page) AS page, max(page) AS page_end, string_agg(line, chr(10) ORDER BY page, line_no) FILTER (NOT head) AS body
FROM n GROUP BY doc_id, section_no HAVING trim(string_agg(line, chr(10) ORDER BY page, line_no) FILTER (NOT head), ' ') <> ''""")
def sections(spark, d):
    return corpus.sections(_paged(spark, d), X.is_heading(F.col("line"), HEADS))


_STRIP = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"
_CHUNKS = rf"""sec AS (SELECT doc_id, section_no::BIGINT AS section_no, coalesce(max(s) FILTER (head), 'Preamble') AS title, trim(string_agg(line, chr(10) ORDER BY page, line_no) FILTER (NOT head), {_STRIP}) AS body FROM n GROUP BY doc_id, section_no),
blk AS (SELECT *, list_filter(flatten(list_transform(string_split(body, chr(10)), lambda p: CASE WHEN contains(p, '|') THEN [p] ELSE string_split(regexp_replace(p, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) END)), lambda b: b <> '') AS blocks FROM sec WHERE length(body) >= 40),
pcs AS (SELECT *, list_concat([{{'buf': '', 'cut': false, 'out': []::VARCHAR[]}}], flatten(list_transform(blocks, lambda b: CASE WHEN length(b) <= 1200 THEN [{{'buf': b, 'cut': false, 'out': []::VARCHAR[]}}]
 ELSE list_transform(regexp_extract_all(regexp_replace(b, ' {{2,}}', ' ', 'g') || ' ', '(?s)[^ ].{{0,999}}.{{0,200}} |[^ ]{{1000}}[^ ]{{0,200}}|[^ ]{{1,1000}}'), lambda x: {{'buf': rtrim(x, ' '), 'cut': true, 'out': []::VARCHAR[]}}) END))) AS elems FROM blk),
fold AS (SELECT doc_id, section_no, title, CASE WHEN length(body) <= 1200 THEN [body] ELSE list_transform([list_reduce(elems, lambda s, x: CASE WHEN NOT x.cut AND length(s.buf) + length(x.buf) + 1 <= 1200 THEN {{'buf': trim(s.buf || ' ' || x.buf, {_STRIP}), 'cut': false, 'out': s.out}}
 ELSE {{'buf': CASE WHEN x.cut OR s.buf = '' THEN x.buf ELSE trim(right(s.buf, 150) || ' ' || x.buf, {_STRIP}) END, 'cut': false, 'out': CASE WHEN s.buf = '' THEN s.out ELSE list_append(s.out, s.buf) END}} END)], lambda r: list_append(r.out, r.buf))[1] END AS chunks FROM pcs),
piece AS (SELECT doc_id, section_no, title, unnest(list_transform(chunks, lambda c: trim(c, {_STRIP}))) AS piece, unnest(range(len(chunks)))::INT AS chunk_no FROM fold)"""
_VOTED = f"""h AS (SELECT *, {_HAY.replace('text', "(title || chr(10) || substr(piece, 1, 1500))")} AS hay, {_HAY.replace('text', 'title')} AS hint FROM piece WHERE length(piece) >= 40)"""


@query(f"""{_FLAGS}, {_CHUNKS}, {_VOTED} SELECT doc_id, section_no, chunk_no, title, {case([(f'{_BEST3} = 0', 'general'), *((f'{e} = {_BEST3}', t) for t, e in _HINTED)], 'NULL')} AS topic, CASE WHEN title = 'Preamble' THEN piece ELSE title || chr(10) || piece END AS chunk_text FROM h""")
def chunk_pack(spark, d):
    found = corpus.chunks(corpus.sections(_paged(spark, d), X.is_heading(F.col("line"), HEADS)), topics=TOPICS)
    return found.select("doc_id", "section_no", "chunk_no", "title", "topic", "chunk_text")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def latest_per_key(spark, d):
    return corpus.latest_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query("""WITH r AS (SELECT o_orderkey AS row_idx, o_orderpriority AS document_type, 'report ' || strftime(o_orderdate, '%d-%m-%Y') || '.xlsx' AS file_name, o_orderdate::DATE AS day FROM orders)
SELECT row_idx, document_type, file_name FROM r WHERE document_type <> '1-URGENT' UNION ALL (SELECT row_idx, document_type, file_name FROM r WHERE document_type = '1-URGENT' ORDER BY day DESC, row_idx LIMIT 1)""")
def newest_wins(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"), F.col("o_orderpriority").alias("document_type"), F.concat(F.lit("report "), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit(".xlsx")).alias("file_name"))
    return files.newest_report(rows, "1-URGENT")


@query("""WITH r AS (SELECT o_orderkey AS row_idx, o_orderpriority AS document_type, 'report ' || strftime(o_orderdate, '%d-%m-%Y') || '.xlsx' AS file_name, o_orderstatus AS title, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE::VARCHAR ELSE '' END AS document_date, 'u' AS source_url, 'o' AS organization FROM orders)
SELECT row_idx, title, document_date, source_url, organization FROM r WHERE document_type <> '1-URGENT' UNION ALL (SELECT row_idx, 'House 1-URGENT Report ' || document_date || ' (1-URGENT)', day::VARCHAR, 'new', 'House' FROM r WHERE document_type = '1-URGENT' ORDER BY day DESC, row_idx LIMIT 1)""")
def newest_patched(spark, d):
    """The newest report takes a patch, a title and the date of its name."""
    n = F.col("o_orderkey")
    day = F.when(n % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("").alias("document_date")
    rows = table(spark, d, "orders").select(n.alias("row_idx"), F.col("o_orderpriority").alias("document_type"), F.concat(F.lit("report "), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit(".xlsx")).alias("file_name"), F.col("o_orderstatus").alias("title"), day, F.lit("u").alias("source_url"), F.lit("o").alias("organization"))
    return files.newest_report(rows, "1-URGENT", {"organization": "House", "source_url": "new"}).drop("document_type", "file_name")


@query("SELECT doc_id AS source_id, 1 AS version, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 2, NULL FROM labels")
def manifest_upsert(spark, d):
    old = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.lit(1).alias("version"), "lang")
    return corpus.replaced(old, table(spark, d, "labels").select(F.col("doc_id").alias("source_id"), F.lit(2).alias("version")))


@query("""WITH f AS (SELECT arg_min(text, (conv_id, turn)) AS text, min((conv_id, turn)) AS place FROM conversations WHERE role = 'user' AND trim(text, ' ') <> '' GROUP BY lower(text))
SELECT text, 'G-' || row_number() OVER (ORDER BY place) AS id FROM f""")
def dedup_questions(spark, d):
    """The first of each question, case ignored, with its number in order."""
    users = table(spark, d, "conversations").where("role = 'user' and trim(text) <> ''").select("text", "conv_id", "turn")
    return corpus.first_by(users, F.col("text"), ["conv_id", "turn"]).select("text", F.concat(F.lit("G-"), "seq").alias("id"))


@query("""SELECT p_partkey, CASE WHEN n = 0 THEN base ELSE base || '_' || n END AS flat_name FROM (SELECT p_partkey, regexp_replace(p_brand, '[^A-Za-z0-9._ -]', '', 'g') AS base, row_number() OVER (PARTITION BY regexp_replace(p_brand, '[^A-Za-z0-9._ -]', '', 'g') ORDER BY p_partkey) - 1 AS n FROM part)""")
def flat_names(spark, d):
    return corpus.suffixed(table(spark, d, "part"), "p_brand", "p_partkey").select("p_partkey", "flat_name")


@query("""SELECT 'host' AS sheet, 0 AS row_idx, 'HEADER: key | name | region' AS line UNION ALL SELECT 'host', n_nationkey + 1, 'key: ' || n_nationkey || ' || name: ' || n_name || ' || region: ' || n_regionkey FROM nation""")
def sheet_rows(spark, d):
    head = spark.createDataFrame([(1, "host", 0, ["key", "name", "region"]), (1, "host", -1, [None, " ", ""])], "doc_id int, sheet string, row_idx int, cells array<string>")
    body = table(spark, d, "nation").select(F.lit(1).alias("doc_id"), F.lit("host").alias("sheet"), (F.col("n_nationkey") + 1).alias("row_idx"), F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("cells"))
    return files.sheet_lines(head.unionByName(body)).select("sheet", "row_idx", "line")


_HOST = "regexp_extract(url, '//([^/]*)/', 1)"
_SCOPE = "regexp_extract(url, '//[^/]*/([a-z]*)/', 1)"


@query(f"SELECT 'organization' AS kind, {_HOST} AS name, arg_min(url, page_id) AS url FROM pages WHERE {_HOST} <> '' GROUP BY 2 UNION ALL SELECT 'scope', {_SCOPE}, arg_max(url, page_id) FROM pages WHERE {_SCOPE} <> '' GROUP BY 2")
def url_lookup(spark, d):
    rows = table(spark, d, "pages").select(F.col("page_id").alias("row_idx"), F.regexp_extract("url", "//([^/]*)/", 1).alias("organization"), F.regexp_extract("url", "//[^/]*/([a-z]*)/", 1).alias("scope"), "url")
    return files.url_lookup(rows)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_shipdate FROM lineitem), b AS (SELECT o_orderkey, 10.0 AS lo, 20.0 AS hi FROM orders WHERE o_orderstatus = 'F')
SELECT l_orderkey AS doc_id, string_agg(l_linenumber::VARCHAR, ' ' ORDER BY x, l_linenumber::VARCHAR) AS line FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE o_orderkey = l_orderkey AND x BETWEEN lo AND hi) GROUP BY 1""")
def words_outside_tables(spark, d):
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").cast("string").alias("text"), F.col("l_quantity").alias("x0"), F.col("l_quantity").alias("x1"), F.lit(1.0).alias("top"), F.lit(1.0).alias("bottom"))
    boxes = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(10.0).alias("x0"), F.lit(0.0).alias("top"), F.lit(20.0).alias("x1"), F.lit(9.0).alias("bottom"))
    return files.outside_tables(words, boxes).select("doc_id", "line")


_WORDS = "SELECT doc_id, (i - 1) // 60 AS page, w[i] AS word, ((i - 1) % 8) * 70.0 AS x0, ((i - 1) % 60 // 8) * 12.0 + doc_id % 5 AS top FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents), unnest(range(1, len(w) + 1)) AS t(i)"
_BOXES = "(0, 20.0, 90.0, 30.0), (100.0, 20.0, 300.0, 60.5), (345.0, 0.0, 420.0, 30.0), (-1000.0, 81.0, 5000.0, 84.0)"


@query(f"""WITH w AS ({_WORDS}), left_ AS (SELECT * FROM w WHERE (doc_id + page) % 3 = 0 OR NOT EXISTS (SELECT 1 FROM (VALUES {_BOXES}) AS b(x0, top, x1, bottom) WHERE w.x0 + 25 BETWEEN b.x0 AND b.x1 AND w.top + 4.5 BETWEEN b.top AND b.bottom))
SELECT doc_id, page, round_even(top / 3, 0)::BIGINT AS line_no, sha256(string_agg(word, ' ' ORDER BY x0, word)) AS line_sha256 FROM left_ GROUP BY ALL""")
def words_outside_boxes(spark, d):
    """Documents set as pages of lines of words, most pages with four boxes, which places across and down decide."""
    docs = table(spark, d, "documents").select("doc_id", F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ").alias("said"))
    starts = F.sequence(F.lit(0), F.floor((F.size("said") - 1) / 60).cast("int"))
    pages = docs.select("doc_id", F.posexplode_outer(F.transform(starts, lambda p: F.slice("said", p * 60 + 1, F.lit(60)))).alias("page", "said")).where(F.col("page").isNotNull()).withColumn("page", F.col("page").cast("long"))

    def word(t, i):
        x0, top = ((F.col("page") * 60 + i) % 8) * 70.0, F.floor(i / 8) * 12.0 + F.col("doc_id") % 5
        return F.struct(t.alias("text"), x0.alias("x0"), (x0 + 50).alias("x1"), top.alias("top"), (top + 9).alias("bottom"))

    boxes = F.explode(F.expr(f"array({_BOXES.replace('(', 'struct(')})")).alias("b")
    some = docs.select("doc_id", F.explode_outer(starts).alias("page")).where("(doc_id + page) % 3 <> 0").select("doc_id", F.col("page").cast("long").alias("page"), boxes)
    found = files.outside_tables_of_pages(pages, F.transform("said", word), some.select("doc_id", "page", *(F.col(f"b.col{k}").cast("double").alias(c) for k, c in enumerate(("x0", "top", "x1", "bottom"), 1))))
    return found.select("doc_id", "page", "line_no", F.sha2("line", 256).alias("line_sha256"))


@query("""WITH l AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
r AS (SELECT doc_id, i + 1 AS n, 'Row ' || i || ' | ' || trim(line, ' ') AS bar, CASE WHEN trim(line, ' ') <> '' THEN 'Row ' || i || ' of ' || source || ': ' || trim(line, ' ') END AS fact FROM l UNION ALL SELECT doc_id, 1, 'Fund Name | ' || source, 'Fund Name of ' || source || ': ' || source FROM documents UNION ALL SELECT doc_id, 0, 'Scheme Summary Document', NULL FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, true AS is_table, sha256(any_value(lang) || chr(10) || chr(10) || string_agg(bar, chr(10) ORDER BY n) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'Scheme Summary Document - ' || any_value(source) || chr(10) || string_agg(fact, chr(10) ORDER BY n) ELSE '' END) AS text_sha256 FROM r JOIN documents USING (doc_id) GROUP BY doc_id""")
def table_pages(spark, d):
    """Documents as tables of their lines under a title, half of them summaries, with what stands outside."""
    docs = table(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", (F.col("i") + 2).alias("row_no"), F.array(F.concat(F.lit("Row "), F.col("i") + 1), "line").alias("cells"))
    heads = docs.where("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("row_no"), F.array(F.lit("Scheme Summary Document")).alias("cells")).unionByName(docs.select("doc_id", F.lit(1).alias("row_no"), F.array(F.lit("Fund Name"), "source").alias("cells")))
    cells = lines.unionByName(heads).withColumns({"page": F.lit(1), "table_no": F.lit(0)})
    plain = docs.select("doc_id", F.lit(1).alias("page"), F.concat(F.lit(" "), "lang").alias("text"))
    return files.table_pages(plain, cells).select("doc_id", "is_table", F.sha2("text", 256).alias("text_sha256"))


# ---- token sets and demotion

_TOK = r"list_distinct(list_filter(string_split_regex(lower({0}), '\s+'), lambda t: length(t) > 2))"


@query(f"""WITH t AS (SELECT conv_id, turn, {_TOK.format('text')} AS w FROM conversations) SELECT a.conv_id, a.turn, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) ELSE 0 END, 6) AS jaccard FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def token_jaccard(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", X.tokens(F.col("text")).alias("w"))
    n = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return t.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


_STOP = ", ".join(map(quote, R.STOPWORDS))


@query(f"""WITH t AS (SELECT conv_id, turn, {_TOK.format('text')} AS w FROM conversations), u AS (SELECT conv_id, turn, list_distinct(list_filter(flatten(list_transform(list_filter(w, lambda x: NOT list_contains([{_STOP}], x)), lambda x: string_split(x, '-'))), lambda x: x <> '')) AS q FROM t)
SELECT u.conv_id, u.turn, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, t.w)) / len(q) ELSE 0 END, 6) AS overlap FROM u JOIN t ON u.conv_id = t.conv_id AND t.turn = u.turn + 1""")
def query_overlap(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", "text")
    n = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return t.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.round(rerank.overlap(F.col("text"), F.col("other")), 6).alias("overlap"))


#: A conversation's turns as a query's hits; every other one says what the one before it said, with a word of its own.
_HITS = """SELECT conv_id AS query_id, turn AS chunk_id, turn // 4 AS document_id, CASE WHEN turn % 2 = 1 THEN coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') || ' own' || turn ELSE text END AS chunk_text, turn + 1 AS rank, round(0.5 - turn / 20, 4) AS rerank_score FROM conversations"""
_JACCARD = "CASE WHEN len(list_distinct(list_concat(k.words, x.words))) > 0 THEN len(list_intersect(k.words, x.words)) / len(list_distinct(list_concat(k.words, x.words))) ELSE 0 END"


@query(f"""WITH t AS ({_HITS}), w AS (SELECT *, {_TOK.format('chunk_text')} AS words FROM t),
g AS (SELECT query_id, list_reduce(list_prepend({{'kept': []::STRUCT(doc BIGINT, words VARCHAR[])[], 'flags': []::BOOLEAN[], 'doc': NULL::BIGINT, 'words': NULL::VARCHAR[]}}, list({{'kept': []::STRUCT(doc BIGINT, words VARCHAR[])[], 'flags': []::BOOLEAN[], 'doc': document_id, 'words': words}} ORDER BY rank)),
 lambda s, x: {{'kept': CASE WHEN len(list_filter(s.kept, lambda k: k.doc = x.doc AND {_JACCARD} > 0.55)) > 0 THEN s.kept ELSE list_append(s.kept, {{'doc': x.doc, 'words': x.words}}) END, 'flags': list_append(s.flags, len(list_filter(s.kept, lambda k: k.doc = x.doc AND {_JACCARD} > 0.55)) > 0), 'doc': NULL::BIGINT, 'words': NULL::VARCHAR[]}}).flags AS flags FROM w GROUP BY query_id),
m AS (SELECT t.*, flags[row_number() OVER (PARTITION BY t.query_id ORDER BY rank)] AS demoted FROM t JOIN g USING (query_id)), n AS (SELECT query_id, chunk_id, rank AS was, demoted, CASE WHEN demoted THEN round(rerank_score * 0.88, 4) ELSE rerank_score END AS rerank_score FROM m)
SELECT query_id, chunk_id, rerank_score, demoted, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, was) AS rank FROM n""")
def near_dup_demote(spark, d):
    own = F.concat(F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")), F.lit(" own"), F.col("turn"))
    said = F.when(F.col("turn") % 2 == 1, own).otherwise(F.col("text"))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("chunk_id"), F.floor(F.col("turn") / 4).alias("document_id"), said.alias("chunk_text"), (F.col("turn") + 1).alias("rank"), F.round(0.5 - F.col("turn") / 20, 4).alias("rerank_score"))
    return rerank.demoted(rows).select("query_id", "chunk_id", "rerank_score", "demoted", "rank")


# ---- conversations


@query(f"""WITH s AS (SELECT conv_id, turn, {case([(' OR '.join(f'contains(lower(text), {quote(a)})' for a in names), n) for n, names in list(SCHEMES.items())[:1] + list(SCHEMES.items())[2:]], 'NULL')} AS scheme, role <> 'system' AS remembered FROM conversations)
SELECT conv_id, turn, coalesce(scheme, last_value(CASE WHEN remembered THEN scheme END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS scheme_used FROM s""")
def carry_over(spark, d):
    some = {k: v for k, v in SCHEMES.items() if k != "Beta"}
    turns = table(spark, d, "conversations").select("conv_id", "turn", R.first_alias(F.col("text"), some).alias("scheme"), (F.col("role") != "system").alias("remembered"))
    return converse.carried(turns, "conv_id").select("conv_id", "turn", "scheme_used")


@query("""WITH e AS (SELECT event_id, user_id, ts, epoch(ts)::BIGINT AS s, CASE WHEN value > 50 THEN event_type END AS scheme, event_type <> 'view' AS remembered FROM events),
l AS (SELECT *, last_value(CASE WHEN remembered THEN s END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e),
m AS (SELECT *, sum(CASE WHEN s - prev > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS memory FROM l)
SELECT event_id, coalesce(scheme, last_value(CASE WHEN remembered THEN scheme END IGNORE NULLS) OVER (PARTITION BY user_id, memory ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS scheme_used FROM m""")
def session_ttl(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("value") > 50, F.col("event_type")).alias("scheme"), (F.col("event_type") != "view").alias("remembered"))
    return converse.carried(e, "user_id", "event_id", "ts", 86400).select("event_id", "scheme_used")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) <= 2 AS admitted FROM events")
def rate_limit(spark, d):
    return converse.admitted(table(spark, d, "events"), "event_type", "ts", "event_id", 2).select("event_id", "admitted")


@query(ORACLES["session_ttl"])
def session_ttl_stream(spark, d):
    """The same by a stream of events that arrive in three parts, none in the order of time."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("turn"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("value") > 50, F.col("event_type")).alias("scheme"), (F.col("event_type") != "view").alias("remembered"))
    out = _streamed(e, "turn", lambda s: session.remembered_in_order(s, 86400, "60 days"))
    return out.select(F.col("turn").alias("event_id"), "scheme_used")


@query(ORACLES["rate_limit"])
def rate_limit_stream(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("client"), F.col("event_id").alias("request"), F.col("ts").cast("timestamp").alias("ts"))
    out = _streamed(e, "request", lambda s: session.admitted_stream(s, 2, "60 days"))
    return out.select(F.col("request").alias("event_id"), "admitted")


def _streamed(rows: DataFrame, key: str, operator) -> DataFrame:
    """What a stream operator makes of rows, dealt to three batches by key, and of a last row in a far future that moves the watermark past them (and is left out)."""
    spark, source, target = rows.sparkSession, scratch(rows.sparkSession, "arrivals"), scratch(rows.sparkSession, "stream")
    for k in range(3):
        rows.where(F.pmod(F.xxhash64(key), F.lit(3)) == k).write.mode("append").parquet(source)
    files = len(spark.read.schema(rows.schema).parquet(source).inputFiles())
    end = rows.limit(1).withColumns({"ts": F.lit("2100-01-01").cast("timestamp"), key: F.lit(-1).cast("long")})
    end.write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files // 3)).parquet(source)
    running = operator(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target}-log").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(target).where(F.col(key) >= 0)


@query("""WITH a AS (SELECT conv_id, turn, 's' || length(text) % 2 AS scheme, CASE WHEN length(text) > 300 THEN 'long' ELSE 'short' END AS topic FROM conversations WHERE role = 'assistant' AND length(text) % 7 <> 0), c AS (SELECT conv_id, turn + s.late AS turn, 'q' || ((length(text) + s.late) % 5) AS question FROM conversations, (VALUES (0), (1), (0)) AS s(late) WHERE role = 'user'),
o(scheme, position, topic, question) AS (SELECT * FROM (VALUES ('s0'), ('s1')) AS t(scheme), (VALUES (1, 'long', 'q0'), (2, 'short', 'q1'), (3, 'other', 'q2'), (4, 'long', 'q3'), (5, 'other', 'q4')) AS u(position, topic, question) WHERE scheme = 's0' OR position <> 3), n AS (SELECT conv_id, arg_max(scheme, turn) AS scheme, arg_max(topic, turn) AS topic FROM a GROUP BY 1),
h AS (SELECT DISTINCT conv_id, question FROM (SELECT c.conv_id, c.question, c.turn, (SELECT count(*) FROM a WHERE a.conv_id = c.conv_id AND a.turn >= c.turn) AS n FROM c) WHERE n < 3),
r AS (SELECT n.conv_id, o.question, row_number() OVER (PARTITION BY n.conv_id ORDER BY position) AS place FROM n JOIN o USING (scheme) WHERE o.topic <> n.topic AND NOT EXISTS (SELECT 1 FROM h WHERE h.conv_id = n.conv_id AND h.question = o.question))
SELECT * FROM r WHERE place <= 3""")
def follow_ups(spark, d):
    """Two schemes, answers that failed, and questions clicked again."""
    c, n = table(spark, d, "conversations").withColumn("session_id", F.col("conv_id")), F.length("text")
    answers = c.where("role = 'assistant'").select("session_id", "turn", F.concat(F.lit("s"), n % 2).alias("scheme"), F.when(n > 300, "long").otherwise("short").alias("topic"), (n % 7 == 0).alias("is_error"))
    late = F.explode(F.array(F.lit(0), F.lit(1), F.lit(0))).alias("late")
    clicks = c.where("role = 'user'").select("session_id", "turn", "text", late).select("session_id", (F.col("turn") + F.col("late")).alias("turn"), F.concat(F.lit("q"), (F.length("text") + F.col("late")) % 5).alias("question"))
    topics = [(1, "long", "q0"), (2, "short", "q1"), (3, "other", "q2"), (4, "long", "q3"), (5, "other", "q4")]
    offers = spark.createDataFrame([(s, *t) for s in ("s0", "s1") for t in topics if s == "s0" or t[0] != 3], "scheme string, position int, topic string, question string")
    return converse.follow_ups(answers, clicks, offers, cooldown=3).select(F.col("session_id").alias("conv_id"), "question", F.col("place").cast("long").alias("place"))


# ---- evaluation

_GOLD = f"""SELECT CASE WHEN quality = 0 AND doc_id % 2 = 0 THEN 'ERROR' ELSE 'FACTUAL' END AS intent, toxic = 1 AS refused, {_pick(ANSWERS, 'doc_id')} || ' ' || text AS answer, CASE WHEN lang = 'en' THEN 'u' WHEN lang = 'fr' THEN '' END AS source_url,
 CASE WHEN doc_id % 3 = 0 THEN source END AS scheme, CASE WHEN doc_id % 4 = 0 THEN source WHEN doc_id % 4 = 1 THEN 'THE' WHEN doc_id % 4 = 2 THEN 'src0' END AS expected_scheme FROM labels JOIN documents USING (doc_id)"""
_WS = "chr(32) || chr(9) || chr(10) || chr(13)"


def _golden_sql(answered: str) -> str:
    return rf"""WITH r AS ({_GOLD}), f AS (SELECT *, intent = 'ERROR' AS errored, {_GONE} AS gone, regexp_matches(answer, 'https?://', 'i') AS linked, len(list_filter(string_split_regex(trim(answer, {_WS}), '[.!?]+\s'), lambda x: trim(x, {_WS}) <> '')) AS sentences FROM r),
a AS (SELECT *, NOT refused AND {answered} AND NOT gone AS answered, NOT refused AND {answered} AND gone AS missing FROM f),
c AS (SELECT count(*) AS n, count(*) FILTER (errored) AS n_errored, count(*) FILTER (answered) AS n_answered, count(*) FILTER (missing) AS n_not_found, count(*) FILTER (answered AND source_url <> '') AS n_cited, count(*) FILTER (answered AND source_url <> '' AND NOT linked) AS n_citation_valid,
 count(*) FILTER (answered AND sentences <= 4) AS n_short, count(*) FILTER (answered AND NOT linked) AS n_no_url, count(expected_scheme) AS n_scheme_expected, count(*) FILTER (scheme = expected_scheme OR (scheme IS NULL AND contains(lower(answer), lower(expected_scheme)))) AS n_scheme_ok FROM a),
m AS (SELECT *, round(n_answered / greatest(n - n_errored, 1), 3) AS retrieval_accuracy, round(n_cited / greatest(n_answered, 1), 3) AS citation_rate, round(n_citation_valid / greatest(n_answered, 1), 3) AS citation_accuracy, round(n_short / greatest(n_answered, 1), 3) AS short_rate,
 round(n_no_url / greatest(n_answered, 1), 3) AS no_url_rate, round(n_scheme_ok / greatest(n_scheme_expected, 1), 3) AS scheme_accuracy FROM c) SELECT *, retrieval_accuracy >= 0.70 AND citation_accuracy >= 0.90 AS passed FROM m"""


def _responses(spark, d):
    n = F.col("doc_id")
    r = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return r.select(
        F.when((F.col("quality") == 0) & (n % 2 == 0), "ERROR").otherwise("FACTUAL").alias("intent"), (F.col("toxic") == 1).alias("refused"), F.concat_ws(" ", _choice(ANSWERS, n), "text").alias("answer"), F.when(F.col("lang") == "en", "u").when(F.col("lang") == "fr", "").alias("source_url"),
        F.when(n % 3 == 0, F.col("source")).alias("scheme"), F.when(n % 4 == 0, F.col("source")).when(n % 4 == 1, "THE").when(n % 4 == 2, "src0").alias("expected_scheme"),
    )


@query(_golden_sql("NOT errored"))
def eval_metrics(spark, d):
    return evaluate.passed(evaluate.golden(_responses(spark, d)))


@query(_golden_sql("true"))
def eval_metrics_errors_answered(spark, d):
    return evaluate.passed(evaluate.golden(_responses(spark, d), errors_answered=True))


_CLASSES = list(evaluate.EQUIVALENT)
_EXPECT = "CASE WHEN toxic = 1 THEN 'PII_ACCOUNT' " + " ".join(f"WHEN doc_id % 5 = {k} THEN {quote(c)}" for k, c in enumerate(_CLASSES)) + " END"
_GOT = "CASE WHEN n_chars % 3 = 0 AND toxic = 1 THEN 'PII_ACCOUNT' " + " ".join(f"WHEN n_chars % 5 = {k} THEN {quote(c)}" for k, c in enumerate(_CLASSES)) + " END"
_EQUAL = " OR ".join(f"(expected = {quote(a)} AND got IN ({', '.join(map(quote, b))}))" for a, b in evaluate.EQUIVALENT.items())


@query(f"""WITH r AS (SELECT {_EXPECT} AS expected, {_GOT} AS got, n_chars > 300 AS refused FROM labels JOIN documents USING (doc_id)), g AS (SELECT *, refused AND (expected = got OR {_EQUAL}) AS good FROM r),
c AS (SELECT count(*) AS n, count(*) FILTER (good) AS n_correct, count(*) FILTER (expected = 'PII_ACCOUNT') AS n_pii, count(*) FILTER (expected = 'PII_ACCOUNT' AND refused AND got = 'PII_ACCOUNT') AS n_pii_blocked FROM g), m AS (SELECT *, round(n_correct / greatest(n, 1), 3) AS refusal_accuracy, round(n_pii_blocked / greatest(n_pii, 1), 3) AS pii_accuracy FROM c)
SELECT *, refusal_accuracy >= 0.95 AND pii_accuracy >= 1.0 AS passed FROM m""")
def guardrail_metrics(spark, d):
    r = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.expr(_EXPECT).alias("expected"), F.expr(_GOT).alias("refusal_type"), (F.col("n_chars") > 300).alias("refused"))
    return evaluate.passed(evaluate.guardrail(r))


@query("SELECT doc_id FROM documents ORDER BY sha1(doc_id::VARCHAR), doc_id LIMIT 50")
def seeded_sample(spark, d):
    return evaluate.sampled(table(spark, d, "documents").select("doc_id"), 50, "doc_id")


from . import queries_service  # noqa: E402, F401  (registers its queries here)
