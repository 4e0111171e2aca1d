"""Queries of sources, stores, loads and answers over the driver's tables, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import intent as I
from .functions import personal as P
from .functions import rules as R
from .functions import text as X
from .operators import converse, evaluate, retrieve
from .plans import lifecycle
from .queries import _CHUNKS, _GONE, _HAY, _INTENT, _JACCARD, _LISTED_BRAND, _NORMAL, _SOURCE, _TOK, _categories_sql, _choice, _expand_sql, _flags_sql, _heading_sql, _listed, _pick, _vote_sql, ORACLES, QUESTIONS, case, query, quote, table
from .sources import files, store

# ---- functions of texts

HOUSES = {"Alpha": ["licensed", "copyright"], "Beta": ["der ", "die "]}


@query(f"SELECT doc_id, {case([(' OR '.join(f'contains(lower(text), {quote(a)})' for a in names), s) for s, names in HOUSES.items()], quote('House'))} AS organization FROM documents")
def organization_detection(spark, d):
    return table(spark, d, "documents").select("doc_id", R.organization(F.col("text"), HOUSES, "House").alias("organization"))


_FILE = "replace(source, 'src', 'The_File-') || '.v1.pdf'"


@query(rf"""SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS squeezed, CASE WHEN contains(lower(text), 'licensed') THEN text ELSE text || ' Licensed' END = scoped AS scoped_ok, stem, sha256(trim(regexp_replace(regexp_replace(said, 'https?://\S+', '', 'gi'), '\s{{2,}}', ' ', 'g'), ' ')) AS without_urls, quotes
FROM (SELECT *, CASE WHEN contains(lower(text), 'licensed') THEN text ELSE text || ' Licensed' END AS scoped, replace(replace(regexp_replace({_FILE}, '\.[^.]*$', ''), '_', ' '), '-', ' ') || ' SID' AS stem, 'see HTTP://a.b/' || source || '  and ' || text AS said, sha256(translate(replace(text, ' ', '’'), '‘’“”', '''''""')) AS quotes FROM documents)""")
def text_tidy(spark, d):
    """White space, a question's scheme, a title from a file name, answers without addresses, straight quotes."""
    docs = table(spark, d, "documents")
    text = F.col("text")
    said = F.concat(F.lit("see HTTP://a.b/"), "source", F.lit("  and "), text)
    name = F.concat(F.replace("source", F.lit("src"), F.lit("The_File-")), F.lit(".v1.pdf"))
    scoped = F.when(F.lower(text).contains("licensed"), text).otherwise(F.concat(text, F.lit(" Licensed")))
    return docs.select("doc_id", F.sha2(X.squeeze(text), 256).alias("squeezed"), (X.scoped(text, F.lit("Licensed")) == scoped).alias("scoped_ok"), X.stem_title(name, F.lit("SID")).alias("stem"), F.sha2(X.without_urls(said), 256).alias("without_urls"), F.sha2(X.straight_quotes(F.replace(text, F.lit(" "), F.lit("’"))), 256).alias("quotes"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), m AS (SELECT doc_id, n, CASE WHEN n % 7 = 0 THEN 'Page ' || n WHEN n % 7 = 1 THEN ' - ' || n || ' - ' ELSE line END AS line FROM l)
SELECT doc_id, n::BIGINT AS n, lower(trim(line, ' ')) = '' OR regexp_matches(line, '^\s*(page\s*)?[-–—|]?\s*\d{{1,4}}\s*[-–—|]?\s*$', 'i') OR regexp_matches(lower(trim(line, ' ')), '^the .*|^und.*') AS noise FROM m""")
def noise_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("n", (F.col("p") + 1).cast("long"))
    line = F.when(F.col("n") % 7 == 0, F.concat(F.lit("Page "), "n")).when(F.col("n") % 7 == 1, F.concat(F.lit(" - "), "n", F.lit(" - "))).otherwise(F.col("line"))
    return lines.withColumn("line", line).select("doc_id", "n", X.is_noise(F.col("line"), ["^the .*", "^und.*"]).alias("noise"))


@query("SELECT event_id, 'intent=' || event_type || ',topic=' || user_id AS logged FROM events")
def log_fields(spark, d):
    """Of an event's fields those that a log may hold."""
    fields = F.create_map(F.lit("intent"), F.col("event_type"), F.lit("question"), F.col("props"), F.lit("topic"), F.col("user_id").cast("string"), F.lit("value"), F.col("value").cast("string"))
    kept = P.loggable(fields)
    pairs = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(spark, d, "events").select("event_id", F.array_join(pairs, ",").alias("logged"))


@query("""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN trim(text, ' ') = '' THEN 'asked' END, CASE WHEN length(text) > 400 THEN 'short' END, CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' END], lambda x: x IS NOT NULL), ',') AS broken FROM conversations""")
def validation(spark, d):
    """Requests that break rules, with their names, beside those that keep them."""
    good, bad = files.validated(table(spark, d, "conversations"), {"asked": F.trim("text") != "", "short": F.length("text") <= 400, "role": F.col("role").isin("user", "assistant")})
    return good.select("conv_id", "turn", F.lit("").alias("broken")).unionByName(bad.select("conv_id", "turn", F.array_join("broken", ",").alias("broken")))


@query(r"""WITH w AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM conversations), b AS (SELECT conv_id, turn, ('0x' || substr(md5(w), 1, 8))::UBIGINT % 384 AS bucket, count(*) AS n FROM w GROUP BY ALL),
n AS (SELECT conv_id, turn, count(*) AS n_buckets, round(max(n) / sqrt(sum(n * n)), 6) AS most, round(sum(n * bucket) / sqrt(sum(n * n)), 4) AS moment FROM b GROUP BY ALL) SELECT conv_id, turn, coalesce(n_buckets, 0) AS n_buckets, coalesce(most, 0.0) AS most, coalesce(moment, 0.0) AS moment FROM conversations LEFT JOIN n USING (conv_id, turn)""")
def embeddings_hashed(spark, d):
    """Unit vectors of 384 numbers: how many aren't zero, the largest, and a sum weighed by place."""
    v = table(spark, d, "conversations").select("conv_id", "turn", retrieve.hashed_embedding(F.col("text")).alias("v"))
    moment = F.aggregate(F.transform("v", lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return v.select("conv_id", "turn", F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("n_buckets"), F.round(F.array_max("v"), 6).alias("most"), F.round(moment, 4).alias("moment"))


# ---- manifests and files


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """A manifest row for each document, some without a file name."""
    docs, n = table(spark, d, "documents"), F.col("doc_id")
    return docs.select(
        F.when(n % 13 != 5, F.concat(F.lit(" "), "source", F.lit(" no, "), n, F.lit(".txt"))).otherwise(" ").alias("file_name"), F.substring("text", 1, 60).alias("title"), F.when(n % 3 == 0, "S").otherwise(" ").alias("scheme"), F.lit('a "house"').alias("organization"),
        _choice(["SID", "KIM", "TER_DATA"], n).alias("document_type"), F.when(n % 2 == 0, "2024-02-03").otherwise("").alias("document_date"), F.lit("").alias("effective_date"), F.lit(None).cast("string").alias("source_url"), n.cast("string").alias("source_id"),
    )


@query(f"""SELECT source || ' no, ' || doc_id || '.txt' AS file_name, sha256(trim(substr(text, 1, 60), ' ')) AS title_sha256, CASE WHEN doc_id % 3 = 0 THEN 'S' ELSE '' END AS scheme, 'a "house"' AS organization, {_pick(['SID', 'KIM', 'TER_DATA'], 'doc_id')} AS document_type, CASE WHEN doc_id % 2 = 0 THEN '2024-02-03' ELSE '' END AS document_date, '' AS source_url, doc_id::VARCHAR AS source_id FROM documents WHERE doc_id % 13 <> 5""")
def manifest_scan(spark, d):
    """Written as CSV, with quotes, commas and line feeds in values, and read back; a manifest that isn't there adds nothing."""
    path = store.scratch(spark, "manifest")
    files.write_manifest(_manifest(spark, d), path)
    found = files.manifest(spark, path).unionByName(files.manifest(spark, f"{path}-none"))
    return found.select("file_name", F.sha2("title", 256).alias("title_sha256"), "scheme", "organization", "document_type", "document_date", "source_url", "source_id")


@query("""WITH m AS (SELECT doc_id, 'f' || doc_id || '.txt' AS file_name, 'new' AS version FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'f' || doc_id || '.txt', 'old' FROM documents WHERE doc_id % 3 = 0 AND doc_id IN (SELECT doc_id FROM labels))
SELECT file_name, version, doc_id IN (SELECT doc_id FROM labels) AS on_disk FROM m""")
def manifest_preserved(spark, d):
    """New rows, and the old ones that the new lack and whose files are still there; which have a file."""
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), "doc_id", F.lit(".txt")).alias("file_name"))
    disk = table(spark, d, "labels").select(F.concat(F.lit("f"), "doc_id", F.lit(".txt")).alias("file_name"))
    kept = files.preserved(rows.withColumn("version", F.lit("old")), rows.where("doc_id % 3 <> 0").withColumn("version", F.lit("new")), disk)
    have, lack = files.present(kept, disk)
    return have.withColumn("on_disk", F.lit(True)).unionByName(lack.withColumn("on_disk", F.lit(False))).drop("doc_id")


FOLDERS, DEFAULTS = {"Folder FR": ["/fr"], "Folder A": ["/a"]}, {"o1": "http://o1", "Name B": "http://b", "": "never"}
_PATHS = "SELECT page_id, '/docs' || CASE page_id % 3 WHEN 0 THEN '/fr' WHEN 1 THEN '/x' ELSE '/a' END || '/' || CASE page_id % 5 WHEN 1 THEN 'beta' ELSE 'plain' END || page_id || '.pdf' AS path, CASE page_id % 5 WHEN 1 THEN 'beta' ELSE 'plain' END || page_id || '.pdf' AS file_name, 'o' || page_id % 2 AS organization FROM pages"


@query(f"""WITH p AS ({_PATHS}), s AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN 'Folder FR' WHEN page_id % 3 = 2 THEN 'Folder A' WHEN page_id % 5 = 1 THEN 'Name B' ELSE '' END AS scheme FROM p)
SELECT page_id, scheme, CASE WHEN scheme = 'Folder FR' THEN 'http://listed' WHEN scheme = '' AND organization = 'o1' THEN 'http://o1' WHEN scheme = 'Name B' THEN 'http://b' WHEN scheme = '' THEN 'never' ELSE '' END AS source_url FROM s""")
def source_urls(spark, d):
    """A file's scheme by its folder, else by its name; its address by scheme, else by organization, else by default."""
    n = F.col("page_id")
    name = F.concat(F.when(n % 5 == 1, "beta").otherwise("plain"), n, F.lit(".pdf"))
    rows = table(spark, d, "pages").select(n, F.concat(F.lit("/docs"), F.when(n % 3 == 0, "/fr").when(n % 3 == 1, "/x").otherwise("/a"), F.lit("/"), name).alias("path"), name.alias("file_name"), F.concat(F.lit("o"), n % 2).alias("organization"))
    lookup = spark.createDataFrame([("scope", "Folder FR", "http://listed")], "kind string, name string, url string")
    return files.with_urls(files.placed(rows, FOLDERS, {"Name B": ["beta"]}), lookup, DEFAULTS).select("page_id", "scheme", "source_url")


@query("""WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderpriority, o_orderstatus, o_totalprice FROM orders)
SELECT o_custkey AS doc_id, o_orderkey AS row_no, CASE WHEN n % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END || ' of ' || 'Fund ' || o_custkey || ': ' || CASE WHEN n % 3 = 0 THEN o_orderpriority ELSE o_orderstatus || CASE WHEN n % 3 = 1 THEN ' more' ELSE '' END END AS fact FROM n WHERE o_custkey % 4 <> 0
UNION ALL SELECT DISTINCT o_custkey, 0, 'Fund name of Fund ' || o_custkey || ': Fund ' || o_custkey FROM orders WHERE o_custkey % 4 <> 0""")
def summary_tables(spark, d):
    """Customers' orders as summary tables: numbered rows with blanks, rows of two cells, and tables without the marker, which give nothing."""
    o = table(spark, d, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    body = o.withColumn("n", n).select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("row_no"),
        F.when(F.col("n") % 3 == 0, F.array("o_orderstatus", F.lit(" "), "o_orderpriority")).when(F.col("n") % 3 == 1, F.array((F.col("n") % 900).cast("string"), F.lit(None), "o_orderpriority", "o_orderstatus", F.lit("more"))).otherwise(F.array((F.col("n") % 900).cast("string"), "o_orderpriority", "o_orderstatus")).alias("cells"),
    )
    one = o.select(F.col("o_custkey").alias("doc_id")).distinct()
    head = one.select("doc_id", F.lit(-1).cast("long").alias("row_no"), F.array(F.when(F.col("doc_id") % 4 != 0, "Scheme Summary\nDocument").otherwise("Other document")).alias("cells"))
    name = one.select("doc_id", F.lit(0).cast("long").alias("row_no"), F.array(F.lit(""), F.lit("Fund name"), F.concat(F.lit("Fund "), "doc_id")).alias("cells"))
    rows = head.unionByName(name).unionByName(body).withColumn("table_no", F.lit(0))
    return files.summary_facts(rows).select("doc_id", "row_no", "fact")


@query("""WITH r AS (SELECT o_custkey AS doc_id, o_orderpriority AS scheme, o_orderdate::DATE AS day, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%d %b %Y') END AS raw, (o_orderkey % 97)::VARCHAR AS a, (o_orderkey % 89)::VARCHAR AS b FROM orders WHERE o_orderkey % 10 <> 7),
x AS (SELECT doc_id, scheme, arg_max({'raw': raw, 'a': a, 'b': b}, (day, -o_orderkey)) AS x, max(day) AS date FROM r GROUP BY 1, 2),
l AS (SELECT *, 'Scheme Name: ' || scheme || ' || Date: ' || x.raw || ' || Regular Plan - Base Expense Ratio: ' || x.a || ' || Regular Plan - Total TER: 1' || x.a || ' || Direct Plan - Base Expense Ratio: ' || x.b || CASE WHEN doc_id % 2 = 0 THEN ' || Direct Plan - Total TER: 2' || x.b ELSE '' END AS row FROM x)
SELECT doc_id, scheme, date, 'Total Expense Ratio (TER) Report - ' || scheme || chr(10) || 'The Total Expense Ratio (TER) of ' || scheme || ' as of ' || x.raw || ' is 1' || x.a || '% for Regular Plan' || CASE WHEN doc_id % 2 = 0 THEN ' and 2' || x.b || '% for Direct Plan' ELSE '' END || '.' || chr(10) || row AS text FROM l""")
def expense_reports(spark, d):
    """Orders as dated expense rows of a workbook for each customer: merged titles, blank rows, days in three formats and some that can't be read."""
    o, n, doc = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    raw = F.when(n % 10 == 7, "soon").when(n % 3 == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).when(n % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "dd MMM yyyy"))
    a, b = (n % 97).cast("string"), (n % 89).cast("string")
    total = F.when(doc % 2 == 0, F.concat(F.lit("2"), b)).otherwise(" ")
    body = o.select(doc.alias("doc_id"), n.alias("row_idx"), F.array("o_orderpriority", F.lit(None), raw, a, F.concat(F.lit("1"), a), b, total).alias("cells"))
    one = body.select("doc_id").distinct()
    tops = [[" ", None], ["", "", "", "Regular Plan", "", "Direct Plan"], ["", ""], ["Scheme Name", "NSDL", "Date", "Base Expense Ratio", "Total TER", "Base Expense Ratio", "Total TER"]]
    for k, cells in enumerate(tops):
        body = body.unionByName(one.select("doc_id", F.lit(k - len(tops) - 1).cast("long").alias("row_idx"), F.array(*map(F.lit, cells)).cast("array<string>").alias("cells")))
    return files.expense_facts(body).select("doc_id", "scheme", "date", "text")


# ---- the store


def _loads(spark: SparkSession, d: str) -> list[tuple[DataFrame, DataFrame]]:
    """All documents with a chunk each, and those with labels again with another scheme: documents and chunks of two loads."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.concat(F.lit("t"), "doc_id").alias("title"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("scheme"), F.lit("o").alias("organization"), F.lit("SID").alias("document_type"), F.lit("").alias("document_date"), F.lit("").alias("effective_date"), F.lit("").alias("source_url"), F.concat(F.lit("f"), "doc_id").alias("file_name"))
    again = docs.join(table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("source_id")), "source_id", "left_semi").withColumn("scheme", F.lit("again"))
    return [(df, df.select("source_id", F.lit(said).alias("chunk_text"))) for df, said in ((docs, "first"), (again, "second"))]


def _loaded(spark: SparkSession, d: str) -> str:
    """The path of a store after both loads."""
    path = store.scratch(spark, "store")
    for docs, chunks in _loads(spark, d):
        store.load(docs, chunks, path)
    return path


def _whole(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    docs, chunks = store.current(spark, path, version)
    return docs.select("source_id", "title", "scheme").join(chunks, "source_id")


_LABELLED = "doc_id IN (SELECT doc_id FROM labels)"
_LATEST = f"SELECT doc_id::VARCHAR AS source_id, 't' || doc_id AS title, CASE WHEN {_LABELLED} THEN 'again' WHEN doc_id % 3 <> 0 THEN source END AS scheme, CASE WHEN {_LABELLED} THEN 'second' ELSE 'first' END AS chunk_text FROM documents"
_FIRST = "SELECT doc_id::VARCHAR AS source_id, 't' || doc_id AS title, CASE WHEN doc_id % 3 <> 0 THEN source END AS scheme, 'first' AS chunk_text FROM documents"


@query(_LATEST)
def store_loads(spark, d):
    """Documents and chunks after two loads: a source's rows are those of its latest."""
    return _whole(spark, _loaded(spark, d))


@query(_LATEST)
def store_recovered(spark, d):
    """The same where the second load failed at first, in its documents and in its chunks; then compacted, and what failed or was replaced deleted."""
    path, (first, second) = store.scratch(spark, "store"), _loads(spark, d)
    store.load(*first, path)
    broken = F.when(F.length("source_id") > 0, F.raise_error(F.lit("lost")).cast("string"))
    for docs, chunks in ((second[0].withColumn("title", broken), second[1]), (second[0], second[1].withColumn("chunk_text", broken))):
        try:
            store.load(docs, chunks, path)
        except Exception as x:
            if "lost" not in str(x):
                raise
    store.load(*second, path)
    store.compact(spark, path)
    store.vacuum(spark, path)
    return _whole(spark, path)


@query(_FIRST)
def store_interleaved(spark, d):
    """Two writers: the one that began first commits last, so its load is the later one."""
    path, (first, second) = store.scratch(spark, "store"), _loads(spark, d)
    parts = [store.written(*x, path) for x in (first, second)]
    for part in reversed(parts):
        store.commit(spark, path, part)
    return _whole(spark, path)


@query(f"SELECT *, 0 AS version FROM ({_FIRST}) UNION ALL SELECT *, 1 FROM ({_LATEST})")
def store_versions(spark, d):
    """The store as each of its loads left it, read after the second was compacted."""
    path = _loaded(spark, d)
    store.compact(spark, path)
    return _whole(spark, path, 0).withColumn("version", F.lit(0)).unionAll(_whole(spark, path, 1).withColumn("version", F.lit(1)))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS none_first, doc_id::VARCHAR AS source_id, 't' || doc_id AS title FROM documents")
def store_listed(spark, d):
    """The list of a store's documents, whole."""
    docs, _ = store.current(spark, _first_only(spark, d))
    return store.listed(docs).select(F.when(F.col("scheme").isNull(), 0).otherwise(1).alias("none_first"), "source_id", "title")


def _first_only(spark: SparkSession, d: str) -> str:
    path = store.scratch(spark, "store")
    store.load(*_loads(spark, d)[0], path)
    return path


@query(f"SELECT source_id, title, scheme FROM ({_LATEST}) WHERE source_id = '7'")
def source_lookup(spark, d):
    """One source of a compacted store: one bucket of its documents is opened."""
    path = _loaded(spark, d)
    store.compact(spark, path)
    return store.source(store.current(spark, path)[0], "7").select("source_id", "title", "scheme")


_ONE_PAGE = f"SELECT doc_id, 1 AS page, (i - 1)::INT AS line_no, lines[i] AS line, false AS is_table FROM (SELECT doc_id, string_split({_NORMAL}, chr(10)) AS lines FROM documents WHERE doc_id % 10 NOT IN (3, 4)), unnest(range(1, len(lines) + 1)) AS t(i)"
_LOADS = f"""{_flags_sql(_ONE_PAGE, _heading_sql(R.HEADINGS))}, {_CHUNKS}, k AS (SELECT doc_id, count(*) AS n FROM piece WHERE length(piece) >= 40 GROUP BY 1),
j AS (SELECT CASE WHEN doc_id % 10 = 5 THEN 'Riskometer ' ELSE '' END || 'f' || doc_id || '.txt' AS file_name, doc_id::VARCHAR AS source_id, CASE WHEN doc_id % 10 = 4 THEN 'failed' WHEN doc_id % 10 = 3 THEN 'missing' WHEN n IS NULL THEN 'empty' ELSE 'ok' END AS status, coalesce(n, 0) AS n_chunks FROM documents LEFT JOIN k USING (doc_id))"""


def _ingested(spark: SparkSession, d: str, path: str | None = None, **options) -> DataFrame:
    docs, n = table(spark, d, "documents"), F.col("doc_id")
    name = F.concat(F.when(n % 10 == 5, "Riskometer ").otherwise(""), F.lit("f"), n, F.lit(".txt")).alias("file_name")
    none = [F.lit("").alias(c) for c in ("title", "organization", "document_date", "effective_date", "source_url")]
    manifest = docs.select(n.alias("row_idx"), name, *none, F.when(n % 10 == 7, "Own Fund").otherwise("").alias("scheme"), F.when(n % 10 == 6, "ter_data").otherwise("SID").alias("document_type"), n.cast("string").alias("source_id"))
    pages = docs.where("doc_id % 10 not in (3, 4)").select(name, F.lit(1).alias("page"), "text", F.lit(False).alias("is_table"))
    rejected = docs.where("doc_id % 10 = 4").select(name, F.lit("unsupported: .txt").alias("reason"))
    return lifecycle.ingest(spark, manifest, pages, rejected, path or store.scratch(spark, "store"), **options)


@query(_LOADS + " SELECT *, 'one' AS part FROM j WHERE file_name = 'f12.txt' UNION ALL SELECT *, 'first' FROM j WHERE source_id::BIGINT IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 30)")
def ingestion_parts(spark, d):
    """One file of the manifest, and its first thirty rows, each loaded into a store of its own."""
    one, first = _ingested(spark, d, only_file="f12.txt"), _ingested(spark, d, first=30)
    return one.withColumn("part", F.lit("one")).unionByName(first.withColumn("part", F.lit("first")))


_ROWED = {**R.ROW_DISCLOSURE, "token": "the "}


@query(f"""WITH p AS ({_ONE_PAGE}), r AS (SELECT doc_id, 10000 + line_no AS n, {quote(_ROWED['header'])} || chr(10) || trim(line, ' ') AS chunk_text FROM p WHERE doc_id % 10 = 5 AND contains(line, 'the ') AND trim(line, ' ') <> '')
SELECT doc_id::VARCHAR AS source_id, doc_id || '-0-' || n AS chunk_id, sha256(chunk_text) AS text_sha256, {quote(_ROWED['title'])} AS section, {quote(_ROWED['topic'])} AS topic FROM r""")
def ingested_rows(spark, d):
    """Disclosures in the store: a chunk for each of their rows that has the token."""
    path = store.scratch(spark, "store")
    _ingested(spark, d, path, disclosure=_ROWED)
    return store.current(spark, path)[1].where(F.col("section") == _ROWED["title"]).select("source_id", "chunk_id", F.sha2("chunk_text", 256).alias("text_sha256"), "section", "topic")


@query(_LOADS + " SELECT * FROM j")
def ingestion(spark, d):
    """Documents as files of one page, loaded: some failed to be read, some are missing, some give no chunk."""
    return _ingested(spark, d)


@query(_LOADS + " SELECT count(*) FILTER (status <> 'failed') AS files_ok, count(*) FILTER (status = 'failed') AS files_failed, count(*) FILTER (status = 'missing') AS files_missing, sum(n_chunks)::BIGINT AS chunks_ingested FROM j")
def ingestion_summary(spark, d):
    return lifecycle.ingestion_summary(_ingested(spark, d))


def _shaped(word: str) -> str:
    """A keyword as the text that votes are counted in has it: two blanks for each character that belongs to no word."""
    return re.sub(r"\W", "  ", word.strip().replace("-", " "))


_SHAPED = {t: [_shaped(w) for w in words] for t, words in R.CHUNK_TOPICS.items()}
_SCORES = [(t, f"({e}) * CASE WHEN {' OR '.join(f'contains(hint, {quote(f" {w} ")})' for w in _SHAPED[t])} THEN 3 ELSE 1 END") for t, e in _vote_sql(_SHAPED, "hay")]
_MOST = f"greatest({', '.join(f'({e})' for _, e in _SCORES)})"
_PLAIN = "replace(lower(title || chr(10) || substr(piece, 1, 1500)), '-', ' ')"
_AMOUNT = f"contains({_PLAIN}, 'minimum application amount') OR (contains({_PLAIN}, 'minimum amount') AND contains(hay, ' sip '))"
_TEXT = "CASE WHEN title = 'Preamble' THEN piece ELSE title || chr(10) || piece END"


@query(f"""{_flags_sql(_ONE_PAGE, _heading_sql(R.HEADINGS))}, {_CHUNKS}, h AS (SELECT *, {_HAY.replace('text', "(title || chr(10) || substr(piece, 1, 1500))")} AS hay, {_HAY.replace('text', 'title')} AS hint FROM piece WHERE length(piece) >= 40)
SELECT doc_id::VARCHAR AS source_id, doc_id || '-' || section_no || '-' || chunk_no AS chunk_id, sha256({_TEXT}) AS text_sha256, substr(title, 1, 200) AS section, CASE WHEN doc_id % 10 = 5 THEN 'riskometer' WHEN doc_id % 10 = 6 THEN 'expense_ratio' WHEN {_AMOUNT} THEN 'minimum_investment' ELSE {case([(f'{_MOST} = 0', 'general'), *((f'{e} = {_MOST}', t) for t, e in _SCORES)], 'NULL')} END AS topic,
CASE WHEN doc_id % 10 = 7 THEN 'Own Fund' ELSE {case([(' OR '.join(f'contains(lower({_TEXT}), {quote(a)})' for a in names), n) for n, names in R.DOCUMENT_SCHEMES.items()], 'NULL')} END AS scheme, 1 AS page_number FROM h""")
def ingested_chunks(spark, d):
    """What a load leaves in the store: texts, sections, topics and schemes of chunks, with what the file forces, and a vector for each."""
    path = store.scratch(spark, "store")
    _ingested(spark, d, path)
    _, chunks = store.current(spark, path)
    return chunks.where(F.size("embedding") == 384).select("source_id", "chunk_id", F.sha2("chunk_text", 256).alias("text_sha256"), "section", "topic", "scheme", "page_number")


@query(f"SELECT DISTINCT topic AS name FROM ({ORACLES['ingested_chunks']})")
def topic_names(spark, d):
    """The topics that occur among the chunks that a load leaves."""
    path = store.scratch(spark, "store")
    _ingested(spark, d, path)
    return store.topics(store.current(spark, path)[1])


@query("""SELECT 'k=' || doc_id // 50 AS folder, 'txt' AS suffix, 'document' AS label, sha256(string_agg(replace(text, chr(10), ' ') || chr(10), '' ORDER BY doc_id)) AS text_sha256 FROM documents GROUP BY doc_id // 50""")
def text_files(spark, d):
    """Documents written as text files of fifty, in as many folders, found there and read as a page each."""
    path = store.scratch(spark, "texts")
    docs = table(spark, d, "documents").select(F.expr("doc_id div 50").alias("k"), "doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    docs.repartition("k").sortWithinPartitions("k", "doc_id").drop("doc_id").write.partitionBy("k").text(path)
    pages, _ = files.extracted(spark, path)
    found = files.listing(spark, path, excluded=["none.txt"]).select("path", "suffix")
    return pages.join(found, "path").select(F.element_at(F.split("path", "/"), -2).alias("folder"), "suffix", "label", F.sha2("text", 256).alias("text_sha256"))


@query("WITH s AS (SELECT doc_id FROM documents ORDER BY sha1(doc_id::VARCHAR), doc_id LIMIT 50) SELECT doc_id, sha256(text) AS text_sha256, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM s)")
def json_results(spark, d):
    """A sample written as one JSON document with its count and read back."""
    path = store.scratch(spark, "json")
    store.write_json(evaluate.sampled(table(spark, d, "documents").select("doc_id", "text", "lang"), 50, "doc_id"), path, "questions", description="a sample")
    return files.evaluation_set(spark, path, "questions").select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang")


# ---- answers


@query("""WITH e AS (SELECT conv_id AS query_id, turn + 1 AS place, 'T' || role || ' (page ' || CASE WHEN turn % 3 = 0 THEN 'None' ELSE turn::VARCHAR END || ')' || chr(10) || text AS piece FROM conversations)
SELECT query_id, sha256(string_agg(piece, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place)) AS context_sha256 FROM e GROUP BY 1""")
def contexts(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("place"), F.col("text").alias("chunk_text"), F.concat(F.lit("T"), "role").alias("title"), F.when(F.col("turn") % 3 != 0, F.col("turn")).alias("page_number"))
    return converse.contexts(rows).select("query_id", F.sha2("context", 256).alias("context_sha256"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Doc ' || conv_id ELSE role END AS title, 'http://' || conv_id AS url, turn AS page, 's' || conv_id AS source_id,
 CASE WHEN turn % 5 = 0 THEN 'FAILED' WHEN role = 'system' THEN 'REFUSED/' || role WHEN turn % 3 = 0 THEN 'NOT_FOUND' WHEN conv_id % 2 = 0 THEN 'OK' ELSE 'NO-SOURCE' END AS status FROM conversations""")
def citations(spark, d):
    """What an answer cites, and what a smoke run says of it."""
    turn, conv = F.col("turn"), F.col("conv_id")
    cited = converse.citation(F.when(turn % 2 == 0, F.concat(F.lit("Doc "), conv)).otherwise(""), F.col("role"), F.concat(F.lit("http://"), conv), turn, F.concat(F.lit("s"), conv))
    said = F.when(turn % 5 != 0, F.when(turn % 3 == 0, "It couldn't be found").otherwise("1 %"))
    status = converse.smoke_status(F.col("role") == "system", F.col("role"), said, F.when(conv % 2 == 0, "u"))
    return table(spark, d, "conversations").select("conv_id", "turn", cited.alias("c"), status.alias("status")).select("conv_id", "turn", "c.*", "status")


def _parrot(model: str, context: str, question: str) -> str:
    """A generator that is limited at times, fails at times, and else repeats what it was given."""
    turn = int(question.split(" ")[0])
    if model == "busy" or turn % 5 == 4:
        raise converse.RateLimited(0)
    if turn % 5 == 3:
        raise ValueError(question)
    return f"{model}: {question} / {context[::-1]}"


_PARROT = """SELECT conv_id, turn, CASE WHEN turn % 5 < 3 THEN sha256('m: ' || turn || ' ' || role || ' / ' || reverse(text)) END AS answer_sha256, CASE WHEN turn % 5 < 3 THEN 'm' {0} END AS model, CASE turn % 5 WHEN 3 THEN {1} WHEN 4 THEN 'RateLimited' END AS error FROM conversations"""


def _spoken(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("context"), F.concat_ws(" ", F.col("turn").cast("string"), "role").alias("question"))


@query(_PARROT.format("WHEN turn % 5 = 3 THEN 'm'", "'ValueError'"))
def generated_answers(spark, d):
    """Every turn answered by a generator with two models, of which the first is always busy."""
    said = converse.generated(F.col("context"), F.col("question"), _parrot, ["busy", "m"], attempts=2)
    return _spoken(spark, d).withColumn("x", said).select("conv_id", "turn", F.sha2("x.answer", 256).alias("answer_sha256"), "x.model", "x.error")


@query(_PARROT.format("WHEN turn % 5 = 3 THEN 'm'", "'ValueError'"))
def generated_rounds(spark, d):
    """The same in rounds, broken off after the first and gone on with."""
    rows, path = _spoken(spark, d), store.scratch(spark, "said")
    converse.generated_in_rounds(rows, "id", _parrot, ["busy", "m"], path, attempts=2, rounds=1)
    found = converse.generated_in_rounds(rows, "id", _parrot, ["busy", "m"], path, attempts=2)
    return rows.select("conv_id", "turn", "id").join(found, "id").select("conv_id", "turn", F.sha2("answer", 256).alias("answer_sha256"), "model", "error")


# ---- search, from questions to hits

_CHUNK_SCHEMES, _CHUNK_TOPICS, _ORGS, _KINDS = list(R.QUERY_SCHEMES), ["sip", "exit_load", "benchmark", "lock_in", "purchase", "expense_ratio"], list(R.ORGANIZATION_RANK), ["SID", "FAQ_DATASET", "FORM"]
_SEARCHED = rf"SELECT doc_id AS id, {_pick(QUESTIONS, 'doc_id // 100')} || ' ' || CASE WHEN doc_id % 300 = 100 THEN 'my mail is a.b@c.co ' ELSE '' END || trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS q FROM documents WHERE doc_id % 100 = 0"
_CLASSED = _INTENT.replace(_LISTED_BRAND, "").replace("SELECT id, topic, scheme, CASE WHEN hard", "SELECT id, q, cats, topic, scheme, CASE WHEN hard")
_CLASSED = f"WITH v AS ({_SEARCHED}), l AS (" + _CLASSED.split("), l AS (", 1)[1]
_BUCKETS = r"SELECT {0}, ('0x' || substr(md5(w), 1, 8))::UBIGINT % 384 AS bucket, count(*)::DOUBLE AS n FROM (SELECT {0}, unnest(list_filter(string_split_regex(lower({1}), '\s+'), lambda x: x <> '')) AS w FROM {2}) GROUP BY ALL"

@query(f"""{_flags_sql(_ONE_PAGE, _heading_sql(R.HEADINGS))}, {_CHUNKS}, t AS (SELECT doc_id || '-' || section_no || '-' || chunk_no AS chunk_id, {_TEXT} AS said FROM piece WHERE length(piece) >= 40), b AS ({_BUCKETS.format('chunk_id', 'said', 't')})
SELECT chunk_id, round(sum((bucket + 1) * n) / sqrt(sum(n * n)), 6) AS weighted, count(*) AS places FROM b GROUP BY 1""")
def ingested_vectors(spark, d):
    """The values of the vectors that a load leaves: of each chunk their sum, weighted by place, and how many aren't zero."""
    path = store.scratch(spark, "store")
    _ingested(spark, d, path)
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return store.current(spark, path)[1].select("chunk_id", F.round(weighted, 6).alias("weighted"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("places"))


def _ranked_sql(n: int) -> str:
    """From `a` (id, q, scheme, topic, intent, expanded) to `n`: each question's hits with their final score and rank."""
    return f"""c AS (SELECT doc_id, 'c' || doc_id AS chunk_id, 't' || doc_id AS doc_title, doc_id // 4 AS doc, text AS said, CASE WHEN doc_id % 6 < 5 THEN {_pick(_CHUNK_SCHEMES, 'doc_id % 6')} END AS c_scheme, {_pick(_CHUNK_TOPICS, 'doc_id')} AS c_topic, {_pick(_ORGS, 'doc_id')} AS org, {_pick(_KINDS, 'doc_id')} AS kind, CASE WHEN doc_id % 4 <> 0 THEN DATE '2023-12-01' - (doc_id % 900)::INT END AS day, doc_id % 7 AS page FROM documents),
qb AS ({_BUCKETS.format('id', 'expanded', 'a')}), cb AS ({_BUCKETS.format('chunk_id', 'said', 'c')}), qn AS (SELECT id, sqrt(sum(n * n)) AS norm FROM qb GROUP BY 1), cn AS (SELECT chunk_id, sqrt(sum(n * n)) AS norm FROM cb GROUP BY 1),
dots AS (SELECT id, chunk_id, sum(qb.n * cb.n) AS dot FROM qb JOIN cb USING (bucket) GROUP BY 1, 2), sims AS (SELECT a.id, cn.chunk_id, round(coalesce(dot, 0) / qn.norm / cn.norm, 12) AS sim FROM a JOIN qn USING (id) CROSS JOIN cn LEFT JOIN dots ON dots.id = a.id AND dots.chunk_id = cn.chunk_id),
r AS (SELECT sims.*, a.q, a.scheme, a.topic, a.intent, c.* EXCLUDE (chunk_id), row_number() OVER (PARTITION BY sims.id ORDER BY sim DESC, chunk_id) AS place, CASE WHEN scheme = c_scheme THEN row_number() OVER (PARTITION BY sims.id, scheme = c_scheme ORDER BY sim DESC, chunk_id) END AS own_place FROM sims JOIN a USING (id) JOIN c USING (chunk_id)),
p AS (SELECT *, CASE WHEN place <= {n} THEN 1 ELSE 2 END AS pass, {_TOK.format('q')} AS asked, {_TOK.format('said')} AS words FROM r WHERE (place <= {n} OR own_place <= {n}) AND (scheme IS NULL OR c_scheme IS NULL OR scheme = c_scheme)),
f AS (SELECT *, list_distinct(list_filter(flatten(list_transform(list_filter(asked, lambda x: NOT list_contains([{', '.join(map(quote, R.STOPWORDS))}], x)), lambda x: string_split(x, '-'))), lambda x: x <> '')) AS terms, {_SOURCE} AS src,
 CASE WHEN topic = c_topic THEN 1.0 WHEN {_listed(R.RELATED_TOPICS, 'topic', 'c_topic')} THEN 0.8 ELSE 0.2 END AS ts, CASE WHEN scheme = c_scheme THEN 1.0 ELSE 0.3 END AS ss, CASE WHEN day IS NULL THEN 0.4 ELSE greatest(1 - greatest(DATE '2024-01-01' - day, 0) / 1095.0, 0) END AS fresh FROM p),
s AS (SELECT *, round(0.55 * sim + 0.18 * ss + 0.14 * ts + 0.08 * least(src, 1.25) / 1.25 + 0.05 * fresh + 0.10 * CASE WHEN len(terms) > 0 THEN len(list_intersect(terms, words)) / len(terms) ELSE 0 END, 4) AS score FROM f),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pass, sim DESC, chunk_id) AS was FROM s),
g AS (SELECT id, list_reduce(list_prepend({{'kept': []::STRUCT(doc BIGINT, words VARCHAR[])[], 'flags': []::BOOLEAN[], 'doc': NULL::BIGINT, 'words': NULL::VARCHAR[]}}, list({{'kept': []::STRUCT(doc BIGINT, words VARCHAR[])[], 'flags': []::BOOLEAN[], 'doc': doc, 'words': words}} ORDER BY was)),
 lambda s, x: {{'kept': CASE WHEN len(list_filter(s.kept, lambda k: k.doc = x.doc AND {_JACCARD} > 0.55)) > 0 THEN s.kept ELSE list_append(s.kept, {{'doc': x.doc, 'words': x.words}}) END, 'flags': list_append(s.flags, len(list_filter(s.kept, lambda k: k.doc = x.doc AND {_JACCARD} > 0.55)) > 0), 'doc': NULL::BIGINT, 'words': NULL::VARCHAR[]}}).flags AS flags FROM w GROUP BY id),
m AS (SELECT w.*, CASE WHEN flags[was] THEN round(score * 0.88, 4) ELSE score END AS final FROM w JOIN g USING (id)), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY final DESC, was) AS rank FROM m)"""


_HITS = f"WITH i AS ({_CLASSED}), a AS (SELECT *, {_expand_sql()} AS expanded FROM i WHERE len(cats) = 0), {_ranked_sql(36)}"


def _corpus(docs: DataFrame) -> DataFrame:
    """All documents as chunks, with schemes, topics, sources and dates by their ids, in a table dealt by chunk, as searches join it by that."""
    n = F.col("doc_id")
    docs = docs.select("doc_id", "text", F.concat(F.lit("c"), n).alias("chunk_id"))
    docs = docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk_id")  # before texts have vectors
    day = F.when(n % 4 != 0, F.date_format(F.date_sub(F.lit("2023-12-01").cast("date"), (n % 900).cast("int")), "yyyy-MM-dd"))
    rows = docs.select(
        "chunk_id", F.floor(n / 4).alias("document_id"), F.col("text").alias("chunk_text"), F.when(n % 6 < 5, _choice(_CHUNK_SCHEMES, n % 6)).alias("scheme"), _choice(_CHUNK_TOPICS, n).alias("topic"), (n % 7).alias("page_number"),
        F.lit("section").alias("section"), F.concat(F.lit("s"), n).alias("source_id"),
        F.struct(_choice(_ORGS, n).alias("organization"), _choice(_KINDS, n).alias("document_type"), day.alias("document_date"), F.concat(F.lit("http://"), n).alias("source_url"), F.concat(F.lit("t"), n).alias("document_title")).alias("metadata"),
        retrieve.hashed_embedding(F.col("text")).alias("embedding"),
    )
    return store.dealt(rows, "corpus", "chunk_id")


def _search(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every hundredth document behind a question, some with an address, against all documents as chunks of their whole texts."""
    docs, n = table(spark, d, "documents"), F.col("doc_id")
    asked = docs.where("doc_id % 100 = 0").select(n.alias("query_id"), F.concat(_choice(QUESTIONS, F.floor(n / 100)), F.lit(" "), F.when(n % 300 == 100, "my mail is a.b@c.co ").otherwise(""), X.squeeze(F.col("text"))).alias("question"))
    return lifecycle.search(asked, _corpus(docs), F.lit("2024-01-01").cast("date"))


@query(_HITS + " SELECT id AS query_id, rank, chunk_id, substr(said, 1, 300) AS preview, round(sim, 4) AS similarity, final AS rerank_score, c_scheme AS scheme, c_topic AS topic, page AS page_number FROM n WHERE rank <= 5")
def search_hits(spark, d):
    """From questions to hits: classified, expanded, embedded, two passes merged, scored, demoted, cut to five."""
    return _search(spark, d)[0].withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH i AS ({_CLASSED}) SELECT id AS query_id, array_to_string(cats, ',') AS categories FROM i WHERE len(cats) > 0")
def search_refused(spark, d):
    return _search(spark, d)[1].select("query_id", F.array_join("categories", ",").alias("categories"))


_TURNS = rf"SELECT conv_id * 1000 + turn AS id, {_pick(QUESTIONS, 'conv_id + turn')} || ' ' || trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS q FROM conversations WHERE role = 'user'"
_ASKED = _INTENT.replace(_LISTED_BRAND, "").replace("SELECT id, topic, scheme, CASE WHEN hard", "SELECT id, q, hard, topic, scheme, CASE WHEN hard")
_ASKED = f"WITH v AS ({_TURNS}), l AS (" + _ASKED.split("), l AS (", 1)[1]
_REFUSED = f"(hard OR intent IN ({', '.join(map(quote, I.REFUSED))}))"
_CLEAN = r"trim(regexp_replace(regexp_replace({0}, 'https?://\S+', '', 'gi'), '\s{{2,}}', ' ', 'g'), ' ')"


_DEPENDS = "intent IN ('FACTUAL_SCHEME', 'AMBIGUOUS') AND scheme IS NULL"


# a turn without a scheme is answered for each that its session named before, and for none; which of these counts follows from what was remembered
@query(f"""WITH i AS ({_ASKED}), x AS (SELECT * REPLACE (CASE WHEN intent = 'HISTORICAL_PERFORMANCE' THEN coalesce(topic, 'performance_reported') ELSE topic END AS topic), {_DEPENDS} AS depends FROM i),
v AS (SELECT id, NULL::VARCHAR AS used FROM x WHERE depends UNION SELECT a.id, b.scheme FROM x a JOIN x b ON a.depends AND b.id // 1000 = a.id // 1000 AND b.id < a.id AND b.scheme IS NOT NULL UNION SELECT id, scheme FROM x WHERE NOT depends),
t AS (SELECT x.* REPLACE (x.id * 100 + row_number() OVER (PARTITION BY x.id ORDER BY used NULLS FIRST) AS id), used FROM x JOIN v USING (id)),
b AS (SELECT id, q AS own, used AS scheme, topic, intent, CASE WHEN used IS NULL OR contains(lower(q), lower(used)) THEN q ELSE q || ' ' || used END AS q FROM t WHERE NOT {_REFUSED}), a AS (SELECT * EXCLUDE (q, own), own AS q, {_expand_sql()} AS expanded FROM b), {_ranked_sql(48)},
e AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY scheme IS NOT NULL AND c_scheme IS NULL, rank) AS nth FROM n WHERE rank <= 4), o AS (SELECT id, doc_id, {_CLEAN.format('said')} AS answer, page, day, doc_title FROM e WHERE nth = 1),
y AS (SELECT id, max(sim) FILTER (rank = 1) >= 0.35 AS ok FROM n GROUP BY 1),
z AS (SELECT t.id, t.q, hard, intent, depends, used, topic, {_REFUSED} AS refused, coalesce(ok, false) AS ok, o.* EXCLUDE (id), {_GONE} AS gone FROM t LEFT JOIN y USING (id) LEFT JOIN o USING (id)),
k AS (SELECT *, NOT refused AND ok AND doc_id IS NOT NULL AND NOT (coalesce(gone, false) AND intent = 'AMBIGUOUS') AS cited FROM z),
mem AS (SELECT a.id, arg_max(b.used, b.id) AS held FROM k a JOIN k b ON a.depends AND NOT b.depends AND b.id // 100000 = a.id // 100000 AND b.id < a.id AND (b.refused OR b.cited) AND b.used IS NOT NULL GROUP BY a.id)
SELECT id // 100 AS query_id, substr(sha256(lower(trim(q, ' '))), 1, 16) AS question_hash, intent, used AS scheme, topic, refused, CASE WHEN hard THEN 'PII_ACCOUNT' WHEN refused THEN intent WHEN NOT ok THEN 'NO_EVIDENCE' WHEN doc_id IS NULL THEN 'SCHEME_MISMATCH' WHEN NOT cited THEN 'NO_EVIDENCE' END AS refusal_type,
CASE WHEN NOT refused AND ok THEN sha256(answer) END AS answer_sha256, CASE WHEN cited THEN doc_title END AS title, CASE WHEN cited THEN 'http://' || doc_id END AS url, CASE WHEN cited THEN page END AS page, CASE WHEN cited THEN 's' || doc_id END AS source_id,
CASE WHEN cited THEN CASE WHEN day IS NULL THEN 'recently updated' ELSE strftime(day, '%B %Y') END END AS last_updated, refused OR cited AS remembered FROM k LEFT JOIN mem USING (id) WHERE NOT depends OR used IS NOT DISTINCT FROM held""")
def answered_turns(spark, d):
    """Sessions of whole user turns from classification to cited answers: schemes carried from turns that were answered or refused, search, gate, evidence, outcome."""
    turn, conv = F.col("turn"), F.col("conv_id")
    asked = table(spark, d, "conversations").where("role = 'user'").select((conv * 1000 + turn).alias("query_id"), conv.alias("session_id"), turn, F.concat_ws(" ", _choice(QUESTIONS, conv + turn), X.squeeze(F.col("text"))).alias("question"))
    out = lifecycle.answer_turns(asked, _corpus(table(spark, d, "documents")), F.lit("2024-01-01").cast("date"))
    return out.select("query_id", "question_hash", "intent", "scheme", "topic", "refused", "refusal_type", F.sha2("answer", 256).alias("answer_sha256"), "citation.title", "citation.url", "citation.page", "citation.source_id", "last_updated", "remembered")
