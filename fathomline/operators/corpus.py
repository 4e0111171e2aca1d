"""Corpus preparation: boilerplate, sections, chunks, topics, latest rows, idempotent loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.keywords import elected
from ..functions.text import is_heading, is_noise, marked_lines, once, strip
from ..sources.shared import stored

TARGET, OVERLAP, LEAST, PREAMBLE = 1200, 150, 40, "Preamble"
#: Pages a document needs before its running lines are looked for, and the share of its pages they must be on.
LEAST_PAGES, SHARE = 5, 0.4


def boilerplate(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, line_no, line) -> doc_id, line: among the first or last two non-blank lines of at least max(3, 40 %) of a document's pages.

    Counts are partial aggregates; the page windows hold one page each.
    """
    text = F.trim("line")
    filled = lines.select("doc_id", "page", "line_no", text.alias("line")).where(F.col("line") != "")
    first = Window.partitionBy("doc_id", "page").orderBy("line_no")
    last = Window.partitionBy("doc_id", "page").orderBy(F.col("line_no").desc())
    ends = filled.select("*", F.row_number().over(first).alias("a"), F.row_number().over(last).alias("b")).where("(a <= 2 or b <= 2) and length(line) between 11 and 119")
    side = F.explode(F.array_compact(F.array(F.when(F.col("a") <= 2, "top"), F.when(F.col("b") <= 2, "bottom")))).alias("side")
    counts = ends.select("doc_id", "line", side).groupBy("doc_id", "line", "side").count()
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    need = F.greatest(F.lit(3), F.floor(SHARE * F.col("pages")))
    return counts.join(pages, "doc_id").where(F.col("count") >= need).select("doc_id", "line").distinct()


def cleaned_lines(lines: DataFrame, noise: list[str] = R.NOISE_LINES) -> DataFrame:
    """lines without noise and boilerplate, in documents of LEAST_PAGES pages or more; others keep theirs."""
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("_pages"))
    out = lines.join(pages, "doc_id")
    running = boilerplate(lines).select(F.col("doc_id").alias("_doc"), F.col("line").alias("_line"))
    gone = out.join(running, (F.col("doc_id") == F.col("_doc")) & (F.trim("line") == F.col("_line")), "left_anti")
    return gone.where((F.col("_pages") < LEAST_PAGES) | ~is_noise(F.col("line"), noise)).drop("_pages")


def sections(lines: DataFrame, heading: Column | None = None) -> DataFrame:
    """lines (doc_id, page, line_no, line, is_table) -> doc_id, section_no, title, page, page_end, body.

    A heading opens a section, except on a page with a table; what comes before the first is the Preamble; headings without a body are dropped. The
    pages of a section are those of its heading and its body.
    """
    own = Window.partitionBy("doc_id", "page")
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    flagged = lines.withColumn("_table", F.max(F.col("is_table").cast("int")).over(own)).withColumn("_head", (F.col("_table") == 0) & (heading if heading is not None else is_heading(F.col("line"))))
    numbered = flagged.withColumn("section_no", F.sum(F.col("_head").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy("doc_id", "section_no").agg(
        F.max(F.when(F.col("_head"), F.trim("line"))).alias("title"), F.min("page").alias("page"), F.max("page").alias("page_end"),
        F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct("page", "line_no", "line")))).alias("_lines"),
    )
    body = F.array_join(F.transform("_lines", lambda x: F.coalesce(x["line"], F.lit(""))), "\n")
    out = grouped.where(F.size("_lines") > 0).select("doc_id", "section_no", F.coalesce("title", F.lit(PREAMBLE)).alias("title"), "page", "page_end", body.alias("body"))
    return out.where(strip(F.col("body")) != "")


def page_lines(pages: DataFrame, text: Column, headings: list[str] = R.HEADINGS) -> DataFrame:
    """pages (doc_id, page, text, is_table; one row a page), and text as it is to be read -> doc_id, page, is_table, lines (line_no, line, heading), top and bottom (lines that may be running ones), written once.

    Everything about a line is found here, in one pass over the texts and without a row for each line.
    """
    fit = lambda part: F.filter(F.transform(part, lambda x: x["trimmed"]), lambda t: F.length(t).between(11, 119))
    ends = lambda filled: F.struct(fit(F.slice(filled, F.lit(1), F.least(F.size(filled), F.lit(2)))).alias("top"), fit(F.slice(filled, F.greatest(F.size(filled) - 1, F.lit(1)), F.lit(2))).alias("bottom"))
    every = once(marked_lines(F.split(text, "\n"), headings), lambda lines: F.struct(F.transform(lines, _untrimmed).alias("lines"), once(F.filter(lines, lambda x: x["trimmed"] != ""), ends).alias("ends")))
    found = pages.where(F.col("text").isNotNull()).select("doc_id", "page", "is_table", every.alias("x"))
    return stored(found.select("doc_id", "page", "is_table", "x.lines", "x.ends.top", "x.ends.bottom"), "page-lines")


def _untrimmed(x: Column) -> Column:
    """A marked line without its trimmed form, which would be most of the text a second time."""
    return F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), x["heading"].alias("heading"))


def running_lines(pages: DataFrame) -> DataFrame:
    """pages of page_lines() -> doc_id, pages, running: of each document the number of its pages, and its running lines (see boilerplate) if it has any."""
    sides = pages.select("doc_id", F.explode(F.concat(*(F.transform(c, _sided(c)) for c in ("top", "bottom")))).alias("x"))
    counts = sides.groupBy("doc_id", "x.line", "x.side").count()
    number = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    need = F.greatest(F.lit(3), F.floor(SHARE * F.col("pages")))
    found = counts.join(number.where(F.col("pages") >= LEAST_PAGES), "doc_id").where(F.col("count") >= need).groupBy("doc_id").agg(F.collect_set("line").alias("running"))
    return number.join(found, "doc_id", "left")


def _sided(side: str):
    return lambda t: F.struct(t.alias("line"), F.lit(side).alias("side"))


def page_sections(pages: DataFrame, rowed: Column | None = None, token: str = "", noise: list[str] = R.NOISE_LINES) -> DataFrame:
    """pages of page_lines(), cleaned and cut as cleaned_lines() and sections() do -> doc_id, section_no, title, page, page_end, body (its lines).

    rowed: documents whose lines with the token are sections of their own, numbered below zero by page and line, if there are any. The pages are
    dealt by document once; numbers of headings are summed over pages, not lines, and only pieces of sections become rows.
    """
    met = pages.join(running_lines(pages), "doc_id")
    kept = F.filter("lines", lambda x: ~F.coalesce(F.array_contains("running", F.trim(x["line"])), F.lit(False)) & ((F.col("pages") < LEAST_PAGES) | ~is_noise(x["line"], noise)))
    rows = F.filter("_kept", lambda x: x["line"].contains(token)) if rowed is not None else F.expr("cast(null as array<struct<line_no: int, line: string>>)")
    own = Window.partitionBy("doc_id")
    cleaned = met.withColumn("_kept", kept).drop("lines").withColumn("_rows", F.when(rowed if rowed is not None else F.lit(False), rows))
    cleaned = cleaned.withColumn("_by_row", F.max(F.coalesce(F.size("_rows") > 0, F.lit(False))).over(own))
    heads = F.when(~F.col("is_table"), F.filter(F.sequence(F.lit(1), F.size("_kept")), lambda i: F.element_at("_kept", i)["heading"])).otherwise(F.array().cast("array<int>"))
    cut = cleaned.where((F.size("_kept") > 0) & (~F.col("_by_row") | (F.size("_rows") > 0))).withColumn("_heads", heads)
    before = F.coalesce(F.sum(F.size("_heads")).over(own.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts, ends = F.concat(F.array(F.lit(0)), F.col("_heads")), F.concat(F.col("_heads"), F.array(F.size("_kept") + 1))
    lines = lambda a, b: F.transform(F.slice("_kept", a + 1, b - a - 1), lambda x: F.coalesce(x["line"], F.lit("")))
    piece = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("at"), F.when(a > 0, F.trim(F.get("_kept", a - 1)["line"])).alias("title"), lines(a, b).alias("lines")))
    numbered = F.transform(piece, lambda x, k: F.struct((F.col("_before") + k).cast("long").alias("section_no"), x["title"].alias("title"), x["lines"].alias("lines")))
    usual = F.filter(numbered, lambda x: x["title"].isNotNull() | (F.size(x["lines"]) > 0))
    single = F.transform("_rows", lambda x: F.struct((-1 - (F.col("page").cast("long") * 10_000 + x["line_no"])).alias("section_no"), F.lit(None).cast("string").alias("title"), F.array(x["line"]).alias("lines")))
    pieces = cut.withColumn("_before", before).select("doc_id", "page", F.explode(F.when(F.col("_by_row"), single).otherwise(usual)).alias("x"))
    grouped = pieces.groupBy("doc_id", "x.section_no").agg(F.max("x.title").alias("title"), F.min("page").alias("page"), F.max("page").alias("page_end"), F.array_sort(F.collect_list(F.struct("page", "x.lines"))).alias("_lines"))
    body = F.array_join(F.flatten(F.transform("_lines", lambda x: x["lines"])), "\n")
    filled = grouped.where(F.exists("_lines", lambda x: F.exists(x["lines"], lambda line: strip(line) != "")))
    return filled.select("doc_id", "section_no", F.coalesce("title", F.lit(PREAMBLE)).alias("title"), "page", "page_end", body.alias("body"))


def blocks(text: Column) -> Column:
    """Sentences, and lines with a bar whole."""
    end = r"[^\S\n](?<=[.!?][^\S\n])[^\S\n]*+(?=[A-Z0-9])"
    lines = F.transform(F.split(text, "\n"), lambda p: F.when(p.contains("|"), F.array(p)).otherwise(F.split(p, end)))
    return F.filter(F.when(text.contains("|"), F.flatten(lines)).otherwise(F.split(text, rf"\n|{end}")), lambda b: b != "")


def hard_split(block: Column, target: int) -> Column:
    """A block as pieces of at most target characters, cut at blanks where there are any within reach. Runs of blanks count as one; no other character is lost."""
    pieces = F.regexp_extract_all(F.regexp_replace(block, " {2,}", " "), F.lit(rf"(?s)[^ ].{{0,{target - 1}}}(?= |$)|[^ ]{{1,{target}}}"), F.lit(0))
    return F.when(F.length(block) <= target, F.array(block)).otherwise(F.filter(pieces, lambda p: F.trim(p) != ""))


def packed_chunks(text: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """Array of chunks. A text of at most target characters is one, as it is; of a longer one, blocks are joined by blanks while they fit the target.

    A chunk after the first starts with the end of the one before it, but for pieces of a block that is longer than a chunk: these start afresh. A fold
    over a section's blocks in the JVM; what it holds is one section.
    """
    start = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))
    pieces = lambda b: F.transform(hard_split(b, target), lambda p: F.struct(p.alias("text"), (F.length(b) > target).alias("cut")))

    def step(s: Column, x: Column) -> Column:
        b = x["text"]
        # bytes, which needn't be counted, are as many as characters or more
        fits = ~x["cut"] & ((F.octet_length(s["buf"]) + F.octet_length(b) + 1 <= target) | (F.length(s["buf"]) + F.length(b) + 1 <= target))
        joined = once(F.concat_ws(" ", s["buf"], b), strip)
        seeded = F.when((s["buf"] == "") | x["cut"], b).otherwise(once(F.concat_ws(" ", F.right(s["buf"], F.lit(overlap)), b), strip)) if overlap else b
        out = F.when(fits | (s["buf"] == ""), s["out"]).otherwise(F.concat(s["out"], F.array(s["buf"])))
        return F.struct(F.when(fits, joined).otherwise(seeded).alias("buf"), out.alias("out"))

    def packed(body: Column) -> Column:
        folded = F.aggregate(F.flatten(F.transform(blocks(body), pieces)), start, step, lambda s: F.when(s["buf"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["buf"]))))
        return F.when(F.length(body) <= target, F.filter(F.array(body), lambda b: b != "")).otherwise(folded)

    return once(strip(text), packed)


def chunk_topic(text: Column, title: Column, topics: dict[str, list[str]] = R.CHUNK_TOPICS, default: str = "general") -> Column:
    """The vote over title and the first 1500 characters, hits in the title counting three times; two rules for minimum amounts override it."""
    plain = F.replace(F.lower(F.concat_ws("\n", title, F.substring(text, 1, 1500))), F.lit("-"), F.lit(" "))
    hint = F.replace(F.lower(title), F.lit("-"), F.lit(" "))
    override = once(plain, lambda p: p.contains("minimum application amount") | (p.contains("minimum amount") & p.rlike(R.bounded("sip"))))
    return F.when(override & F.lit("minimum_investment" in topics), "minimum_investment").otherwise(elected(plain, topics, default, hint))


def chunks(sectioned: DataFrame, target: int = TARGET, overlap: int = OVERLAP, topics: dict[str, list[str]] = R.CHUNK_TOPICS) -> DataFrame:
    """sections -> a row for each piece of at least LEAST characters, with its own topic; the section's title stands before its text, but for the Preamble's."""
    piece = strip(F.col("_piece"))
    out = sectioned.where(F.length(strip(F.col("body"))) >= LEAST).select("*", F.posexplode(packed_chunks(F.col("body"), target, overlap)).alias("chunk_no", "_piece")).where(F.length(piece) >= LEAST)
    text = F.when(F.col("title") == PREAMBLE, piece).otherwise(F.concat_ws("\n", "title", piece))
    return out.withColumn("topic", chunk_topic(piece, F.col("title"), topics)).withColumn("chunk_text", text).drop("body", "_piece")


def row_chunks(lines: DataFrame, token: str, header: str, title: str, topic: str, least: int = 30) -> DataFrame:
    """Tables that list one subject a line: lines (doc_id, page, line_no, line) -> a chunk under a header for each line that has the token, as chunks() gives them."""
    text = F.concat_ws("\n", F.lit(header), strip(F.col("line")))
    kept = lines.where(F.col("line").contains(token)).withColumn("chunk_text", text).where(F.length("chunk_text") >= least)
    # numbered by page and line: no window over a document
    return kept.select("doc_id", F.lit(0).cast("long").alias("section_no"), F.lit(title).alias("title"), "page", F.col("page").alias("page_end"), (F.col("page").cast("int") * 10_000 + F.col("line_no").cast("int")).alias("chunk_no"), F.lit(topic).alias("topic"), "chunk_text")


def latest_per_key(df: DataFrame, keys: list[str], date: str, order: str) -> DataFrame:
    """The row with the latest date of each key, the first by `order` of equals; rows without a date are left out.

    max_by over a struct aggregates partially, so a hot key is no hot window.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(date), -F.col(order)))
    return df.where(F.col(date).isNotNull()).groupBy(*keys).agg(best.alias("_best")).select(*keys, *(F.col(f"_best.`{c}`").alias(c) for c in rest))


def replaced(old: DataFrame, new: DataFrame, key: str = "source_id") -> DataFrame:
    """old without the keys of new, and new: loading twice gives what loading once gives."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def first_by(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row by order of each key (as text, case ignored), with its place seq among them. See numbered()."""
    rest = df.columns
    firsts = df.groupBy(F.lower(key).alias("_key")).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select("_row.*")
    return numbered(firsts, order)


def numbered(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Adds each row's place by order, from 1. Rows are dealt by ranges and numbered within each; a count for each range comes to the driver, no row does."""
    dealt = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    before, total = {}, 0
    for part, n in dealt.groupBy("_range").count().orderBy("_range").collect():
        before[part], total = total, total + n
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    first = R.lookup(before, F.col("_range")) if before else F.lit(0)
    return dealt.withColumn(name, (own + first).cast("int")).drop("_range")


def suffixed(df: DataFrame, name: str, order: str) -> DataFrame:
    """File names made of allowed characters; the n-th of equals gets _n."""
    base = F.regexp_replace(name, r"[^A-Za-z0-9._ -]", "")
    n = F.row_number().over(Window.partitionBy(base).orderBy(order)) - 1
    stem, suffix = F.regexp_replace(base, r"\.[^.]*$", ""), F.regexp_extract(base, r"\.[^.]*$", 0)
    return df.withColumn("flat_name", F.when(n == 0, base).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), suffix)))
