"""Cross-site boilerplate removal by the distinct sites of every line, in DataFrame operations alone.

A line is a part of a text between line feeds; its key is the XXH64 of its form without outer blanks and with A-Z in lower case. HyperLogLog sketches
of the sites of each key merge by partial aggregation. Where the estimate lies within BAND of a number of sites that decides, the exact number of
distinct sites does; beyond the band the estimate does. Lines on at least so many sites stay in the document with the smallest doc_id among those that
have them and go from all others, so a passage and the lines of copied documents remain once:

* SITES for a line of LEAST_WORDS words or LEAST_CHARS characters (scripts without blanks);
* SHORT_SITES for a shorter one, which more documents share by chance;
* LONG_SITES for one of LONG_WORDS words, a passage. On fewer than SITES sites it goes only where such lines are less than half of the text: a document
  that shares more is a copy, which a near-duplicate stage takes as a whole.

Lines without a character but blanks and tabs have no key. A line that repeats within one site only stays, however often.

Nulls and edge cases: a null text has no lines and stays null; null sites are one site; a null doc_id counts as larger than any other, and each row
is judged by its own text; of repeated rows each is treated alike; empty tables give no rows; extra columns pass through. A document that loses all
of its lines gets the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, stored, table

SITES, SHORT_SITES, LONG_SITES = 3, 10, 2
LEAST_WORDS, LEAST_CHARS, LONG_WORDS = 5, 40, 50
#: Registers: 2**LG_K; relative standard error about 1.04 / sqrt(2**LG_K), 3.25 % here.
LG_K = 10
#: Estimates within this share of a threshold are counted exactly: over seven standard errors.
BAND = 0.25
#: Parts that a line's documents are dealt into for the join with the boilerplate lines: a line may be in a third of all documents.
_SALTS = 16
_LAST = (1 << 63) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHORT, _USUAL, _LONG = 0, 1, 2


def _words(n: int) -> str:
    """A pattern of lines with at least n words (runs without blanks and tabs)."""
    return rf"^[ \t]*+(?:[^ \t]++[ \t]++){{{n - 1}}}[^ \t]"


def normal(line: Column) -> Column:
    return F.translate(F.trim(line), _UPPER, _LOWER)


def kind_of(line: Column) -> Column:
    """Short, usual or long; null for a line without words."""
    usual = line.rlike(_words(LEAST_WORDS)) | (F.length(F.trim(line)) >= LEAST_CHARS)
    return F.when(line.rlike(_words(LONG_WORDS)), _LONG).when(usual, _USUAL).when(line.rlike("[^ \t]"), _SHORT)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def row_of(docs: DataFrame) -> Column:
    """What rows of the same doc_id and text share."""
    return F.xxhash64(docs["doc_id"], docs["text"].cast("string"), docs["doc_id"].isNull())


def keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source) -> row, doc_id (null as the largest), site, place (from 0), key, kind, chars: a row for each line with a key."""
    line = F.transform(lines_of(docs["text"].cast("string")), lambda x, i: F.struct(i.alias("place"), F.xxhash64(normal(x)).alias("key"), kind_of(x).alias("kind"), F.length(x).alias("chars")))
    return docs.select(
        row_of(docs).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64(docs["source"].cast("string"), docs["source"].isNull()).alias("site"), F.explode(F.filter(line, lambda x: x["kind"].isNotNull())).alias("line")
    ).select("row", "doc_id", "site", "line.*")


def boilerplate(lines: DataFrame, sites: int = SITES, short_sites: int = SHORT_SITES, long_sites: int = LONG_SITES, band: float = BAND) -> DataFrame:
    """lines (doc_id, site, key, kind) -> key, owner (the smallest doc_id with it) and weak (a long line on fewer than `sites` sites) of each boilerplate line."""
    least = F.when(F.col("kind") == _SHORT, short_sites).when(F.col("kind") == _LONG, min(long_sites, sites)).otherwise(sites)
    most = F.when(F.col("kind") == _SHORT, short_sites).otherwise(sites)
    spread = lines.groupBy("key", "kind").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate"), F.min("doc_id").alias("owner"))
    near = stored(spread.where(F.col("estimate") >= (1 - band) * least), "spread")
    beyond = F.col("estimate") > (1 + band) * most
    unsure = near.where(~beyond).select("key", "kind", "owner")
    # of a line in millions of documents a row for each site goes into the join
    pairs = lines.select("key", "site").distinct()
    exact = pairs.join(unsure, "key").groupBy("key", "kind", "owner").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return near.where(beyond).select("key", "owner", F.lit(False).alias("weak")).unionByName(exact.select("key", "owner", (F.col("n") < most).alias("weak")))


def removals(docs: DataFrame, **limits) -> DataFrame:
    """docs -> row, gone: the places, sorted, of the lines that such rows may lose, each with weak and chars."""
    lines = stored(keyed(docs), "lines")
    found = boilerplate(lines, **limits).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    met = lines.withColumn("salt", F.pmod("row", F.lit(_SALTS)).cast("int")).join(found.hint("merge"), ["key", "salt"])
    # a set: repeated rows give their places once
    return met.where("doc_id <> owner").groupBy("row").agg(F.array_sort(F.collect_set(F.struct("place", "weak", "chars"))).alias("gone"))


def without(lines: Column, places: Column) -> Column:
    """An array without the elements at places (from 0, sorted): the stretches between them."""
    before, behind = F.concat(F.array(F.lit(-1)), places), F.concat(places, F.array(F.size(lines)))
    return F.flatten(F.zip_with(before, behind, lambda a, b: F.slice(lines, a + 2, b - a - 1)))


def deduplicated(docs: DataFrame, counts: bool = False, **limits) -> DataFrame:
    """docs with boilerplate lines removed from text; with counts also n_lines and n_removed (long)."""
    names = docs.columns
    gone, at, kept, places = (free_name(docs, x) for x in ("_gone", "_at", "_kept", "_places"))
    lost = removals(docs, **limits).select(F.col("row").alias(at), F.col("gone").alias(gone))
    joined = docs.join(lost, row_of(docs) == F.col(at), "left")
    text = docs["text"].cast("string")
    weak = F.aggregate(F.filter(gone, lambda x: x["weak"]), F.lit(0).cast("long"), lambda s, x: s + x["chars"])
    joined = joined.withColumn(places, F.transform(F.filter(gone, lambda x: ~x["weak"] | (2 * weak < F.length(text))), lambda x: x["place"]))
    joined = joined.withColumn(kept, F.when(F.size(places) > 0, without(lines_of(text), F.col(places))))
    out = [F.when(F.col(kept).isNull(), docs["text"]).otherwise(F.array_join(kept, "\n")).alias(c) if c == "text" else docs[c] for c in names]
    if counts:
        n = F.when(docs["text"].isNull(), 0).otherwise(F.size(lines_of(text))).cast("long")
        out += [n.alias("n_lines"), F.when(F.col(kept).isNull(), F.lit(0)).otherwise(F.size(places)).cast("long").alias("n_removed")]
    return joined.select(*out)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, lines removed, and the digest of the text that is left (of the empty text for null)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return deduplicated(docs, counts=True).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' '), '{_UPPER}', '{_LOWER}') AS norm, len(list_filter(string_split_regex(line, '[ \\t]+'), lambda w: w <> '')) AS n_words FROM lines
), kinds AS (
  SELECT *, CASE WHEN n_words >= {LONG_WORDS} THEN 'long' WHEN n_words >= {LEAST_WORDS} OR length(trim(line, ' ')) >= {LEAST_CHARS} AND n_words > 0 THEN 'usual' WHEN n_words > 0 THEN 'short' END AS kind FROM keyed
), boiler AS (
  SELECT norm, kind, min(doc_id) AS owner, kind = 'long' AND count(DISTINCT coalesce('s' || source, '')) < {SITES} AS weak FROM kinds WHERE kind IS NOT NULL GROUP BY norm, kind
  HAVING count(DISTINCT coalesce('s' || source, '')) >= CASE kind WHEN 'short' THEN {SHORT_SITES} WHEN 'long' THEN {LONG_SITES} ELSE {SITES} END
), met AS (
  SELECT kinds.*, owner IS NOT NULL AND owner <> doc_id AS going, coalesce(weak, false) AS weak FROM kinds LEFT JOIN boiler USING (norm, kind)
), shares AS (
  SELECT *, 2 * coalesce(sum(length(line)) FILTER (going AND weak) OVER (PARTITION BY doc_id), 0) < length(text) AS minor FROM met
), marked AS (
  SELECT *, going AND (NOT weak OR minor) AS gone FROM shares
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""
