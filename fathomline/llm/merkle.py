"""A Merkle manifest of a dataset: trees of digests, kept as Parquet, and proofs read from them.

Leaves are dealt by ranges of (group, id) and sorted within them: runs that lie on disk in the order of the tree. A *page* holds RUN consecutive nodes of
one level and the STEPS levels above them, down to the page's own node; pages lie under the level that they start at, `level=0`, `level=8` and so on, and
those of a level are made from the nodes of the pages of the level before, read once in their order. So a level costs a job no more than its nodes, and
nothing but the number of leaves of the largest group comes to the driver. Proofs are read from the top down: the pages of a level are merged with
the proofs of the nodes they hang from by coordinate (group, page), so that each page is read once for all of its leaves.

Each group's leaves have a tree of their own; its top node is the subroot. The subroots, in the order of their groups (null first, bytewise), are the
leaves of the last tree, whose top is the root.

Nulls and edge cases: a null in any column is a field of its own (`-`), told from the empty text (`0:`); a null group is a group, a null id comes first;
rows of one group and id are in the order of their leaves, repeated rows are leaves of their own; one leaf alone is its tree's top; an empty table has
no root and no proofs; extra columns take no part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEPS = 8
RUN = 1 << STEPS


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """`-` for null, else the value's bytes, a colon and the value."""
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*columns: Column) -> Column:
    return digest(*map(field, columns))


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds place (from 0, by order within group) and n (leaves of the group). Rows are numbered in sorted runs; what is summed has a row for each run and group."""
    spread = leaves.withColumn("_spread", F.monotonically_increasing_id())  # equal rows needn't lie in one range
    ranged = spread.repartitionByRange("group", *order, "_spread").sortWithinPartitions("group", *order).drop("_spread")
    runs = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "leaf-runs")
    starts = runs.groupBy("group", F.shiftright("_at", 33).alias("_run")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("group").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = starts.select(F.col("group").alias("_group"), "_run", (earlier - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy("group")).alias("n"))
    met = runs.join(shifts, (F.shiftright("_at", 33) == F.col("_run")) & F.col("group").eqNullSafe(F.col("_group")))
    return met.withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_run", "_shift", "_group")


def _above(nodes: Column) -> Column:
    """The next level: every two consecutive nodes, the last alone if it has no other."""
    return F.transform(F.sequence(F.lit(0), F.size(nodes) - 1, F.lit(2)), lambda i: digest(F.get(nodes, i), F.coalesce(F.get(nodes, i + 1), F.lit(""))))


def pages(nodes: DataFrame) -> DataFrame:
    """nodes (group, place, n, digest, about) -> group, page, n, about (of its nodes, in order), levels: the page's nodes and the levels above them.

    A page that is its group's only one ends with the group's top; the others end after STEPS levels.
    """
    members = F.array_sort(F.collect_list(F.struct("place", "digest", "about")))
    grouped = nodes.groupBy("group", F.floor(F.col("place") / RUN).alias("page")).agg(F.first("n").alias("n"), members.alias("m"))
    own = F.transform("m", lambda x: x["digest"])
    short = F.size(F.filter(F.array(*(F.lit(1 << k) for k in range(STEPS))), lambda x: x < F.size("m")))
    steps = F.when(F.col("n") > RUN, F.lit(STEPS)).otherwise(short)
    levels = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(1), steps), F.array(own), lambda s, _: F.concat(s, F.array(_above(F.element_at(s, -1)))))
    return grouped.select("group", "page", "n", F.transform("m", lambda x: x["about"]).alias("about"), levels.alias("levels"))


def _tree(leaves: DataFrame, path: str) -> tuple[list[DataFrame], DataFrame | None]:
    """Writes the pages of leaves (group, place, n, digest, about) to path; the pages by level, and the tops (group, digest)."""
    spark, nodes, found, most = leaves.sparkSession, leaves, [], None
    while most is None or most > RUN:
        if most is not None:
            most = -(-most // RUN)
        target = f"{path}/level={STEPS * len(found)}"
        pages(nodes).write.parquet(target)
        found.append(spark.read.parquet(target))
        if most is None:
            most = found[0].agg(F.max("n")).first()[0]
            if most is None:
                return found, None
        nodes = found[-1].where(F.col("n") > RUN).select("group", F.col("page").alias("place"), F.ceil(F.col("n") / RUN).alias("n"), F.get(F.element_at("levels", -1), F.lit(0)).alias("digest"), F.lit(None).cast("string").alias("about"))
    tops = [p.where(F.col("n") <= RUN).select("group", F.get(F.element_at("levels", -1), F.lit(0)).alias("digest")) for p in found]
    every = tops[0]
    for t in tops[1:]:
        every = every.unionAll(t)
    return found, every


def _paths(levels: list[DataFrame], beyond: DataFrame | None) -> DataFrame:
    """group, place, n, about, path of each leaf: for each level whether its sibling stands left, and the sibling, null where there is none.

    beyond: group, path from the group's top on.
    """
    step = lambda i: lambda level, k: F.struct((F.call_function("shiftright", i, k) % 2 == 1).alias("left"), F.get(level, F.call_function("shiftright", i, k).bitwiseXOR(F.lit(1))).alias("sibling"))
    below, upper = "slice(levels, 1, size(levels) - 1)", None
    for at in reversed(levels):
        ends = None if beyond is None else beyond.select(F.col("group").alias("_group"), F.lit(0).cast("long").alias("_place"), F.col("path").alias("_path"))
        own = at.where(F.col("n") <= RUN)
        parts = [own.withColumn("_path", F.expr("cast(array() as array<struct<left: boolean, sibling: string>>)")) if ends is None else own.join(ends, F.col("group").eqNullSafe(F.col("_group")) & (F.col("page") == F.col("_place")))]
        if upper is not None:
            more = upper.select(F.col("group").alias("_group"), F.col("place").alias("_place"), F.col("path").alias("_path"))
            parts.append(at.where(F.col("n") > RUN).join(more, F.col("group").eqNullSafe(F.col("_group")) & (F.col("page") == F.col("_place"))))
        met = parts[0].select("group", "page", "n", "about", "levels", "_path")
        for p in parts[1:]:
            met = met.unionAll(p.select(*met.columns))
        every = F.transform("about", lambda a, i: F.struct(a.alias("about"), i.alias("i"), F.transform(F.expr(below), step(i)).alias("path")))
        out = met.select("group", "page", "n", "_path", F.explode(every).alias("x"))
        upper = out.select("group", (F.col("page") * RUN + F.col("x.i")).alias("place"), "n", F.col("x.about").alias("about"), F.concat("x.path", "_path").alias("path"))
        if at is not levels[0]:
            upper = stored(upper, "paths")
    return upper


def folded(start: Column, path: Column) -> Column:
    """The top that a leaf's digest and its path lead to."""
    return F.aggregate(path, start, lambda h, s: F.when(s["sibling"].isNull(), digest(h)).when(s["left"], digest(s["sibling"], h)).otherwise(digest(h, s["sibling"])))


def siblings(path: Column) -> Column:
    """A path's siblings, where there are any, as one text."""
    return F.array_join(F.filter(F.transform(path, lambda s: s["sibling"]), lambda x: x.isNotNull()), "")


def manifest(leaves: DataFrame, path: str, order: list[str]) -> tuple[str | None, DataFrame | None]:
    """Writes the trees of leaves (group, digest, about struct, and the columns of order) to path: the root, and group, about, subroot, path of each leaf.

    Both are None for no leaves. Equal places of order go by digest.
    """
    trees, subroots = _tree(placed(leaves, [*order, "digest"]), f"{path}/trees")
    if subroots is None:
        return None, None
    named = subroots.select(F.lit(0).alias("group"), "digest", F.struct(F.col("group").alias("name"), F.col("digest").alias("subroot")).alias("about"), F.col("group").alias("_name"))
    crown, top = _tree(placed(named, ["_name"]).drop("_name"), f"{path}/crown")
    root = top.first()["digest"]
    beyond = stored(_paths(crown, None).select(F.col("about.name").alias("group"), F.col("about.subroot").alias("subroot"), "path"), "beyond")
    proven, tops = _paths(trees, beyond), beyond.select(F.col("group").alias("_group"), "subroot")
    return root, proven.join(tops, F.col("group").eqNullSafe(F.col("_group"))).select("group", "about", "subroot", "path")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its group's subroot, the root, its proof's digest, and the root that the (possibly changed) document leads to."""
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/manifest-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    other = leaf(*(F.try_add(F.col(c), F.lit(1).cast("long")) if c == "n_chars" else F.col(c) for c in FIELDS))
    own = docs.select(F.col("lang").alias("group"), "doc_id", leaf(*map(F.col, FIELDS)).alias("digest"), F.when(changed, other).alias("changed"))
    leaves = stored(own, "leaves").withColumn("about", F.struct("doc_id", F.col("digest").alias("leaf"), "changed")).drop("changed")
    root, proven = manifest(leaves, path, ["doc_id"])
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if root is None:
        return spark.createDataFrame([], schema)
    back = folded(F.coalesce("about.changed", "about.leaf"), F.col("path"))
    out = proven.select(F.col("about.doc_id").cast("long").alias("doc_id"), F.col("about.leaf").alias("leaf"), "subroot", F.lit(root).alias("root"), digest(siblings(F.col("path"))).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_POLYNOMIAL = 0xEDB88320
ORACLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS id, doc_id, lang, n_chars, source, text,
    sha256(list_aggregate(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text], lambda v: coalesce(strlen(v) || ':' || v, '-')), 'string_agg', '')) AS leaf,
    sha256(list_aggregate(list_transform([doc_id::VARCHAR, source, lang, (n_chars + 1)::VARCHAR, text], lambda v: coalesce(strlen(v) || ':' || v, '-')), 'string_agg', '')) AS other,
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, {_POLYNOMIAL} * (c & 1)) END) AS crc
  FROM documents
), first AS (
  SELECT id, doc_id, lang, leaf, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN other ELSE leaf END AS now,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), nodes AS (
  SELECT lang, 0 AS level, place, leaf AS digest, n FROM first UNION ALL
  SELECT lang, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, place // 2
), subroots AS (
  SELECT lang, digest, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), crown AS (
  SELECT 0 AS level, place, digest, n FROM subroots UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 1) // 2 FROM crown WHERE n > 1 GROUP BY level, place // 2
), steps AS (
  SELECT f.id, a.level, f.place >> a.level AS spot, b.digest AS sibling FROM first f JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) a ON f.lang IS NOT DISTINCT FROM a.lang
    LEFT JOIN nodes b ON b.lang IS NOT DISTINCT FROM f.lang AND b.level = a.level AND b.place = xor(f.place >> a.level, 1) UNION ALL
  SELECT f.id, s.height + a.level, s.place >> a.level, b.digest FROM first f JOIN subroots s ON f.lang IS NOT DISTINCT FROM s.lang
    JOIN (SELECT DISTINCT level FROM crown WHERE n > 1) a ON true LEFT JOIN crown b ON b.level = a.level AND b.place = xor(s.place >> a.level, 1)
), walk AS (
  SELECT id, 0 AS level, now AS h FROM first UNION ALL
  SELECT w.id, w.level + 1, sha256(CASE WHEN sibling IS NULL THEN h WHEN spot % 2 = 1 THEN sibling || h ELSE h || sibling END) FROM walk w JOIN steps s ON s.id = w.id AND s.level = w.level
), ends AS (SELECT id, arg_max(h, level) AS folded FROM walk GROUP BY id),
proofs AS (SELECT id, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof FROM steps GROUP BY id)
SELECT doc_id, leaf, s.digest AS subroot, c.digest AS root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = c.digest AS verified
FROM first f JOIN subroots s ON f.lang IS NOT DISTINCT FROM s.lang JOIN crown c ON c.n = 1 JOIN ends e ON e.id = f.id LEFT JOIN proofs p ON p.id = f.id
"""
