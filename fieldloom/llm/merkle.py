"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions only.

Leaves are the paragraphs (lines with their line end), in parts of at most 160 code
points counted from the paragraph's start. A section ends after a blank line, and after
a leaf whose hash starts with 0 (one in sixteen), so that an edit changes the sections it
touches and no later ones. All hashes are SHA-256, cut to 12 hex digits (root: 32).

The fingerprint is the whole tree as text, ``root:section=leaf,leaf;section=leaf,...``.
Roots test equality; ``changed_sections`` follows differing branches to the edits;
``likeness`` is the Dice coefficient of the leaves.

Defined results: a null text is an empty one, whose tree has a root only; it is like
another empty text (1) and unlike any other (0). ``with_next`` orders rows by descending
id (null last), ties by the text's hash; rows that repeat id and text are one row in that
order and have the same results each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm.shared import cut

LEAF = "[^\n]{0,159}\n|[^\n]{1,160}"
#: The first 12 hex digits of the SHA-256 of a line end: the leaf of a blank line.
BLANK = "01ba4719c80b"
#: Stands for a null id in the order of documents.
NO_ID = -(1 << 63)


def _hash(x: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(x, 256), 1, digits)


def fingerprint(text: Column) -> Column:
    """The tree of a text, as a string."""
    leaves = F.transform(F.regexp_extract_all(text, F.lit(LEAF), F.lit(0)), lambda x: _hash(x))
    ended = F.transform(leaves, lambda x: F.concat(x, F.when((x == BLANK) | x.startswith("0"), F.lit(";")).otherwise(F.lit(","))))
    sections = F.filter(F.split(F.regexp_replace(F.array_join(ended, ""), "[,;]$", ""), ";"), lambda x: x != "")
    nodes = F.array_join(F.transform(sections, lambda x: F.concat(_hash(x), F.lit("="), x)), ";")
    return F.concat(_hash(F.regexp_replace(nodes, "=[^;]*", ""), 32), F.lit(":"), nodes)


def root(tree: Column) -> Column:
    return F.substring_index(tree, ":", 1)


def sections(tree: Column) -> Column:
    """The section hashes of a fingerprint, in order."""
    return F.filter(F.split(F.regexp_replace(F.substring_index(tree, ":", -1), "=[^;]*", ""), ";"), lambda x: x != "")


def leaves(tree: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.substring_index(tree, ":", -1), "[0-9a-f]{12}=", ""), "[,;]"), lambda x: x != "")


def changed_sections(before: Column, after: Column) -> Column:
    """Places (from 0) of the sections of ``after`` that ``before`` doesn't have."""
    old = sections(before)
    marked = F.transform(sections(after), lambda x, i: F.when(~F.array_contains(old, x), i))
    return F.filter(marked, lambda i: i.isNotNull())


def likeness(a: Column, b: Column) -> Column:
    """1 for equal trees, else the Dice coefficient of their distinct leaves."""
    x, y = F.array_distinct(leaves(a)), F.array_distinct(leaves(b))
    size = F.size(x) + F.size(y)
    dice = F.lit(2.0) * F.size(F.array_intersect(x, y)) / F.greatest(size, F.lit(1))
    return F.when(a == b, F.lit(1.0)).otherwise(dice)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, n`` (code points), and of the next document in descending order of the id
    (after the last: the first) ``next_head``, its first ``floor(n / 3)`` code points, and
    ``next_tree``, its fingerprint.

    The order is found over ids and lengths alone, by ranges. Each text is shuffled once by
    its own key, and only the heads go on to their receivers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    slim = rows.select("k", "h", F.length("text").alias("n")).groupBy("k", "h", "n").agg(F.count(F.lit(1)).alias("copies"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("k").desc(), F.col("h")]
    placed = cut(slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()), "order")
    # One row per range partition: the place of its last row, and that of the next one's first.
    part = F.shiftright("pos", 33)
    ends = placed.groupBy(part.alias("p")).agg(F.max("pos").alias("last"), F.min("pos").alias("first"))
    over = W.partitionBy(F.lit(0)).orderBy("p")
    ends = ends.select(F.col("last").alias("pos"), F.coalesce(F.lead("first").over(over), F.first("first").over(over)).alias("jump"))
    after = placed.join(ends, "pos", "left").withColumn("next_pos", F.coalesce("jump", F.col("pos") + 1))
    receivers = after.select(F.col("next_pos").alias("pos"), F.col("k").alias("to_k"), F.col("h").alias("to_h"), F.expr("n div 3").alias("head"))
    links = cut(placed.join(receivers, "pos").select("k", "h", "n", "copies", "to_k", "to_h", "head"), "order")
    repeated = not links.where("copies > 1").isEmpty()

    known = rows.join(links, ["k", "h"])
    heads = known.select("to_k", "to_h", F.expr("substring(text, 1, cast(head AS int))").alias("next_head"), fingerprint(F.col("text")).alias("next_tree"))
    if repeated:
        heads = heads.dropDuplicates(["to_k", "to_h"])
    joined = known.drop("to_k", "to_h").join(heads.withColumnsRenamed({"to_k": "k", "to_h": "h"}), ["k", "h"])
    return joined.select(F.when(F.col("k") != NO_ID, F.col("k")).alias("id"), "text", "n", "next_head", "next_tree")


def edited(text: Column, n: Column, head: Column) -> Column:
    """The text with its last third replaced by the head."""
    return F.concat(F.substr(text, F.lit(1), (n - F.floor(n / 3)).cast("int")), head)


SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
near AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next FROM docs),
made AS (SELECT doc_id, n, text, next, substring(text, 1, n - n // 3) || substring(next, 1, n // 3) AS edited FROM near),
texts AS (SELECT DISTINCT t FROM (SELECT text AS t FROM made UNION ALL SELECT edited FROM made)),
l AS (SELECT t, list_transform(regexp_extract_all(t, '[^\\n]{0,159}\\n|[^\\n]{1,160}'), lambda x: substring(sha256(x), 1, 12)) AS leaves FROM texts),
s AS (SELECT t, leaves, list_filter(string_split(regexp_replace(array_to_string(list_transform(leaves, lambda x: x || CASE WHEN x = '01ba4719c80b' OR x LIKE '0%' THEN ';' ELSE ',' END), ''), '[,;]$', ''), ';'), lambda x: x <> '') AS sections FROM l),
f AS (SELECT t, list_distinct(leaves) AS leaves, coalesce(array_to_string(list_transform(sections, lambda x: substring(sha256(x), 1, 12) || '=' || x), ';'), '') AS nodes,
  substring(sha256(coalesce(array_to_string(list_transform(sections, lambda x: substring(sha256(x), 1, 12)), ';'), '')), 1, 32) AS root FROM s),
j AS (SELECT m.*, a.root || ':' || a.nodes AS fa, b.root || ':' || b.nodes AS fb, c.root || ':' || c.nodes AS fc, a.leaves AS la, b.leaves AS lb, c.leaves AS lc
  FROM made m JOIN f a ON a.t = m.text JOIN f b ON b.t = m.edited JOIN f c ON c.t = m.next)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
  CASE WHEN fa = fb THEN 1.0 ELSE 2.0::DOUBLE * len(list_intersect(la, lb)) / greatest(len(la) + len(lb), 1) END::DOUBLE AS near_edited,
  CASE WHEN fa = fc THEN 1.0 ELSE 2.0::DOUBLE * len(list_intersect(la, lc)) / greatest(len(la) + len(lc), 1) END::DOUBLE AS near_next
FROM j
"""
