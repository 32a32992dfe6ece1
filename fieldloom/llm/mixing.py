"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

A tree of levels (domain, language, source) has a weight at each node. The budget of
tokens goes down from the root: each node shares its own among its children in
proportion to their weights, but no child gets more than its capacity, the tokens
below it times ``max_epochs``. What a child can't take goes to its siblings; a node whose
children can't take it all has a capacity below its share, so that the rest goes to the
node's own siblings, and so on up. The shares of one node follow from one window over
its children ordered by capacity / weight, in whole numbers:

    full(i)  <=>  capacity(i) * (weights from i on)  <=  (budget - capacities before i) * weight(i)

and the rest is dealt among those not full; the last few tokens go to the first of them.

Each leaf then takes a prefix of its stream of seeded epochs: epoch e is its documents in
the order of md5(seed:e:doc_id), whole epochs first. Only the last epoch needs an order.
Its cut is found over ``16^3`` ranges of the hash per leaf, and exactly in the one range
that it falls in, so no leaf is sorted in one task. The leaf's row then says all: the
documents are joined to it and not shuffled otherwise.

Defined results: null values of a level are a child of their own; a null text has no
tokens; documents without tokens are taken with those before them; rows with the same id
share their place, and are taken together; weight 0 takes nothing; an empty table gives
no rows; all columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm.shared import cut

Levels = list[tuple[str, Column]]

#: Parts that the rows of one leaf are dealt into.
SALTS = 32


def estimated_tokens(text_col: str = "text") -> Column:
    """A quarter of the code points, rounded up."""
    return F.floor((F.coalesce(F.length(text_col), F.lit(0)) + 3) / 4).cast("long")


def _share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``budget`` of each child of nodes with ``node_budget``; ``cap`` and ``w`` are the children's."""
    here = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = here.orderBy("ratio", name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    x = children.withColumn("ratio", F.col("cap") / F.greatest(F.col("w"), F.lit(1)))
    x = x.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    x = x.withColumn("w_from", F.sum("w").over(here) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    x = x.withColumn("full", F.expr("CAST(cap AS decimal(19)) * CAST(w_from AS decimal(19)) <= CAST(node_budget - cap_before AS decimal(19)) * CAST(w AS decimal(19))"))
    x = x.withColumn("rest", F.col("node_budget") - F.sum(F.expr("if(full, cap, 0)")).over(here))
    x = x.withColumn("w_rest", F.sum(F.expr("if(full, 0, w)")).over(here))
    x = x.withColumn("budget", F.expr("if(full, cap, CAST(rest AS decimal(19)) * CAST(w AS decimal(19)) div greatest(w_rest, 1))"))
    x = x.withColumn("over", F.col("rest") - F.sum(F.expr("if(full, 0, budget)")).over(here))
    x = x.withColumn("place", F.sum(F.expr("if(full, 0, 1)")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return x.withColumn("budget", F.expr("budget + if(NOT full AND place <= over, 1, 0)"))


def budgets(leaves: DataFrame, names: list[str], weights: dict[str, dict[str, int]], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """``budget`` for each leaf (``names`` and ``tokens``). ``share``: the part of all tokens that the mix should have."""

    def weight(name: str) -> Column:
        given = weights.get(name, {})
        named = [(f"={k}", int(v)) for k, v in given.items()]
        out = F.lit(1).cast("long")
        for k, v in named:
            out = F.when(F.col(name) == k, F.lit(v).cast("long")).otherwise(out)
        return out

    rows = leaves.withColumn("cap", F.col("tokens") * F.lit(max_epochs).cast("long"))
    for name in names:
        rows = rows.withColumn("cap", F.when(weight(name) > 0, F.col("cap")).otherwise(F.lit(0).cast("long")))
    root = rows.agg(F.least(F.expr(f"sum(tokens) * {int(share[0])}L div {int(share[1])}L"), F.sum("cap"))).first()[0]
    node = None
    for k, name in enumerate(names):
        path = names[: k + 1]
        children = rows.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", weight(name))
        children = children.join(node, names[:k]) if k else children.withColumn("node_budget", F.lit(root or 0).cast("long"))
        node = _share(children, names[:k], name).select(*path, F.col("budget").alias("node_budget"))
    return leaves.join(node.withColumnRenamed("node_budget", "budget"), names)


def mix(
    docs: DataFrame,
    levels: Levels,
    weights: dict[str, dict[str, int]],
    share: tuple[int, int],
    max_epochs: int = 1,
    seed: int = 1,
    tokens: Column | None = None,
    id_col: str = "doc_id",
) -> DataFrame:
    """``_row`` (a struct of the columns of ``docs``), ``tokens``, the leaf's levels and ``epoch``, one row per taken copy."""
    names = [f"level_{name}" for name, _ in levels]
    weights = {f"level_{name}": w for name, w in weights.items()}
    marks = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null")).alias(n) for n, (_, c) in zip(names, levels)]
    rows = docs.select(*marks, F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("_key"), (estimated_tokens() if tokens is None else tokens).alias("tokens"), F.struct("*").alias("_row"))
    slim = cut(rows.select(*names, "_key", "tokens"), "mix")
    leaves = cut(slim.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "mix")
    leaves = budgets(leaves, names, weights, share, max_epochs)
    leaves = leaves.withColumns({"whole": F.expr("if(tokens = 0, 0, budget div greatest(tokens, 1))"), "rest": F.expr("budget - if(tokens = 0, 0, budget div greatest(tokens, 1)) * tokens")})
    leaves = cut(leaves.select(*names, F.col("whole").cast("long").alias("whole"), F.col("rest").cast("long").alias("rest")), "mix")

    place = F.md5(F.concat(F.lit(f"{seed}:"), (F.col("whole") + 1).cast("string"), F.lit(":"), F.col("_key")))
    # A leaf may hold a third of all rows: it is met in SALTS parts, and summed by range.
    parts = leaves.where("rest > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = slim.withColumn("salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
    last = salted.join(parts, [*names, "salt"]).withColumn("h", place).withColumn("range", F.substring("h", 1, 3))
    sums = last.groupBy(*names, "rest", "range").agg(F.sum("tokens").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*names).orderBy("range"))
    split = sums.withColumn("upto", upto).where("upto > rest AND upto - n <= rest").groupBy(*names).agg(F.min(F.struct("range", (F.col("upto") - F.col("n")).alias("before"))).alias("s"))
    split = split.select(*names, "s.range", "s.before")
    inside = last.join(split, [*names, "range"])
    run = F.sum("tokens").over(W.partitionBy(*names).orderBy("h").rangeBetween(W.unboundedPreceding, 0))
    taken = inside.withColumn("run", F.col("before") + run).where("run <= rest").groupBy(*names).agg(F.max("h").alias("upto"))
    ends = leaves.join(split, names, "left").join(taken, names, "left")
    ends = cut(ends.select(*names, "whole", "rest", "range", "upto"), "mix")

    chosen = rows.join(ends, names).withColumn("h", place)
    in_last = F.expr("rest > 0 AND (range IS NULL OR substring(h, 1, 3) < range OR h <= coalesce(upto, ''))")
    chosen = chosen.withColumn("copies", F.col("whole") + F.when(in_last, 1).otherwise(0)).where("copies > 0")
    return chosen.select("_row", "tokens", *names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("epoch"))


def source_domain(source_col: str = "source") -> Column:
    """A domain of the test tables: the remainder of the source's number by three."""
    number = F.regexp_extract(F.col(source_col), "([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (F.expr(f"try_cast(regexp_extract({source_col}, '([0-9]+)$', 1) AS bigint)") % 3).cast("string")))


#: The weights of the query and of the pipeline.
WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 4, "fr": 2, "de": 2, "es": 2}}


def levels_of_documents() -> Levels:
    return [("domain", source_domain()), ("lang", F.col("lang")), ("source", F.col("source"))]


def _sql_share(k: int, names: list[str]) -> str:
    """The CTEs of one level; the same arithmetic over the children of level k."""
    path, parent, name = ", ".join(names[: k + 1]), ", ".join(names[:k]), names[k]
    by = f"PARTITION BY {parent}" if parent else ""
    weight = {"domain": "CASE domain WHEN '=d0' THEN 5 WHEN '=d1' THEN 3 WHEN '=d2' THEN 2 ELSE 1 END", "lang": "CASE lang WHEN '=en' THEN 4 WHEN '=fr' THEN 2 WHEN '=de' THEN 2 WHEN '=es' THEN 2 ELSE 1 END", "source": "1"}[name]
    join = f"JOIN node{k} USING ({parent})" if parent else "CROSS JOIN node0"
    return f"""
kids{k} AS (SELECT {path}, sum(cap)::BIGINT AS cap, ({weight})::BIGINT AS w FROM leaves GROUP BY {path}),
a{k} AS (SELECT *, cap / greatest(w, 1) AS ratio FROM kids{k} {join}),
b{k} AS (SELECT *, coalesce(sum(cap) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
  sum(w) OVER ({by}) - coalesce(sum(w) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_from
  FROM a{k} WINDOW x AS ({by} ORDER BY ratio, {name})),
c{k} AS (SELECT *, cap * w_from <= (node_budget - cap_before) * w AS is_full FROM b{k}),
d{k} AS (SELECT *, node_budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}) AS rest,
  sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({by}) AS w_rest,
  sum(CASE WHEN is_full THEN 0 ELSE 1 END) OVER ({by} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM c{k}),
e{k} AS (SELECT *, CASE WHEN is_full THEN cap ELSE (rest * w) // greatest(w_rest, 1) END AS budget FROM d{k}),
node{k + 1} AS (SELECT {path}, budget + CASE WHEN NOT is_full AND place <= rest - sum(CASE WHEN is_full THEN 0 ELSE budget END) OVER ({by}) THEN 1 ELSE 0 END AS node_budget FROM e{k})"""


_NAMES = ["domain", "lang", "source"]
SQL = f"""
WITH docs AS (SELECT doc_id, coalesce('=' || 'd' || (nullif(regexp_extract(source, '([0-9]+)$', 1), '')::BIGINT % 3), 'null') AS domain,
  coalesce('=' || lang, 'null') AS lang, coalesce('=' || source, 'null') AS source, (coalesce(length(text), 0) + 3) // 4 AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * 3 AS cap FROM docs GROUP BY ALL),
node0 AS (SELECT least(sum(tokens)::BIGINT * 6 // 10, sum(cap)::BIGINT) AS node_budget FROM leaves),
{",".join(_sql_share(k, _NAMES) for k in range(3))},
ends AS (SELECT domain, lang, source, node_budget // greatest(tokens, 1) AS whole, node_budget % greatest(tokens, 1) AS rest FROM leaves JOIN node3 USING (domain, lang, source)),
placed AS (SELECT d.*, whole, rest, md5('1:' || (whole + 1) || ':' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM docs d JOIN ends USING (domain, lang, source)),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed),
taken AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM run)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, epoch::BIGINT AS epoch FROM (SELECT *, unnest(range(1, copies::BIGINT + 1)) AS epoch FROM taken)
"""
