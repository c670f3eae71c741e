"""Mixing sources to target weights, in DataFrame functions alone.

Sources are ranked by code point (null last) and weigh 1, 2, 3, repeating.
The targets share all words by weight; a source is clamped at ``max_epochs``
times its own size and the excess is shared by weight among the rest until
none is above its cap.  That fixed point is a water level: with the sources in
order of cap / weight, a source is clamped exactly when filling all to its own
level takes no more than there is, so two running sums over the source table
find it.

Every document gets the whole repetitions of its source.  The fractional one
takes documents in a seeded order (md5 of the seed and the id) until the target
is met, the last of them in part.  The order is cut into ``16 ** digits``
ranges of the hash; only sums of ranges are accumulated, and single documents
are ordered inside the one range of each source where the target falls, so no
source is gathered in one task.

Nulls: a null text has size 0 and a null id is ordered as empty text; a null
source is one source.  Ties in the order are equal in (id, size), so whichever
comes first the rows are the same.  An empty table gives an empty result.
Columns of ``docs`` named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, quoted

WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def order_key(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(quoted(id_col).cast("string"), F.lit(""))).cast("binary"))


def source_plan(sized: DataFrame, max_epochs: int = 3, digits: int = 3) -> DataFrame:
    """One row a source: its size, target, whole repetitions, and the range of
    the seeded order in which the fractional repetition ends.

    ``sized`` has _source, _size and _key.
    """
    ranges = sized.groupBy("_source", F.substring("_key", 1, digits).alias("_range")).agg(F.sum("_size").alias("_rs"))
    sources = ranges.groupBy("_source").agg(F.sum("_rs").alias("source_size"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(0)).orderBy("_ratio", "_rank")
    upto = all_rows.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    leveled = (
        sources.withColumn("_rank", F.row_number().over(by_name))
        .withColumn("_weight", ((F.col("_rank") - 1) % 3 + 1).cast("long"))
        .withColumn("_cap", F.col("source_size") * max_epochs)
        .withColumn("_ratio", F.col("_cap").cast("double") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(whole))
        .withColumn("_caps", F.sum("_cap").over(upto))
        .withColumn("_left", F.sum("_weight").over(whole) - F.sum("_weight").over(upto))
        .withColumn("_full", F.col("_caps") + F.col("_ratio") * F.col("_left") <= F.col("_total"))
        .withColumn("_clamped", F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(whole))
        .withColumn("_open", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_weight"))).over(whole))
        .withColumn(
            "target",
            F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(
                F.col("_weight") * ((F.col("_total") - F.col("_clamped")).cast("double") / F.col("_open"))
            ),
        )
        .withColumn("_words", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.expr("_words div source_size")).otherwise(F.lit(0)))
        .withColumn("_part", F.col("_words") - F.col("_epochs") * F.col("source_size"))
        .select("_source", "source_size", "target", "_epochs", "_part")
    )
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        ranges.withColumn("_before", F.coalesce(F.sum("_rs").over(before), F.lit(0)))
        .join(leveled.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")))
        .where((F.col("_before") <= F.col("_part")) & (F.col("_part") < F.col("_before") + F.col("_rs")))
        .select("_s", "_range", "_before")
        .withColumnRenamed("_s", "_es")
    )
    return (
        leveled.join(ends, F.col("_source").eqNullSafe(F.col("_es")), "left")
        .drop("_es")
        .withColumnRenamed("_source", "_s")
        .withColumnRenamed("_range", "_end")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    max_epochs: int = 3,
    digits: int = 3,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes).

    ``keep`` names the columns of ``docs`` that stay, all by default.
    """
    new = {"size", "source_size", "target", "taken"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    sized = docs.select(
        *[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)],  # no name of a caller meets an own one
        quoted(source_col).alias("_source"),
        quoted(id_col).alias("_id"),
        size_of(quoted(text_col)).alias("_size"),
        order_key(id_col, seed).alias("_key"),
    )
    if text_col not in keep:
        sized = cut(sized)
    plan = cut(source_plan(sized.select("_source", "_size", "_key"), max_epochs, digits))
    joined = sized.join(plan, F.col("_source").eqNullSafe(F.col("_s"))).withColumn(
        "_range", F.substring("_key", 1, digits)
    )
    ending = F.coalesce(F.col("_range") == F.col("_end"), F.lit(False))
    whole = F.col("_epochs") * F.col("_size")
    rest = joined.where(~ending).withColumn(
        "taken", whole + F.when(F.coalesce(F.col("_range") < F.col("_end"), F.lit(False)), F.col("_size")).otherwise(0)
    )
    inside = (
        Window.partitionBy("_source", "_range").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    )
    at_end = joined.where(ending).withColumn(
        "taken",
        whole
        + F.greatest(
            F.lit(0),
            F.least(
                F.col("_size"),
                F.col("_part") - F.col("_before") - F.coalesce(F.sum("_size").over(inside), F.lit(0)),
            ),
        ),
    )
    cols = [*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("_size").alias("size"), "source_size", "target", F.col("taken").cast("long")]
    return rest.select(*cols).unionByName(at_end.select(*cols))


ORACLE_SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS w,
             3 * source_size AS cap FROM g),
l AS (SELECT a.source, a.source_size, a.w, a.cap,
             (SELECT sum(least(CAST(b.cap AS DOUBLE), b.w * (CAST(a.cap AS DOUBLE) / a.w))) FROM r b)
               <= (SELECT sum(source_size) FROM r) + 1e-6 AS clamped FROM r a),
t AS (SELECT source, source_size,
             CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE
               w * (CAST((SELECT sum(source_size) FROM l) - (SELECT coalesce(sum(cap), 0) FROM l WHERE clamped) AS DOUBLE)
                    / (SELECT sum(w) FROM l WHERE NOT clamped)) END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS e,
             CAST(floor(target + 0.5) AS BIGINT) AS words FROM t)
SELECT s.doc_id, s.size, p.source_size, p.target,
       CAST(p.e * s.size + greatest(0, least(s.size, p.words - p.e * p.source_size - coalesce(
         sum(s.size) OVER (PARTITION BY s.source ORDER BY k, doc_id, s.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source
"""
