"""Mixing sources to target weights.

The words of all sources are shared out by weight; a source takes at most ``most`` times its own words, and what
it cannot take goes to the others by weight until none is above. Each document is then emitted floor(rate)
times, and once more with probability equal to the fraction, drawn from a hash of the seed and its id.

The shares have a closed form: in the order of cap per weight, a source is capped exactly if its cap is below
its share of what the capped sources before it leave. Word counts are added as integers, so that every run and
any partitioning give the same targets.

Null texts have size 0; a null source is a source of its own and comes last; equal ids draw alike; a source
without words has target 0 and its documents are emitted once, which takes no words. Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import WORD_SPACE, join_small, written

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    clean = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_SPACE))
    return F.when(clean == "", F.lit(0)).otherwise(F.size(F.split(clean, r"[\x20\x09-\x0D]+", -1))).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source of ``sized`` (source, size): source_size and target.

    The windows run over sources, one row each, never over documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    per = per.withColumns(
        {
            "words": F.sum("source_size").over(total),
            "weights": F.sum("weight").over(total),
            "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    left_words, left_weights = F.col("words") - F.col("cap_before"), F.col("weights") - F.col("weight_before")
    per = per.withColumn("capped", F.col("cap") * left_weights <= F.col("weight") * left_words)
    capped = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(total)
    capped_weight = F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(total)
    share = F.col("weight").cast("double") * (F.col("words") - capped).cast("double") / F.nullif(F.col("weights") - capped_weight, F.lit(0)).cast("double")
    return per.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share)).select("source", "source_size", "target")


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """row (the whole row of ``docs``), size, source_size, target and copies: how often the mix emits each row."""
    sized = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    targets = written(source_targets(sized.select("source", "size"), weights, most))
    joined = join_small(sized, targets, ["source"], "inner")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))
    rated = joined.withColumn("rate", rate)
    return rated.select("row", "size", "source_size", "target", (F.floor("rate") + F.when(drawn < F.col("rate") - F.floor("rate"), 1).otherwise(0)).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as its copies say, with the columns of ``docs``."""
    emitted = copies(docs, weights, most, seed).filter("copies > 0")
    return emitted.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def mix_query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    mixed = copies(docs.select("doc_id", "text", "source"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


ORACLE = """
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, 3 * source_size AS cap,
         sum(source_size) OVER () AS words, sum(weight) OVER () AS weights,
         coalesce(sum(3 * source_size) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM per
  WINDOW w AS (ORDER BY 3 * source_size / weight ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (
  SELECT *, cap * (weights - weight_before) <= weight * (words - cap_before) AS capped FROM ordered),
summed AS (
  SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS caps,
         sum(CASE WHEN capped THEN weight ELSE 0 END) OVER () AS cap_weights
  FROM marked),
targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE CAST(weight AS DOUBLE) * CAST(words - caps AS DOUBLE) / CAST(weights - cap_weights AS DOUBLE) END AS target
  FROM summed),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0 END AS rate,
         CAST(CAST('0x' || left(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS drawn
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rated
"""
