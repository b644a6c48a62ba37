"""Mixing sources to target weights, to the word.

Every document gets a hash-random key. A source is cut into key ranges (as many as its rows need), each range is summed, the
sums are scanned into offsets, and each range adds its own running sum: a distributed prefix sum with no task larger than a
range, however large the source. A source with budget b and size s takes b // s whole epochs and then the first b % s
words in key order.

Every row has a number of its own, by which its words come back to it: rows that repeat an id, or a whole row, are documents each for itself. Their
common key would put them into one range, so a range that gets far more rows than its share is split by a hash of the row number.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source of its own and sorts last; rows of one
doc_id and size follow their order in the table; texts of any length are counted whole; an empty table gives no rows; other columns pass through, and clashing names get underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, n_words, own_name, table

WEIGHTS = (5, 2, 1)
CAP = 3
#: Rows that a key range holds in the mean; a task sorts a few of them.
RANGE_ROWS = 4096
SEED = "mix"


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP, share: float = 1.0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per source of sizes (source, size): source_size, n_rows, target.

    With sources by cap / weight, each prefix of capped sources leaves (total - their caps) / (weight of the rest) per unit of
    weight; the largest of these levels is the one at which resharing ends.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights)).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(share) - (F.sum("cap").over(by) - F.col("cap"))
    level = left / (F.sum("w").over(everything) - F.sum("w").over(by) + F.col("w"))
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / F.lit(range_rows))).cast("long")
    return s.select("source", "source_size", buckets.alias("ranges"), F.least("cap", F.col("level") * F.col("w")).alias("target"))


def takes(keyed: DataFrame, weights=WEIGHTS, cap: float = CAP, share: float = 1.0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """keyed (row columns, source, size, key: 32 hex digits, row: a number) with source_size, target and taken (words)."""
    targets = source_targets(keyed.select("source", "size"), weights, cap, share, range_rows)
    u = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    t = targets.withColumnRenamed("source", "t_source")
    dealt = keyed.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source").withColumn("range", F.floor(u * F.col("ranges")))
    # Only rows that share a key can make a range this full.
    full = dealt.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 8 * range_rows)
    full = full.select(F.col("source").alias("f_source"), F.col("range").alias("f_range"), F.ceil(F.col("n") / range_rows).cast("long").alias("parts"))
    dealt = dealt.join(full, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("range") == F.col("f_range")), "left").drop("f_source", "f_range")
    dealt = dealt.withColumn("sub", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)))
    sums = dealt.groupBy("source", "range", "sub").agg(F.sum("size").alias("range_size"))
    # Ranges of a source are summed in blocks first, so that no task scans all of a source's ranges.
    block = F.floor(F.col("range") / 1024)
    blocks = sums.groupBy("source", block.alias("block")).agg(F.sum("range_size").alias("block_size"))
    blocks = blocks.select(F.col("source").alias("b_source"), "block", (F.sum("block_size").over(Window.partitionBy("source").orderBy("block")) - F.col("block_size")).alias("block_ahead"))
    inside = F.sum("range_size").over(Window.partitionBy("source", "block").orderBy("range", "sub")) - F.col("range_size")
    ahead = sums.withColumn("block", block).withColumn("inside", inside).join(blocks.withColumnRenamed("block", "b_block"), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
    ahead = ahead.select(F.col("source").alias("a_source"), F.col("range").alias("a_range"), F.col("sub").alias("a_sub"), (F.col("inside") + F.col("block_ahead")).alias("ahead"))
    own = F.sum("size").over(Window.partitionBy("source", "range", "sub").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = dealt.withColumn("own", own).join(ahead, F.col("source").eqNullSafe(F.col("a_source")) & (F.col("range") == F.col("a_range")) & (F.col("sub") == F.col("a_sub")))
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead") - F.col("own")))
    return placed.withColumn("taken", (whole * F.col("size") + part).cast("long")).drop("ranges", "range", "sub", "parts", "own", "ahead", "a_source", "a_range", "a_sub")


def keyed_documents(docs: DataFrame, seed: str = SEED, row: Column | None = None) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), (F.monotonically_increasing_id() if row is None else row).alias("row"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, share: float = 1.0, seed: str = SEED) -> DataFrame:
    """The mixed corpus with the columns of docs: a document repeated for each whole epoch, and cut to its first words where the budget ends inside it.

    Texts are moved once: numbers, sizes and words taken go through the mixing, then rows are joined by their number.
    """
    row, size, taken, turn = (own_name(docs, name) for name in ("row", "size", "taken", "turn"))
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    plan = takes(cut(keyed_documents(numbered, seed, F.col(row))), weights, cap, share)
    plan = plan.filter("taken > 0").select(F.col("row").alias("p_row"), F.col("size").alias("p_size"), F.col("taken").alias("p_taken"))
    p = {n: own_name(numbered, n) for n in plan.columns}
    d = numbered.join(plan.select(*[F.col(n).alias(m) for n, m in p.items()]), F.col(row) == F.col(p["p_row"]))
    d = d.withColumn(size, F.col(p["p_size"])).withColumn(taken, F.col(p["p_taken"]))
    d = d.withColumn(turn, F.explode(F.sequence(F.lit(0), F.floor((F.col(taken) - 1) / F.col(size)).cast("int"))))
    words = F.least(F.col(size), F.col(taken) - F.col(turn) * F.col(size))
    return d.withColumn("text", F.when(words == F.col(size), F.col("text")).otherwise(first_words(F.col("text"), words))).select(*docs.columns)


def first_words(text: Column, n: Column) -> Column:
    """The first n words with what stands between them."""
    pieces = F.slice(F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1)), F.lit(1), n.cast("int"))
    return F.array_join(pieces, "")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(keyed_documents(table(spark, sf_dir, "documents")))
    return takes(docs).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
    ((sum(source_size) OVER ())::DOUBLE - (sum(3.0::DOUBLE * source_size) OVER o - 3.0::DOUBLE * source_size))
    / (sum(w) OVER () - sum(w) OVER o + w) AS level
  FROM s WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST)),
t AS (SELECT source, source_size, least(cap, (max(level) OVER ()) * w) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN (budget // source_size) * size
     + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM p
"""
