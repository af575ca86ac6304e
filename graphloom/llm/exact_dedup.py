"""Exact dedup by 128-bit content hash with byte comparison inside groups.

Two passes over the texts, neither of which shuffles a text that has no twin:

1. each row is reduced to (id, md5, sha-256, length); rows are counted per hash with map-side
   combination, so a hot group costs one row per map task;
2. texts whose hash occurs twice or more are grouped by (hash, normalised text), which compares the
   bytes inside every group.  A hash that stands for several different texts is a collision; its rows
   take the text itself as a second key, so the result stays exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, keep_matching, repeated, without_white, written


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash=F.md5) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when they agree after removal of white space; null counts as empty, so null and
    blank texts form one group.  The row with the most code points in the original text stays, among
    those the smallest id (a null id comes last).  A row that occurs several times with the same id is
    a copy like any other: exactly one of its occurrences has kept = true.  An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"), without_white(F.col(text_col)).alias("norm"))
    hashed = texts.withColumns({"md5": content_hash(F.col("norm").cast("binary")), "text_sha256": F.sha2(F.col("norm").cast("binary"), 256)})
    # Equal rows (one id read twice) become one row with a count; all four columns deal hot texts out evenly.
    rows = written(hashed.groupBy("doc_id", "md5", "text_sha256", "n_chars").agg(F.count("*").alias("copies")), "dedup-rows")
    twice = rows.groupBy("md5").agg(F.sum("copies").alias("n")).where("n > 1").select("md5")
    twins = keep_matching(texts.select(content_hash(F.col("norm").cast("binary")).alias("md5"), "norm"), twice, ["md5"])
    collided = twins.groupBy("md5", "norm").agg(F.count("*").alias("n")).groupBy("md5").agg(F.count("*").alias("n")).where("n > 1").select("md5")
    collided = written(collided, "dedup-collisions")
    if collided.limit(1).count():
        apart = hashed.join(collided.withColumn("apart", F.col("md5")), "md5", "left").withColumn("part", F.when(F.col("apart").isNotNull(), F.col("norm")))
        rows = apart.groupBy("doc_id", "md5", "part", "text_sha256", "n_chars").agg(F.count("*").alias("copies"))
    else:
        rows = rows.withColumn("part", F.lit(None).cast("string"))
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id")))
    groups = rows.groupBy("md5", "part").agg(F.sum("copies").alias("group_size"), best.alias("best"))
    groups = groups.select("md5", "part", "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars"))
    key = F.when(F.col("part").isNull(), F.col("md5")).otherwise(F.concat("md5", F.lit(":"), "part"))
    groups = written(groups.withColumn("key", key).drop("md5", "part"), "dedup-groups")
    joined = join_counted(rows.withColumn("key", key), groups, "key", "group_size")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    out = repeated(joined.select("doc_id", "keep_id", "group_size", stays.alias("stays"), "text_sha256", "n_chars", "copies"), "copies")
    return out.withColumn("kept", F.col("stays") & (F.col("copies") == 0)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_chars")
