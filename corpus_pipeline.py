"""Corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Every stage works on all rows that its predecessor kept; all but the last return the columns of
`documents`.  Verdicts are applied row by row: a row is known by its id, which may be null or repeated,
and the SHA-256 of its text, so neither rows without id nor other texts of an id escape one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fresh, keep_matching, new_path, written
from graphloom.llm.exact_dedup import exact_dedup
from graphloom.llm.jaccard_join import jaccard_join
from graphloom.llm.mixing import mix_sources
from graphloom.llm.quality_classifier import fit_quality, score_quality
from graphloom.llm.sentencepiece_lattice import DEFAULT_MODEL, Vocabulary, encode

#: SQL cannot express the classifier, the random paths or the lattice search.
ORACLE_SQL = None


def _with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs plus a row key, and the name of that column: id and hash of the text, ordered by id (null last); its fields may be null."""
    row = fresh(docs.columns, "row")
    key = F.struct(F.when(F.col("doc_id").isNull(), 1).alias("no_id"), "doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("hash"))
    return docs.withColumn(row, key), row


def _apply(docs: DataFrame, row: str, verdicts: DataFrame) -> DataFrame:
    """Rows of docs without those whose verdict (row, once) is in the table; of a row with `once` one copy stays."""
    verdicts = written(verdicts.withColumnRenamed("row", row), "pipeline-verdicts")
    rest = keep_matching(docs, verdicts.select(row), [row], "left_anti")
    once = verdicts.where("once").select(row)
    if once.limit(1).count():
        first = keep_matching(docs, once, [row]).groupBy(row).agg(F.min(F.struct(*[c for c in docs.columns if c != row])).alias("first"))
        rest = rest.unionByName(first.select("first.*", row))
    return rest.drop(row)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, row = _with_row(docs)
    scores = written(score_quality(rows, fit_quality(docs, labels), id_col=row).select(F.col("doc_id").alias("row"), "predicted"), "pipeline-scores")
    return _apply(rows, row, scores.where("predicted = 0").groupBy("row").agg(F.lit(False).alias("once")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts, the longest as it stands, among those the smallest id."""
    rows, row = _with_row(docs)
    found = exact_dedup(rows, row).groupBy(F.col("doc_id").alias("row")).agg(F.count("*").alias("rows"), F.sum(F.col("kept").cast("int")).alias("kept"))
    return _apply(rows, row, found.where("kept < rows").select("row", (F.col("kept") > 0).alias("once")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of each group linked by similar word shingles; blank texts are in none."""
    rows, row = _with_row(docs)
    found = jaccard_join(rows, id_col=row).where("n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias("row"), (F.col("doc_id") == F.col("group_id")).alias("once")).agg(F.count("*").alias("rows"))
    return _apply(rows, row, found.where("not once or rows > 1").select("row", "once"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and drop documents so that sources meet their target weights.

    Documents stay whole: a fractional repetition of half a document or more counts as a whole one."""
    rows, row = _with_row(docs)
    repeats = F.col("repeats") + (F.col("part") * 2 >= F.greatest("size", F.lit(1))).cast("int")
    # The key must tell sources apart too: rows that agree in key and source are alike.
    mix = mix_sources(rows, id_col=row).select(F.col("doc_id").alias("row"), F.col("source").alias("of"), repeats.alias("repeats"))
    mix = written(mix.groupBy("row", "of").agg(F.max("repeats").alias("repeats")).where("repeats > 0"), "pipeline-mix")
    taken = rows.join(mix.hint("shuffle_hash"), (rows[row] == mix["row"]) & rows["source"].eqNullSafe(mix["of"]))
    copies = F.explode(F.sequence(F.lit(1), mix["repeats"]))
    return taken.select(*[rows[c] for c in docs.columns], copies.alias(row)).drop(row)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every remaining row to piece ids; the scores are of its four best segmentations."""
    return encode(docs, Vocabulary(DEFAULT_MODEL))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram jaccard join", near_copies),
    ("source mixing", source_mix),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
