"""Queries on the documents: packing, leaked passages, reading level."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import leakage, packing, reading
from strandlake.session import materialize
from strandlake.sources.tables import table

#: Posts of level 4 and 5: estimates are on a continuous scale.
HARD = 3.5
LEAST_WORDS = 40


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), table(spark, folder, "pack_specs"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that had to be split: those with a second piece."""
    return p7_containers(spark, folder).where("piece = 1").select("spec_id", "doc_id")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per container size: containers, tokens and the mean fill."""
    one = p7_containers(spark, folder).groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("tokens"))
    specs = table(spark, folder, "pack_specs")
    return one.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("tokens").alias("tokens")).join(specs, "spec_id").select(
        "spec_id", "n_containers", "tokens", (F.col("tokens") / F.col("n_containers") / F.col("capacity")).alias("fill")
    )


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per container size what must hold: n_docs, documents packed; lost, tokens that went missing; overfull, containers
    above capacity; needless, documents cut though they fit; doubled, pieces in more than one container; filled, whether the
    containers are full to 90 % on average, the last of a task left out."""
    docs, specs = table(spark, folder, "documents"), table(spark, folder, "pack_specs")
    pieces = materialize(packing.pack_documents(docs, specs), "pieces").join(specs, "spec_id")
    sizes = docs.where(F.col("text").rlike(r"\S")).select("doc_id", packing.byte_tokens(F.col("text")).alias("size"))
    per_doc = pieces.groupBy("spec_id", "capacity", "doc_id").agg(F.sum("tokens").alias("got"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("different")).join(sizes, "doc_id", "full")
    whole = per_doc.groupBy("spec_id").agg(
        F.count("doc_id").alias("n_docs"),
        F.sum(F.abs(F.coalesce("got", F.lit(0)) - F.coalesce("size", F.lit(0)))).alias("lost"),
        F.sum(((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity"))).cast("bigint")).alias("needless"),
        F.sum(F.col("pieces") - F.col("different")).alias("doubled"),
    )
    boxes = pieces.groupBy("spec_id", "capacity", "container_id").agg(F.sum("tokens").alias("tokens"))
    # a container's number is its task's, shifted, plus its place: the last container of each task closes as it is
    last = boxes.groupBy("spec_id", F.shiftright("container_id", 36).alias("task")).agg(F.max("container_id").alias("container_id")).drop("task").withColumn("last", F.lit(True))
    full = boxes.join(last, ["spec_id", "container_id"], "left").groupBy("spec_id").agg(
        F.sum((F.col("tokens") > F.col("capacity")).cast("bigint")).alias("overfull"),
        (F.coalesce(F.avg(F.when(F.col("last").isNull(), F.col("tokens") / F.col("capacity"))), F.lit(1.0)) >= 0.9).alias("filled"),
    )
    return whole.join(full, "spec_id").select("spec_id", "n_docs", "lost", "overfull", "needless", "doubled", "filled")


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return leakage.leaks(docs, table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_leaks(spark, folder).select("item_id", "doc_id")


def p8_clean_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return leakage.without_leaks(docs, p8_leaks(spark, folder)).select("doc_id")


def _graded(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, reading.Corpus]:
    """The English posts, the labels, and counts over the whole texts of all posts."""
    docs = table(spark, folder, "documents")
    return docs.where("lang = 'en'").select("doc_id", "text"), table(spark, folder, "reading_labels"), reading.corpus_counts(docs)


def _levels(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """Levels of docs by the model fitted on the graded English posts. Without own words there is no prose to judge: score
    and level are then null."""
    model = reading.train(*_graded(spark, folder), LEAST_WORDS)
    rows = reading.reading_levels(docs.select("doc_id", "text"), model)
    judged = F.col("own_words") > 0
    return rows.select("doc_id", "own_words", *[F.when(judged, F.col(c)).alias(c) for c in ("score", "level")])


def p9_held_out(spark: SparkSession, folder: str) -> DataFrame:
    """One row of five-fold cross-validation on the graded posts: accurate, whether at least 95 % are put on the right
    side of level 4 (raters' median); ordered, whether at least 85 % of the pairs of different level are in order (equal
    estimates count half). The limits leave room for small inputs: 41 graded posts at scale 0.01, 503 at 0.1."""
    level, guess = reading.held_out(*_graded(spark, folder), LEAST_WORDS)
    right = float(np.mean((guess >= HARD) == (level >= HARD))) if len(level) else 1.0
    groups, good, pairs = [np.sort(guess[level == v]) for v in np.unique(level)], 0.0, 0
    for i, upper in enumerate(groups):
        for lower in groups[:i]:  # the pairs are counted, not listed
            good += (np.searchsorted(lower, upper, "left").sum() + np.searchsorted(lower, upper, "right").sum()) / 2
            pairs += len(upper) * len(lower)
    order = good / pairs if pairs else 1.0
    return spark.createDataFrame([(bool(right >= 0.95), bool(order >= 0.85))], "accurate boolean, ordered boolean")


def p9_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """One row: graded English posts, and whether p9_found holds at least 95 % of those at level 4 or 5 and, of its graded
    posts, at least 95 % are."""
    docs = table(spark, folder, "documents").where("lang = 'en'").select("doc_id")
    graded = reading.agreed_levels(table(spark, folder, "reading_labels")).join(docs, "doc_id")
    found = p9_found(spark, folder).withColumn("found", F.lit(True))
    rows = graded.join(found, "doc_id", "left").select((F.col("level") >= HARD).cast("int").alias("hard"), F.coalesce("found", F.lit(False)).cast("int").alias("found"))
    both = F.sum(F.col("hard") * F.col("found"))
    return rows.agg(F.count(F.lit(1)).alias("graded"), (both >= 0.95 * F.sum("hard")).alias("recall"), (both >= 0.95 * F.sum("found")).alias("precision"))


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Every post with its own words and level, whatever its language and length."""
    return _levels(spark, folder, table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Of the English posts with enough own prose, the hard ones."""
    rows = _levels(spark, folder, table(spark, folder, "documents").where("lang = 'en'"))
    return rows.where((F.col("own_words") >= LEAST_WORDS) & (F.col("level") >= HARD)).select("doc_id")


def p9_boards(spark: SparkSession, folder: str) -> DataFrame:
    """Per board: all its posts, how many have own prose and so a level, their mean level and the share of hard ones."""
    boards = table(spark, folder, "documents").select("doc_id", "source")
    return p9_levels(spark, folder).join(boards, "doc_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_posts"), F.count("level").alias("n_levels"), F.avg("level").alias("mean_level"), F.avg((F.col("level") >= HARD).cast("double")).alias("hard_share")
    )
