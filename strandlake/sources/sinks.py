"""How results leave the engine: TSV, BED and JSON."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH = ["strand", "chrom", "p_min", "p_max", "read_id"]


def tsv(matches: DataFrame) -> DataFrame:
    return matches.select(*MATCH)


def bed(matches: DataFrame) -> DataFrame:
    """chrom, 0-based start, end, name, score, strand."""
    return matches.select("chrom", (F.col("p_min") - 1).alias("start"), F.col("p_max").alias("end"), F.concat(F.lit("read_"), F.col("read_id").cast("string")).alias("name"), F.lit(0).cast("bigint").alias("score"), "strand")


def json_lines(matches: DataFrame) -> DataFrame:
    """json: one object per match. A single document of all matches would have to be built by one task."""
    return matches.select(F.to_json(F.struct(*MATCH)).alias("json"))


def json_document(matches: DataFrame, mode: str = "sorted") -> DataFrame:
    """json: one document {"mode", "matches", "count"}, the matches in the order of `ord` where there is one. One task makes
    it, so it is for results of a known size; larger ones are written by json_pieces()."""
    order = [F.col("ord")] if "ord" in matches.columns else []
    held = matches.agg(F.array_sort(F.collect_list(F.struct(*order, *MATCH))).alias("x"))
    rows = F.transform("x", lambda m: F.struct(*[m[c].alias(c) for c in MATCH]))
    return held.select(F.to_json(F.struct(F.lit(mode).alias("mode"), rows.alias("matches"), F.size("x").cast("bigint").alias("count"))).alias("json"))


def json_pieces(matches: DataFrame, mode: str = "sorted") -> Iterator[str]:
    """The same document piece by piece; the driver holds one partition at a time."""
    yield f'{{"mode":"{mode}","matches":['
    n = 0
    for row in json_lines(matches).toLocalIterator():
        yield ("," if n else "") + row["json"]
        n += 1
    yield f'],"count":{n}}}'


def json_summary(matches: DataFrame, mode: str = "sorted") -> DataFrame:
    """json: {"mode", "count"} of a result."""
    return matches.agg(F.count(F.lit(1)).alias("count")).select(F.to_json(F.struct(F.lit(mode).alias("mode"), "count")).alias("json"))


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)
