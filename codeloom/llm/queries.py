"""The registered queries of the numbered problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, docs, handwritten, lookalike, neighbours, packing, secrets, syntax
from codeloom.tables import current_files, cut, extension, read


def _not_handwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are judged where they lie; a text row that is repeated counts once, so each current file has one row."""
    return handwritten.told_apart(current_files(spark, sf_dir, lambda raw: handwritten.judged(raw).dropDuplicates(["repository", "path", "commit"])))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _not_handwritten(spark, sf_dir).select("file_id").distinct()


def p1_handwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains: the files that people on the project wrote."""
    ext = extension(F.col("path"))
    mine = current_files(spark, sf_dir).where(ext.isin(*handwritten.EXTENSIONS)).select("file_id", "repository", "path").distinct()
    return mine.join(_not_handwritten(spark, sf_dir).select("file_id"), "file_id", "left_anti")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found(read(spark, sf_dir, "chunks").select("chunk_id", "content", "file_path"))


def p2_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk that holds a credential with its masked content."""
    return secrets.masked(read(spark, sf_dir, "chunks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.judged(current_files(spark, sf_dir)).where("invalid").select("file_id").distinct()


def p3_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least repair of each invalid file: number of edits, cause, lines."""
    return syntax.repairs(current_files(spark, sf_dir))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of invalid files per repository and language, with what parser had read them."""
    judged = syntax.judged(current_files(spark, sf_dir)).distinct()
    parser = read(spark, sf_dir, "ast_data").groupBy("file_id").agg(F.max("parser").alias("parser"))
    return (
        judged.join(parser, "file_id", "left")
        .groupBy("repository", "language")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.count_if("invalid").alias("invalid_files"),
            F.count_if(F.col("invalid") & F.col("parser").isNotNull()).alias("invalid_with_parser"),
        )
        .withColumn("share", F.col("invalid_files") / F.col("files"))
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbour_pairs(read(spark, sf_dir, "chunk_vectors"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = docs.documented(read(spark, sf_dir, "function_defs"), current_files(spark, sf_dir))
    return pairs.where("informative").select("function_id").distinct()


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and description of each function whose documentation says something."""
    pairs = docs.documented(read(spark, sf_dir, "function_defs"), current_files(spark, sf_dir))
    return pairs.where("informative AND code IS NOT NULL").select("function_id", "code", "doc").dropDuplicates(["function_id"])


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bpe.spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", bpe.ids_of(F.col("text")).alias("ids"))


def _sizes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs_ = bpe.spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs_.select("doc_id", bpe.count_of(F.col("text")).alias("tokens")), read(spark, sf_dir, "pack_limits")


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(*_sizes(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per limit: containers used, those of plain best fit, the least that the tokens need, and the share of room used."""
    sizes, limits = _sizes(spark, sf_dir)
    sizes = cut(sizes)
    return packing.fill(packing.packed(sizes, limits), limits, packing.seeds(sizes, limits))


def p8_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bpe.spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return lookalike.unified(docs).select("doc_id", "form")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_look(bpe.spread(read(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_handwritten": p1_handwritten,
        "p2_found": p2_found,
        "p2_masked": p2_masked,
        "p3_found": p3_found,
        "p3_repairs": p3_repairs,
        "p3_rates": p3_rates,
        "p4_found": p4_found,
        "p5_found": p5_found,
        "p5_pairs": p5_pairs,
        "p6_ids": p6_ids,
        "p7_packing": p7_packing,
        "p7_fill": p7_fill,
        "p8_unified": p8_unified,
        "p8_found": p8_found,
    }


def oracle_sql() -> dict[str, str]:
    """Nothing here has an SQL twin: the operators are tested against brute force, round trips and fixtures."""
    return {}
