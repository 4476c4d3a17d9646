"""Queries pN_... of the training-data problems: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import alignment, leakage, lookalikes, mojibake, packing, page_text, shared_spans, site_lines, text_cuts
from lexmill.runtime import stage, table

Query = Callable[[SparkSession, str], DataFrame]


def _library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "chapters"), table(spark, sf_dir, "books")


def _look_alikes(spark: SparkSession, sf_dir: str) -> lookalikes.Model:
    texts = table(spark, sf_dir, "chapters").select("content_source").unionAll(table(spark, sf_dir, "glossary").select("source"))
    return lookalikes.train(texts)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.missed_matches(table(spark, sf_dir, "glossary"), table(spark, sf_dir, "chapters"), _look_alikes(spark, sf_dir))


def p1_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every glossary row with its source in the one consistent form."""
    rows = table(spark, sf_dir, "glossary").where("id IS NOT NULL").select("id", "source").dropDuplicates(["id"])
    return lookalikes.consistent(rows, "source", _look_alikes(spark, sf_dir)).withColumnRenamed("id", "glossary_id")


def p1_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter with its content_source in the one consistent form."""
    rows = table(spark, sf_dir, "chapters").where("id IS NOT NULL").select("id", "content_source").dropDuplicates(["id"])
    return lookalikes.consistent(rows, "content_source", _look_alikes(spark, sf_dir)).withColumnRenamed("id", "chapter_id")


def _site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.site_lines(site_lines.with_site(*_library(spark, sf_dir), "content_source"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _site_lines(spark, sf_dir).select(F.col("id").alias("chapter_id"), "line_no").distinct()


def p2_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per site its repeated lines (one form of each), the chapters each stands in and how often it stands there."""
    chapters, _ = _library(spark, sf_dir)
    docs = chapters.where("id IS NOT NULL").select("id", "content_source").dropDuplicates(["id"])
    return site_lines.listed(docs, stage(_site_lines(spark, sf_dir)))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter's content_source without the repeated lines of its site."""
    chapters, _ = _library(spark, sf_dir)
    docs = chapters.where("id IS NOT NULL").select("id", "content_source").dropDuplicates(["id"])
    return site_lines.without_lines(docs, _site_lines(spark, sf_dir)).withColumnRenamed("id", "chapter_id")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(page_text.labelled(stage(page_text.chapter_lines(*_library(spark, sf_dir)))))


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.found(mojibake.garbled_values(mojibake.library_fields(*_library(spark, sf_dir))))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = alignment.bilingual(*_library(spark, sf_dir))
    return alignment.aligned_sentences(docs)


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stage(page_text.chapter_lines(*_library(spark, sf_dir), with_ends=True))
    return text_cuts.cut_fields(*_library(spark, sf_dir), lines, stage(page_text.labelled(lines)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cuts(spark, sf_dir).select("chapter_id", "field").distinct()


def p3_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cut value with its evidence: word (the trie alone), limit (the length alone) or both."""
    return _cuts(spark, sf_dir).select("chapter_id", "field", "evidence").distinct()


def p3_site_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cut values per site and field."""
    return text_cuts.cut_share(*_library(spark, sf_dir), _cuts(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.residue_fields(_labels(spark, sf_dir))


def p5_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters without template residue in title or text: (chapter_id, book_id, seq)."""
    chapters = table(spark, sf_dir, "chapters").where("id IS NOT NULL").select(F.col("id").alias("chapter_id"), "book_id", "seq").dropDuplicates(["chapter_id"])
    return chapters.join(p5_found(spark, sf_dir), "chapter_id", "left_anti")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).select("tbl", "rec_id", "field")


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected values with every verified place turned back."""
    return _garbled(spark, sf_dir)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.page_lines(_labels(spark, sf_dir))


def p7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter's content_source, only the story's own lines."""
    return page_text.main_text(table(spark, sf_dir, "chapters"), p7_found(spark, sf_dir))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "bins"))


def p8_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class what was placed: documents, tokens, containers that overflow, and whole documents that were cut."""
    placed = stage(p8_containers(spark, sf_dir))
    over = placed.groupBy("bin_class", "container_id", "capacity_tokens").agg(F.sum("tokens").alias("t")).where("t > capacity_tokens").groupBy("bin_class").agg(F.count("*").alias("n_over"))
    pieces = placed.groupBy("bin_class", "doc_id", "capacity_tokens").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    out = pieces.groupBy("bin_class").agg(F.count("*").alias("n_docs"), F.sum("t").alias("n_tokens"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("n_cut"))
    return out.join(over, "bin_class", "left").select("bin_class", "n_docs", "n_tokens", F.coalesce("n_over", F.lit(0)).cast("long").alias("n_over"), "n_cut")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "bench_items"))


def p9_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked test item the number of documents that hold a passage of it."""
    return p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def p9_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with several terms of a passage in order and near each other, edits between them allowed."""
    return leakage.proximity_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "bench_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.sharing_pairs(*shared_spans.repeated_windows(table(spark, sf_dir, "documents")))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its classes: the least document that holds one of its stretches, and the number of documents that do."""
    return shared_spans.memberships(*shared_spans.repeated_windows(table(spark, sf_dir, "documents")))


def p10_shared_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of its characters that stand verbatim in another one."""
    return shared_spans.shared_share(*shared_spans.repeated_windows(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_glossary, p1_chapters, p4_found, p2_found, p2_site_lines, p2_clean, p3_found, p3_evidence, p3_site_share, p5_found, p5_library, p6_found, p6_restored, p7_found,
        p7_main_text, p8_containers, p8_placed, p9_found, p9_leaked_items, p9_proximity, p10_found, p10_classes, p10_shared_chars,
    )
}
