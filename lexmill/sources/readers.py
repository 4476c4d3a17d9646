"""Files to DataFrames: archives, plain texts, term tables, event logs. Oversized or broken input becomes an error row."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.functions.arrow import column
from lexmill.functions.prose import text_chapters
from lexmill.sources import charset, epub

# Size limits of uploads in bytes and of a term table in rows.
MAX_EPUB, MAX_TEXT, MAX_CSV, MAX_ROWS = 50 * 1024 * 1024, 20 * 1024 * 1024, 10 * 1024 * 1024, 100_000
_CHAPTERS = "path string, title string, author string, error string, idx int, title_source string, content_source string"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of binary files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def epub_chapters(archives: DataFrame, hints: tuple[str, ...] = ()) -> DataFrame:
    """archives: path, content. One row per chapter, or one with error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                stem = path.rpartition("/")[2].rpartition(".")[0] or path
                book = {"title": stem, "author": None, "chapters": [], "error": "too large"} if raw is None or len(raw) > MAX_EPUB else epub.read(raw, stem, hints)
                for c in book["chapters"] or [{"idx": None, "title": None, "content": None}]:
                    rows.append((path, book["title"], book["author"], book["error"], c["idx"], c["title"], c["content"]))
            out = pd.DataFrame(rows, columns=["path", "title", "author", "error", "idx", "title_source", "content_source"])
            yield out.astype({"idx": "Int32"})

    return archives.select("path", "content").mapInPandas(run, _CHAPTERS)


def decoded(raw: F.Column, markup: bool = False, hints: tuple[str, ...] = ()) -> F.Column:
    """Bytes as text by the charset rules."""
    return column(lambda b: charset.decode(b, markup, hints), "string")(raw)


def split_text(text: F.Column, fallback: F.Column) -> F.Column:
    """Chapters of a plain text as array<struct<title, content>>."""
    f = column(lambda t, name: [{"title": a, "content": b} for a, b in text_chapters(t, name or "")], "array<struct<title:string,content:string>>")
    return f(text, fallback)


def text_file_chapters(texts: DataFrame, hints: tuple[str, ...] = ()) -> DataFrame:
    """texts: path, content (bytes). (path, error, idx, title_source, content_source)."""
    small = texts.where(F.length("content") <= MAX_TEXT).withColumn("text", decoded(F.col("content"), hints=hints))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    parts = small.select("path", split_text(F.col("text"), stem).alias("parts"))
    rows = parts.select("path", F.when(F.size("parts") == 0, "empty").alias("error"), F.posexplode_outer("parts").alias("idx", "c"))
    rows = rows.select("path", "error", "idx", F.col("c.title").alias("title_source"), F.col("c.content").alias("content_source"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("idx", "int"), ("title_source", "string"), ("content_source", "string"))]
    return rows.unionByName(texts.where(F.length("content") > MAX_TEXT).select("path", F.lit("too large").alias("error"), *none))


def csv_rows(line: F.Column) -> F.Column:
    """Fields of one CSV record as array<string>; null where a quote is not closed."""
    import csv

    def one(s: str) -> list[str] | None:
        if s.count('"') % 2:
            return None
        return next(csv.reader([s]), [])

    return column(one, "array<string>")(line)


def term_rows(table: DataFrame, *keep: str) -> DataFrame:
    """Terms of an imported table: either generation of headers, trimmed, without rows that lack a side; user-curated. keep: further columns."""
    names = {c.strip().lower(): c for c in table.columns}
    get = lambda *keys: F.coalesce(*(F.col(f"`{names[k]}`") for k in keys if k in names), F.lit(None).cast("string"))
    tags = X.hashtags(get("description"))
    extra = F.filter(tags, lambda t: ~t.isin("#masculine", "#male", "#feminine", "#female", "#neuter"))
    aliases = F.filter(F.transform(F.split(F.coalesce(get("aliases"), F.lit("")), r"\|"), F.trim), lambda a: a != "")
    rows = table.select(
        *keep, F.trim(get("source", "raw")).alias("source"), F.trim(get("target", "translation")).alias("target"), X.gender(tags).alias("gender"),
        F.nullif(F.regexp_replace(get("context"), r"^\s+|\s+$", ""), F.lit("")).alias("context"), F.nullif(F.array_join(extra, " "), F.lit("")).alias("tags"),
        F.nullif(F.lower(F.trim(get("category"))), F.lit("")).alias("category"), X.truthy(get("pinned")).alias("pinned"),
        F.when(F.size(aliases) > 0, aliases).alias("aliases"), F.lit("user").alias("status"),
    )
    cleaned = rows.withColumns({c: F.regexp_replace(c, r"^\s+|\s+$", "") for c in ("source", "target")})
    return cleaned.where("source <> '' AND target <> ''")


def term_files(spark: SparkSession, path: str, *keep: str, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Terms of CSV files with a header; files with a quote left open, or of more than max_rows rows in all, are refused. Ragged rows are kept."""
    table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    quotes = spark.read.text(path).groupBy(F.input_file_name().alias("file")).agg(F.sum(F.regexp_count("value", F.lit('"'))).alias("n"))
    if quotes.where("n % 2 = 1").limit(1).count():
        raise ValueError("a quote is not closed")
    if max_rows is not None and table.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return term_rows(table, *keep)


def term_table(terms: DataFrame, *keep: str) -> DataFrame:
    """Terms as a table to export: formula signs disarmed, gender and tags in one column, aliases joined. keep: further columns."""
    sex = F.when(F.col("gender").isin("masculine", "feminine"), F.concat(F.lit("#"), "gender"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return terms.select(
        *keep, X.csv_safe(F.col("source")).alias("source"), X.csv_safe(F.col("target")).alias("target"), X.csv_safe(text(F.col("context"))).alias("context"),
        text(F.col("category")).alias("category"), F.when(F.col("pinned"), "true").otherwise("").alias("pinned"),
        X.csv_safe(text(F.array_join("aliases", " | "))).alias("aliases"), X.csv_safe(F.concat_ws(" ", sex, "tags")).alias("description"),
    )


def sse_events(log: F.Column) -> F.Column:
    """Events of a server-sent log as array<string>: per complete block its first data line, if that is valid JSON."""

    def events(s: str) -> list[str]:
        out = []
        for block in s.split("\n\n")[:-1]:
            data = next((x[5:].strip() for x in block.split("\n") if x.startswith("data:")), "")
            try:
                json.loads(data)
            except ValueError:
                continue
            out.append(data)
        return out

    return column(events, "array<string>")(log)
