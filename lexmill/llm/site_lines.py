"""Lines repeated across one site's documents (problem 2).

Each text is cut into content-defined chunks: a rolling hash over CUT_WINDOW code points ends a chunk wherever it falls
into one of 2**CUT_BITS residues. The hash starts anew after a line feed, because the result is stated by line: a line is a
whole number of chunks, a chunk knows whether it begins or ends one, and the chunks of equal lines are equal. Spark counts the distinct documents per (site, chunk). A line
that is one chunk is repeated if its chunk is. Of the longer lines those whose chunks are all frequent remain; frequent chunks may
be put together anew in every document, so the documents of these chains of chunks are counted once more.

A frequent chunk or line of a large site meets its documents by broadcast up to a counted bound, beyond it in SALTS parts.

Lines are compared after trimming Unicode white space and replacing every run of ASCII digits by one mark; empty lines never
count. Null text has no lines, documents without a site (null url) belong to none, rows
without an id are left out, repeated rows of one id count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.rolling import chunks, codes, mix, prefix, spans, windows
from lexmill.functions.web import site
from lexmill.runtime import BROADCAST_ROWS, small, stage

MIN_DOCS = 5
MIN_SHARE = 0.1
CUT_WINDOW = 6
CUT_BITS = 4
_DIGITS = re.compile("[0-9]+")
_LF = 10


def _cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the numbers and hashes of its non-empty lines, and the chunks with the index of their line."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for i, j in chunks(texts):
            masked = []
            for t in texts[i:j]:
                if t is None:
                    masked.append([])
                else:
                    masked.append([x.strip() for x in _DIGITS.sub("\x00", t).split("\n")])
            flat = [x for doc in masked for x in doc]
            c = codes("\n".join(flat) + "\n")
            line = np.zeros(len(c), dtype=np.int64)
            feeds = np.flatnonzero(c == _LF)
            line[feeds[:-1] + 1] = 1
            line = np.cumsum(line)
            h = windows(c, CUT_WINDOW)
            ends = c == _LF
            inner = np.flatnonzero((h & np.uint64((1 << CUT_BITS) - 1)) == 0) + CUT_WINDOW - 1
            inner = inner[line[inner] == line[inner - CUT_WINDOW + 1]]
            cut = ends.copy()
            cut[inner[inner + 1 < len(c)] + 1] = True  # a chunk ends before the next code point
            edge = np.flatnonzero(cut)
            p = prefix(c)
            starts = np.concatenate(([0], np.where(ends[edge], edge + 1, edge)[:-1]))
            full = edge > starts
            starts, edge = starts[full], edge[full]
            # where a chunk begins or ends a line belongs to its content
            side = (np.concatenate(([True], c[:-1] == _LF))[starts].astype(np.uint64) << np.uint64(1)) | ends[edge].astype(np.uint64)
            h_chunk, of = mix(spans(p, starts, edge) + side), line[starts]
            begin = np.concatenate(([0], feeds[:-1] + 1))
            h_line, filled = spans(p, begin, feeds), feeds > begin
            first = np.concatenate(([0], np.cumsum([len(doc) for doc in masked])))
            kept_before = np.concatenate(([0], np.cumsum(filled)))
            chunk_at = np.searchsorted(of, first)
            per_line = np.bincount(of, minlength=len(filled))
            numbers, line_hashes, counts, chunk_hashes, chunk_lines = [], [], [], [], []
            for d in range(j - i):
                a, b = first[d], first[d + 1]
                on = filled[a:b]
                numbers.append((np.flatnonzero(on) + 1).astype(np.int32))
                line_hashes.append(h_line[a:b][on].view(np.int64))
                counts.append(per_line[a:b][on].astype(np.int32))
                x, y = chunk_at[d], chunk_at[d + 1]
                chunk_hashes.append(h_chunk[x:y].view(np.int64))
                chunk_lines.append((kept_before[of[x:y]] - kept_before[a]).astype(np.int32))
            part = batch.slice(i, j - i)
            yield pa.record_batch(
                [
                    part.column(0), part.column(1), pa.array(numbers, pa.list_(pa.int32())), pa.array(line_hashes, pa.list_(pa.int64())),
                    pa.array(counts, pa.list_(pa.int32())), pa.array(chunk_hashes, pa.list_(pa.int64())), pa.array(chunk_lines, pa.list_(pa.int32())),
                ],
                ["id", "site", "numbers", "lines", "counts", "chunks", "chunk_line"],
            )


_CUT = "id long, site string, numbers array<int>, lines array<long>, counts array<int>, chunks array<long>, chunk_line array<int>"


def with_site(chapters: DataFrame, books: DataFrame, *columns: str) -> DataFrame:
    """(id, site, *columns) of the chapters whose book has a site."""
    hosts = books.select(F.col("id").alias("book_id"), site(F.col("source_url")).alias("site")).where(F.col("site").isNotNull()).dropDuplicates(["book_id"])
    return chapters.where("id IS NOT NULL").select("id", "book_id", *columns).join(small(hosts), "book_id").select(F.col("id").cast("long").alias("id"), "site", *columns)


SALTS = 32


def _meet(texts: DataFrame, keys: DataFrame, on: list[str], most: int = BROADCAST_ROWS) -> DataFrame:
    """texts (with a column id) joined with a staged table of distinct keys; no key's texts meet in one task as a whole."""
    if keys.limit(most + 1).count() <= most:
        return texts.join(F.broadcast(keys), on)
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return texts.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def site_lines(
    docs: DataFrame, text_col: str = "content_source", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, most: int = BROADCAST_ROWS
) -> DataFrame:
    """docs: id, site, text. Every occurrence of a repeated line: (site, id, line_no, line_hash)."""
    cut = stage(docs.where(F.col("site").isNotNull()).select("id", "site", text_col).mapInArrow(_cut_lines, _CUT).dropDuplicates(["id"]))
    need = cut.groupBy("site").agg(F.greatest(F.lit(min_docs), F.ceil(F.count("*") * F.lit(min_share) - F.lit(1e-9))).alias("need"))
    need = small(stage(need))
    often = (
        cut.select("site", F.explode(F.array_distinct("chunks")).alias("chunk")).groupBy("site", "chunk").agg(F.count("*").alias("n"))
        .join(need, "site").where("n >= need").select("site", "chunk")
    )
    # position k of a line within its document stands for the line until it is kept
    each = cut.select("id", "site", F.explode(F.arrays_zip("chunks", "chunk_line")).alias("x")).select("id", "site", F.col("x.chunks").alias("chunk"), F.col("x.chunk_line").alias("k"))
    hot = _meet(each, stage(often), ["site", "chunk"], most).groupBy("id", "k").agg(F.count("*").alias("hot"))
    hot = hot.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "hot"))).alias("hot"))
    whole = cut.join(hot, "id").select(
        "id", "site",
        F.explode(F.expr(
            "filter(transform(lines, (h, i) -> named_struct('line_no', numbers[i], 'line_hash', h, "
            "'hot', coalesce(hot[i], 0L), 'all', counts[i])), x -> x.hot = x.all)"
        )).alias("x"),
    ).select("id", "site", "x.line_no", "x.line_hash", (F.col("x.all") == 1).alias("one"))
    whole = stage(whole)
    chains = whole.where("NOT one")
    counted = chains.groupBy("site", "line_hash").agg(F.count_distinct("id").alias("n")).join(need, "site").where("n >= need").select("site", "line_hash")
    columns = ["site", "id", "line_no", "line_hash"]
    return whole.where("one").select(*columns).unionByName(_meet(chains, stage(counted), ["site", "line_hash"], most).select(*columns))


def listed(docs: DataFrame, found: DataFrame, text_col: str = "content_source") -> DataFrame:
    """(site, line, n_chapters, n_lines): every repeated line once, as it stands in the first document that holds it."""
    each = found.groupBy("site", "line_hash").agg(
        F.count_distinct("id").alias("n_chapters"), F.count("*").alias("n_lines"), F.min(F.struct("id", "line_no")).alias("first")
    )
    texts = docs.join(small(stage(each.select("first.id").distinct())), "id", "left_semi")
    line = F.regexp_replace(F.element_at(F.split(text_col, "\n", -1), F.col("first.line_no")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return each.withColumn("id", F.col("first.id")).join(texts, "id").select("site", line.alias("line"), "n_chapters", "n_lines")


def without_lines(docs: DataFrame, found: DataFrame, text_col: str = "content_source") -> DataFrame:
    """The texts of docs (id, text) without the found lines (id, line_no); a text without such lines stays as it is."""
    gone = found.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    rest = F.expr(f"array_join(filter(split({text_col}, '\\n', -1), (x, i) -> NOT array_contains(gone, i + 1)), '\\n')")
    kept = docs.join(gone, "id", "left")
    return kept.withColumn(text_col, F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(rest)).drop("gone")
