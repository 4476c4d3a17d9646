"""Long exact spans shared between records (problem 10).

Every window of min_len code points that may stand in two texts gets a Rabin-Karp hash, and Spark counts the windows. Which
may: of every NEIGHBOURS successive shorter windows of WINDOW code points the one of least hash is kept, so texts that share
min_len = WINDOW + NEIGHBOURS - 1 code points keep one of the same stretch; only the min_len-windows around kept windows seen
in two texts are hashed, no other can be shared.

The texts that hold one repeated window form a class. Classes are told apart by their number of texts, their least id and
a combined hash of their ids, never by a list of them, so a window in a third of all texts is one row per text. All windows
of a stretch shared by the same texts make one class. Repeated windows of a text merge into maximal intervals. Exact copies are
represented by one text. Only sharing_pairs, whose result is stated in pairs, expands classes into pairs.

Null or short texts (below min_len) share nothing and never appear, nor do rows without an id. Rows repeated with the same id count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.rolling import chunks, codes, joined, signed, windows, winnow
from lexmill.runtime import small, stage

MIN_LEN = 200
WINDOW = 120
_KEPT = "id long, pos int, h long"
_WINDOWS = "id long, pos int, h long, first boolean"


def _kept(window: int, neighbours: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for i, j in chunks(texts):
                c, offsets = joined(texts[i:j])
                owner, pos, h = winnow(c, offsets, window, neighbours)
                if len(owner):
                    yield pa.record_batch([pa.array(ids[i:j][owner]), pa.array(pos.astype(np.int32)), signed(h)], ["id", "pos", "h"])

    return run


def _around(size: int, window: int):
    """Hashes of all windows of size around the given places of kept windows; first: the first of equal ones in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = np.arange(-(size - window), 1)
        for batch in batches:
            for ident, text, places in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                c = codes(text)
                at = np.unique((np.array(places)[:, None] + reach[None, :]).ravel())
                at = at[(at >= 0) & (at <= len(c) - size)]
                if len(at):
                    h = windows(c, size)[at]
                    first = np.zeros(len(h), dtype=bool)
                    first[np.unique(h, return_index=True)[1]] = True
                    yield pa.record_batch([pa.array(np.full(len(at), ident)), pa.array(at.astype(np.int32)), signed(h), pa.array(first)], ["id", "pos", "h", "first"])

    return run


def copy_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Members of classes of equal texts with more than one member: (id, rep, n, size), rep the least id, n the length, size the members."""
    keyed = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.md5(text_col).alias("k"), F.length(text_col).alias("n")).distinct()
    reps = keyed.groupBy("k", "n").agg(F.min("id").alias("rep"), F.count("*").alias("size")).where("size > 1")
    return keyed.join(reps, ["k", "n"]).select("id", "rep", "n", "size")


def repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(found, copies), both staged: the windows of min_len that stand in two different texts or more, and copy_classes.

    found: id (one of every copy class), pos, rep (least id with the window), n_docs (ids with it), sign (combined hash of the ids).
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where((F.length("text") >= min_len) & F.col("id").isNotNull())
    copies = stage(copy_classes(docs, "id", "text"))
    docs = docs.join(small(copies.where("id <> rep").select("id")), "id", "left_anti")
    kept = stage(docs.mapInArrow(_kept(window, min_len - window + 1), _KEPT))
    again = kept.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h")
    hits = stage(kept.join(again, "h").groupBy("id").agg(F.collect_set("pos").alias("places")))
    texts = docs.join(small(hits.select("id")), "id", "left_semi").dropDuplicates(["id"]).join(hits, "id").select("id", "text", "places")
    every = stage(texts.mapInArrow(_around(min_len, window), _WINDOWS))
    weight = small(copies.where("id = rep").select("id", "size"))
    firsts = every.where("first").join(weight, "id", "left").select("id", "h", F.coalesce("size", F.lit(1)).alias("size"))
    counted = firsts.groupBy("h").agg(F.min("id").alias("rep"), F.max("id").alias("hi"), F.sum("size").alias("n_docs"), F.bit_xor(F.xxhash64("id")).alias("sign")).where("rep < hi")
    return stage(every.join(counted, "h").select("id", "pos", "rep", "n_docs", "sign")), copies


def memberships(found: DataFrame, copies: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """(doc_id, rep_id, n_docs), one row for each class of a document: the least document that holds the same window, and how many do."""
    own = found.groupBy("id").agg(F.count_distinct("pos").alias("shared"))
    # windows that only the copies of one text hold
    rest = copies.join(own, "id", "left").join(own.toDF("rep", "rep_shared"), "rep", "left").where(F.coalesce("rep_shared", F.lit(0)) < F.col("n") - min_len + 1)
    classes = found.select("id", "rep", "n_docs").distinct()
    members = copies.where("id <> rep").select("id", F.col("rep").alias("like"))
    doubles = members.join(classes.withColumnRenamed("id", "like"), "like").select("id", "rep", "n_docs")
    every = classes.unionByName(doubles).unionByName(rest.select("id", "rep", F.col("size").alias("n_docs")))
    return every.select(F.col("id").alias("doc_id"), F.col("rep").alias("rep_id"), F.col("n_docs").cast("long").alias("n_docs")).distinct()


def sharing_pairs(found: DataFrame, copies: DataFrame) -> DataFrame:
    """All pairs of ids (a < b) that share a window, members of copy classes included."""
    classes = stage(found.select("rep", "n_docs", "sign", "id").distinct())
    key = ["rep", "n_docs", "sign"]
    pairs = classes.withColumnRenamed("id", "id_a").join(classes.withColumnRenamed("id", "id_b"), key).where("id_a < id_b").select("id_a", "id_b").distinct()
    members = copies.select("rep", "id")
    for side in ("id_a", "id_b"):
        other = members.toDF(side, "member")
        pairs = pairs.join(other, side, "left").withColumn(side, F.coalesce("member", side)).drop("member")
    left, right = members.toDF("rep", "id_a"), members.toDF("rep", "id_b")
    pairs = pairs.unionByName(left.join(right, "rep").where("id_a < id_b").select("id_a", "id_b"))
    return pairs.select(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b")).distinct()


def shared_share(found: DataFrame, copies: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """Per record the number of its code points that stand verbatim in another record: (doc_id, shared_chars, n_spans).

    The repeated windows of a text merge into maximal intervals. A member of a copy class is shared whole.
    """
    merged = found.groupBy("id").agg(F.sort_array(F.collect_set("pos")).alias("v")).select(
        "id",
        F.expr(
            f"aggregate(v, named_struct('n', 0, 'k', 0, 'end', -1), (acc, x) -> named_struct("
            f"'n', acc.n + {min_len} - greatest(0, acc.end - x), 'k', acc.k + if(x > acc.end, 1, 0), 'end', x + {min_len}))"
        ).alias("r"),
    )
    part = merged.select("id", F.col("r.n").alias("shared_chars"), F.col("r.k").alias("n_spans"))
    whole = copies.select("id", F.col("n").alias("shared_chars"), F.lit(1).alias("n_spans"))
    return whole.unionByName(part.join(copies, "id", "left_anti")).withColumnRenamed("id", "doc_id")
