"""Evaluation passages inside training documents (problem 9), by a positional inverted index.

Texts are reduced to lower-case letters and digits. A term is a run of TERM such characters; a posting is (term, document,
position, the term before it, the term after it). A run of 2 * TERM characters of a test passage is two neighbouring terms,
so an exact phrase is found by intersecting the two offset-adjusted lists. The rarer term of the two leads: only its
postings are stored, and the neighbour kept in the posting decides the intersection.

Where a passage was edited, no long run is left. A proximity match is two or more of the successive terms of a passage (those at
multiples of TERM) next to each other in one document, in their order and within NEAR letters and digits: the positional lists
of these terms are merged with the offsets left free.

The test vocabulary is sent to the executors while its counted size stays within MAX_TERMS; a larger test set is worked off
in several blocks of items, each against all documents. Null or short texts and passages (below 2 * TERM characters) match
nothing, nor do rows without an id; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.rolling import chunks, joined, signed, windows
from lexmill.runtime import stage

TERM = 25
#: Letters and digits between the beginnings of two terms of a proximity match.
NEAR = 400
#: Terms of one block of test items (8 bytes each).
MAX_TERMS = 2_000_000
_BITS = 22
_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower-case form and whether that is a letter or digit."""
    if not _TABLES:
        lower, kept = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, dtype=bool)
        for c in range(0x110000):
            s = chr(c).lower()
            if len(s) == 1:
                lower[c] = ord(s)
            kept[c] = chr(c).isalnum()
        _TABLES.extend((lower, kept))
    return _TABLES[0], _TABLES[1]


def reduced(c: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the letters and digits of the joined texts, lower case, with the offsets moved along."""
    lower, kept = _tables()
    keep = kept[c]
    return lower[c[keep]], np.concatenate(([0], np.cumsum(keep)))[offsets]


def _terms(texts: list[str | None], term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term hashes at every position, owner of each, whether the term lies in one text, offsets)."""
    c, offsets = reduced(*joined(texts))
    h = windows(c, term)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = len(h)
    return h, owner[:n], owner[:n] == owner[term - 1 : term - 1 + n], offsets


class _Vocabulary:
    """Membership of 64-bit terms: a bit table first, a binary search for what passes it."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms)
        self.table = np.zeros(1 << _BITS, dtype=bool)
        self.table[(self.terms >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def positions(self, h: np.ndarray, whole: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - _BITS)).astype(np.int64)] & whole)
        if not len(at) or not len(self.terms):
            return at[:0]
        found = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        return at[self.terms[found] == h[at]]


def _frequency(data, term: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary(np.frombuffer(data.value, dtype=np.uint64))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in chunks(texts):
                h, _, whole, _ = _terms(texts[i:j], term)
                t, n = np.unique(h[vocabulary.positions(h, whole)], return_counts=True)
                if len(t):
                    yield pa.record_batch([signed(t), pa.array(n)], ["term", "n"])

    return run


def _postings(data, term: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary(np.frombuffer(data.value, dtype=np.uint64))
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for i, j in chunks(texts):
                h, owner, whole, offsets = _terms(texts[i:j], term)
                at = vocabulary.positions(h, whole)
                if not len(at):
                    continue
                before, after = np.maximum(at - term, 0), np.minimum(at + term, len(h) - 1)
                has = ((at - term >= 0) & (owner[before] == owner[at])), ((at + term < len(h)) & (owner[after] == owner[at]) & whole[after])
                yield pa.record_batch(
                    [
                        signed(h[at]), pa.array(ids[i:j][owner[at]]), pa.array((at - offsets[owner[at]]).astype(np.int32)),
                        pa.array(h[before].view(np.int64), mask=~has[0]), pa.array(h[after].view(np.int64), mask=~has[1]),
                    ],
                    ["term", "doc_id", "pos", "before", "after"],
                )

    return run


def _item_terms(term: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for i, j in chunks(texts):
                h, owner, whole, offsets = _terms(texts[i:j], term)
                at = np.flatnonzero(whole)
                yield pa.record_batch(
                    [signed(h[at]), pa.array(ids[i:j][owner[at]]), pa.array((at - offsets[owner[at]]).astype(np.int32))],
                    ["term", "item_id", "pos"],
                )

    return run


def _collected(terms: DataFrame) -> np.ndarray:
    """Distinct terms of one block, at most about MAX_TERMS."""
    return terms.select("term").distinct().toArrow().column("term").to_numpy()


def _listed(items: DataFrame, term: int, block_terms: int, every: int = 1) -> list[DataFrame]:
    """(term, item_id, pos) of the items, at every so many positions, in blocks of whole items."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "passage").where("passage IS NOT NULL AND item_id IS NOT NULL").distinct()
    listed = stage(items.mapInArrow(_item_terms(term), "term long, item_id long, pos int").where(F.col("pos") % every == 0))
    blocks = max(1, -(-listed.count() // block_terms))
    return [listed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) for b in range(blocks)]


def proximity_matches(docs: DataFrame, items: DataFrame, term: int = TERM, near: int = NEAR, block_terms: int = MAX_TERMS) -> DataFrame:
    """(doc_id, item_id, n_terms): documents in which one of the successive terms of a passage is followed by a later one near it.

    n_terms: how many of the passage's terms stand near another one. Exact phrases of 3 * term - 1 are among the matches.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    parts = []
    for own in _listed(items, term, block_terms, term):
        words = docs.sparkSession.sparkContext.broadcast(_collected(own).tobytes())
        index = docs.mapInArrow(_postings(words, term), "term long, doc_id long, pos int, before long, after long").select("term", "doc_id", F.col("pos").alias("at"))
        terms = own.groupBy("item_id", "term").agg(F.min("pos").alias("pos"))  # a term that a passage repeats counts where it stands first
        met = index.join(terms, "term").select("doc_id", "item_id", "at", "pos").distinct()
        order = Window.partitionBy("doc_id", "item_id").orderBy("at")
        pairs = met.withColumns({"at0": F.lag("at").over(order), "pos0": F.lag("pos").over(order)}).where((F.col("pos") > F.col("pos0")) & (F.col("at") - F.col("at0")).between(term, near))
        parts.append(pairs.select("doc_id", "item_id", F.explode(F.array("pos0", "pos")).alias("pos")))
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(F.count_distinct("pos").cast("int").alias("n_terms"))


def phrase_matches(docs: DataFrame, items: DataFrame, term: int = TERM, block_terms: int = MAX_TERMS, places: bool = True) -> DataFrame:
    """Every place where 2 * term successive letters and digits of a passage stand in a document.

    docs: doc_id, text; items: item_id, passage. Result: doc_id, item_id, doc_pos, item_pos (in letters and digits).
    Without places only doc_id and item_id, each posting and anchor counted once however often a text repeats itself.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    parts = []
    for own in _listed(items, term, block_terms):
        left, right = own.toDF("lead", "item_id", "pos"), own.select(F.col("term").alias("next"), "item_id", (F.col("pos") - term).alias("pos"))
        pairs = left.join(right, ["item_id", "pos"]).select("item_id", "pos", "lead", "next")
        words = _collected(own)
        counts = docs.mapInArrow(_frequency(spark.sparkContext.broadcast(words.tobytes()), term), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        counts = stage(counts)
        found = pairs.join(counts.toDF("lead", "n_lead"), "lead").join(counts.toDF("next", "n_next"), "next")
        forward = F.col("n_lead") <= F.col("n_next")
        anchors = stage(
            found.select(
                "item_id", "pos", F.when(forward, F.col("lead")).otherwise(F.col("next")).alias("term"),
                F.when(forward, F.col("next")).otherwise(F.col("lead")).alias("partner"), forward.alias("forward"),
            )
        )
        if not places:
            anchors = anchors.select("item_id", "term", "partner", "forward").distinct()
        rare = _collected(anchors)
        index = docs.mapInArrow(
            _postings(spark.sparkContext.broadcast(rare.tobytes()), term), "term long, doc_id long, pos int, before long, after long"
        )
        index = index.withColumnRenamed("pos", "at") if places else index.select("term", "doc_id", "before", "after").distinct()
        met = index.join(anchors, "term")
        met = met.where(F.when(F.col("forward"), F.col("after")).otherwise(F.col("before")) == F.col("partner"))
        if not places:
            parts.append(met.select("doc_id", "item_id"))
            continue
        parts.append(met.select("doc_id", "item_id", (F.col("at") - F.when(F.col("forward"), 0).otherwise(term)).alias("doc_pos"), F.col("pos").alias("item_pos")))
    return reduce(DataFrame.unionByName, parts)


def leaks(docs: DataFrame, items: DataFrame, term: int = TERM) -> DataFrame:
    """(doc_id, item_id): documents that hold at least 2 * term successive letters and digits of the passage."""
    return phrase_matches(docs, items, term, places=False).distinct()
