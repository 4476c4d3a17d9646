"""Text decoded with the wrong character encoding (problem 6).

1. Inventory: per language the characters that occur in at least CLEAN_SHARE of its values are clean, and so are those that
   compatibility normalization maps to clean ones.
2. Words of the clean corpus: in scripts with blanks every word with a letter outside ASCII, else, where nothing parts words,
   every character and every pair of neighbours; all of them, however rare. Every distinct word is written in each true
   encoding and read in each wrong one (all chains, double UTF-8 included): the table (form, chain, original).
3. The tokens of values that hold unclean characters are hash-joined with the table. A hit names a chain and brings an original.
4. Pieces of a value are replaced by the originals of its hits, the longest form first, if these give the piece when garbled
   again; pieces with words that the table lacks are turned back along the chains of the hits. A piece counts if it consists
   of clean characters only.
   Replacement characters, C1 controls and private-use characters are traces of a wrong decoding that lost text; such a value
   is affected even where so much was lost that no word of it is in the table.

All texts are read twice (counts, tokens), those of the affected values once more. The character sets sent to executors are
bounded by Unicode. Null values are clean; rows without an id are left out, repeated rows of one id count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.rolling import chunks, joined
from lexmill.runtime import BROADCAST_ROWS, small, stage

CLEAN_SHARE = 0.003
MIN_CLEAN = 3
#: The same for what Western code pages show for the bytes of other encodings, which most wrong decodings share.
CLEAN_SHARE_WESTERN = 0.03
#: Characters a piece must have to prove a chain between two double-byte encodings.
PROOF = 4
_LOST = re.compile("[\ufffd\x80-\x9f\ue000-\uf8ff]")
_LEGACY = ("gb18030", "big5", "cp932", "euc_jp", "cp949")
#: (true encoding, wrong encoding); w1252 is Windows-1252 with undefined bytes read as Latin-1, 2x is UTF-8 read twice.
CHAINS: tuple[tuple[str, str], ...] = (
    *((true, wrong) for true in ("utf-8", *_LEGACY) for wrong in ("w1252", "latin-1")),
    ("2x", "latin-1"), ("2x", "w1252"),
    *(("utf-8", wrong) for wrong in _LEGACY),
    *((true, wrong) for true in _LEGACY for wrong in _LEGACY if true != wrong),
)


@lru_cache(maxsize=1)
def _w1252() -> tuple[dict[int, str], dict[int, int]]:
    """Latin-1 to Windows-1252 where they differ, and back."""
    chars = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256)]
    return {b: c for b, c in enumerate(chars) if ord(c) != b}, {ord(c): b for b, c in enumerate(chars) if ord(c) != b}


def _read(raw: bytes, encoding: str, errors: str = "strict") -> str:
    return raw.decode("latin-1").translate(_w1252()[0]) if encoding == "w1252" else raw.decode(encoding, errors)


def _write(text: str, encoding: str) -> bytes:
    return text.translate(_w1252()[1]).encode("latin-1") if encoding == "w1252" else text.encode(encoding)


def garble(text: str, chain: tuple[str, str], errors: str = "strict") -> str:
    """What becomes of text when it is written in the true and read in the wrong encoding."""
    true, wrong = chain
    if true == "2x":
        return _read(_read(text.encode("utf-8"), wrong).encode("utf-8"), wrong)
    return _read(_write(text, true), wrong, errors)


def ungarble(text: str, chain: tuple[str, str]) -> str:
    """The inverse of garble; raises UnicodeError where there is none."""
    true, wrong = chain
    if true == "2x":
        return _write(_write(text, wrong).decode("utf-8"), wrong).decode("utf-8")
    return _read(_write(text, wrong), true)


_SPACED = re.compile("[^\\W_\u2e80-\ua4cf\uf900-\ufaff\uff00-\uffef]*[^\\W_\\x00-\\x7f\u2e80-\ua4cf\uf900-\ufaff\uff00-\uffef][^\\W_\u2e80-\ua4cf\uf900-\ufaff\uff00-\uffef]*")
_SPACED_HIGH = re.compile("[^\\W_\\x00-\\x7f\u2e80-\ua4cf\uf900-\ufaff\uff00-\uffef]")
_COUNTS = "lang string, k long, word string, n long"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of a language with a character (k: the character), places of a pair of neighbours (k: both) and of a word (k: -1)."""
    high = np.ones(0x110000, dtype=bool)
    high[:128] = False
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        seen: dict[str, Counter[str]] = {}
        words: Counter[str] = Counter()
        for lang, text in zip(langs, texts, strict=True):
            if text and not text.isascii():
                seen.setdefault(lang or "", Counter()).update(set(text))
                if _SPACED_HIGH.search(text):
                    words.update(_SPACED.findall(text))
        for i, j in chunks(texts):
            c, _ = joined(texts[i:j])
            both = high[c[:-1]] & high[c[1:]]
            k, n = np.unique((c[:-1][both].astype(np.int64) << 21) | c[1:][both], return_counts=True)
            if len(k):
                yield pa.record_batch([pa.nulls(len(k), pa.string()), pa.array(k), pa.nulls(len(k), pa.string()), pa.array(n)], ["lang", "k", "word", "n"])
        rows = [(lang, ord(c), None, n) for lang, counts in seen.items() for c, n in counts.items() if c > "\x7f"]
        rows += [(None, -1, w, n) for w, n in words.items()]
        if rows:
            yield pa.record_batch([pa.array([r[x] for r in rows], t) for x, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], ["lang", "k", "word", "n"])


def clean_sets(inventory: list, values: dict[str, int]) -> dict[str, set[str]]:
    """Per language the clean characters, from (lang, c, n) and the number of values."""
    out: dict[str, set[str]] = {lang: set() for lang in values}
    western = {c for b in range(0x80, 0x100) for c in (chr(b), bytes([b]).decode("cp1252", "ignore")) if c} - set("‘’“”–—…·×—")
    for lang, c, n in inventory:
        if n >= max(MIN_CLEAN, (CLEAN_SHARE_WESTERN if c in western else CLEAN_SHARE) * values[lang]) and not _LOST.match(c):
            out[lang].add(c)
    for lang, c, _ in inventory:  # dirt of other kinds: other forms of clean characters, ignorable and combining ones
        plain = unicodedata.normalize("NFKC", c)
        if all(p in out[lang] or p <= "\x7f" or unicodedata.category(p) in ("Cf", "Mn", "Zs") for p in plain) and not _LOST.match(c):
            out[lang].add(c)
    return out


def forms(words: list[str], pairs: bool = False) -> Iterator[tuple[int, list[str]]]:
    """(number of a chain, garbled form of every word): "" where a word has none. Words hold no line feed and no question mark.

    pairs: words are pairs of neighbours, needed only where the bytes of neighbours fall into one character.
    """
    text = "\n".join(words)
    for at, (true, wrong) in enumerate(CHAINS):
        # UTF-8 read as a double-byte encoding: the last bytes of a word run into what follows, the rest still names it
        joins = true == "utf-8" and wrong in _LEGACY
        if pairs and not joins:
            continue
        raw = text.encode("utf-8" if true == "2x" else true, "replace")
        for _ in range(2 if true == "2x" else 1):
            was = raw
            read = _read(raw, wrong, "replace")
            raw = read.encode("utf-8") if true == "2x" else was
        out = read.split("\n")
        if len(out) != len(words):  # a byte of a wide character read as a line feed: word by word
            out = [_form(w, CHAINS[at], joins) for w in words]
        yield at, [f.rstrip("\ufffd") if joins else "" if "\ufffd" in f or "?" in f else f for f in out]


def _form(word: str, chain: tuple[str, str], joins: bool) -> str:
    try:
        return garble(word, chain, "replace" if joins else "strict")
    except UnicodeError:
        return ""


def _forms(sets, asked=None):
    """asked: broadcast tokens, the only forms to give; None gives all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = asked.value if asked is not None else None
        clean = set().union(*sets.value.values()) if sets.value else set()
        known, high = clean | {chr(c) for c in range(128)}, {c for c in clean if c > "\x7f"}
        for batch in batches:
            keys, words = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            pairs = [chr(k >> 21) + chr(k & 0x1FFFFF) for k in keys[keys >> 21 > 0].tolist()]
            others = [chr(k) if w is None else w for k, w in zip(keys.tolist(), words, strict=True) if w is not None or 0 <= k < 1 << 21]
            for of_pairs, own in ((True, pairs), (False, others)):
                own = [w for w in own if known.issuperset(w) and "\n" not in w and "?" not in w]
                for at, garbled in forms(own, of_pairs) if own else ():
                    rows = [(f, w) for f, w in zip(garbled, own, strict=True) if f and f != w and (wanted is None or f in wanted) and not high.issuperset(f)]
                    yield pa.record_batch([pa.array([f for f, _ in rows], pa.string()), pa.array([at] * len(rows), pa.int32()), pa.array([w for _, w in rows], pa.string())], ["form", "chain", "original"])

    return run


#: Lengths of the garbled forms of characters and pairs. Only UTF-8 read twice makes forms longer than SHORT, and these all
#: begin with the character that is the first byte of two: the UTF-8 of a Latin letter.
SHORT, LONG, LEAD = (1, 2, 3), (4, 5, 6, 7, 8), "\xc3"
_RUN = re.compile("[^\x00-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f\u3000-\u3002\uff01-\uff0f]+")


def _tokens(sets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean = {lang: s | {chr(c) for c in range(128)} for lang, s in sets.value.items()}
        none: set[str] = set()
        for batch in batches:
            key, lost, tokens = [], [], []
            for lang, text, k in zip(*(batch.column(x).to_pylist() for x in range(3)), strict=True):
                if not text:
                    continue
                bad = set(text) - clean.get(lang or "", none)
                if not bad:
                    continue
                own = set()
                for line in text.split("\n"):
                    at = [p for p, c in enumerate(line) if c in bad]
                    for p in at:
                        for n in SHORT:
                            own.update(line[q : q + n] for q in range(max(0, p - n + 1), p + 1))
                        own.update(line[p : p + n] for n in (LONG if line[p] == LEAD else LONG[:1]))
                    if at:
                        own.update(w for w in _RUN.findall(line) if not bad.isdisjoint(w))
                key.append(k)
                lost.append(bool(_LOST.search(text)))
                tokens.append(list(own))
            if key:
                yield pa.record_batch([pa.array(key), pa.array(lost), pa.array(tokens, pa.list_(pa.string()))], ["key", "lost", "tokens"])

    return run


_PIECES = re.compile(r"([\s，。、：；？！…「」『』\x20-\x7e]+)")
_HIGH = re.compile(r"[^\x00-\x7f]+")


Hits = dict[tuple[str, str], dict[str, str]]


@lru_cache(maxsize=64)
def _allowed(clean: frozenset[str]) -> frozenset[str]:
    return clean | {chr(c) for c in range(32, 128)} | {"\n", "\t"}


def substituted(piece: str, originals: dict[str, str]) -> str:
    """piece with every known form replaced by its original, the longest form first; what is no form stays."""
    out, at, most = [], 0, max(map(len, originals), default=0)
    while at < len(piece):
        for n in range(min(most, len(piece) - at), 0, -1):
            was = originals.get(piece[at : at + n])
            if was is not None:
                out.append(was)
                at += n
                break
        else:
            out.append(piece[at])
            at += 1
    return "".join(out)


def restore(text: str, hits: Hits, clean: set[str] | frozenset[str]) -> tuple[str, int, int]:
    """(text with all garbled places that can be verified turned back, places turned back, places still unclean).

    hits: by chain, the chain of most hits first, the originals of the forms found in the text.
    """
    fine = _allowed(frozenset(clean)).issuperset
    proven: set[tuple[str, str]] = set()
    covered = {chain: set().union(*originals) for chain, originals in hits.items()}

    def back(piece: str) -> str | None:
        if "\ufffd" in piece:  # something is lost for good
            return None
        bad = {c for c in piece if not fine(c)}
        for chain, originals in hits.items():
            was = None
            try:
                if bad <= covered[chain]:
                    was = substituted(piece, originals)
                if was is None or not fine(was) or garble(was, chain) != piece:
                    was = ungarble(piece, chain)  # it holds words that the table lacks
            except UnicodeError:
                try:
                    was = ungarble(piece, chain)
                except UnicodeError:
                    continue
            if was == piece:
                continue
            if fine(was) and was.strip():
                # between two double-byte encodings single characters turn into others by chance
                if chain[0] not in _LEGACY or chain[1] not in _LEGACY or chain in proven:
                    return was
                if sum(c > "\x7f" for c in was) >= PROOF:
                    proven.add(chain)
                    return was
        return None

    if any(true in _LEGACY and wrong in _LEGACY for true, wrong in hits):
        for line in text.split("\n"):  # a first look for the chains that longer pieces prove
            for piece in () if fine(line) else _PIECES.split(line):
                if not fine(piece):
                    back(piece)
    out, turned, left = [], 0, 0
    for line in text.split("\n"):
        if fine(line):
            out.append(line)
            continue
        whole = back(line)
        if whole is not None:
            out.append(whole)
            turned += 1
            continue
        for split in (_PIECES, None):
            parts = split.split(line) if split else re.split(f"({_HIGH.pattern})", line)
            fixed = [p if fine(p) else back(p) for p in parts]
            if any(f is not None and f != p for f, p in zip(fixed, parts, strict=True)):
                line = "".join(p if f is None else f for f, p in zip(fixed, parts, strict=True))
                turned += 1
                break
        left += not fine(line)
        out.append(line)
    return "\n".join(out), turned, left


def _restored(sets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_sets = {lang: frozenset(s) for lang, s in sets.value.items()}
        for batch in batches:
            rows = []
            lists = batch.column(4)
            parts = [lists.flatten().field(k).to_pylist() for k in range(3)]  # the lists end to end
            sizes = [n or 0 for n in pc.list_value_length(lists).to_pylist()]
            at = 0
            for lang, text, key, lost, size in zip(*(batch.column(x).to_pylist() for x in range(4)), sizes, strict=True):
                by_chain: dict[int, dict[str, str]] = {}
                for k in range(at, at + size):
                    own = by_chain.setdefault(parts[0][k], {})
                    form, original = parts[1][k], parts[2][k]
                    own[form] = min(own.get(form, original), original)
                at += size
                hits = {CHAINS[c]: by_chain[c] for c in sorted(by_chain, key=lambda c: (-len(by_chain[c]), c))}
                was, turned, left = restore(text, hits, own_sets.get(lang or "", frozenset()))
                if lost or turned:
                    rows.append((key, was if turned else None, bool(turned) and not left))
            if rows:
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_()))], ["key", "restored", "whole"])

    return run


def library_fields(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """(lang, text, key) of chapters.content_source, chapters.title_source and books.title; key is tbl, field and id."""
    langs = small(books.select(F.col("id").alias("book_id"), F.col("source_lang").alias("lang")).dropDuplicates(["book_id"]))
    c = chapters.where("id IS NOT NULL").select("id", "book_id", "title_source", "content_source").join(langs, "book_id", "left")
    key = lambda tbl, field, rec: F.concat_ws("\t", F.lit(tbl), F.lit(field), rec.cast("string"))
    each = F.array(
        *(F.struct(F.col(f).alias("text"), key("chapters", f, F.col("id")).alias("key")) for f in ("title_source", "content_source"))
    )
    return c.select("lang", F.explode(each).alias("x")).select("lang", "x.text", "x.key").unionByName(
        books.where("id IS NOT NULL").select(F.col("source_lang").alias("lang"), F.col("title").alias("text"), key("books", "title", F.col("id")).alias("key"))
    )


def garbled_values(fields: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """fields: lang, text, key. (key, restored, whole) of the values with text in a wrong encoding.

    restored: the value with all verified places turned back, null where none could be; whole: nothing unclean is left.
    only: keys of the values to look at; the corpus and its words are those of all fields.
    """
    spark = fields.sparkSession
    fields = fields.where(F.length("text") > 0)
    values = {r[0] or "": r[1] for r in fields.groupBy("lang").agg(F.count("*")).collect()}  # a row per language
    counts = stage(fields.select("lang", "text").mapInArrow(_counts, _COUNTS).groupBy("lang", "k", "word").agg(F.sum("n").alias("n")))
    inventory = counts.where("lang IS NOT NULL").select("lang", "k", "n").collect()  # at most the characters of Unicode for each language
    sets = spark.sparkContext.broadcast(clean_sets([(lang, chr(k), n) for lang, k, n in inventory], values))
    asked = fields if only is None else fields.join(small(only), "key", "left_semi").select("lang", "text", "key")
    suspects = stage(asked.mapInArrow(_tokens(sets), "key string, lost boolean, tokens array<string>").dropDuplicates(["key"]))
    forms_of = suspects.select(F.explode("tokens").alias("form")).distinct()
    # few tokens go to the words, else the whole table meets the tokens
    few_forms = [r.form for r in forms_of.limit(BROADCAST_ROWS + 1).collect()] if only is not None else None
    asked_forms = spark.sparkContext.broadcast(set(few_forms)) if few_forms is not None and len(few_forms) <= BROADCAST_ROWS else None
    table = counts.select("k", "word").distinct().mapInArrow(_forms(sets, asked_forms), "form string, chain int, original string")
    hits = suspects.select("key", F.explode("tokens").alias("form")).join(table, "form").groupBy("key").agg(F.collect_set(F.struct("chain", "form", "original")).alias("hits"))
    chosen = stage(suspects.select("key", "lost").join(hits, "key", "left").where("lost OR hits IS NOT NULL"))
    few = asked.join(small(chosen.select("key")), "key", "left_semi").dropDuplicates(["key"])  # only keys may be broadcast
    texts = few.join(chosen, "key").select("lang", "text", "key", "lost", "hits")
    return texts.mapInArrow(_restored(sets), "key string, restored string, whole boolean")


def found(values: DataFrame) -> DataFrame:
    """(tbl, rec_id, field, restored, whole)."""
    part = F.split("key", "\t", 3)
    return values.select(part[0].alias("tbl"), part[2].alias("rec_id"), part[1].alias("field"), "restored", "whole")
