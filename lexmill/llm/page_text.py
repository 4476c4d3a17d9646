"""Lines of web chapters: story, page boilerplate (problem 7) and template residue or error text (problem 5).

Pass one decides every line by rules on length, stop-word density and link density and by how widely the same line (digits
and request ids masked) recurs on its site and over all books. Short lines that no rule decides inherit the label of the
nearest decided line of their chapter, of two equally near ones that of the line before (a list stands under its heading).

Residue is found by several kinds of evidence together. Detectors: holes of templates and status lines (hole). Low information:
lines that repeat one unit, long lines without any function word, wording of known notices (low). Host evidence: a line that
recurs over books or in many chapters, and the chapters that hold it have next to no prose beside it (response). A text is
residue if it has no line of story and a hole, a low line, or a response while the terms of its title and address are nowhere
in it. A title is residue if it is a hole or a known notice, or if it recurs over books, its terms are not in the texts under
it, and an uncommon share of those texts is residue.

A chapter is one row throughout: its text becomes arrays of line hashes and rule bits in one Arrow pass, Spark counts the
hashes per site and book, and a vectorised pass over those arrays labels all lines of a batch at once.

Labels: S story, P page, R residue, Q response; a small letter where the label was inherited. Null or empty texts have no
lines; rows without an id are left out, repeated rows of one id count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.web import site
from lexmill.llm.site_lines import MIN_DOCS, MIN_SHARE
from lexmill.runtime import BROADCAST_ROWS, small, stage

#: Share of all books from which a line that is no story line counts as widespread, and the least number of books.
WIDE_SHARE = 0.004
WIDE_BOOKS = 8
#: Lines without a closing mark up to this length stay undecided unless they read like prose.
SHORT = 90
#: The most characters of an item of a list.
ITEM_CHARS = 180
#: Share of a line in addresses and entries of menus from which it is one of links, and the most characters of such an entry.
LINK_DENSITY = 0.2
ENTRY_CHARS = 20
#: A line is a response if the prose of the chapters that hold it is at most this share of what chapters have on average.
RESPONSE_INFO = 0.2
#: A title is residue by evidence if it stands over so many texts of residue, these are this share of its chapters, and at most TITLE_FITS of the texts fit it.
TITLE_CHAPTERS = 3
TITLE_RESIDUE = 0.3
TITLE_FITS = 0.35

# How servers write a status.
STATUS = (r"\d{3}", r"(?:error )?\d{3}(?: [a-z]+){1,4}", r"error \d+", r"gateway/[\d.]+")
# Wording of notices of servers, blockers and scripts, and filler, in the languages of the library.
MESSAGES = (
    r"not found", r"page not found", r"bad gateway",
    r"just a moment\.*", r"access denied\.?", r"forbidden", r"untitled(?: document)?", r"todo(?: title)?", r"null", r"undefined", r"nan", r"none",
    r"(?:\w+ ){0,6}(?:enable|turn on) javascript.*", r".*checking (?:that you are human|your browser).*", r"too many requests.*",
    r"error establishing a (?:connection to the database|database connection)\.?", r"the page you (?:asked for|requested|are looking for).*",
    r"lorem ipsum.*", r"service (?:temporarily )?unavailable.*", r"\[object object\]",
    r"页面不存在", r"頁面不存在", r"您(?:访问的页面|訪問的頁面)不存在.*", r"返回首[页頁]", r"标题待补", r"標題待補", r"内容待补充|內容待補充",
    r".*(?:需要启用|需要啟用) JavaScript .*", r"访问过于频繁.*", r"訪問過於頻繁.*", r"请求编号 \w+", r"請求編號 \w+",
    r"系统维护中.*", r"系統維護中.*", r"此章节为付费章节.*", r"此章節為付費章節.*", r"章节内容正在手打中.*", r"章節內容正在手打中.*",
    r"ページが見つかりません", r"お探しのページは.*", r"このページを表示するには.*有効にしてください。?", r"ただいまメンテナンス中です.*",
    r"\d* ?サービスが一時的に利用できません", r"要求番号 \w+",
    r"アクセスが(?:集中|拒否).*", r"(?:無題|タイトル未設定|タイトルを入力してください)",
    r"(?:요청하신 )?페이지를 찾을 수 없습니다", r"주소를 다시 확인해 주세요", r"이 페이지를 보려면 자바스크립트를 켜 주세요\.?",
    r"서버 점검 중입니다.*", r"접속이 차단되었습니다", r"요청 번호 \w+", r"제목을 입력하세요", r"제목 없음",
)
# How template languages write a hole.
PLACEHOLDERS = (
    r"\{\{[^}]*\}\}", r"\{%.*?%\}", r"<%.*?%>", r"\$\{[^}]*\}", r"%%[A-Z_]+%%", r"%[a-z_]+%", r"\[\[[A-Z_ ]+\]\]", r"\[[A-Z]+(?:_[A-Z]+)+\]",
    r"__[A-Z]+(?:_[A-Z]+)*__", r"\{(?-i:[a-z_]+)\}", r"%[ds]",
)
# A chapter number before a title.
_NUMBER = re.compile(
    r"^\s*(?:第\s*(?:\d+|[一二三四五六七八九十百千零〇兩两]+)\s*[章話话回節节]|제\s*\d+\s*[화장]|\d+\s*화|chapter\s+\d+|ch\.\s*\d+|\d+\s*[.、:：\-–])\s*[:：.\-–—]?\s*", re.I
)
# Frequent function words or characters; their share of a line is its stop-word density.
_STOPS = re.compile(
    r"[的了在是不有和就也都把被說说著着過过這这那他她它與与到從从はがをにのとでもたて]|(?:은|는|이|가|을|를|에|다|의|로|도)(?=[\s.!?,\"]|$)|\b(?:the|of|and|to|a|in|was|that|had|with|at|not|for|on)\b", re.I
)
# Marks that end a sentence, and those that may follow one.
TERMINAL, CLOSING, OPENING = "。！？!?….．", "”’\"'」』）)]】", "\"'“‘([{<《「『"
_INNER = re.compile(r"[。！？!?…](?=.)|\.[”\"]? (?=[A-ZÀ-Þ가-힣])")
_COMMA = re.compile("[，、,]")
_LINKISH = re.compile(r"https?:|www\.|\bm\.|[|｜·»›＞>«←→©]")
_ADDRESS = re.compile(r"(?:https?://|www\.|\bm\.(?=[\w\-]+\.))\S+")
_ENTRIES = re.compile("[|｜·»›＞>]")
_ARROW = re.compile(r"^(?:←|<<|«|© )|(?:→|>>|»)$")
#: A label and a colon, a number in brackets or between blanks near the beginning, columns.
_ITEM = re.compile(r"^\d{1,3}[.．] ?\S|^[^「『“\"，。]{1,40}[：:] ?[^「『“\"]*$|^\D{1,24}[（(][^()（）\d]{0,8}\d+[）)]|^\S+\s+\d+[^\d\s]\s|\S\u3000\S")
_GARBLED = re.compile("[\x80-\x9f\ufffd\ue000-\uf8ff]|[\xa0-\xff]{3,}")
_LATIN = re.compile(r"^(?:[A-Z][a-z\-]+(?: [a-z\-]+){4,}[.,] ?)+$")
#: One unit again and again: a sentence at least twice, or something shorter six times.
_PERIODIC = re.compile(r"(.{5,}?)[\s。.!！…、,]*(?:\1[\s。.!！…、,]*)+$|(.{1,4}?)(?:\2){2,}$", re.S)
_MESSAGE = re.compile(r"(?:" + "|".join(MESSAGES) + r")$", re.I | re.S)
_STATUS = re.compile(r"(?:" + "|".join(STATUS) + r")$", re.I)
_HOLE = re.compile("|".join(PLACEHOLDERS), re.I)
#: Radicals stand for letters, though they count as symbols.
_LETTERLIKE = re.compile("[\u2e80-\u2fdf]")
_CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
_QUOTES = ("「」", "『』", "“”")
_NO_LETTER = re.compile(r"[\W\d_]")
_NUMERALS = "0123456789"
_DIGITS = re.compile(f"[{_NUMERALS}]+")
_IDS = re.compile(r"\b[0-9a-f]{8,}\b")
_TERM = re.compile("[\u30a0-\u30ff\u3400-\u9fff]+|[A-Za-zÀ-ÖØ-öø-ÿ]{4,}|[가-힣]{2,}")
# Unicode white space and the byte order mark.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

T_CLOSED, T_PROSE, T_LINKS, T_ITEM, T_HOLE, T_GARBLED, T_LOW = 1, 2, 4, 8, 16, 32, 64


def trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def hole(t: str) -> bool:
    """Whether a trimmed line or title is a status, or holes of a template with few words around."""
    if _STATUS.match(t):
        return True
    if "{" in t or "%" in t or "[" in t or "__" in t:
        rest, holes = _HOLE.subn("", t)
        return holes > 0 and len(_NO_LETTER.sub("", rest)) <= 24
    return False


def low(t: str) -> bool:
    """Whether a trimmed line says next to nothing: one unit repeated, invented Latin without a function word, a known notice."""
    again = t.find(t[:5], 5) > 0 or t.find(t[:1], 1, 5) > 0  # what a repeated unit needs
    if again and len(t) >= 6 and _PERIODIC.match(t) and any(c.isalnum() for c in t):
        return True
    return _MESSAGE.match(t) is not None or t.isascii() and _LATIN.match(t) is not None and _STOPS.search(t) is None


def own_title(title: str | None) -> str:
    """What a title says beside the number of its chapter."""
    return _NUMBER.sub("", (title or "").strip(SPACES))


def residue_title(title: str | None) -> bool:
    """Whether a title by itself is residue, with or without a chapter number before it."""
    t = (title or "").strip(SPACES)
    if not t:
        return False
    own = own_title(title)
    return hole(t) or low(t) or bool(own) and own != t and not own.isdigit() and (hole(own) or low(own))


def terms(title: str | None, address: str | None = None) -> set[str]:
    """What a text under this title and address should speak of: words, word heads and pairs of characters."""
    slug = re.sub(r"[?#].*|\.\w+$", "", address or "").rsplit("/", 1)[-1]
    out: set[str] = set()
    for t in _TERM.findall(f"{own_title(title)} {slug}"):
        if t.isascii() or t[0] < "\u0250":
            out.add(t.lower())
        elif "가" <= t[0] <= "힣":
            out.add(t[:2])
        else:
            out.update(map(str.__add__, t, t[1:]))
    return out


def link_density(t: str) -> float:
    """Share of a trimmed line in addresses and entries of a menu; a line that is one arrowed link is all link."""
    if not _LINKISH.search(t):
        return 0.0
    if _ARROW.search(t):
        return 1.0
    entries = _ENTRIES.split(t)
    linked = sum(len(e) for e in entries if len(e.strip()) <= ENTRY_CHARS) if len(entries) > 2 else 0
    return (linked or sum(map(len, _ADDRESS.findall(t)))) / len(t)


def closed_end(t: str) -> bool:
    return t.rstrip(CLOSING)[-1:] in TERMINAL if t else False


def hashed(s: str) -> int:
    h = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def masked(t: str) -> str:
    return _DIGITS.sub("#", _IDS.sub("0", t)) if _DIGITS.search(t) else t


def rules(t: str) -> tuple[int, int]:
    """(hash with digits and request ids masked, rule bits) of a trimmed line."""
    n, bits = len(t), 0
    end = t.rstrip(CLOSING)
    closed = bool(end) and end[-1] in TERMINAL
    if not t.isascii() and _GARBLED.search(t):
        bits |= T_GARBLED
    if link_density(t) >= LINK_DENSITY:
        bits |= T_LINKS
    if hole(t):
        bits |= T_HOLE
    elif low(t):
        bits |= T_LOW
    if closed:
        if n >= 10 or _STOPS.search(t):
            bits |= T_CLOSED
    else:
        if n <= ITEM_CHARS and _ITEM.search(t):
            bits |= T_ITEM
        if n > SHORT or _INNER.search(t) or _COMMA.search(t) and len(_STOPS.findall(t)) >= 0.04 * n:
            bits |= T_PROSE
    return hashed(masked(t)), bits


def bare(word: str) -> str:
    """A word without opening marks, every number as a nought."""
    return _DIGITS.sub("0", word.lstrip(OPENING))


def line_end(t: str) -> str:
    """How a trimmed line ends: script, quotations left open and closing marks (its shape), then a tab and its last token.

    The token is what stands after the last blank without opening marks, or, where a script has no blanks, the last two characters; a number is a nought.
    """
    at = len(t)
    while at and not (t[at - 1].isalnum() or _LETTERLIKE.match(t[at - 1]) or unicodedata.combining(t[at - 1])):
        at -= 1
    if not t.isascii() and _CJK.search(t):
        kind, token = "c", _DIGITS.sub("0", t[-2:]) if not t[-1].isdecimal() else t.rstrip(_NUMERALS)[-1:] + "0"
    else:
        kind, token = "h" if "가" <= t[at - 1 : at] <= "힣" else "l", bare(t.rsplit(None, 1)[-1])
    left = ""
    for x, y in _QUOTES:
        if x in t and t.count(x) > t.count(y):
            left += x
    if '"' in t and t.count('"') % 2:
        left += '"'
    return f"{kind} {left} {t[at:]}\t{token}"


def _ruled(with_ends: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int, str]] = {}
        for batch in batches:
            numbers, hashes, bits, ends, targets, info, keys, shared = [], [], [], [], [], [], [], []
            titles, urls = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for text, title, url in zip(batch.column(2).to_pylist(), titles, urls, strict=True):
                no, hs, bs, es, prose = [], [], [], [], 0
                for k, line in enumerate((text or "").split("\n"), 1):
                    t = line.strip(SPACES)
                    if t:
                        got = known.get(t)
                        if got is None:
                            got = (*rules(t), line_end(t) if with_ends else "")
                            if len(t) <= SHORT:
                                if len(known) > 20_000:
                                    known.clear()
                                known[t] = got
                        no.append(k)
                        hs.append(got[0])
                        bs.append(got[1])
                        if got[1] & (T_CLOSED | T_PROSE) and not got[1] & (T_LOW | T_HOLE | T_LINKS):
                            prose += len(t)
                        if with_ends:
                            es.append(got[2])
                numbers.append(no)
                hashes.append(hs)
                bits.append(bs)
                ends.append(es)
                info.append(prose)
                own = own_title(title)
                keys.append(hashed(masked(own)) if any(c.isalpha() for c in own) else None)
                body = (text or "").lower()
                shared.append(any(t in body for t in terms(title, url)))
            columns = [
                batch.column(0), batch.column(1), pa.array([residue_title(t) for t in titles]), pa.array(keys, pa.int64()), pa.array(shared, pa.bool_()), pa.array(info, pa.int32()),
                pa.array(numbers, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int32())),
            ]
            names = ["id", "book_id", "title_residue", "title_key", "shared", "info", "numbers", "hashes", "bits"]
            if with_ends:
                for text in batch.column(5).to_pylist():
                    targets.append([line_end(t) for x in (text or "").split("\n") if (t := x.strip(SPACES))])
                columns += [pa.array(ends, pa.list_(pa.string())), pa.array(targets, pa.list_(pa.string()))]
                columns += [f(batch.column(k)) for k in (2, 5) for f in (pc.utf8_length, pc.binary_length)]
                names += ["ends", "target_ends", "n_source", "b_source", "n_target", "b_target"]
            yield pa.record_batch(columns, names)

    return run


#: shared: a term of the title or address stands in the text; info: characters of its lines of prose.
_RULED = "id long, book_id string, title_residue boolean, title_key long, shared boolean, info int, numbers array<int>, hashes array<long>, bits array<int>"
#: line_end of every non-empty line of both texts, and the lengths of the texts in characters and bytes.
_ENDS = "ends array<string>, target_ends array<string>, n_source int, b_source int, n_target int, b_target int"


def chapter_lines(chapters: DataFrame, books: DataFrame, with_ends: bool = False) -> DataFrame:
    """One row per chapter: (id, book_id, web, site, *_RULED) of its non-empty lines, and _ENDS."""
    kept = small(
        books.select(F.col("id").alias("book_id"), (F.col("source_type") == "web").alias("web"), site(F.col("source_url")).alias("site")).dropDuplicates(["book_id"])
    )
    more = ["content_target"] if with_ends else []
    rows = chapters.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "book_id", "content_source", "title_source", "chapter_url", *more)
    rows = rows.mapInArrow(_ruled(with_ends), f"{_RULED}, {_ENDS}" if with_ends else _RULED)
    rest = [c for c in rows.columns if c not in ("id", "book_id")]
    joined = rows.dropDuplicates(["id"]).join(kept, "book_id", "left")
    return joined.select("id", "book_id", F.coalesce("web", F.lit(False)).alias("web"), "site", *rest)


def widespread(lines: DataFrame) -> DataFrame:
    """(h, often, wide, response): lines frequent on some site, in so many books that no story repeats them, or of chapters that hold little else."""
    keyed = lines.select(F.xxhash64("site").alias("s"), F.col("site").isNotNull().alias("hosted"), F.xxhash64("book_id").alias("b"), "info", "hashes")
    each = keyed.select("s", "hosted", "b", "info", F.explode(F.array_distinct("hashes")).alias("h")).groupBy("h", "s", "hosted", "b").agg(F.count("*").alias("n"), F.sum("info").alias("info"))
    per_site = each.groupBy("h", "s", "hosted").agg(F.sum("n").alias("n"), F.count("*").alias("books"), F.sum("info").alias("info"))
    docs = keyed.where("hosted").groupBy("s").agg(F.count("*").alias("docs"), F.count_distinct("b").alias("all_books"))
    total, info = lines.agg(F.count_distinct("book_id"), F.avg("info")).first()  # one row
    rate = per_site.join(small(stage(docs)), "s", "left")
    often = F.col("hosted") & ((F.col("n") >= F.greatest(F.lit(MIN_DOCS), F.col("docs") * MIN_SHARE)) | ((F.col("n") >= 3) & (F.col("books") >= F.greatest(F.lit(4), F.col("all_books") * 0.2))))
    n, books = F.sum("n"), F.sum("books")
    return (
        rate.groupBy("h").agg(
            F.coalesce(F.bool_or(often), F.lit(False)).alias("often"), (books >= max(WIDE_BOOKS, (total or 0) * WIDE_SHARE)).alias("wide"),
            (((books > 1) | (n >= MIN_DOCS)) & (n > 1) & (F.sum("info") / n <= RESPONSE_INFO * (info or 0.0))).alias("response"),
        ).where("often OR wide OR response")
    )


def label_batch(sizes: np.ndarray, bits: np.ndarray, web: np.ndarray, often: np.ndarray, wide: np.ndarray, response: np.ndarray) -> np.ndarray:
    """Labels of the lines of many chapters laid end to end (sizes: lines of each), as bytes."""
    on = lambda bit: (bits & bit) != 0
    web_line, chapter = np.repeat(web, sizes), np.repeat(np.arange(len(sizes)), sizes)
    lacking = on(T_LOW) & ~(web_line & (often | wide))
    label = np.select(
        [on(T_HOLE), lacking, response, ~web_line, often | wide, on(T_GARBLED), on(T_LINKS), on(T_CLOSED), on(T_ITEM), on(T_PROSE)],
        [ord(c) for c in "R?QSPSPSPS"], 0,
    ).astype(np.int64)
    told = np.bincount(chapter[label == ord("S")], minlength=len(sizes)) > 0
    # a line that says little is residue only where nothing else tells a story
    label = np.where(label == ord("?"), np.where(told[chapter], ord("S"), ord("R")), label)
    n = len(label)
    at = np.arange(n)
    first, last = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.cumsum(sizes) - 1, sizes)
    before = np.maximum.accumulate(np.where(label > 0, at, -1)) if n else at
    after = np.minimum.accumulate(np.where(label > 0, at, n)[::-1])[::-1] if n else at
    has_before, has_after = before >= first, after <= last
    near = np.where(has_before & (~has_after | (at - before <= after - at)), before, np.where(has_after, after, -1))
    got = np.where(near >= 0, label[np.maximum(near, 0)] if n else label, ord("S"))
    return np.where(label > 0, label, np.where(got == ord("S"), ord("s"), ord("p"))).astype(np.uint8)


_KEPT = ["id", "book_id", "web", "site", "title_residue", "title_key", "shared", "numbers"]
_LABELLED = "id long, book_id string, web boolean, site string, title_residue boolean, title_key long, shared boolean, numbers array<int>, labels string"


def _labeller(data):
    """data: broadcast sorted hashes with their flags, or None where each row brings its own in columns often and wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bits = batch.column(8), batch.column(9)
            sizes = np.diff(hashes.offsets.to_numpy())
            h, b = hashes.flatten().to_numpy(zero_copy_only=False), bits.flatten().to_numpy(zero_copy_only=False)
            if data is not None:
                keys, flags = data.value
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), dtype=bool)
                flag = np.where(hit, flags[at], 0) if len(keys) else np.zeros(len(h), dtype=np.int64)
            else:
                flag = np.zeros(len(h), dtype=np.int64)
                start = 0
                for size, own in zip(sizes, batch.column(10).to_pylist(), strict=True):
                    if own:
                        table = {x["h"]: x["often"] * 1 + x["wide"] * 2 + x["response"] * 4 for x in own}
                        flag[start : start + size] = [table.get(x, 0) for x in h[start : start + size].tolist()]
                    start += size
            web = np.array(batch.column(2).to_pylist(), dtype=bool)
            text = label_batch(sizes, b, web, (flag & 1) > 0, (flag & 2) > 0, (flag & 4) > 0).tobytes().decode("ascii")
            ends = np.cumsum(sizes)
            labels = [text[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.record_batch([*(batch.column(k) for k in range(8)), pa.array(labels, pa.string())], [*_KEPT, "labels"])

    return run


def labelled(lines: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The staged chapter_lines with labels, one letter for each line."""
    known = stage(widespread(lines))
    columns = [*_KEPT, "hashes", "bits"]
    if known.limit(most + 1).count() <= most:
        rows = sorted((r.h, int(r.often) + 2 * int(r.wide) + 4 * int(r.response)) for r in known.collect())
        data = lines.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)))
        return lines.select(*columns).mapInArrow(_labeller(data), _LABELLED)
    own = lines.select("id", F.explode(F.array_distinct("hashes")).alias("h")).join(known, "h")
    own = own.groupBy("id").agg(F.collect_list(F.struct("h", "often", "wide", "response")).alias("known"))
    return lines.select(*columns).join(own, "id", "left").select(*columns, "known").mapInArrow(_labeller(None), _LABELLED)


def _is_residue() -> Column:
    """No decided story line; a residue line, or a response to which title and address do not fit, or whose title is residue too."""
    labels = F.col("labels")
    return ~labels.contains("S") & (labels.contains("R") | labels.contains("Q") & (~F.col("shared") | F.col("title_residue")))


def residue_content(labels: DataFrame) -> DataFrame:
    """Ids of chapters whose text is residue."""
    return labels.where(_is_residue()).select("id")


def residue_titles(labels: DataFrame) -> DataFrame:
    """Keys of titles that recur over books, do not fit the texts under them, and stand over texts of residue uncommonly often."""
    bad, fits = F.count_if(_is_residue()), F.count_if(F.col("shared") & ~_is_residue())
    n, books = F.count("*"), F.count_distinct("book_id")
    return labels.where("title_key IS NOT NULL").groupBy("title_key").agg(
        ((books > 1) & (bad >= TITLE_CHAPTERS) & (bad >= TITLE_RESIDUE * n) & (fits <= TITLE_FITS * n)).alias("bad_title")
    ).where("bad_title")


def residue_fields(labels: DataFrame) -> DataFrame:
    """(chapter_id, field) of titles and texts that are template residue or error messages."""
    labels = labels.join(small(stage(residue_titles(labels))), "title_key", "left")
    title = F.col("title_residue") | F.coalesce("bad_title", F.lit(False))
    fields = F.array(F.when(title, F.lit("title_source")), F.when(_is_residue(), F.lit("content_source")))
    return labels.select(F.col("id").alias("chapter_id"), F.explode(F.array_compact(fields)).alias("field"))


def page_lines(labels: DataFrame) -> DataFrame:
    """(chapter_id, line_no) of the lines of web chapters that are no story; chapters of residue have none."""
    other = F.expr("filter(transform(numbers, (n, i) -> if(upper(substr(labels, i + 1, 1)) = 'S', null, n)), n -> n IS NOT NULL)")
    return labels.where(F.col("web") & ~_is_residue()).select(F.col("id").alias("chapter_id"), F.explode(other).alias("line_no"))


def story_end(labels: DataFrame) -> DataFrame:
    """(id, site, at): index of the last story line of every chapter that has one."""
    at = F.length("labels") - F.instr(F.reverse(F.upper("labels")), "S")
    return labels.where(F.upper("labels").contains("S")).select("id", "site", at.alias("at"))


def main_text(chapters: DataFrame, found: DataFrame) -> DataFrame:
    """(chapter_id, content_source) with the found page lines (chapter_id, line_no) taken out."""
    gone = found.groupBy("chapter_id").agg(F.collect_set("line_no").alias("gone"))
    rest = F.expr("array_join(filter(split(content_source, '\\n', -1), (x, i) -> NOT array_contains(gone, i + 1)), '\\n')")
    one = chapters.where("id IS NOT NULL").select(F.col("id").cast("long").alias("chapter_id"), "content_source").dropDuplicates(["chapter_id"])
    return one.join(gone, "chapter_id", "left").select("chapter_id", F.when(F.col("gone").isNull(), F.col("content_source")).otherwise(rest).alias("content_source"))
