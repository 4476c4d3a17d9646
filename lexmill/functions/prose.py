"""Paragraph and sentence operators that scan a text once, as plain functions over one value."""

from __future__ import annotations

import json
import re

# Limits of paragraph joining and chunking, zero-width characters, sentence ends, labels of page controls.
JOIN_LIMIT = 2000
EXTRACT_LIMIT, EXTRACT_CHUNKS = 9000, 200
CHUNK_LIMIT, CHUNK_PARAGRAPHS = 12000, 80
LABEL_LIMIT = 36
_ZERO_WIDTH = re.compile("[\u200b-\u200d\u2060\ufeff]")
_SENTENCE_END = re.compile("[.!?…。！？‥\"'“”‘’」』）》〉)~～\\]]$")
# Labels of page controls, by what they do; a pair of tuples stands for every combination of the two.
_STEPS = ((("上一", "下一"), ("章", "页", "頁", "节", "節", "篇")), (("前一", "后一"), ("章", "页", "頁")))
_PAGE_LABELS = (
    "返回", "后退", "返回目录", "返回目錄", "返回页", "返回頁", "返回書页", "返回書頁", "返回顶部", "回到顶部", "目录", "目錄", "章节目录", "章节目錄",
    "prev", "previous", "back", "next", "index", "content", "contents", "toc", "table of contents",
    "字体", "大", "中", "小", "换手", "關燈", "关灯", "开灯", "繁體", "繁体", "簡體", "简体", "手机阅读", "手機閱讀",
    "存书签", "加入书签", "加入书籤", "加入书架", "書架", "书架", "收藏", "收藏书", "收藏書", "收藏本书", "收藏本書", "推荐书", "推荐書", "推荐本书", "推荐本書",
    "分享", "報錯", "报错",
)
_LABEL_PATTERNS = (
    r"章节错误.*", r".*点此举报.*", r"第\(\d+/\d+\)页", r"\d{1,4}\s*/\s*\d{1,4}", r"소설\s*내용을\s*불러오고\s*있습니다\.?", r"커버\s*접기", r"커버\s*펼치기",
    r"이전\s*화(?:\s*보기)?", r"다음\s*화(?:\s*보기)?", r"목록(?:\s*보기)?", r"목차", r"로딩\s*중\.*",
)
_LABEL = re.compile(
    "(?:" + "|".join([*map(re.escape, [x + y for xs, ys in _STEPS for x in xs for y in ys]), *map(re.escape, _PAGE_LABELS), *_LABEL_PATTERNS]) + ")$", re.I
)
#: White space at the ends of lines, the byte order mark included.
EDGES = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_PARA = re.compile(r"\n{2,}")
_WHITE = re.compile(r"\s+")
# Headings of chapters; a heading ends its line or a separator follows it.
_HEADINGS = (
    r"第\s*[0-9零一二三四五六七八九十百千万億兩两]+\s*[章節节回卷部篇集話话]", r"제\s*[0-9]+\s*[장화권부편]", r"Chapter\s+\d+", "序章", "楔子", "序言", "尾聲", "尾声", "後記", "后记",
    "番外", "閑話", "プロローグ", "エピローグ", "あとがき", "프롤로그", "에필로그", "외전",
)
_HEADING = re.compile(r"\s*(?:" + "|".join(_HEADINGS) + r")(?:[\s：:、.\-—].*)?$", re.I)
_MARKER_END = re.compile(r"[\s：:、.\-—]")


def units(s: str) -> int:
    """Length in UTF-16 units."""
    return len(s) + sum(c > "￿" for c in s)


def paragraphs(text: str) -> list[str]:
    return [p for p in (x.strip(EDGES) for x in _PARA.split(text)) if p]


def without_labels(text: str) -> str:
    """Paragraphs that are nothing but a short label of a page control are dropped."""
    keep = []
    for p in text.split("\n\n"):
        c = _WHITE.sub(" ", p).strip()
        if c and not (units(c) <= LABEL_LIMIT and _LABEL.match(c)):
            keep.append(p)
    return "\n\n".join(keep)


def coalesced(text: str) -> str:
    """Paragraphs broken in mid-sentence are joined up to the limit; paragraphs of symbols alone stay apart."""
    parts: list[list[str]] = []
    size, joinable = 0, False
    for p in paragraphs(_ZERO_WIDTH.sub("", text)):
        n = units(p)
        if joinable and size + 1 + n <= JOIN_LIMIT:
            parts[-1].append(p)
            size += 1 + n
            lettered = True
        else:
            parts.append([p])
            size, lettered = n, any(c.isalpha() for c in p)
        joinable = lettered and not _SENTENCE_END.search(p)
    return "\n\n".join(" ".join(p) for p in parts)


def body_text(text: str) -> str:
    return coalesced(without_labels(text))


def extract_chunks(text: str) -> list[str]:
    """Paragraphs packed greedily into chunks of the extraction limit (inner separators count), at most EXTRACT_CHUNKS."""
    paras = [p for p in _PARA.split(text) if p.strip()]
    if not paras:
        return [text] if text.strip() else []
    out, now, size = [], [], 0
    for p in paras:
        if now and size + units(p) > EXTRACT_LIMIT:
            out.append("\n\n".join(now))
            now, size = [], 0
        size += units(p) + (2 if now else 0)
        now.append(p)
    out.append("\n\n".join(now))
    return out[:EXTRACT_CHUNKS]


def paragraph_chunks(text: str) -> list[list[str]]:
    """Paragraphs of the body text packed greedily by length (separators aside) and count."""
    out: list[list[str]] = []
    now, size = [], 0
    for p in paragraphs(body_text(text)):
        if now and (size + units(p) > CHUNK_LIMIT or len(now) >= CHUNK_PARAGRAPHS):
            out.append(now)
            now, size = [], 0
        now.append(p)
        size += units(p)
    return [*out, now] if now else out


def numbered(paras: list[str]) -> str:
    return "\n".join(f"⟦¶{k}⟧ {p}" for k, p in enumerate(paras, 1))


_TAG = re.compile("[⟦-⟯〚〛]*¶([0-9]+)[⟦-⟯〚〛]*")
_BRACKET = re.compile("[⟦-⟯〚〛]")


def slots(raw: str, n: int) -> list[str | None]:
    """Tagged output back in its n places: brackets may be mangled, pieces of one place are joined, strange numbers ignored."""
    out: list[str | None] = [None] * n
    hits = list(_TAG.finditer(raw))
    for m, after in zip(hits, [*hits[1:], None], strict=True):
        k = int(m[1])
        text = _BRACKET.sub("", raw[m.end() : after.start() if after else len(raw)]).strip()
        if text and 1 <= k <= n:
            out[k - 1] = f"{out[k - 1]} {text}" if out[k - 1] else text
    return out


def gaps(filled: list[str | None]) -> list[int]:
    """Places to ask for again: the missing ones and for each the nearest filled one before it (from 0)."""
    ask, last = set(), None
    for k, v in enumerate(filled):
        if v is None:
            ask.add(k)
            if last is not None:
                ask.add(last)
        else:
            last = k
    return sorted(ask)


_ENDERS, _TRAILERS = set(".!?。！？…"), set("\"'”’」』）)]》>")


def sentence_spans(text: str) -> list[list[int]]:
    """[start, end) of sentences: decimals stay whole, marks after the end belong to it, a line feed always ends one."""
    out, n = [], len(text)
    start = at = 0

    def close(end: int) -> None:
        s = start
        while s < end and text[s].isspace():
            s += 1
        if s < end:
            out.append([s, end])

    while at < n:
        c = text[at]
        if c == "\n":
            close(at)
        elif c in _ENDERS and not (c == "." and 0 < at < n - 1 and text[at - 1].isdigit() and text[at + 1].isdigit()):
            at += 1
            while at < n and (text[at] in _ENDERS or text[at] in _TRAILERS):
                at += 1
            close(at)
            at -= 1
        else:
            at += 1
            continue
        at += 1
        while at < n and text[at].isspace():
            at += 1
        start = at
    if start < n:
        close(n)
    return out


_INLINE = {"b", "strong", "i", "em", "u", "s", "del", "mark", "sub", "sup", "code"}
_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "nbsp": " "}
_PIECE = re.compile(r"<(/?)\s*([A-Za-z]+)\s*/?>|&([#A-Za-z0-9]{1,9});")


def runs(html: str) -> list[tuple[str, list[str]]]:
    """Plain text of inline HTML with the tags open over each stretch; unknown tags and entities stay text."""
    out: list[tuple[str, list[str]]] = []
    open_tags: list[str] = []
    buf, at = "", 0

    def flush() -> None:
        nonlocal buf
        if buf:
            out.append((buf, list(open_tags)))
            buf = ""

    for m in _PIECE.finditer(html):
        buf += html[at : m.start()]
        at = m.end()
        tag = (m[2] or "").lower()
        if m[3]:
            buf += _ENTITIES.get(m[3], m[0])
        elif tag == "br":
            flush()
            out.append(("\n", list(open_tags)))
        elif tag not in _INLINE:
            buf += m[0]
        elif not m[1]:
            flush()
            open_tags.append(tag)
        else:
            flush()
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k] == tag:
                    del open_tags[k]
                    break
    buf += html[at:]
    flush()
    return out


def tokens(html: str) -> list[dict]:
    """Words and white space of inline HTML with offsets into the plain text."""
    out, at = [], 0
    for text, tags in runs(html):
        for part in re.split(r"(\s+)", text):
            if part:
                out.append({"text": part, "start": at, "end": at + len(part), "tags": tags, "is_word": not part.isspace(), "is_break": "\n" in part})
                at += len(part)
    return out


def highlighted(html: str, terms: list[tuple[str, str]], word_bounded: bool) -> str:
    """Occurrences of (id, text) terms between the tags of safe HTML wrapped in a span; the longest term wins."""
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")
    ids: dict[str, str] = {}
    for i, t in terms:
        if t:
            ids.setdefault(esc(t), i)
    if not ids:
        return html
    core = "|".join(map(re.escape, sorted(ids, key=lambda k: -units(k))))
    edge = r"(?<!\w)(?:{})(?!\w)" if word_bounded else "(?:{})"
    find = re.compile(edge.format(core))
    mark = lambda m: f'<span data-term="{esc(ids[m[0]])}">{m[0]}</span>'
    return re.sub(r"<[^>]*>|[^<]+", lambda seg: seg[0] if seg[0][0] == "<" else find.sub(mark, seg[0]), html)


def term_objects(reply: str) -> list[dict]:
    """Objects of a reply: its 'terms', a bare array, or every complete object of a broken one."""
    def load(s: str) -> object:
        try:
            return json.loads(s)
        except ValueError:
            return None

    whole = load(reply)
    if isinstance(whole, dict):
        whole = whole.get("terms")
    if not isinstance(whole, list):
        whole = [load(m) for m in re.findall(r"\{[^{}]*\}", reply)]
    return [x for x in whole if isinstance(x, dict)]


def text_chapters(text: str, fallback: str) -> list[tuple[str, str]]:
    """(title, content) of the chapters of a plain text: cut at headings, empty ones dropped, unheaded ones numbered."""
    found: list[tuple[str | None, list[str]]] = [(None, [])]
    for line in re.sub(r"\r\n?", "\n", text).split("\n"):
        head = line.strip(EDGES)
        if _HEADING.match(line) and len(_MARKER_END.split(head, maxsplit=1)[0]) <= 20:
            found.append((head, []))
        elif head:
            found[-1][1].append(head)
    kept = [(t, "\n\n".join(ls)) for t, ls in found if ls]
    any_heading = any(t is not None for t, _ in kept)
    return [(t if t is not None else f"Chapter {k}" if any_heading else fallback.strip(), c) for k, (t, c) in enumerate(kept, 1)]


def natural_key(name: str) -> list[tuple[int, int, str]]:
    """Sort key by which 'c2' comes before 'c10'."""
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", name)]
