"""EPUB archives: container, package, spine; or all pages of a bare archive in natural order."""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from urllib.parse import unquote

from lexmill.functions.html import Node, paragraphs_of, select, tree
from lexmill.functions.prose import natural_key
from lexmill.sources.charset import decode

# Limits against archive bombs, of whole-book splitting and of a preamble.
MAX_ENTRY, MAX_TOTAL = 25 * 1024 * 1024, 150 * 1024 * 1024
SPLIT_CHARS, SPLIT_HEADINGS, PREAMBLE, LEAST = 25_000, 3, 200, 4
_TEXT = re.compile(r"\.(?:x?html?|xml|opf|ncx)$", re.I)
_PAGE = re.compile(r"\.x?html?$", re.I)


def _path(folder: str, rel: str) -> str:
    out: list[str] = []
    for p in (folder + rel.split("#")[0]).split("/"):
        if p == "..":
            out[-1:] = []
        elif p not in ("", "."):
            out.append(p)
    return "/".join(out)


def _heading(root: Node) -> str | None:
    first = next((n for n in root.walk() if n.tag in ("h1", "h2", "h3")), None) or select(root, "title")
    return (first.clean() or None) if first else None


def _split(body: Node) -> list[tuple[str | None, str]]:
    """Segments of a whole-book page at its shallowest repeated heading level; a long enough preamble comes first."""
    flat = [n for n in body.walk() if re.fullmatch("h[1-6]", n.tag)]
    often = [lv for lv, k in sorted(Counter(n.tag for n in flat).items()) if k >= SPLIT_HEADINGS]
    if not often:
        return []
    segments: list[tuple[str | None, list]] = [(None, [])]

    def visit(n: Node) -> None:
        for c in n.children:
            if isinstance(c, Node) and c.tag == often[0]:
                segments.append((c.clean() or None, [c]))
            elif isinstance(c, Node) and any(d.tag == often[0] for d in c.walk()):
                visit(c)
            else:
                segments[-1][1].append(c)

    visit(body)
    out = []
    for k, (title, nodes) in enumerate(segments):
        holder = Node("div", {}, None)
        holder.children = nodes
        text = paragraphs_of(holder, more_breaks=True)
        if text if k else len(text) >= PREAMBLE:
            out.append((title if k else _heading(holder), text))
    return out if len(out) >= 2 else []


def page_chapters(html: str, fallback: str) -> list[tuple[str, str]]:
    root = tree(html)
    body = select(root, "body") or root
    text = paragraphs_of(body, more_breaks=True)
    if len(text) >= SPLIT_CHARS and (parts := _split(body)):
        return [(t or f"{fallback} ({k})", x) for k, (t, x) in enumerate(parts, 1)]
    return [(_heading(root) or fallback, text)] if len(text) >= LEAST else []


def read(raw: bytes, fallback: str, hints: tuple[str, ...] = ()) -> dict:
    """Title, author and chapters of an archive; error instead where it is none, too large or without a readable chapter."""
    bad = lambda why: {"title": fallback, "author": None, "chapters": [], "error": why}
    try:
        z = zipfile.ZipFile(io.BytesIO(bytes(raw)))
    except (zipfile.BadZipFile, ValueError, OSError):
        return bad("not an archive")
    names = [i for i in z.infolist() if _TEXT.search(i.filename)]
    if any(i.file_size > MAX_ENTRY for i in z.infolist()) or sum(i.file_size for i in z.infolist()) > MAX_TOTAL:
        return bad("too large")
    held = {i.filename for i in names}
    get = lambda n: decode(z.read(n), True, hints) if n in held else None
    title, author, chapters = fallback, None, []
    container = get("META-INF/container.xml")
    m = re.search(r"""full-path=["']([^"']+)["']""", container or "", re.I)
    package = get(m[1]) if m else None
    if package:
        root, folder = tree(package), m[1].rpartition("/")[0]
        folder = folder + "/" if folder else ""
        first = lambda tag: next((n.clean() for n in root.walk() if n.tag == tag), "")
        title, author = first("dc:title") or fallback, first("dc:creator") or None
        manifest = {n.attrs.get("id"): n.attrs.get("href") for n in root.walk() if n.tag == "item" and n.attrs.get("id") and n.attrs.get("href")}
        for n in root.walk():
            if n.tag == "itemref" and (href := manifest.get(n.attrs.get("idref"))):
                at = _path(folder, href)
                page = get(at) or get(unquote(at))
                if page:
                    chapters += page_chapters(page, f"Chapter {len(chapters) + 1}")
    if not chapters:
        for name in sorted((n for n in held if _PAGE.search(n)), key=natural_key):
            stem = re.sub(r"[_-]+", " ", _PAGE.sub("", name.rpartition("/")[2])).strip()
            chapters += page_chapters(get(name) or "", stem or f"Chapter {len(chapters) + 1}")
    if not chapters:
        return bad("no readable chapters")
    return {"title": title, "author": author, "chapters": [{"idx": k, "title": t, "content": c} for k, (t, c) in enumerate(chapters)], "error": None}
