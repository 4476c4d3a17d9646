"""Bytes of unknown encoding to text: byte order mark, declared label, strict UTF-8, then the best-scoring legacy encoding."""

from __future__ import annotations

import re

# Sample size, default candidates, labels that mean another codec.
SAMPLE = 64 * 1024
DEFAULTS = ("gb18030", "big5")
ALIASES = {
    "gb2312": "gb18030", "gbk": "gb18030", "gb_2312-80": "gb18030", "csgb2312": "gb18030", "big5-hkscs": "big5", "cn-big5": "big5", "csbig5": "big5",
    "shift-jis": "shift_jis", "sjis": "shift_jis", "ms_kanji": "shift_jis", "x-sjis": "shift_jis", "euc_jp": "euc-jp", "x-euc-jp": "euc-jp",
    "euc_kr": "euc-kr", "ks_c_5601-1987": "euc-kr", "csksc56011987": "euc-kr", "korean": "euc-kr", "utf8": "utf-8",
}
_CODEC = {"shift_jis": "cp932", "euc-kr": "cp949"}
_GOOD = re.compile("[\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff\u3040-\u30ff\uac00-\ud7a3]")
_DECLARED = re.compile(rb"<\?xml[^>]*encoding=[\"']([\w-]+)[\"']|<meta[^>]+charset=[\"']?([\w-]+)", re.I)


def _decoded(raw: bytes, label: str) -> str | None:
    try:
        return raw.decode(_CODEC.get(label, label), "replace")
    except LookupError:
        return None


def score(text: str) -> int:
    """East Asian characters, less eight for every replacement character."""
    return len(_GOOD.findall(text)) - 8 * text.count("�")


def decode(raw: bytes, markup: bool = False, hints: tuple[str, ...] = ()) -> str:
    """Text of raw bytes. markup: honour an encoding declared in the first two kilobytes; hints: candidates tried first."""
    raw = bytes(raw)
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(codec, "replace")
    if markup and (m := _DECLARED.search(raw[:2048])):
        label = (m[1] or m[2]).decode("ascii").strip().lower()
        if (text := _decoded(raw, ALIASES.get(label, label))) is not None:
            return text
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    labels = dict.fromkeys([*(ALIASES.get(h.strip().lower(), h.strip().lower()) for h in hints), *DEFAULTS])
    probes = [(score(t), -k, label) for k, label in enumerate(labels) if (t := _decoded(raw[:SAMPLE], label)) is not None]
    return _decoded(raw, max(probes)[2]) or ""
