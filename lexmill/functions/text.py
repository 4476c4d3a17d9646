"""String, URL, hash and title expressions, all built in (no Python at run time)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerals and units of Chinese chapter numbers, markers of special chapters and their tags.
DIGITS = {"〇": 0, "零": 0, "一": 1, "二": 2, "兩": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000, "萬": 10000, "万": 10000}
SPECIAL = (
    ("Prologue", r"楔子|序章|序言|引子|プロローグ|프롤로그|(?i:\bprologue\b)"),
    ("Finale", r"尾聲|尾声|大結局|大结局|終章|终章"),
    ("Epilogue", r"(?i:\bepilogue\b)|エピローグ|에필로그"),
    ("Extra", r"番外|閑話|外伝|외전|(?i:\bside[\s-]?story\b|\bextra\b)"),
    ("Note", r"後記|后记|後話|后话|完本感言|感言|作者的?[話话]|上架|請假|请假|通知|公告|あとがき|작가의?\s*말|(?i:author.?s?\s*note|\bafterword\b)"),
)
_NUMERAL = "[" + "".join((*DIGITS, *UNITS)) + "]"
_KO = "[화話장회권부편]"
# Characters found in only one of the two Chinese scripts.
SIMPLIFIED = "们这国说时为对开关边门见车马鸟长东书会买卖学觉际汉还进过远爱图义乐习写双发"
TRADITIONAL = "們這國說時為對開關邊門見車馬鳥長東書會買賣學覺際漢還進過遠愛圖義樂習寫雙發"
SPACE = r"[\s\p{Z}\x{feff}]"


def trimmed(c: Column) -> Column:
    """White space of every kind off both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def clean(c: Column) -> Column:
    """White space of every kind collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def slug(c: Column) -> Column:
    """ASCII stem of at most 60 characters; 'book' where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.left(s, F.lit(60)), F.lit("")), F.lit("book"))


def filename(c: Column) -> Column:
    """A file name without separators and control characters, 120 characters at most."""
    return F.left(F.regexp_replace(c, r'[\\/:*?"<>|\x{0}-\x{1f}]+', "_"), F.lit(120))


def title_from_path(c: Column) -> Column:
    base = F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?i)\.x?html?$", "")
    return clean(F.regexp_replace(base, "[_-]+", " "))


def resolve_path(base: Column, rel: Column) -> Column:
    """rel against the folder base: '.' and empty parts dropped, '..' takes one back, the fragment cut off."""
    parts = F.split(F.concat(base, F.split(rel, "#")[0]), "/")
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def percent_decoded(c: Column) -> Column:
    """Percent escapes decoded, a plus sign stays one; null where an escape is malformed."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def csv_safe(c: Column) -> Column:
    """A leading formula sign is disarmed by a tab, which a re-import trims again."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("\t"), c)).otherwise(c)


def truthy(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike("(?i)^(?:true|1|yes|y|★)$"), F.lit(False))


def hashtags(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda t: t.startswith("#"))


def gender(tags: Column) -> Column:
    has = lambda *t: reduce(Column.__or__, (F.array_contains(tags, x) for x in t))
    return F.when(has("#masculine", "#male"), "masculine").when(has("#feminine", "#female"), "feminine").otherwise("neuter")


def unquoted(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^[\"'“”‘’「『]+|[\"'“”‘’」』]+$", "")


def occurrences(hay: Column, needle: Column) -> Column:
    """Non-overlapping occurrences, letter case aside; none of an empty needle."""
    h, n = F.lower(hay), F.lower(needle)
    return F.when(F.length(n) > 0, ((F.length(h) - F.length(F.replace(h, n, F.lit("")))) / F.length(n)).cast("int")).otherwise(0)


def markup(c: Column) -> Column:
    """Escaped text in which bare inline tags and inline markdown come back as HTML."""
    s = c
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    s = F.regexp_replace(s, r"(?i)&lt;/?br\s*/?&gt;", "<br>")
    for tag in ("b", "strong", "i", "em", "u", "s", "del", "mark", "sub", "sup", "code"):
        s = F.regexp_replace(s, rf"(?i)&lt;(/?){tag}\s*/?&gt;", f"<$1{tag}>")
    for pattern, tag in (
        (r"\*\*([^\n*]+?)\*\*", "strong"), (r"__([^\n_]+?)__", "strong"), (r"\*([^\n*]+?)\*", "em"),
        (r"(?<![\w_])_([^\n_]+?)_(?![\w_])", "em"), (r"~~([^\n~]+?)~~", "del"), (r"`([^\n`]+?)`", "code"),
    ):
        s = F.regexp_replace(s, pattern, f"<{tag}>$1</{tag}>")
    return s


def quoted_url(c: Column) -> Column:
    """The first quoted absolute URL or path in a script call; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"""['"]((?:https?://|/)[^'"]+)['"]""", 1), F.lit(""))


def host(url: Column) -> Column:
    h = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.coalesce(F.nullif(F.regexp_replace(h, r"^www\.", ""), F.lit("")), F.lit("unknown"))


def is_host(url: Column, name: str) -> Column:
    return (host(url) == name) | F.endswith(host(url), F.lit("." + name))


def like_base_slash(url: Column, base: Column) -> Column:
    """The trailing slash of url's path as base has it; a bare '/' stays."""
    path = lambda u: F.regexp_extract(u, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    on, off = F.endswith(path(base), F.lit("/")), F.endswith(path(url), F.lit("/"))
    added = F.regexp_replace(url, r"^([^:]+://[^/?#]*[^?#]*)", "$1/")
    cut = F.regexp_replace(url, r"^([^:]+://[^/?#]*[^?#]*?)/($|[?#])", "$1$2")
    return F.when(on & ~off, added).when(~on & off & (F.length(path(url)) > 1), cut).otherwise(url)


def url_ids(url: Column, pattern: Column) -> Column:
    """(book, chapter) by the two groups of a pattern column; nulls where it does not match."""
    got = lambda k: F.when(F.regexp_like(url, pattern), F.regexp_extract_all(url, pattern, F.lit(k))[0])
    return F.struct(got(1).alias("book"), got(2).alias("chapter"))


def meta_tags(html: Column) -> Column:
    """property or name -> content of all meta tags, keys in lower case, the last of a key wins."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<meta\b[^>]*>)"), F.lit(1))
    pair = lambda t: F.struct(
        F.lower(F.regexp_extract(t, r"""(?i)(?:property|name)\s*=\s*["']([^"']+)["']""", 1)).alias("key"),
        F.regexp_extract(t, r"""(?i)content\s*=\s*["']([^"']*)["']""", 1).alias("value"),
    )
    pairs = F.filter(F.transform(tags, pair), lambda p: (p["key"] != "") & (p["value"] != ""))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def fingerprint(terms: Column) -> Column:
    """First 16 hex digits over the sorted strings of an array: independent of their order."""
    return F.left(F.sha2(F.array_join(F.array_sort(terms), "\n"), 256), F.lit(16))


def term_string(source: Column, target: Column, gender: Column, context: Column, pinned: Column, aliases: Column) -> Column:
    """What of a term shapes a translation: context, pin and sorted aliases are appended where present."""
    ctx = F.when(F.trim(F.coalesce(context, F.lit(""))) != "", F.concat(F.lit("@"), F.trim(context))).otherwise("")
    also = F.when(F.size(aliases) > 0, F.concat(F.lit("~"), F.array_join(F.array_sort(aliases), ","))).otherwise("")
    return F.concat(source, F.lit("="), target, F.lit("#"), gender, ctx, F.when(pinned, "!").otherwise(""), also)


def utf16_length(c: Column) -> Column:
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def language(c: Column) -> Column:
    """Language by script of the first 4000 characters; zh-Hant for blank text, en for Latin."""
    s = F.left(c, F.lit(4000))
    count = lambda chars: F.length(F.regexp_replace(s, f"[^{chars}]", ""))
    return (
        F.when(F.coalesce(F.trim(clean(s)), F.lit("")) == "", "zh-Hant")
        .when(s.rlike(r"[\x{3040}-\x{30ff}]"), "ja").when(s.rlike(r"[\x{ac00}-\x{d7a3}]"), "ko")
        .when(s.rlike(r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"), F.when(count(SIMPLIFIED) > count(TRADITIONAL), "zh-Hans").otherwise("zh-Hant"))
        .when(s.rlike(r"[\x{e00}-\x{e7f}]"), "th").when(s.rlike(r"[\x{590}-\x{5ff}]"), "he").when(s.rlike(r"[\x{600}-\x{6ff}]"), "ar")
        .when(s.rlike(r"[\x{900}-\x{97f}]"), "hi").when(s.rlike(r"[\x{370}-\x{3ff}\x{1f00}-\x{1ffc}]"), "el").when(s.rlike(r"[\x{400}-\x{4ff}]"), "ru")
        .otherwise("en")
    )


def has_residue(text: Column, lang: Column) -> Column:
    """Whether characters of a dense source script are left in a translation; Japanese is kana or kanji."""
    han = text.rlike(r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2a6df}]")
    kana, hangul = text.rlike(r"[\x{3040}-\x{30ff}\x{31f0}-\x{31ff}]"), text.rlike(r"[\x{ac00}-\x{d7a3}\x{1100}-\x{11ff}\x{3130}-\x{318f}]")
    return F.when(lang.startswith("zh"), han).when(lang == "ja", kana | han).when(lang == "ko", hangul).otherwise(False)


def degenerate(c: Column) -> Column:
    """Word salad: many lower-to-upper joins, or fifty equal characters in a row; short texts never are."""
    joins = F.regexp_count(c, F.lit("[a-z][A-Z]")) / utf16_length(c) * 1000
    return (utf16_length(c) >= 200) & ((joins > 2) | c.rlike(r"(.)\1{49,}"))


def over_expanded(source: Column, target: Column) -> Column:
    s, t = utf16_length(source), utf16_length(target)
    return (s > 0) & (t > s * 6 + 400)


def numeral(c: Column) -> Column:
    """Value of a Chinese numeral: a unit multiplies the digit before it and is added to the total."""
    digit, unit = F.create_map(*(F.lit(x) for p in DIGITS.items() for x in p)), F.create_map(*(F.lit(x) for p in UNITS.items() for x in p))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("now"))

    def step(acc: Column, ch: Column) -> Column:
        d, u = digit[ch], unit[ch]
        taken = acc["total"] + F.when(acc["now"] == 0, 1).otherwise(acc["now"]) * u
        return F.struct(F.when(d.isNotNull(), acc["total"]).otherwise(taken).alias("total"), F.coalesce(d, F.lit(0)).alias("now"))

    return F.aggregate(F.filter(F.split(c, "(?!^)"), lambda ch: ch != ""), start, step, lambda acc: (acc["total"] + acc["now"]).cast("long"))


def chapter_number(title: Column) -> Column:
    """Number of a chapter from its title: Chinese or Japanese, Korean, English marker, else a leading number."""
    zh = F.regexp_extract(title, rf"第\s*([0-9]{{1,7}}|{_NUMERAL}{{1,12}})\s*[章回節节卷話话]", 1)
    from_zh = F.when(zh == "", None).when(zh.rlike("^[0-9]+$"), F.try_to_number(zh, F.lit("9999999")).cast("long")).otherwise(numeral(zh))
    number = lambda p: F.nullif(F.regexp_extract(title, p, 1), F.lit("")).cast("long")
    lead = rf"^\s*제?\s*0*([0-9]{{1,7}})(?:\s*{_KO})?(?=[\s\-–—.:、)\]]|$)"
    return F.coalesce(from_zh, number(r"제\s*([0-9]{1,7})\s*[장화권부편]"), number(r"(?i)\bchapter\s+([0-9]{1,7})\b"), number(lead))


def special_tag(title: Column) -> Column:
    out = None
    for tag, pattern in SPECIAL:
        out = F.when(title.rlike(pattern), tag) if out is None else out.when(title.rlike(pattern), tag)
    return out


def without_prefix(title: Column) -> Column:
    """The subtitle after a chapter marker; empty if there is none."""
    s = F.regexp_replace(title, rf"^\s*第\s*(?:[0-9]{{1,7}}|{_NUMERAL}{{1,12}})\s*[章回節节卷][\s:：、.\-—]*", "")
    s = F.regexp_replace(s, r"(?i)^\s*chapter\s+[0-9]{1,7}\s*[:：.\-—]*\s*", "")
    s = F.regexp_replace(s, rf"^\s*제?\s*0*[0-9]{{1,7}}(?:\s*{_KO})?(?:[\s\-–—.:、)\]]+|$)", "")
    return trimmed(s)


def without_leading_title(content: Column, title: Column) -> Column:
    """Text without a first paragraph that repeats the title or is a chapter heading; a single paragraph stays."""
    paras = F.split(content, r"\n{2,}", -1)
    key = lambda c: F.lower(F.regexp_replace(c, r"""[\s【】\[\]()（）:：、，,.。!！?？\-—~～'"·#*]""", ""))
    heading = paras[0].rlike(rf"(?i)^\s*#{{0,6}}\s*(?:第\s*(?:[0-9]{{1,7}}|{_NUMERAL}{{1,12}})\s*[章回節节卷]|chapter\s+[0-9])")
    same = (key(F.coalesce(title, F.lit(""))) != "") & (key(paras[0]) == key(F.trim(F.coalesce(title, F.lit("")))))
    rest = F.regexp_replace(F.array_join(F.slice(paras, 2, F.greatest(F.size(paras) - 1, F.lit(0))), "\n\n"), r"^\s+", "")
    return F.when((F.size(paras) > 1) & (heading | same), rest).otherwise(content)


def content_stats(body: Column, delimited: Column, rate: Column) -> Column:
    """(chars, words, paragraphs, read_minutes): code points without breaks, words where blanks part them."""
    paras = F.filter(F.split(F.coalesce(body, F.lit("")), r"\n{2,}"), lambda p: p != "")
    chars = F.length(F.array_join(paras, ""))
    tokens = F.filter(F.split(F.array_join(paras, " "), r"\s+"), lambda w: w != "")
    words = F.when(delimited, F.size(tokens)).otherwise(0)
    units = F.when(delimited, words).otherwise(chars)
    minutes = F.when(units > 0, F.greatest(F.lit(1), F.round(units / rate).cast("int"))).otherwise(0)
    return F.struct(chars.alias("chars"), words.alias("words"), F.size(paras).alias("paragraphs"), minutes.alias("read_minutes"))


def private_ip(ip: Column) -> Column:
    """Whether an IPv4 address lies in a private, loopback, link-local, shared or reserved range, or is malformed."""
    o = F.transform(F.split(ip, r"\."), lambda x: x.cast("int"))
    a, b = o[0], o[1]
    valid = (F.size(o) == 4) & F.forall(o, lambda x: x.isNotNull() & x.between(0, 255))
    inside = a.isin(0, 10, 127) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a >= 224)
    return ~valid | inside


def outcome(status: Column) -> Column:
    """Replay outcome of an HTTP status: transient client errors, server errors and none at all are tried again."""
    return F.when(status.between(400, 499) & ~status.isin(401, 408, 425, 429), "drop").otherwise("retry")
