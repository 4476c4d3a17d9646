"""The language dimension: script, whether blanks part words, reading speed in words or characters a minute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, name, script, whether blanks part words, units read a minute, tier of quality; right-to-left scripts.
LANGUAGES = (
    ("en", "English", "latin", True, 220, 1), ("zh-Hans", "Simplified Chinese", "han", False, 400, 1), ("zh-Hant", "Traditional Chinese", "han", False, 400, 1),
    ("ja", "Japanese", "kana", False, 400, 1), ("ko", "Korean", "hangul", True, 600, 1),
    ("es", "Spanish", "latin", True, 200, 2), ("fr", "French", "latin", True, 200, 2), ("de", "German", "latin", True, 200, 2), ("pt", "Portuguese", "latin", True, 200, 2),
    ("it", "Italian", "latin", True, 200, 2), ("ru", "Russian", "cyrillic", True, 180, 2), ("nl", "Dutch", "latin", True, 200, 2), ("pl", "Polish", "latin", True, 200, 2),
    ("ar", "Arabic", "arabic", True, 180, 2), ("tr", "Turkish", "latin", True, 200, 2), ("vi", "Vietnamese", "latin", True, 200, 2), ("id", "Indonesian", "latin", True, 200, 2),
    ("hi", "Hindi", "devanagari", True, 180, 2),
    ("sv", "Swedish", "latin", True, 200, 3), ("nb", "Norwegian", "latin", True, 200, 3), ("da", "Danish", "latin", True, 200, 3), ("fi", "Finnish", "latin", True, 200, 3),
    ("cs", "Czech", "latin", True, 200, 3), ("el", "Greek", "greek", True, 190, 3), ("he", "Hebrew", "hebrew", True, 180, 3), ("th", "Thai", "thai", False, 350, 3),
    ("ms", "Malay", "latin", True, 200, 3), ("tl", "Tagalog", "latin", True, 200, 3), ("uk", "Ukrainian", "cyrillic", True, 180, 3), ("ro", "Romanian", "latin", True, 200, 3),
    ("hu", "Hungarian", "latin", True, 200, 3), ("bn", "Bengali", "bengali", True, 180, 3), ("ta", "Tamil", "tamil", True, 180, 3), ("ur", "Urdu", "arabic", True, 180, 3),
    ("sw", "Swahili", "latin", True, 200, 3),
)
RIGHT_TO_LEFT = ("ar", "he", "ur")


def dimension(spark: SparkSession) -> DataFrame:
    """The languages as a table: code, name, script, delimited, rate, tier, rtl."""
    schema = "code string, name string, script string, delimited boolean, rate int, tier int, rtl boolean"
    return spark.createDataFrame([(*row, row[0] in RIGHT_TO_LEFT) for row in LANGUAGES], schema)


def _lookup(lang: Column, k: int, default: object) -> Column:
    table = F.create_map(*(F.lit(x) for row in LANGUAGES for x in (row[0], row[k])))
    return F.coalesce(table[lang], F.lit(default))


def delimited(lang: Column) -> Column:
    return _lookup(lang, 3, True)


def read_rate(lang: Column) -> Column:
    return _lookup(lang, 4, 220)
