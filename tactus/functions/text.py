"""Text functions as Spark columns: lyric normalisation, Japanese measures, ids, cards."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and characters of the lyric formats.
ANNOTATION = r"[\[【（(][^】\]）)]*[\]】）)]"
SEPARATOR = r"^[-─━=～〜＝]{3,}\s*$"
TIMECODE = r"[\[(（][0-9]{1,2}:[0-9]{2}(?:\.[0-9]+)?[\])）]"
SPACES = r"[ \t　]{2,}"
EDGES = r"^[ \t\r　]+|[ \t\r　]+$"
JAPANESE = r"[぀-ゟ゠-ヿ一-鿿㐀-䶿]"
MATCH_PUNCTUATION = r"[。、！？!?.,…「」『』【】〈〉《》・\-\s　]+"
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA = "".join(chr(ord(c) - 0x60) for c in KATAKANA)
CHARS_FROM, CHARS_TO = "–･’‘“”", "—・''\"\""
SMALL_KANA = "ぁぃぅぇぉゃゅょゎァィゥェォャュョヮ"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; Spark SQL has no such function."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def kata_to_hira(c: Column) -> Column:
    return F.translate(c, KATAKANA, HIRAGANA)


def normalize_line(c: Column, compose: bool = False) -> Column:
    """A lyric line without time codes, annotations and superfluous space; compose: NFKC first."""
    c = F.translate(nfkc(c) if compose else c, CHARS_FROM, CHARS_TO)
    for pattern, to in ((TIMECODE, ""), (ANNOTATION, ""), (EDGES, "")):
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(F.trim(c), SPACES, " ")


def is_noise(c: Column) -> Column:
    """Empty, a separator, only an annotation, or up to three letters without Japanese."""
    bare = F.regexp_replace(c, r"^\s+|\s+$", "")
    short = (F.length(bare) <= 3) & ~bare.rlike(JAPANESE)
    only = F.length(F.regexp_replace(F.regexp_replace(bare, ANNOTATION, ""), r"\s+", "")) == 0
    return (F.length(bare) == 0) | bare.rlike(SEPARATOR) | only | short


def japanese_ratio(c: Column) -> Column:
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(F.regexp_count(c, F.lit(JAPANESE)) / F.length(c))


def has_japanese(c: Column) -> Column:
    return c.rlike(JAPANESE)


def has_kanji(c: Column) -> Column:
    return c.rlike("[一-鿿㐀-䶿]")


def is_kana_only(c: Column) -> Column:
    return c.rlike(r"^[぀-ヿー\s]+$")


def match_form(c: Column, compose: bool = False) -> Column:
    """For matching: hiragana, no punctuation or long marks, runs of three or more shortened to two, lower case."""
    c = kata_to_hira(nfkc(c) if compose else c)
    c = F.regexp_replace(F.regexp_replace(c, MATCH_PUNCTUATION, ""), "ー+", "")
    return F.trim(F.lower(F.regexp_replace(c, r"(.)\1{2,}", "$1$1")))


def mora_count(c: Column) -> Column:
    """Beats of a line: kana and long marks 1, small kana 0, kanji 2, ASCII letters 1; at least 1."""
    kana = F.regexp_count(c, F.lit("[ぁ-ゖァ-ヺ]")) - F.regexp_count(c, F.lit(f"[{SMALL_KANA}]"))
    rest = F.regexp_count(c, F.lit("[ー〜]")) + 2 * F.regexp_count(c, F.lit("[一-鿿㐀-䶿]")) + F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.greatest(kana + rest, F.lit(1))


def pitch_mora_count(c: Column) -> Column:
    """Beats of a reading for pitch accent: every character but small kana and the small tsu."""
    return F.length(F.regexp_replace(c, f"[{SMALL_KANA}っッ]", ""))


def char_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\s+", ""))


def youtube_id(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?:v=|youtu\.be/|embed/|shorts/)([A-Za-z0-9_-]{11})", 1)
    return F.when(found != "", found)


def confidence_tier(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.55, "medium").when(c > 0, "low").otherwise("none")


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def escape_tsv(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "\t", "    "), "\r?\n", "<br>")


def furigana_to_ruby(c: Column) -> Column:
    ruby = F.regexp_replace(c, r"([一-鿿㐀-䶿々]+)\(([぀-ゟ゠-ヿ]+)\)", "<ruby>$1<rt>$2</rt></ruby>")
    return F.regexp_replace(ruby, r"\([぀-ゟ゠-ヿ]+\)", "")


def vtt_seconds(c: Column) -> Column:
    """Seconds of HH:MM:SS.mmm, 0 if it isn't one."""
    part = [F.regexp_extract(F.trim(c), r"^([0-9]+):([0-9]{2}):([0-9]{2})[.,]([0-9]{3})", i) for i in range(1, 5)]
    value = sum(p.try_cast("bigint") * k for p, k in zip(part, (3_600_000, 60_000, 1000, 1), strict=True))
    return F.coalesce(value / 1000.0, F.lit(0.0))


def video_title(title: Column) -> Column:
    """The quoted part of a title, or the title without bracketed parts."""
    quoted = F.regexp_extract(title, "[「『]([^」』]+)[」』]", 1)
    bare = F.trim(F.regexp_replace(F.regexp_replace(title, r"[\[【（(][^】\]）)]*[\]】）)]", ""), r"\s{2,}", " "))
    return F.when(quoted != "", quoted).otherwise(bare)


def jlpt_hardest(levels: Column) -> Column:
    """The hardest of an array of levels (N1 is the hardest)."""
    return F.array_min(F.filter(levels, lambda x: x.isNotNull()))
