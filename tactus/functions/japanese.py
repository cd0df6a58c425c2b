"""Columns for furigana, readings and Japanese runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tactus.functions.text import japanese_ratio, kata_to_hira

# Letter classes.
KANJI = "[一-鿿㐀-䶿]"
KANA = "[ぁ-んァ-ン]"


def looks_like_reading(s: Column) -> Column:
    """Whether a text is nothing but kana and spaces."""
    return F.coalesce(F.trim(s).rlike(r"^[぀-ゟ゠-ヿ\s・ー]+$"), F.lit(False))


def japanese_runs(s: Column) -> Column:
    """The runs of Japanese letters."""
    return F.regexp_extract_all(s, F.lit("([぀-ヿ㐀-䶿一-鿿ｦ-ﾟ]+)"), F.lit(1))


def vowel_tail(s: Column) -> Column:
    """Whether the last letter before spaces and punctuation is a vowel or the long mark."""
    return F.coalesce(s.rlike(r"[あいうえおアイウエオーaeiouAEIOU][\s。、！？!?.…]*$"), F.lit(False))


def ends_held(s: Column) -> Column:
    """Whether a line ends in a vowel or an exclamation."""
    return vowel_tail(s) | F.coalesce(s.rlike(r"[？！…～!?]\s*$"), F.lit(False))


def _tail(surface: Column, reading: Column) -> Column:
    """Letters of the longest kana ending that both have, leaving a letter of each."""
    most = F.least(F.length(surface), F.length(reading)) - 1
    same = lambda k: (F.right(surface, k) == F.right(reading, k)) & F.right(surface, k).rlike(f"^{KANA}+$")
    return F.when(most >= 1, F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), most), same)), F.lit(0))).otherwise(F.lit(0))


def align_furigana(surface: Column, reading: Column) -> Column:
    """surface with the reading of its kanji in brackets, without the kana ending; null where nothing is to be read."""
    tail = _tail(surface, reading)
    kanji, read = F.left(surface, F.length(surface) - tail), F.left(reading, F.length(reading) - tail)
    fits = (F.length(reading) > 0) & (reading != surface) & surface.rlike(KANJI) & (F.length(read) > 0) & (read != kanji)
    return F.when(fits, F.concat(kanji, F.lit("("), read, F.lit(")"), F.right(surface, tail)))


def furigana(surface: Column, katakana: Column) -> Column:
    """As align_furigana for a katakana reading; the whole word is annotated where its ending doesn't fit."""
    reading = kata_to_hira(katakana)
    whole = F.concat(surface, F.lit("("), reading, F.lit(")"))
    return F.when((F.length(katakana) > 0) & surface.rlike(KANJI), F.coalesce(align_furigana(surface, reading), whole))


def ruby(display: Column, annotated: Column, surface: Column) -> Column:
    """The first of a ready ruby, one made from an annotated text, and the plain surface that isn't empty."""
    from tactus.functions.text import furigana_to_ruby

    some = lambda c: F.when(F.length(c) > 0, c)
    return F.coalesce(some(display), furigana_to_ruby(some(annotated)), some(surface), F.lit(""))


def soft(s: Column) -> Column:
    """Runs of white space as one space; compose to NFKC first where the text needs it."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def lyrics_block(description: Column, least_ratio: float = 0.35, least_lines: int = 4) -> Column:
    """The lyrics in a video's description: what follows a heading, else the paragraph with most Japanese letters."""
    heading = r"(?i)(?:▶\s*lyrics?|▶\s*lyric|lyrics?|歌詞|作詞|lyric|words?)[：:＝=\s]*\n"
    at = F.regexp_instr(description, F.lit(heading))
    rest = F.regexp_replace(F.substr(description, at), "^" + heading, "")
    headed = F.trim(F.regexp_replace(rest, r"(?s)\n[A-Za-z　-鿿]{1,20}[：:＝=]\s*\n.*$", ""))
    lines = lambda p: F.split(p, "\n")
    credits_ = lambda p: F.size(F.filter(lines(p), lambda x: F.trim(x).rlike(r"^.{1,15}[：:].{1,30}$")))
    good = lambda p: (F.size(lines(p)) >= least_lines) & (2 * credits_(p) <= F.size(lines(p))) & (japanese_ratio(p) > least_ratio)
    found = F.filter(F.split(F.trim(description), r"\n{2,}"), good)
    # of equal ratios the first paragraph
    ranked = F.array_max(F.transform(found, lambda p, i: F.struct(japanese_ratio(p).alias("r"), (-i).alias("i"), p.alias("p"))))
    return F.when(at > 0, headed).otherwise(ranked["p"])
