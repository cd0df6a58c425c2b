"""Flash-card sinks: rows of a tab-separated deck, and note checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.functions.text import escape_tsv, strip_html

# The directives that open a deck file.
DIRECTIVES = ["#separator:tab", "#html:true", "#notetype column:1", "#deck column:2", "#tags column:5"]


def tsv_rows(cards: DataFrame, *keep: str) -> DataFrame:
    """One value per card (note_type, deck, front, back, tags), with the columns to keep."""
    tags = F.array_join(F.transform("tags", lambda t: F.regexp_replace(F.trim(t), r"\s+", "_")), " ")
    cells = [escape_tsv(F.coalesce(F.col(c), F.lit(""))) for c in ("note_type", "deck", "front", "back")]
    return cards.select(*keep, F.concat_ws("\t", *cells, tags).alias("value"))


def checksum(field: Column) -> Column:
    """A note's checksum: the first eight digits of SHA-1 of its sort field without markup, as a number."""
    return F.conv(F.substring(F.sha1(F.substring(strip_html(field), 1, 100)), 1, 8), 16, 10).cast("bigint")


def write_tsv(cards: DataFrame, path: str) -> None:
    """The rows as text files in path, and the directives, a file of their own that sorts before them."""
    tsv_rows(cards).write.mode("overwrite").text(path)
    head = cards.sparkSession.createDataFrame([("\n".join(DIRECTIVES),)], "value string")
    head.coalesce(1).write.mode("overwrite").text(f"{path}/_header")


def csv_rows(cards: DataFrame, *keep: str) -> DataFrame:
    """One value per card (front, back, tags, deck): cells without markup, in quotes."""
    plain = lambda c: F.regexp_replace(strip_html(F.coalesce(c, F.lit(""))), '"', '""')
    cells = [plain(F.col("front")), plain(F.col("back")), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "), F.coalesce("deck", F.lit(""))]
    return cards.select(*keep, F.concat(F.lit('"'), F.concat_ws('","', *cells), F.lit('"')).alias("value"))


def json_decks(cards: DataFrame, default: str = "Japanese Lyrics") -> DataFrame:
    """deck, count and json: each deck as one document of its cards (key, front, back, tags, guid) in key order."""
    named = cards.withColumn("deck", F.coalesce("deck", F.lit(default)))
    card = F.struct("key", "front", "back", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "guid", F.col("deck").alias("deckName"))
    decks = named.groupBy("deck").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list(card)).alias("c"))
    cards_ = F.transform("c", lambda x: x.dropFields("key"))
    return decks.select("deck", "count", F.to_json(F.struct(F.col("deck").alias("deckName"), "count", cards_.alias("cards"))).alias("json"))
