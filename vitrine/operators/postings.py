"""Keyword search through posting lists of three-letter grams, so that a keyword reads the texts that can hold it, not all.

Texts are stored in blocks by id. A posting is the list of a block's rows that have a gram in a column, in order and as
differences, so that no list is longer than a block. A keyword's grams are looked up, a block's lists are intersected, and the
rows that are left are read from their blocks alone and tested by the very condition of the plain search. Grams are of folded
text: lower case, without the accents of Latin letters. Rows with any other character that isn't ASCII, which a collation may
take for a Latin letter, are candidates of every keyword, so that nothing that the plain search finds is lost.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import new_folder, stored
from .search import matching

#: Letters of a gram, rows of a block (about), and blocks at most, beyond which blocks grow.
GRAM, BLOCK_ROWS, MOST_BLOCKS = 3, 16_384, 100_000
#: Rows of a block whose bits are in one long while postings are made.
WORD_BITS = 6
WORD = 1 << WORD_BITS
#: Latin letters with one accent, and what they are without it; sharp s is two letters.
_ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x180)) if len(d := unicodedata.normalize("NFD", c)) == 2 and d[0].isascii() and c == c.lower())
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)
#: What a collation may skip (controls but white space), and anything that isn't ASCII after folding.
_ODD = r"[^\t\n\x0B-\r -~]"
#: Posted for rows that are candidates of every keyword.
ANY = ""


@dataclass
class Index:
    """Folders of texts (in blocks) and postings, the searched columns and the columns in all."""

    spark: SparkSession
    texts: str
    lists: str
    columns: list[str]

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.texts)

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(self.lists)


def folded(column: str) -> Column:
    """Lower case without accents; in ASCII, where there are as many bytes as letters, nothing is left to replace."""
    low = F.lower(F.col(column))
    return F.when(F.octet_length(column) == F.length(column), low).otherwise(F.replace(F.translate(low, _ACCENTED, _PLAIN), F.lit("ß"), F.lit("ss")))


def _fold(keyword: str) -> str:
    return keyword.lower().translate(str.maketrans(_ACCENTED, _PLAIN)).replace("ß", "ss")


def grams_of(keyword: str, *, wildcards: bool = False) -> list[str] | None:
    """The grams that every text with the keyword has; none if any text may have it, that is if it has no run of GRAM letters.

    With wildcards the runs between them count. A keyword with a character that folding doesn't know has no grams either.
    """
    word = _fold(keyword)
    if re.search(_ODD, word) or wildcards and "\\" in word:
        return None
    runs = re.split("[%_]", word) if wildcards else [word]
    return sorted({r[k : k + GRAM] for r in runs for k in range(len(r) - GRAM + 1)}) or None


def _rows_of(word: Column, bits: Column) -> Column:
    """Numbers of the rows whose bits are set, in order."""
    first = F.shiftleft(word, WORD_BITS)
    return F.filter(F.sequence(first, first.bitwiseOR(F.lit(WORD - 1))), lambda row: F.getbit(bits, row.bitwiseAND(F.lit(WORD - 1))) == 1)


def build(rows: DataFrame, columns: list[str], *, id_col: str, block_rows: int = BLOCK_ROWS) -> Index:
    """Write rows in blocks by id, and the postings of columns. A null has no grams; rows of one id may be in several blocks.

    Grams are cut from bytes, one generated row each, which takes linear time. WORD rows of a block are the bits of one long, by
    which those of a row and column are posted once; a list is made of its longs, so that no row is a value to sort or to gather.
    """
    spark = rows.sparkSession
    texts, lists = new_folder(spark, "texts"), new_folder(spark, "postings")
    blocks = max(1, min(MOST_BLOCKS, -(-rows.count() // block_rows)))
    ordered = rows.repartitionByRange(blocks, F.col(id_col)).sortWithinPartitions(id_col)
    placed = ordered.withColumns({"_block": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("int")})
    placed.write.option("compression", "zstd").partitionBy("_block").parquet(texts)
    each = spark.read.parquet(texts).select("_block", "_row", F.explode(F.array(*(F.struct(F.lit(k).alias("column"), folded(c).alias("text")) for k, c in enumerate(columns)))).alias("f")).select("_block", "_row", "f.*").filter("text is not null")
    odd, place = F.col("text").rlike(_ODD), F.shiftright("_row", WORD_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_row").bitwiseAND(F.lit(WORD - 1)))
    coded = each.select("_block", place.alias("_word"), bit.alias("bit"), odd.alias("odd"), F.when(odd, F.lit(-1)).otherwise(F.col("column")).alias("column"), F.col("text").cast("binary").alias("code"))
    at = F.when(F.col("odd"), F.array(F.lit(0))).when(F.length("code") >= GRAM, F.sequence(F.lit(1), F.length("code") - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    gram = F.when(F.col("odd"), F.lit(ANY)).otherwise(F.substring("code", F.col("k"), F.lit(GRAM)).cast("string"))
    posted = coded.select("*", F.explode(at).alias("k")).select(gram.alias("gram"), "column", "_block", "_word", "bit")
    words = posted.groupBy("gram", "column", "_block", "_word").agg(F.bit_or("bit").alias("bits"))
    found = words.repartitionByRange("gram", "_block").select("gram", "column", "_block", F.struct("_word", _rows_of(F.col("_word"), F.col("bits")).alias("rows")).alias("part"))
    lists_of = found.groupBy("gram", "column", "_block").agg(F.flatten(F.sort_array(F.collect_list("part"))["rows"]).alias("at"))
    steps = F.zip_with("at", F.concat(F.array(F.lit(0)), F.slice("at", F.lit(1), F.size("at") - 1)), lambda x, before: x - before)
    lists_of.select("gram", "column", "_block", F.size("at").alias("n"), steps.alias("steps")).sortWithinPartitions("gram", "column", "_block").write.option("compression", "zstd").parquet(lists)
    return Index(spark, texts, lists, columns)


def candidates(index: Index, keyword: str, *, wildcards: bool = False) -> DataFrame | None:
    """(_block, _row) of the rows that may match: those posted for all grams in one column; None if all may.

    Lists are read by their grams, and a row is the sum of a list's differences up to it.
    """
    grams = grams_of(keyword, wildcards=wildcards)
    if grams is None:
        return None
    steps = index.postings().filter(F.col("gram").isin(ANY, *grams)).select("gram", "column", "_block", F.posexplode("steps").alias("k", "step"))
    row = F.sum("step").over(Window.partitionBy("gram", "column", "_block").orderBy("k"))
    rows = steps.withColumn("_row", row.cast("int"))
    every = rows.filter(F.col("gram") == ANY).select("_block", "_row")
    full = rows.filter(F.col("gram") != ANY).groupBy("_block", "_row", "column").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select("_block", "_row")
    return every.unionByName(full).distinct()


def search(index: Index, keyword: str, *, wildcards: bool = False) -> DataFrame:
    """The rows that matching() finds in the stored table, read from the blocks of candidates alone (MOST_BLOCKS at most)."""
    found, rows = candidates(index, keyword, wildcards=wildcards), index.rows()
    if found is not None:
        found = stored(found, "candidates")
        blocks = [r["_block"] for r in found.select("_block").distinct().collect()]
        rows = rows.filter(F.col("_block").isin(blocks)).join(found, ["_block", "_row"], "left_semi")
    return matching(rows, index.columns, keyword, wildcards=wildcards).drop("_block", "_row")
