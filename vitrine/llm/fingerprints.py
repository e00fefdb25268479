"""Document fingerprints by winnowing, with DataFrame operations only.

The hash of every run of K words is a cyclic polynomial of the words' hashes, the one that a rolling hash has at that
place. It rolls here over run lengths instead of places, for all places at once: the hash of a + b words is that of the
first a, turned by b, exclusive-or that of the next b, so that K words take as many steps as K has binary digits. Of every
WINDOW neighbouring hashes the least is chosen, of equal ones the rightmost; hash and position are held in one long whose
order is just that, so that minima by doubling (windows of 2, 4, 8) choose both. Any run of WINDOW + K - 1 words that two
texts share gives them a common fingerprint, and positions tell where.

The next document by id is found in buckets of ids (a piecewise linear map of id quantiles, so that buckets are even; an
id that many rows have, or none, is dealt to buckets by its texts' hashes); each bucket also holds the first document of
the next one. Texts are shuffled once, whatever their sources, into as many partitions as rows, bytes and cores ask for; ids and hashes
are kept in a table of their own, from which buckets are made.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import SPACES, materialize

#: Words in a hash, hashes in a window (a power of two).
K, WINDOW = 3, 8
#: Bits for a position: a string has under 2^31 bytes, a word and its gap at least two. The other bits hold the hash.
POSITION_BITS = 30
_POSITIONS = (1 << POSITION_BITS) - 1
_HASHES = (1 << (64 - POSITION_BITS)) - 1
#: Rows of a bucket of neighbouring ids, buckets of a partition, buckets whose first rows are broadcast at most (some 100
#: bytes each; more are joined), and cuts between ranges of ids.
BUCKET_ROWS, PARTITION_BUCKETS, MOST_BROADCAST, QUANTILES = 1000, 8, 1_000_000, 128
#: Rows of a bucket at least where there are few for all cores, and bytes of texts of a partition (about).
LEAST_ROWS, PARTITION_BYTES = 100, 16_000_000


def _turn(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def with_fingerprint(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Add column out: an array of chosen (hash, position) longs in order of position; none for a text without words.

    A text of fewer than K words has one hash, of all its words.
    """
    words, hashes, grams = f"{out}_words", f"{out}_hashes", f"{out}_grams"
    rows = rows.withColumn(words, F.filter(F.split(F.lower(F.col(text)), f"[{SPACES}]+"), lambda w: w != ""))
    rows = rows.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))

    short = F.array(_packed(F.xxhash64(F.col(words)), F.lit(0)))
    n = F.size(words)
    length = 0
    for digit in f"{K:b}":  # twice as many words, and one more where the digit is 1
        if length:
            rows, length = rows.withColumn(grams, _joined(grams, length, grams, length)), 2 * length
            rows, length = (rows.withColumn(grams, _joined(grams, length, hashes, 1)), length + 1) if digit == "1" else (rows, length)
        else:
            rows, length = rows.withColumn(grams, F.col(hashes)), 1
    full = F.transform(F.slice(grams, F.lit(1), F.greatest(n - (K - 1), F.lit(0))), _packed)
    rows = rows.withColumn(grams, F.when(n >= K, full).when(n > 0, short).otherwise(F.array().cast("array<long>")))
    rows = rows.withColumn(out, F.col(grams))
    width = 1
    while width < WINDOW:
        ahead = F.slice(out, F.lit(1 + width), F.greatest(F.size(out), F.lit(1)))
        rows = rows.withColumn(out, F.zip_with(out, ahead, lambda a, b: F.least(a, b)))
        width *= 2
    chosen = F.array_distinct(F.slice(out, F.lit(1), F.greatest(F.size(out) - (WINDOW - 1), F.lit(1))))
    return rows.withColumn(out, chosen).drop(words, hashes, grams)


def _joined(first: str, a: int, then: str, b: int) -> Column:
    """At each place the hash of a + b words: of first's a words and of then's b words after them; null where the text ends."""
    return F.zip_with(first, F.slice(then, F.lit(1 + a), F.greatest(F.size(then), F.lit(1))), lambda x, y: _turn(x, b).bitwiseXOR(y))


def _packed(value: Column, place: Column) -> Column:
    """Hash above (signed, as longs are compared), position below, so that of equal hashes the rightmost is the least."""
    return F.shiftleft(value, POSITION_BITS).bitwiseOR(F.lit(_POSITIONS) - place.cast("long"))


def shown(fingerprint: str) -> Column:
    """The fingerprint as a string: hash in hexadecimal, colon, position of its first word; comma-joined."""
    return F.array_join(F.transform(fingerprint, lambda v: F.concat(F.hex(F.shiftrightunsigned(v, POSITION_BITS)), F.lit(":"), F.lit(_POSITIONS) - v.bitwiseAND(F.lit(_POSITIONS)))), ",")


def hashes_of(fingerprint: str) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda v: F.shiftrightunsigned(v, POSITION_BITS)))


def likeness(a: str, b: str) -> Column:
    """Share of the common among all hashes of two fingerprints; 1 if neither has any."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(1.0)


def _id_buckets(docs: DataFrame) -> tuple[Column, int, int]:
    """The bucket of a row (doc_id, text_hash) in the order of ids and hashes, and the numbers of buckets and of partitions.

    docs: doc_id and bytes of every row. Partitions are as many as rows, bytes and cores ask for.

    Ranges of ids between quantiles have as many buckets as their rows ask for. An id that is several quantiles, and the
    null, are ranges of their own, whose buckets divide the hashes. Only the cuts, a fixed number, are on the driver.
    """
    low, high, known, n, size, cuts = docs.agg(
        F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0)), F.percentile_approx("doc_id", F.array(*(F.lit(k / QUANTILES) for k in range(1, QUANTILES))), 10 * QUANTILES)
    ).first()
    by_hash = (F.col("text_hash").cast("double") + 2.0**63) / 2.0**64
    cores = docs.sparkSession.sparkContext.defaultParallelism
    in_bucket = min(BUCKET_ROWS, max(LEAST_ROWS, math.ceil(n / (4 * cores))))
    width = lambda rows: max(1, math.ceil(rows / in_bucket))
    parts = lambda buckets: min(buckets, max(math.ceil(n / (BUCKET_ROWS * PARTITION_BUCKETS)), math.ceil(size / PARTITION_BYTES), 4 * cores))
    spread = lambda share, parts: F.least(F.floor(share * parts), parts - 1)
    nulls = width(n - known)
    if low is None:
        return spread(by_hash, F.lit(nulls)).cast("long"), nulls, parts(nulls)
    starts = {low: 0}  # of a range of ids: how many quantiles lie in it
    for c in cuts:
        starts[c] = starts.get(c, 0) + 1
    ranges = []
    for a, b in zip(sorted(starts), [*sorted(starts)[1:], high + 1], strict=True):
        if starts[a] > 1 and b > a + 1:
            ranges += [(a, a + 1, starts[a]), (a + 1, b, 1)]
        else:
            ranges.append((a, b, max(1, starts[a])))
    widths = [width(known * share / QUANTILES) for _, _, share in ranges]
    offsets = [nulls + sum(widths[:k]) for k in range(len(widths))]
    first, last, counts, offset = (F.array(*(F.lit(float(x) if k < 2 else x) for x in column)) for k, column in enumerate(([a for a, _, _ in ranges], [b for _, b, _ in ranges], widths, offsets)))
    at = F.greatest(F.size(F.filter(F.array(*(F.lit(a) for a, _, _ in ranges)), lambda x: x <= F.col("doc_id"))), F.lit(1))
    a, b = F.element_at(first, at), F.element_at(last, at)
    share = F.when(b - a <= 1, by_hash).otherwise((F.col("doc_id") - a) / (b - a))
    found = F.element_at(offset, at) + spread(share, F.element_at(counts, at))
    return F.when(F.col("doc_id").isNull(), spread(by_hash, F.lit(nulls))).otherwise(found).cast("long"), nulls + sum(widths), parts(nulls + sum(widths))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the next row by id, and of the first row after the last.

    Null ids come first; rows with one id are in the order of a hash of their texts. Rows that agree in both stay in one
    bucket.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    keys = materialize(hashed.select("doc_id", "text_hash", F.octet_length("text").cast("long").alias("bytes")), "keys")
    bucket, buckets, parts = _id_buckets(keys.select("doc_id", "bytes"))
    keyed = hashed.withColumn("bucket", bucket)
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("id"), F.col("text_hash").alias("hash"))
    firsts = keys.withColumn("bucket", bucket).groupBy("bucket").agg(F.min(order).alias("first"))
    by_bucket = Window.orderBy("bucket")
    back = F.coalesce(F.lag("bucket").over(by_bucket), F.max("bucket").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select("first", F.col("bucket").alias("at"), back.alias("before"))
    dealt = keyed.join(F.broadcast(firsts) if buckets <= MOST_BROADCAST else firsts, (order == F.col("first")) & (F.col("bucket") == F.col("at")), "left")
    copies = F.array(F.struct(F.col("bucket"), F.lit(False).alias("beyond")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("beyond")))
    dealt = dealt.withColumn("to", F.explode(F.filter(copies, lambda c: c["bucket"].isNotNull()))).select("doc_id", "text", "text_hash", "to.*")
    # by ranges of buckets, as hashes of so few of them would fill partitions unevenly
    dealt = dealt.repartitionByRange(parts, "bucket")
    ordered = Window.partitionBy("bucket").orderBy("beyond", F.col("doc_id").asc_nulls_first(), "text_hash")
    return dealt.withColumn("next_text", F.lead("text").over(ordered))


def compare_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document's. Null texts count as empty; a text without words has an empty fingerprint. A table of one row is its own
    next; an empty table gives no rows. Repeated rows come after each other. Very long texts are single values in arrays of
    their words; nothing is cut. Other columns of docs are ignored, whatever their names.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(source).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = with_fingerprint(rows, "text", "own").withColumn("own_set", hashes_of("own"))
    ordered = Window.partitionBy("bucket").orderBy("beyond", F.col("doc_id").asc_nulls_first(), "text_hash")
    rows = rows.withColumn("next_set", F.lead("own_set").over(ordered)).filter("not beyond")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half))
    rows = with_fingerprint(rows.withColumn("edited", edited), "edited", "changed").withColumn("changed_set", hashes_of("changed"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown("own").alias("fingerprint"),
        shown("changed").alias("edited_fingerprint"),
        likeness("own_set", "changed_set").alias("near_edited"),
        likeness("own_set", "next_set").alias("near_next"),
    )
