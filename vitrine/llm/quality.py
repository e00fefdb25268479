"""Quality classifier by importance resampling with hashed n-gram models.

Two bag-of-n-grams models over the same BUCKETS: the raw model counts all documents, the target model a bounded sample of
labelled good ones; n-grams are runs of NGRAM bytes. A document's ratio is the mean over its n-grams of the log of target
over raw, without the document's own counts in either, so that it is judged by the others alone; each ratio is drawn
towards 1 by PRIOR expected occurrences. The log weight is the ratio on the scale of log odds: a logistic curve with two
parameters, fitted on labelled documents. Documents are then resampled: Gumbel noise of scale 1 is added to the log
weight, and the k largest keys stay, which draws k documents without replacement by their weights. k is a share of all
documents, or else the number of keys that reach the one which keeps KEEP_GOOD of the labelled good documents.

Models are BUCKETS numbers each, whatever the corpus's size. N-grams are counted for a portion of texts at once; a text
longer than a portion is counted piece by piece, so that memory doesn't grow with it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize, ship

#: Bytes of an n-gram, and hash buckets (a power of two); a model is broadcast and has 8 bytes a bucket.
NGRAM, BUCKET_BITS = 4, 18
BUCKETS = 1 << BUCKET_BITS
#: Labelled documents of each kind, good and others, that are used at most; drawn by a hash of the id.
LABEL_SAMPLE = 50_000
#: Occurrences by which a ratio is drawn towards 1.
PRIOR = 3.0
#: Share of the labelled good documents that stay where no share of all is given.
KEEP_GOOD = 0.995
#: Weight of the squared slope in the fit of the curve, which bounds it where labels can be told apart without fault.
RIDGE = 0.01
#: Bytes and texts that are counted at once.
BATCH_BYTES, BATCH_TEXTS = 1 << 19, 1 << (32 - BUCKET_BITS)


def _buckets(raw: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram at each byte, where one begins."""
    n = max(0, len(raw) - NGRAM + 1)
    value = np.zeros(n, dtype=np.uint64)
    for k in range(NGRAM):
        value = value * np.uint64(257) + raw[k : k + n]
    return (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the text) of every n-gram; none reaches across two texts."""
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends, begins = np.cumsum(lengths), np.ones(len(raw), dtype=bool)
    for k in range(1, NGRAM):
        begins[(ends - k)[lengths >= k]] = False
    found = _buckets(raw)
    return found[begins[: len(found)]], np.repeat(np.arange(len(texts), dtype=np.uint64), np.maximum(lengths - NGRAM + 1, 0))


def _pieces(text: bytes) -> Iterator[np.ndarray]:
    """The buckets of a text's n-grams, piece by piece."""
    raw = np.frombuffer(text, dtype=np.uint8)
    for k in range(0, len(raw), BATCH_BYTES):
        yield _buckets(raw[k : k + BATCH_BYTES + NGRAM - 1])


def _portions(texts: list[bytes]) -> Iterator[slice]:
    """Runs of texts of at most BATCH_BYTES together; a longer text is a run of its own."""
    start, held = 0, 0
    for k, text in enumerate(texts):
        if k > start and (held + len(text) > BATCH_BYTES or k - start == BATCH_TEXTS):
            yield slice(start, k)
            start, held = k, 0
        held += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def _texts_of(batch: pa.Array) -> list[bytes]:
    return batch.cast(pa.binary()).to_pylist()


def ngram_counts(docs: DataFrame, fitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket over all rows of (doc_id, text), and over those with an id in fitted (sorted).

    Each task sums its own rows before the shuffle; the driver gets two numbers a bucket.
    """
    held = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of_target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            own, inside = _texts_of(batch["text"]), _is_in(batch["doc_id"], held.value)
            for part in _portions(own):
                if part.stop - part.start == 1:
                    for bucket in _pieces(own[part.start]):
                        counts = np.bincount(bucket.view(np.int64), minlength=BUCKETS)
                        total += counts
                        of_target += counts * inside[part.start]
                else:
                    bucket, owner = ngrams(own[part])
                    total += np.bincount(bucket.view(np.int64), minlength=BUCKETS)
                    of_target += np.bincount(bucket[inside[part][owner.view(np.int64)]].view(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(of_target[at])], names=["bucket", "n", "target"])

    sums = docs.mapInArrow(run, "bucket long, n long, target long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("target").alias("target")).toArrow()
    out = np.zeros((2, BUCKETS))
    out[:, sums["bucket"].to_numpy()] = [sums["n"].to_numpy(), sums["target"].to_numpy()]
    return out[0], out[1]


def _is_in(ids: pa.Array, fitted: np.ndarray) -> np.ndarray:
    """Whether each id is one of fitted (sorted); a null isn't."""
    own, known = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
    at = np.searchsorted(fitted, own)
    return known & (at < len(fitted)) & (np.append(fitted, 0)[at] == own)


def _ratio(target, raw, counts, fitted, n, totals: tuple[float, float]) -> np.ndarray:
    """Log ratios of buckets to a document's counts and n n-grams, without its own: in raw, and in target if fitted."""
    expected = np.maximum(raw - counts, 0) * ((totals[0] - n * fitted) / np.maximum(totals[1] - n, 1))
    return np.log((target - counts * fitted + PRIOR) / (expected + PRIOR))


def mean_ratios(texts: list[bytes], fitted: np.ndarray, target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The mean log ratio of each text; 0 for one without n-grams."""
    out, totals = np.zeros(len(texts)), (target.sum(), raw.sum())
    for part in _portions(texts):
        if part.stop - part.start == 1:
            counts = np.zeros(BUCKETS)
            for bucket in _pieces(texts[part.start]):
                counts += np.bincount(bucket.view(np.int64), minlength=BUCKETS)
            at, n = np.flatnonzero(counts), max(counts.sum(), 1)
            out[part.start] = (_ratio(target[at], raw[at], counts[at], fitted[part.start], n, totals) * counts[at]).sum() / n
            continue
        bucket, owner = ngrams(texts[part])
        keys = ((owner << np.uint64(BUCKET_BITS)) | bucket).astype(np.uint32)
        keys.sort()
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(first, len(keys)))
        of, at = (keys[first] >> np.uint32(BUCKET_BITS)).astype(np.int64), (keys[first] & np.uint32(BUCKETS - 1)).astype(np.int64)
        size = part.stop - part.start
        n = np.maximum(np.bincount(owner.view(np.int64), minlength=size), 1)
        out[part] = np.bincount(of, _ratio(target[at], raw[at], counts, fitted[part][of], n[of], totals) * counts, minlength=size) / n
    return out


def _weigher(spark: SparkSession, target: np.ndarray, raw: np.ndarray, fitted: np.ndarray) -> Callable[[Column, Column], Column]:
    """The mean ratio as a function of the columns doc_id and text. The models and ids are of a fixed size."""
    model = spark.sparkContext.broadcast((target, raw, fitted))

    @F.arrow_udf("double")
    def weigh(doc_id: pa.Array, text: pa.Array) -> pa.Array:
        of_target, of_all, ids = model.value
        return pa.array(mean_ratios(_texts_of(text), _is_in(doc_id, ids), of_target, of_all))

    return weigh


def fit_curve(ratios: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the log odds of being good, by Newton's method."""
    spread = float(ratios.std()) or 1.0
    x, w = np.stack([ratios / spread, np.ones(len(ratios))]), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + np.diag([RIDGE, RIDGE]), x @ (p - good) + RIDGE * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]) / spread, float(w[1])


def gumbel(doc_id: Column, text_hash: Column, seed: int) -> Column:
    """Gumbel noise that depends on a document's id and text alone."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, text_hash, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def label_sample(labels: DataFrame, seed: int) -> DataFrame:
    """(doc_id, good) of at most LABEL_SAMPLE labelled documents of each kind. An id is good if all its labels say so."""
    known = labels.filter("quality is not null and toxic is not null and doc_id is not null")
    by_id = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_and((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    drawn = [by_id.filter(F.col("good") == kind).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(LABEL_SAMPLE) for kind in (True, False)]
    return materialize(drawn[0].unionAll(drawn[1]), "labels")


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, share: float | None, seed: int) -> tuple[DataFrame, Column]:
    """The rows of classify, and for docs whether a row stays."""
    ship(docs.sparkSession)
    text, id_ = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    source = docs.select(id_.alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    sample = label_sample(labels, seed)
    fitted = np.sort(sample.filter("good").select("doc_id").toArrow()["doc_id"].to_numpy())
    raw, target = ngram_counts(source.select("doc_id", "text"), fitted)
    weigh = _weigher(source.sparkSession, target, raw, fitted)
    scored = materialize(source.select("doc_id", "text_hash", weigh("doc_id", "text").alias("ratio")), "ratios")
    # one row an id, so that what reaches the driver is bounded by the sample
    known = scored.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "good").agg(F.min(F.struct("ratio", "text_hash")).alias("r"))
    noise = gumbel(F.col("doc_id"), F.col("r.text_hash"), seed).alias("noise")
    seen = known.select("good", "r.ratio", noise).toArrow()
    good, ratios = (seen[c].to_numpy() for c in ("good", "ratio"))
    if not good.any() or good.all():
        return scored.select("doc_id", "text_hash", F.lit(0.0).alias("log_weight"), gumbel(F.col("doc_id"), F.col("text_hash"), seed).alias("sample_key"), F.lit(True).alias("kept")), F.lit(True)
    slope, offset = fit_curve(ratios, good.astype(float))
    key = lambda ratio, own_id, own_hash: ratio * F.lit(slope) + F.lit(offset) + gumbel(own_id, own_hash, seed)
    scored = scored.withColumn("log_weight", F.col("ratio") * F.lit(slope) + F.lit(offset)).withColumn("sample_key", key(F.col("ratio"), F.col("doc_id"), F.col("text_hash")))
    if share is None:
        reached = np.sort((ratios * slope + offset + seen["noise"].to_numpy())[good])
        least = float(reached[int(len(reached) * (1 - KEEP_GOOD))])
    else:
        least = _kth_largest(scored, round(share * scored.count()))
    stays = F.lit(True) if least is None else key(weigh(id_, text), id_, F.xxhash64(text)) >= F.lit(least)
    return scored.select("doc_id", "text_hash", "log_weight", "sample_key", (F.lit(True) if least is None else F.col("sample_key") >= F.lit(least)).alias("kept")), stays


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float | None = None, seed: int = 11) -> DataFrame:
    """Per row: doc_id, text_hash, log_weight, sample_key, kept.

    labels: doc_id, quality, toxic; good is quality 1 and toxic 0, and rows with nulls are no labels. share: of all
    documents that stay; if not given, as many as reach the key that keeps KEEP_GOOD of the labelled good ones. Null and
    empty texts, and those shorter than an n-gram, have a mean ratio of 0. A null id is no labelled one. Rows with one
    id and text have one key, and ties at the k-th place all stay. Without labelled documents of both kinds all rows
    stay, with weight 0. Very long texts are counted in pieces. An empty table gives no rows. Other columns of docs are
    ignored, whatever their names. Reruns agree.
    """
    return _scored(docs, labels, id_col, text_col, share, seed)[0]


def drop_rejected(docs: DataFrame, labels: DataFrame, *, share: float | None = None, seed: int = 11) -> DataFrame:
    """The rows of docs (doc_id, text and any other columns) that classify keeps; what it says of nulls and ties holds.

    Ratios are computed a second time where the rows are, which costs less than joining texts to the first ones.
    """
    return docs.filter(_scored(docs, labels, "doc_id", "text", share, seed)[1])


def _kth_largest(rows: DataFrame, k: int) -> float | None:
    """The k-th largest sample_key: a histogram finds its bin, and only that bin is sorted. None if all rows are asked for."""
    low, high, n = rows.agg(F.min("sample_key"), F.max("sample_key"), F.count(F.lit(1))).first()
    if k >= n:
        return None
    if k <= 0:
        return math.inf
    while True:
        if low == high:
            return low
        bins = max(64, math.isqrt(n))
        width = (high - low) / bins
        at = F.least(F.floor((F.col("sample_key") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        inside = rows.filter(F.col("sample_key").between(low, high))
        above = rows.filter(F.col("sample_key") > high).count()
        counts = inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("sample_key").alias("low"), F.max("sample_key").alias("high"))
        until = F.sum("n").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = counts.withColumn("until", until + above).filter(F.col("until") >= k).orderBy("until").first()
        if found["low"] == found["high"] or found["n"] <= 10_000:
            rank = k - (found["until"] - found["n"])
            return rows.filter(F.col("sample_key").between(found["low"], found["high"])).select("sample_key").orderBy(F.desc("sample_key")).limit(rank).agg(F.min("sample_key")).first()[0]
        low, high, n = found["low"], found["high"], found["n"]
