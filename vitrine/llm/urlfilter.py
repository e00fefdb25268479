"""URL filters by a sorted digest array.

An entry is a host and the start of a path, a listed host, or the address of one listed page; one with an empty host fits
nothing. Its 64-bit xxHash stands in a sorted array that tasks map into memory; beside it lie the entries themselves. For a
URL the digests of all entries that could fit it (the domains above its host with as many labels as some entry has, each
path length that occurs, its own address) are probed by one vectorised binary search a batch, and every hit is confirmed
against the stored entry, so collisions decide nothing. Up to a stated number and size of entries the whole array is
shipped as files, once to each executor, and URLs are judged where they are, without a shuffle. A longer list is dealt into
ranges of its digests: a task maps the array of one range and searches it for the different probes of that range.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, ship

#: Rules of the contract: host, path, verdict (fixed values).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Our own list of hosts to block where no rule fits.
BLOCKED = ("spam-farm.example.org", "cheap-pills.example.com", "casino-win.example.org", "free-bets.example.com", "ads-track.example.org")
#: Entries that go through the driver and to every executor as files, at most: some 40 bytes each, held as Arrow arrays.
MOST_ENTRIES = 2_000_000
#: Bytes of their texts, at most.
MOST_BYTES = 64 << 20
#: The seed of the digests is that of Spark's xxhash64, so that both sides give the same.
SEED = 42
#: A page with more than one link per so many characters of markup is a list of links.
LINK_SPAN = 300
SCHEMA = "page_id long, host string, path string, rule string, verdict string, listed string"
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty without '://'."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((at for c in "/?#" if (at := rest.find(c)) >= 0), default=len(rest))
    path = rest[end:]
    stop = min((at for c in "?#" if (at := path.find(c)) >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


def domains(host: str, labels: list[int], longest: int) -> list[str]:
    """The domains above a host, and itself, that have so many labels (in ascending order) and no more characters, longest first."""
    out, at, dots = [], len(host), 0
    for n in labels:
        while dots < n and at >= 0:
            at = host.rfind(".", 0, at)
            dots += 1
            if len(host) - at - 1 > longest:
                return out[::-1]
        if dots == n:
            out.append(host[at + 1 :])
    return out[::-1]


def label_count(host: str) -> int:
    return host.count(".") + 1


class DigestArray:
    """Sorted digests of entries, with the entries as stored: text and verdict."""

    NAMES = ("digests", "offsets", "text", "verdicts")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays

    @staticmethod
    def build(entries: pa.Array, verdicts: np.ndarray) -> DigestArray:
        """entries: different texts, with a verdict code each."""
        digests = np.fromiter((xxhash.xxh64_intdigest(t.as_py(), seed=SEED) for t in entries), dtype=np.uint64, count=len(entries))
        order = np.argsort(digests, kind="stable")
        stored = entries.cast(pa.large_binary()).take(pa.array(order))
        _, offsets, text = stored.buffers() if len(stored) else (None, bytes(8), None)
        return DigestArray(
            {
                "digests": digests[order],
                "offsets": np.frombuffer(offsets, dtype=np.int64)[: len(stored) + 1].copy(),
                "text": np.frombuffer(text, dtype=np.uint8).copy() if text else np.empty(0, dtype=np.uint8),
                "verdicts": np.asarray(verdicts, dtype=np.int8)[order],
            }
        )

    def save(self, stem: str) -> list[str]:
        for name in self.NAMES:
            np.save(f"{stem}-{name}.npy", self.arrays[name])
        return [f"{stem}-{name}.npy" for name in self.NAMES]

    @staticmethod
    def load(path_of, stem: str) -> DigestArray:
        return DigestArray({n: np.load(path_of(f"{stem}-{n}.npy"), mmap_mode="r" if os.path.getsize(path_of(f"{stem}-{n}.npy")) > 128 else None) for n in DigestArray.NAMES})

    def find(self, texts: list[str]) -> np.ndarray:
        """Verdict code of each text that is an entry; -1 for the others."""
        out = np.full(len(texts), -1, dtype=np.int64)
        digests, offsets, stored, verdicts = (self.arrays[n] for n in self.NAMES)
        if not texts or not len(digests):
            return out
        raw = [t.encode() for t in texts]
        own = np.array([xxhash.xxh64_intdigest(t, seed=SEED) for t in raw], dtype=np.uint64)
        first, last = np.searchsorted(digests, own, "left"), np.searchsorted(digests, own, "right")
        for k in np.flatnonzero(first < last):
            for at in range(first[k], last[k]):  # more than one only where digests collide
                if stored[offsets[at] : offsets[at + 1]].tobytes() == raw[k]:
                    out[k] = verdicts[at]
        return out


def link_lists(pages: DataFrame) -> DataFrame:
    """(host,): addresses (host and path) of the pages (url, html) that have more than one link per LINK_SPAN characters, each once."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring("url", at + 3, F.length("url")))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    links = (F.length("html") - F.length(F.replace("html", F.lit("<a ")))) / 3
    rows = pages.filter(links * LINK_SPAN > F.length("html")).select(host.alias("h"), path.alias("p")).filter("h <> '' and p <> ''")
    return rows.select(F.concat("h", "p").alias("host")).distinct()


def judge(
    urls: DataFrame, rules: tuple = RULES, blocked: tuple | DataFrame = BLOCKED, *, id_col: str = "page_id", url_col: str = "url", most_entries: int = MOST_ENTRIES
) -> DataFrame:
    """Per row: SCHEMA. rule: the longest rule that fits; verdict: that rule's, else block if the URL is listed, else allow.

    blocked: entries, or a DataFrame with them as the column host. One without a slash is a host, which stands for all its
    subdomains; one with a slash is a host and the whole path of one page. listed is the longest that fits. Of a rule given
    twice the first counts; rules and entries that are null or empty fit nothing. Null URLs and those without '://' have an
    empty host and path, which no entry fits. Null ids stay null, repeated rows are judged alike, and an empty table gives no
    rows. Very long URLs cost their length times the number of different label counts. Other columns of urls are ignored,
    whatever their names.
    """
    spark = urls.sparkSession
    ship(spark)
    rules = list({(h, p): (h, p, v) for h, p, v in reversed(rules) if h}.values())[::-1]
    lengths = sorted({len(p) for _, p, _ in rules}, reverse=True)
    if isinstance(blocked, DataFrame):
        table = materialize(blocked.select("host").filter("host <> ''").distinct(), "listed")
        count, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("host")), F.lit(0))).first()
        if count > most_entries or size > MOST_BYTES:
            return _in_ranges(judge(urls, tuple(rules), (), id_col=id_col, url_col=url_col), table, -(-max(count, 1) // most_entries))
        hosts = table.toArrow()["host"].combine_chunks()
    else:
        hosts = pa.array(sorted({h for h in blocked if h}), pa.string())
    names = [h for x in hosts if "/" not in (h := x.as_py())]
    pages = len(names) < len(hosts)
    of_rules, of_hosts = (_reach(h) for h in ([h for h, _, _ in rules], names))
    listed = pc.binary_join_element_wise(pa.scalar("list", pa.large_string()), hosts.cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
    entries = pa.concat_arrays([pa.array([f"rule {h}{p}" for h, p, _ in rules], pa.large_string()), listed])
    index = DigestArray.build(entries, np.array([v == "block" for _, _, v in rules] + [True] * len(hosts)))
    stem = f"urls-{uuid.uuid4().hex}"
    for path in index.save(os.path.join(tempfile.mkdtemp(prefix="vitrine-"), stem)):
        spark.sparkContext.addFile(path)  # from the driver's own folder to each executor's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray.load(SparkFiles.get, stem)
        for batch in batches:
            found = [split_url(u) for u in batch["url"].to_pylist()]
            probes, owner = [], []
            for k, (host, path) in enumerate(found):
                own = [f"rule {d}{path[:n]}" for d in domains(host, *of_rules) for n in lengths if n <= len(path)] if host else []
                own += [f"list {host}{path}"] if pages and host and path else []
                own += [f"list {d}" for d in domains(host, *of_hosts)] if host else []
                probes += own
                owner += [k] * len(own)
            codes = index.find(probes)
            rule: list = [None] * len(found)
            verdict, listed = [0] * len(found), [None] * len(found)
            for at in np.flatnonzero(codes >= 0):
                k, (kind, text) = owner[at], (probes[at][:4], probes[at][5:])
                if kind == "list":
                    listed[k] = listed[k] or text
                elif rule[k] is None or len(text) > len(rule[k]):
                    rule[k], verdict[k] = text, int(codes[at])
            final = ["block" if (verdict[k] if rule[k] is not None else listed[k]) else "allow" for k in range(len(found))]
            columns = [[h for h, _ in found], [p for _, p in found], rule, final, listed]
            yield pa.RecordBatch.from_arrays([batch["page_id"], *(pa.array(c, pa.string()) for c in columns)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return urls.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, SCHEMA)


def _reach(hosts: Iterable[str]) -> tuple[list[int], int]:
    """The label counts that occur, and the length of the longest host."""
    counts, longest = set(), 0
    for h in hosts:
        counts.add(label_count(h))
        longest = max(longest, len(h))
    return sorted(counts), longest


def _in_ranges(judged: DataFrame, table: DataFrame, parts: int) -> DataFrame:
    """For lists beyond the bounds: different probes are dealt by ranges of digests, each range's array is searched in one task.

    A probe is a text that could be listed: a page's address, or a domain above a host; each is searched once, whatever number
    of pages ask for it, so no range is hot. The label counts that occur go through the driver; there are no more of them than
    the longest host has labels.
    """
    labels = F.length("host") - F.length(F.replace("host", F.lit("."))) + 1
    of_hosts = table.filter(~F.contains("host", F.lit("/")))
    counts, longest = of_hosts.agg(F.collect_set(labels), F.max(F.char_length("host"))).first()
    hosts = judged.filter("host <> ''").select("host").distinct()
    n = F.explode(F.filter(F.array(*(F.lit(k) for k in sorted(counts))).cast("array<int>"), lambda k: k <= labels))
    above = hosts.select("host", n.alias("n")).withColumn("entry", F.expr("substring_index(host, '.', -n)")).filter(F.char_length("entry") <= F.lit(longest or 0))
    address = F.when((F.col("host") != "") & (F.col("path") != ""), F.concat("host", "path"))
    probes = judged.select(address.alias("entry")).filter("entry is not null").union(above.select("entry")).distinct()
    found = materialize(_search(table.select(F.col("host").alias("entry")), probes, parts), "hits")
    hits = above.join(found, "entry").groupBy("host").agg(F.max_by("entry", "n").alias("domain"))
    pages = found.select(F.col("entry").alias("address"))
    rows = judged.withColumn("key", address).join(pages, F.col("key") == F.col("address"), "left").join(hits, "host", "left")
    listed = F.coalesce("address", "domain")
    verdict = F.when(F.col("rule").isNull() & listed.isNotNull(), "block").otherwise(F.col("verdict"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), listed.alias("listed"))


def _search(entries: DataFrame, probes: DataFrame, parts: int) -> DataFrame:
    """The probes (entry, each once) that are entries (entry, each once), by the sorted array of each range of digests.

    Ranges have parts to 2 * parts different numbers, so that one holds about as many entries as may be shipped.
    """
    bits = max(1, (parts - 1).bit_length())
    digest = F.xxhash64("entry")
    rows = entries.select("entry", F.lit(0).alias("probe")).union(probes.select("entry", F.lit(1).alias("probe")))
    dealt = rows.withColumn("range", F.shiftrightunsigned(digest, 64 - bits)).repartition(1 << bits, "range").sortWithinPartitions("range", "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, index = None, [], None
        with tempfile.TemporaryDirectory(prefix="vitrine-") as folder:  # this task's own files, which no other reads
            for batch in batches:
                ranges, asked = batch["range"].to_numpy(), batch["probe"].to_numpy()
                cuts = [0, *(np.flatnonzero((np.diff(ranges) != 0) | (np.diff(asked) != 0)) + 1).tolist(), len(ranges)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    if ranges[a] != current:
                        current, waiting, index = ranges[a], [], None
                    texts = batch["entry"].slice(a, b - a)
                    if not asked[a]:
                        waiting.append(texts.cast(pa.large_string()))
                        continue
                    if index is None:
                        stored = pa.concat_arrays(waiting) if waiting else pa.array([], pa.large_string())
                        stem, waiting = os.path.join(folder, f"range-{current}"), []
                        DigestArray.build(stored, np.ones(len(stored), dtype=np.int8)).save(stem)
                        index = DigestArray.load(str, stem)
                    hit = index.find(texts.to_pylist()) >= 0
                    yield pa.RecordBatch.from_arrays([texts.filter(pa.array(hit)).cast(pa.string())], names=["entry"])

    return dealt.mapInArrow(run, "entry string")


def oracle(rules: tuple = RULES, blocked: tuple = BLOCKED, own: bool = False) -> str:
    """The result in DuckDB's SQL. own: the addresses of lists of links are listed, too."""
    listed = ", ".join(f"('{h}')" for h in blocked)
    stated = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    more = f"UNION SELECT host || path FROM split JOIN pages USING (page_id) WHERE (length(html) - length(replace(html, '<a ', ''))) / 3 * {LINK_SPAN} > length(html) AND host <> '' AND path <> ''" if own else ""
    return rf"""
WITH rules(rh, rp, rv) AS (VALUES {stated}), hosts(lh) AS (VALUES {listed}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM parts
), listed AS (FROM hosts {more}), ruled AS (
  SELECT page_id, host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS rv
  FROM split LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL
), hits AS (
  SELECT page_id, max_by(lh, length(lh)) AS hit FROM (
    SELECT page_id, lh FROM split JOIN hosts ON host = lh OR ends_with(host, '.' || lh) UNION ALL SELECT page_id, lh FROM split JOIN listed ON path <> '' AND host || path = lh
  ) GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN hit IS NULL THEN 'allow' ELSE 'block' END) AS verdict, hit AS listed
FROM ruled LEFT JOIN hits USING (page_id)
"""
