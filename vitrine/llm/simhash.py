"""Near-duplicates by SimHash: tiled exact comparison of fingerprints by exclusive-or and bit counts.

Fingerprints are made per text and grouped, so that copies cost one row. Every pair within the radius shares a block:
blocks are the bits outside some pieces (with more pieces than differing bits, enough pieces agree). A block of up to
TILE fingerprints is one tile. A larger one is dealt into tiles by bit count; tiles meet only if their bit counts allow a
pair within the radius, each pair of tiles in its own task. Tiles give a star for each component of their links instead
of all pairs. Components of the links are found by joins.

Near-duplicates on word shingles take the same three steps. Bands of minima of the shingle hashes deal texts into blocks, as
no pieces of bits would at so wide a radius; fingerprints that meet in a tile of a block are compared by exclusive-or and bit
counts; only texts whose fingerprint has another within the radius in its tile are read, and the exact similarity decides. A
block is first confirmed against one of its texts at a time, which joins most of a group of near copies by as many
comparisons as it has texts. In a block that PIVOTS rounds leave in several components, the texts outside the component of
one of them are compared with all, in tiles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import MOST_BROADCAST, NO_ID, keep_rows, materialize, ship, text_of
from .components import components

TILE = 4096
#: Blocks of so many fingerprints are compared neighbour by neighbour over a whole batch.
SMALL = 8
SEED = 42
#: Near-duplicates on word shingles: words, bits, and bands of minima (a similarity of 0.8 shares none of them once in 40,000
#: pairs). Links are then confirmed by the similarity itself, a ratio of whole numbers, in tiles of so many texts and shingles.
NEAR_WORDS, NEAR_BITS, NEAR_BANDS = 5, 256, (20, 4)
SIMILARITY, TEXT_TILE, SHINGLE_TILE = (4, 5), 512, 2_000_000
#: Bits in which fingerprints of texts that similar may differ. 4 of 5 common shingles are the worst case: a bit then differs
#: with odds of 3/16, more than 96 of 256 do once in 10^12 pairs; unrelated texts are that near once in 26,000.
NEAR_RADIUS = 96
#: Rounds in which a block's texts are compared with one of them.
PIVOTS = 2
#: Bytes of a text whose words are held at once, and hashes whose bits are.
PORTION, BIT_ROWS = 4 << 20, 1 << 16
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_MIX = np.random.default_rng(SEED).integers(0, 2**63, size=(2, 1024), dtype=np.uint64) | np.uint64(1)


def word_portions(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about PORTION bytes."""
    start = 0
    while start < len(text):
        stop = min(len(text), start + PORTION)
        if stop < len(text):
            stop = gap.start() if (gap := _GAP.search(text, stop)) else len(text)
        yield text[start:stop].split()
        start = stop


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of so many words, joined by spaces; of all words if they are fewer."""
    out, carried = [], []
    for part in word_portions(text.translate(_LOWER)):
        found = carried + part
        if len(found) < words:
            carried = found
            continue
        line = b" ".join(found)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(found) - words + 1].tolist()
        runs = (line[a:b] for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True))
        out.append(np.fromiter((xxhash.xxh64_intdigest(run, SEED) for run in runs), dtype=np.uint64, count=len(starts)))
        carried = found[len(found) - words + 1 :]
    if not out and carried:
        out.append(np.array([xxhash.xxh64_intdigest(b" ".join(carried), SEED)], dtype=np.uint64))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def simhash(hashes: np.ndarray, bits: int) -> bytes:
    """Big-endian fingerprint: a bit is 1 if it is set in over half the hashes. Beyond 64 bits the hashes are mixed anew."""
    words = []
    for k in range(bits // 64):
        ones = np.zeros(64, dtype=np.int64)
        for start in range(0, len(hashes), BIT_ROWS):
            part = hashes[start : start + BIT_ROWS]
            own = part if not k else _scramble(part * _MIX[0, k])
            ones += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        words.append(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()[::-1])
    return b"".join(words)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """A key for each band of minima; two texts share a band's key with the rows-th power of their Jaccard similarity."""
    n = bands * rows
    least = np.full(n, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096]
        np.minimum(least, _scramble(part[None, :] * _MIX[0, :n, None] + _MIX[1, :n, None]).min(axis=1), out=least)
    folded = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        folded = _scramble(folded * np.uint64(0x9E3779B97F4A7C15) + column)
    return folded.view(np.int64).tolist()


def fingerprints(docs: DataFrame, words: int, bits: int = 64, bands: tuple[int, int] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp, ones (its bits that are set), shingles and, with bands (how many, of how many minima each), blocks. No words: all bits 0.

    With bands, repeats of a shingle count once, as for the Jaccard similarity; otherwise each counts.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, blocks, shingles = [], [], []
            for text in batch["text"].cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(text, words)
                hashes = np.unique(hashes) if bands else hashes
                prints.append(simhash(hashes, bits))
                shingles.append(len(hashes))
                if bands:
                    blocks.append(band_keys(hashes, *bands))
            ones = [int.from_bytes(p, "big").bit_count() for p in prints]
            columns = {"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "fp": pa.array(prints, pa.binary()), "ones": pa.array(ones, pa.int32()), "shingles": pa.array(shingles, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | ({"blocks": pa.array(blocks, pa.list_(pa.int64()))} if bands else {}))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return source.mapInArrow(run, "doc_id long, text_hash long, fp binary, ones int, shingles long" + ", blocks array<long>" * bool(bands))


def piece_blocks(prints: DataFrame, radius: int, spare: int = 2) -> DataFrame:
    """(block, fp, ones): a block for each choice of spare pieces out of radius + spare, for 64-bit fingerprints.

    Two fingerprints that differ in at most radius bits agree in at least spare of the pieces, so they share a block.
    """
    pieces = radius + spare
    edges = [64 * k // pieces for k in range(pieces + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    chosen = [sum(c) for c in combinations(masks, spare)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch["fp"].to_pylist()
            own = np.frombuffer(b"".join(raw), ">u8").astype(np.uint64)
            for k, mask in enumerate(chosen):
                keys = _scramble((own & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15) + _MIX[1, k])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch["fp"], batch["ones"]], names=["block", "fp", "ones"])

    return prints.select("fp", "ones").mapInArrow(run, "block long, fp binary, ones int")



def tiles(blocks: DataFrame, radius: int) -> DataFrame:
    """(block, tile, side, fp): the groups that are compared. Side 2: the rows of a tile meet each other; 0 and 1: the sides meet."""
    counted = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
    large = counted.filter(F.col("rows") > TILE).select("block")
    hot = materialize(blocks.join(large, "block", "left_semi"), "large_blocks")
    parts = hot.groupBy("block", "ones").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))
    maps = parts.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("ones", "parts"))).alias("parts"))
    cell = F.struct(F.col("ones"), F.pmod(F.xxhash64("fp"), F.col("parts")[F.col("ones")].cast("long")).cast("int").alias("part"))
    near = F.expr(
        f"flatten(transform(filter(map_keys(parts), o -> abs(o - ones) <= {radius}), "
        "o -> transform(sequence(0, parts[o] - 1), p -> named_struct('ones', o, 'part', p))))"
    )
    met = hot.join(maps, "block").withColumn("cell", cell).withColumn("other", F.explode(near))
    dealt = met.select(
        "block",
        F.xxhash64(F.least("cell", "other"), F.greatest("cell", "other")).alias("tile"),
        F.when(F.col("cell") == F.col("other"), 2).otherwise((F.col("cell") > F.col("other")).cast("int")).alias("side"),
        "fp",
    )
    plain = blocks.join(counted.filter(F.col("rows") <= TILE).select("block"), "block", "left_semi").select("block", F.lit(0).cast("long").alias("tile"), F.lit(2).alias("side"), "fp")
    return plain.unionAll(dealt)


def _close(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs within the radius, tile by tile; a and b are in order of bit counts."""
    ones_a, ones_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    left, right = [], []
    for i in range(0, len(a), 128):
        lo, hi = ones_a[i] - radius, ones_a[min(i + 128, len(a)) - 1] + radius
        for j in range(0, len(b), 128):
            if ones_b[j] > hi or ones_b[min(j + 128, len(b)) - 1] < lo:
                continue  # no pair of these tiles can lie within the radius
            apart = np.zeros((len(a[i : i + 128]), len(b[j : j + 128])), dtype=np.int64)
            for k in range(a.shape[1]):
                apart += np.bitwise_count(a[i : i + 128, None, k] ^ b[None, j : j + 128, k])
            x, y = np.nonzero(apart <= radius)
            left.append(x + i)
            right.append(y + j)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def _stars(prints: list[bytes], left: np.ndarray, right: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Links that join what the given pairs join: each print with the least one of its component.

    The least print is nearly always the same in all the blocks where a group meets, so most links coincide.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            if prints[rb] < prints[ra]:
                ra, rb = rb, ra
            parent[rb] = ra
    return [(prints[x], prints[r]) for x in list(parent) if (r := root(x)) != x]


def _by_tile(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole tiles of rows that come in order of keys, and the first row of each tile."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
        names = np.stack([held[k].to_numpy() for k in keys], axis=1)
        edges = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
        if len(edges):  # the last tile may go on in the next batch
            yield held.slice(0, edges[-1]), np.concatenate([[0], edges[:-1]])
            held = held.slice(edges[-1]).combine_chunks()
    if held is not None:
        yield held, np.zeros(1, dtype=np.int64)


def _pairs(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])


def links(dealt: DataFrame, radius: int) -> DataFrame:
    """(a, b): fingerprints whose links join all pairs within the radius that meet in a tile."""

    def compare(group: np.ndarray, side: np.ndarray, raw: list[bytes]) -> list[tuple[bytes, bytes]]:
        order = np.argsort(np.bitwise_count(group).sum(axis=1, dtype=np.int64), kind="stable")
        if side[0] == 2:
            own = group[order]
            x, y = _close(own, own, radius)
            keep = x < y
            return _stars(raw, order[x[keep]], order[y[keep]])
        p, q = order[side[order] == 0], order[side[order] == 1]
        x, y = _close(group[p], group[q], radius)
        return _stars(raw, p[x], q[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _by_tile(batches, ("block", "tile")):
            flat = rows["fp"].to_pylist()
            prints, side = np.frombuffer(b"".join(flat), ">u8").astype(np.uint64).reshape(len(flat), -1), rows["side"].to_numpy()
            sizes = np.diff(np.concatenate([starts, [len(flat)]]))
            pairs, near = [], []
            small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes) & (side == 2)
            group = np.repeat(np.arange(len(sizes)), sizes)
            for gap in range(1, SMALL):
                at = np.flatnonzero(small[:-gap] & (group[:-gap] == group[gap:]))
                if not len(at):
                    break
                at = at[np.bitwise_count(prints[at] ^ prints[at + gap]).sum(axis=1, dtype=np.int64) <= radius]
                near.append((at, at + gap))
            if near:
                pairs += _stars(flat, *map(np.concatenate, zip(*near, strict=True)))
            for k in np.flatnonzero(sizes > 1):
                s = slice(starts[k], starts[k] + sizes[k])
                if not small[s.start]:
                    pairs += compare(prints[s], side[s], flat[s])
            yield _pairs(pairs)

    ordered = dealt.select("block", "tile", F.col("side").cast("int").alias("side"), "fp").repartition("block", "tile").sortWithinPartitions("block", "tile")
    return ordered.mapInArrow(run, "a binary, b binary")


def _rooted(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """(fp, root): the component of every node (fp) by the links near (a, b), named by its least fingerprint."""
    found = components(near).select(F.col("node").alias("fp"), "root")
    return nodes.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def classes(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root): the component of every fingerprint, named by its least fingerprint."""
    nodes = prints.select("fp", "ones").distinct()
    blocks = materialize(piece_blocks(nodes, radius), "blocks")
    return _rooted(nodes, materialize(links(tiles(blocks, radius), radius), "links"))


def near_duplicates(docs: DataFrame, *, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (hexadecimal), component_id: the smallest id linked to it, directly or through others.

    Null texts count as empty; all texts without words have fingerprint 0 and so are linked. Null ids are no smallest
    ids: a component of null ids alone has a null id. Repeated rows are in one component. Very long texts are hashed in
    portions; their hashes, 8 bytes a word, are held whole. An empty table gives no rows. Other columns of docs are ignored, whatever their names.
    """
    prints = materialize(fingerprints(docs, words, id_col=id_col, text_col=text_col).drop("text_hash", "shingles"), "fingerprints")
    nodes = materialize(prints.groupBy("fp", "ones").agg(F.min("doc_id").alias("least")), "nodes")
    found = materialize(classes(nodes, radius), "classes")
    named = found.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(found.join(named, "root").drop("root"), "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def similar(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of rows, of columns) of sets of numbers whose Jaccard similarity is SIMILARITY or more; empty sets are alike."""
    least, of = SIMILARITY
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = np.zeros((len(rows), len(columns)))
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for k in range(0, len(every), 8192):
        part = slice(*np.searchsorted(at, (k, k + 8192)))
        held = np.zeros((len(sets), min(8192, len(every) - k)), dtype=np.float32)
        held[owner[part], at[part] - k] = 1
        common += held[rows] @ held[columns].T
    both = sizes[rows][:, None] + sizes[columns][None, :] - common
    return np.nonzero(of * common >= least * both)


def _in_tiles(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows with block, tile, side and these columns, tile by tile."""
    return rows.select("block", "tile", F.col("side").cast("int").alias("side"), *columns).repartition("block", "tile").sortWithinPartitions("block", "tile")


def near_rows(tiled: DataFrame, radius: int) -> DataFrame:
    """The rows of tiled (block, tile, side, fp) whose fingerprint is within the radius of another that it meets in its tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _by_tile(batches, ("block", "tile")):
            prints, sides = np.frombuffer(b"".join(rows["fp"].to_pylist()), ">u8").astype(np.uint64).reshape(rows.num_rows, -1), rows["side"].to_numpy()
            ones, near = np.bitwise_count(prints).sum(axis=1, dtype=np.int64), np.zeros(rows.num_rows, dtype=bool)
            for start, stop in zip(starts, [*starts[1:], rows.num_rows], strict=True):
                order = start + np.argsort(ones[start:stop], kind="stable")
                left, right = order[sides[order] != 1], order[sides[order] != 0]
                x, y = _close(prints[left], prints[right], radius)
                met = left[x] != right[y]  # on side 2 each row meets itself too
                near[left[x[met]]] = near[right[y[met]]] = True
            yield from rows.filter(pa.array(near)).to_batches()

    return _in_tiles(tiled, "fp").mapInArrow(run, "block long, tile long, side int, fp binary")


def _compared(tiled: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(a, b): links of the fingerprints of tiled (block, tile, side, fp) whose texts (fp, text) are similar, tile by tile.

    Fingerprints meet first; the texts of those that are near none in their tile are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _by_tile(batches, ("block", "tile")):
            prints, sides, pairs = rows["fp"].to_pylist(), rows["side"].to_numpy(), []
            for start, stop in zip(starts, [*starts[1:], len(prints)], strict=True):
                own_side = sides[start:stop]
                left = np.flatnonzero(own_side != 1)
                right = left if own_side[0] == 2 else np.flatnonzero(own_side == 1)
                if not len(left) or not len(right) or right is left and len(left) < 2:
                    continue
                sets = [np.unique(shingle_hashes(t, words)) for t in rows["text"].slice(start, stop - start).cast(pa.binary()).to_pylist()]
                x, y = similar(sets, left, right)
                pairs += _stars(prints[start:stop], left[x], right[y])
            yield _pairs(pairs)

    met = near_rows(tiled.withColumn("tile", F.col("tile").cast("long")), NEAR_RADIUS)
    return materialize(_in_tiles(met.join(texts, "fp"), "fp", "text").mapInArrow(run, "a binary, b binary"), "links")


def _parts() -> Column:
    """Into how many tiles so many rows with so many shingles are dealt."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / TEXT_TILE, F.sum("shingles") / SHINGLE_TILE, F.lit(1))).cast("int").alias("parts")


def _part(parts: str = "parts") -> Column:
    return F.pmod(F.xxhash64("fp"), F.col(parts).cast("long")).cast("int")


def pivot_tiles(placed: DataFrame) -> DataFrame:
    """Tiles in which the texts of placed (block, fp, root, shingles, pivot) meet their block's pivot, unless joined to it already.

    Texts that share a pivot in several blocks meet it once. Each tile has a part of them and the pivot.
    """
    pairs = materialize(placed.filter(F.col("root") != F.col("pivot.root")).select(F.col("pivot.fp").alias("p"), "fp", "shingles").distinct(), "pairs")
    sizes = materialize(pairs.groupBy("p").agg(_parts()), "sizes")
    few = F.broadcast if sizes.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else lambda df: df
    texts = pairs.join(few(sizes), "p").select(F.xxhash64("p").alias("block"), _part().alias("tile"), F.lit(0).alias("side"), "fp")
    return texts.unionAll(sizes.select(F.xxhash64("p").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("tile"), F.lit(1).alias("side"), F.col("p").alias("fp")))


def rest_tiles(placed: DataFrame) -> DataFrame:
    """Tiles in which the texts of placed (block, fp, root, shingles, pivot) outside the pivot's component meet all of their block.

    Those outside are dealt into parts of their own; each part meets itself, the others of its kind and those of the rest,
    which don't meet each other. Blocks of the same texts count once.
    """
    rows = placed.withColumn("outside", F.col("root") != F.col("pivot.root"))
    kind = lambda flag: F.ceil(F.greatest(F.sum(F.when(flag, 1)) / TEXT_TILE, F.sum(F.when(flag, F.col("shingles"))) / SHINGLE_TILE, F.lit(1))).cast("int")
    sums = [F.sum(F.xxhash64("fp", F.lit(k)).cast("decimal(38,0)")).alias(f"sum{k}") for k in (0, 1)]
    signed = rows.groupBy("block").agg(kind(F.col("outside")).alias("few"), kind(~F.col("outside")).alias("many"), F.count(F.lit(1)).alias("size"), *sums)
    once = materialize(signed.groupBy("size", "sum0", "sum1").agg(F.min_by(F.struct("block", "few", "many"), "block").alias("b")).select("b.*"), "blocks")
    part = F.when(F.col("outside"), _part("few")).otherwise(F.col("few") + _part("many"))
    other = F.sequence(F.lit(0), F.when(F.col("outside"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)
    met = rows.join(once, "block").withColumn("part", part).withColumn("other", F.explode(other))
    tile = F.least("part", "other").cast("long") * (F.col("few") + F.col("many")) + F.greatest("part", "other")
    side = F.when(F.col("part") == F.col("other"), 2).otherwise((F.col("part") > F.col("other")).cast("int"))
    return met.select("block", tile.alias("tile"), side.alias("side"), "fp")


def confirmed(blocks: DataFrame, own: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(fp, root): components of the links between near fingerprints that share a block (block, fp) and whose texts are similar.

    own: fp, shingles and least (id_key, text_hash), the text that stands for each fingerprint. Only texts that share a
    block are read, once. A pair that shares a block is skipped only where links join it already or its fingerprints are
    beyond the radius, so no link within it is lost.
    """
    sizes = materialize(blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    members = materialize(blocks.join(sizes, "block").join(own.select("fp", "shingles"), "fp"), "members")
    keys = materialize(members.select("fp").distinct().join(own, "fp").select("fp", "least.*"), "keys")
    few = F.broadcast if keys.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else lambda df: df
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id_key"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    texts = materialize(named.join(few(keys), ["id_key", "text_hash"]).select("fp", "text"), "texts")
    if texts.count() > keys.count():  # repeated rows
        texts = materialize(texts.dropDuplicates(["fp"]), "texts")
    found, links = keys.select("fp", F.col("fp").alias("root")), None
    for turn in range(PIVOTS + 1):
        least = 3 if turn else 2  # a block of two has one pair
        rooted = materialize(members.filter(F.col("n") >= least).join(found, "fp"), "rooted")
        order = F.xxhash64("fp", F.lit(turn))
        apart = rooted.groupBy("block").agg(F.min_by(F.struct("fp", "root"), order).alias("pivot"), F.min("root").alias("low"), F.max("root").alias("high"))
        pivots = materialize(apart.filter("low <> high").select("block", "pivot"), "pivots")
        blocks_left = pivots.limit(MOST_BROADCAST + 1).count()
        if not blocks_left:
            break
        placed = rooted.join(F.broadcast(pivots) if blocks_left <= MOST_BROADCAST else pivots, "block")
        more = _compared(pivot_tiles(placed) if turn < PIVOTS else rest_tiles(placed), texts, words)
        links = more if links is None else links.unionAll(more)
        found = materialize(_rooted(keys.select("fp"), links), "roots")
    return found


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and any other columns) with one row of each group of near-duplicates, of the least id.

    Texts are linked at a Jaccard similarity of 0.8 or more over runs of five words, each counted once, if they share a
    band of minima and their fingerprints differ in at most NEAR_RADIUS bits. Null ids come first; null texts count as empty, and texts without words are one group; of repeated rows one stays. Very long texts
    are hashed in portions. An empty table stays empty. Other columns may have any names.
    """
    prints = materialize(fingerprints(docs, NEAR_WORDS, NEAR_BITS, NEAR_BANDS), "fingerprints")
    blocks = materialize(prints.select(F.explode("blocks").alias("block"), "fp").distinct(), "blocks")
    rows = prints.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id_key"), "text_hash", "fp", "shingles")
    own = materialize(rows.groupBy("fp").agg(F.min(F.struct("id_key", "text_hash")).alias("least"), F.max("shingles").alias("shingles")), "nodes")
    found = confirmed(blocks, own, docs, NEAR_WORDS)
    named = own.join(found, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "least")
    kept = materialize(named.groupBy("root").agg(F.min("least").alias("least")).select("least.*"), "kept")
    return keep_rows(docs, rows, kept)
