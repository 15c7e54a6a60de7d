"""Near-duplicates by SimHash, decided and completed by the exact Jaccard similarity of word shingles.

Equal texts are one class, and so are all texts without words. The trie of fingerprints (``simhash``) proposes pairs within
``BITS_APART`` bits. Fingerprints miss most pairs near the border, so prefixes of the shingle sets propose the rest: all
shingles have one order, which puts those common in a sample of the documents last. If two sets have a Jaccard similarity
of at least t, each begins in that order with a prefix of n - ceil(t n) + 1 shingles and the two prefixes share one. The
sample only moves the cost. Shingles that no second text has in its prefix are left out first, by a bitmap of bounded size.
Every list of classes with one shingle is compared with its first class, components are found, and the pairs of a list that
are not yet in one component are compared then; a group of near copies thus costs one comparison per member and list.

A proposed pair is first held against a sketch of one bit per shingle: the parities of the sets' hashes differ in no more
bits than the sets do in shingles, which excludes most pairs of texts that share a passage. What is left is decided on the
texts themselves, read again and moved only for these pairs. No link is lost, and no table holds the shingles of all texts.

Sets are of 64-bit hashes. Defined results: null and empty texts have no shingles and are one class, texts of fewer words
than a shingle are one shingle, equal rows share their class, rows without an id are grouped but name no group, an empty
table gives no rows. Extra columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import WHITE_SPACE, lean, lean_group
from touchline.llm.components import components
from touchline.llm.simhash import class_links, cut_trie, fingerprints
from touchline.llm.wordscan import Bitmap, Words, bitmap, byte_kinds, mix, summed, windows
from touchline.session import compute_partitions, stored

SHINGLE_WORDS = 5
# The similarity is a fraction, so sizes are compared in whole numbers.
SIMILAR = (4, 5)
BITS_APART = 2
SAMPLE_DOCUMENTS = 20_000
COMMON = 4
COMMON_SHINGLES = 200_000
BUCKET_ROWS = 200_000
PAIRS_IN_BUCKET = 500
HEAD_PAIRS = 64
SLICE_BYTES = 2_000_000
WINDOW_BYTES = 1_000_000
KEPT_HASHES = 1_000_000
KEPT_CLASSES = 100_000
ROWS_AT_ONCE = 1_000
KINDS = byte_kinds("", WHITE_SPACE)


def shingle_sets(texts: pa.Array, words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Per text the sorted hashes of the distinct shingles of its ASCII-lower-cased words; empty for a text without words."""
    factor = np.uint64(Words.FACTORS[1])
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64))
    for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1):
        if not len(rows):
            continue
        part = texts.slice(rows[0], len(rows))
        offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        hashes, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for at, data, starts in windows(part, WINDOW_BYTES, KINDS):
            found = Words(data, starts, KINDS)
            hashes.append(found.hashes[0])
            of.append(np.searchsorted(offsets, at + found.begin, "right") - 1)
        h, of = np.concatenate(hashes), np.concatenate(of)
        ends = np.searchsorted(of, np.arange(len(part)), "right").tolist()
        grams = h
        for k in range(1, words):
            grams = mix(grams[: max(len(h) - k, 0)] * factor + h[k:])
        begin = 0
        for end in ends:
            if end - begin >= words:
                yield np.unique(grams[begin : end - words + 1])
            elif end > begin:
                short = np.full(1, end - begin, np.uint64)
                for k in range(begin, end):
                    short = mix(short * factor + h[k : k + 1])
                yield short
            else:
                yield grams[:0]
            begin = end


def text_class() -> Column:
    """Class of a row by its text; texts without words are class 0."""
    text = F.coalesce("text", F.lit(""))
    return F.when(F.trim(text, F.lit(WHITE_SPACE)) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(text)).alias("cls")


def common_shingles(docs: DataFrame, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles found most often in a sample of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = np.concatenate(list(shingle_sets(batch.column(0).slice(at, 256), words)))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    one_in = -(-docs.count() // SAMPLE_DOCUMENTS) or 1
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = sample.mapInArrow(lean(run), "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    top = counts.orderBy(F.desc("count"), "h").limit(COMMON_SHINGLES).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix_of(found: np.ndarray, common: np.ndarray, often: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """The first shingles of a set, rare ones first, that a similar set must share one of."""
    if len(common) and len(found):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        found = found[np.lexsort((found, np.where(common[at] == found, often[at], 0)))]
    p, q = similar
    return found[: len(found) - -(-p * len(found) // q) + 1] if len(found) else found


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the number of hashes per place, about one place per hash; halves of it fold by exclusive or."""
    places = max(64, 1 << max(len(found) - 1, 0).bit_length())
    odd = np.bincount((found & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def sketch_distance(x: np.ndarray, y: np.ndarray) -> int:
    """A number of shingles that differ at least between the two sets."""
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _new_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of classes that a task has not met before, as far as it remembers."""
    met: set[int] = set()
    for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
        new = []
        for i, c in enumerate(batch.column(0).to_pylist()):
            if c not in met:
                met.add(c)
                new.append(i)
        if len(met) > KEPT_CLASSES:
            met.clear()
        if new:
            yield batch.take(pa.array(new))


def repeated_shingles(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], words: int, similar: tuple[int, int], part_bits: int) -> DataFrame:
    """``hash`` of the shingles in the prefixes of more than one row of ``cls`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting = [], 0

        def emitted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(kept), return_counts=True)
            cuts = np.searchsorted(h, np.arange(1, 1 << part_bits, dtype=np.uint64) << np.uint64(64 - part_bits)) if part_bits else []
            rows = [(p, h[a:b].tobytes(), np.minimum(n[a:b], 2).astype(np.uint8).tobytes()) for p, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(h)])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "hashes", "counts"])

        for batch in _new_classes(batches):
            for found in shingle_sets(batch.column(1), words):
                if len(found):
                    kept.append(prefix_of(found, *common, similar))
                    waiting += len(kept[-1])
                if waiting > KEPT_HASHES:
                    yield emitted()
                    kept, waiting = [], 0
        if waiting:
            yield emitted()

    def merge(rows: pa.Table) -> pa.Table:
        h, n = ([np.frombuffer(b, kind) for b in rows.column(c).to_pylist()] for c, kind in (("hashes", np.uint64), ("counts", np.uint8)))
        h, n = summed(h, [x.astype(np.int64) for x in n])
        return pa.table({"hash": h[n > 1].view(np.int64)})

    return texts.mapInArrow(lean(run), "part int, hashes binary, counts binary").groupBy("part").applyInArrow(lean_group(merge), "hash long")


def listed_classes(texts: DataFrame, repeated: Bitmap, common: tuple[np.ndarray, np.ndarray], words: int, similar: tuple[int, int]) -> DataFrame:
    """``cls``, size ``n``, ``sketch``, and places ``at`` and hashes ``h`` of the prefix shingles that another text may have,
    for classes that have such; a class may come from several tasks."""
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _new_classes(batches):
            rows = []
            for cls, found in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words)):
                prefix = prefix_of(found, *common, similar)
                at = np.flatnonzero(held.value.has(prefix))
                if len(at):
                    rows.append((cls, len(found), sketch(found).tobytes(), at.astype(np.int32), prefix[at].view(np.int64)))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["cls", "n", "sketch", "at", "h"])

    return texts.mapInArrow(lean(run), "cls long, n int, sketch binary, at array<int>, h array<long>")


def _pairs(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of all pairs within runs of the given sizes."""
    later = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    j = np.repeat(np.arange(size.sum()), later)
    nth = np.arange(len(j)) - np.repeat(np.cumsum(later) - later, later)
    return np.repeat(np.repeat(np.cumsum(size) - size, size), later) + nth, j


def _distinct(pairs: list[np.ndarray]) -> np.ndarray:
    both = np.concatenate(pairs)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    return both[np.r_[True, (both[1:] != both[:-1]).any(axis=1)]] if len(both) else both


PAIRS_AT_ONCE = 500_000


def close_lists(rows: pa.Table, first: bool, similar: tuple[int, int] = SIMILAR) -> pa.Table:
    """Distinct pairs ``a`` < ``b`` of classes that share a prefix shingle and may be similar.

    With ``first``, those of the first class of each list; else all; of classes with different ``root`` in both cases. At the
    first shingle that two sets share, no more can follow than either has left; pairs that fail this at one list pass at
    their first, if they are similar.
    """
    h, cls, n, at, root = (rows.column(c).to_numpy() for c in ("h", "cls", "n", "at", "root"))
    order = np.lexsort((cls, n, h))
    h, cls, n, at, root = h[order], cls[order], n[order].astype(np.int64), at[order].astype(np.int64), root[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(h)])
    p, q = similar
    out, waiting = [np.zeros((0, 2), np.int64)], 0

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal waiting
        most = 1 + np.minimum(n[i] - at[i] - 1, n[j] - at[j] - 1)
        good = (root[i] != root[j]) & (most * (p + q) >= p * (n[i] + n[j])) & (n[i] * q >= n[j] * p)
        out.append(np.sort(np.stack([cls[i[good]], cls[j[good]]], axis=1), axis=1))
        waiting += len(out[-1])
        if waiting > PAIRS_AT_ONCE:
            out[:], waiting = [_distinct(out)], 0

    if first:
        rest = np.arange(len(h))
        keep(np.repeat(starts, sizes), rest)
    else:
        mixed = np.maximum.reduceat(root, starts) != np.minimum.reduceat(root, starts) if len(h) else sizes > 1
        starts, sizes = starts[mixed], sizes[mixed]
        small = sizes <= 1_000
        room = np.cumsum(sizes[small] * (sizes[small] - 1) // 2) // PAIRS_AT_ONCE
        for part in np.unique(room):
            s, z = starts[small][room == part], sizes[small][room == part]
            place = np.repeat(s, z) + np.arange(z.sum()) - np.repeat(np.cumsum(z) - z, z)
            i, j = _pairs(z)
            keep(place[i], place[j])
        for s, z in zip(starts[~small], sizes[~small]):
            for j in range(s + 1, s + z):
                # sizes rise, so classes too small for this one come first
                low = s + np.searchsorted(n[s:j] * q, n[j] * p)
                i = np.arange(low, j)
                keep(i[root[i] != root[j]], np.int64(j) + np.zeros((root[i] != root[j]).sum(), np.int64))
    found = _distinct(out)
    return pa.table({"a": found[:, 0], "b": found[:, 1]})


def list_pairs(listed: DataFrame, roots: DataFrame, first: bool, buckets: int, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Pairs of classes of different roots that share a prefix shingle."""
    rooted = listed.select("cls", "n", "at", "h").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rows = rooted.select("cls", "n", "root", F.explode(F.arrays_zip("at", "h")).alias("x")).select("cls", "n", "root", "x.at", "x.h")
    met = rows.withColumn("bucket", F.pmod("h", F.lit(buckets))).groupBy("bucket")
    return met.applyInArrow(lean_group(lambda rows: close_lists(rows, first, similar)), "a long, b long").distinct()


def may_be_similar(pairs: DataFrame, listed: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The pairs that sizes and sketches do not exclude."""
    p, q = similar
    of = listed.select("cls", "n", "sketch").dropDuplicates(["cls"])
    both = pairs.join(of.withColumnsRenamed({"cls": "a", "n": "na", "sketch": "sa"}), "a").join(of.withColumnsRenamed({"cls": "b", "n": "nb", "sketch": "sb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
            fit = np.flatnonzero((na * q >= nb * p) & (nb * q >= na * p))
            sa, sb = batch.column(4), batch.column(5)
            kept = [i for i in fit.tolist() if (p + q) * sketch_distance(np.frombuffer(sa[i].as_buffer(), np.uint8), np.frombuffer(sb[i].as_buffer(), np.uint8)) <= (q - p) * int(na[i] + nb[i])]
            take = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], names=["a", "b"])

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lean(run), "a long, b long")


def similar_pairs(pairs: DataFrame, texts: DataFrame, similar: tuple[int, int] = SIMILAR, words: int = SHINGLE_WORDS) -> DataFrame:
    """The stored pairs ``a``, ``b`` of classes whose texts' shingle sets are similar.

    A text goes once to each bucket of pairs that asks for it; the pairs of one class are spread over several.
    """
    spark = pairs.sparkSession
    held = spark.sparkContext.broadcast(bitmap(stored(pairs.select(F.explode(F.array("a", "b")).alias("hash")).distinct())))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _new_classes(b.filter(pa.array(held.value.has(b.column(0).to_numpy().view(np.uint64)))) for b in batches)

    found = texts.mapInArrow(lean(wanted), "cls long, text string").groupBy("cls").agg(F.first("text").alias("text"))
    buckets = max(1, -(-pairs.count() // PAIRS_IN_BUCKET))
    sized = pairs.join(pairs.groupBy("a").count(), "a")
    spread = F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), 1 + F.floor(F.col("count") / HEAD_PAIRS))), F.lit(buckets))
    dealt = sized.select("a", "b", spread.alias("bucket"))
    asks = dealt.select(F.col("b").alias("cls"), "a", "bucket").unionByName(dealt.select(F.col("a").alias("cls"), "a", "bucket").distinct())
    p, q = similar

    def decide(rows: pa.Table) -> pa.Table:
        cls, a = rows.column("cls").to_pylist(), rows.column("a").to_pylist()
        first = {c: i for i, c in reversed(list(enumerate(cls)))}
        chosen = rows.column("text").take(pa.array(list(first.values()))).combine_chunks()
        sets = dict(zip(first, shingle_sets(chosen.chunk(0) if isinstance(chosen, pa.ChunkedArray) else chosen, words)))
        out = []
        for c, head in zip(cls, a):
            if c != head and head in sets:
                x, y = sets[head], sets[c]
                if (p + q) * len(np.intersect1d(x, y, assume_unique=True)) >= p * (len(x) + len(y)):
                    out.append((head, c))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return found.join(asks, "cls").groupBy("bucket").applyInArrow(lean_group(decide), "a long, b long")


def print_pairs(texts: DataFrame, words: int = SHINGLE_WORDS, bits: int = BITS_APART) -> DataFrame:
    """Pairs of classes whose fingerprints are equal or linked in the trie."""
    prints = stored(fingerprints(texts, words, "cls").distinct())
    nodes = stored(prints.groupBy("fp").agg(F.min("cls").alias("rep")))
    links = class_links(cut_trie(nodes.select("fp")), bits)
    ends = links.join(nodes.withColumnsRenamed({"fp": "a", "rep": "ra"}), "a").join(nodes.withColumnsRenamed({"fp": "b", "rep": "rb"}), "b")
    pairs = ends.select("ra", "rb").unionByName(prints.join(nodes, "fp").select(F.col("rep").alias("ra"), F.col("cls").alias("rb")))
    return pairs.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similar: tuple[int, int] = SIMILAR, words: int = SHINGLE_WORDS, key: str = "doc_id") -> DataFrame:
    """Key, ``cls`` and ``component_id``: the smallest key reachable over pairs at least ``similar``."""
    texts = docs.select(text_class(), F.coalesce("text", F.lit("")).alias("text"))
    common = common_shingles(docs, words)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a fifth of the shingles, 9 bytes each, of words of about 6 bytes
    part_bits = (total * 9 // (5 * 6 * 9 * BUCKET_ROWS)).bit_length()
    repeated = bitmap(stored(repeated_shingles(texts, common, words, similar, part_bits)))
    listed = stored(listed_classes(texts, repeated, common, words, similar))
    rows = listed.agg(F.sum(F.size("h"))).first()[0] or 0
    buckets = max(compute_partitions(docs.sparkSession), -(-rows // BUCKET_ROWS))

    def decided(pairs: DataFrame) -> DataFrame:
        return stored(similar_pairs(stored(may_be_similar(pairs, listed, similar)), texts, similar, words))

    def roots(links: DataFrame) -> DataFrame:
        return stored(components(links).withColumnRenamed("node", "cls"))

    links = decided(print_pairs(texts, words))
    tried = stored(list_pairs(listed, roots(links), True, buckets, similar))
    links = links.unionByName(decided(tried))
    more = list_pairs(listed, roots(links), False, buckets, similar).join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(decided(more))
    classes = stored(docs.select(key, text_class()))
    smallest = classes.groupBy("cls").agg(F.min(key).alias("smallest"))
    of_root = stored(smallest.join(roots(links), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    named = of_root.groupBy("root").agg(F.min("smallest").alias("component_id"))
    of_class = stored(of_root.join(named, "root").select("cls", "component_id"))
    return classes.join(of_class, "cls").select(key, "cls", "component_id")
