"""Phrase collocations mined by partitioning: shards first, each completely, then the whole corpus exactly.

Runs of ``RUN_ROWS`` documents are dealt to ``SHARDS`` shards. A phrase with ``min_count`` occurrences among a language's words has at least its share of
them, ``min_count * words of the shard / words of the language``, in one shard or more; each shard therefore finds all of
its phrases with that many occurrences. Phrases grow by length: a longer phrase is counted only where all its words, then
all its word pairs, were frequent in some shard. The number of shards doesn't grow, as the lowered support would fall under
one occurrence; a shard is mined by as many tasks as it is large, which meet by hash ranges of its phrases. There, phrases
are 64-bit hashes in packed arrays. What was frequent somewhere is passed on as a bitmap over hashes of at most
2^28 bits: bits that others set too cost work, not exactness.

Then a pass over all documents counts all candidates, by hash, and a last one counts what is left by its text, which
decides. Scores come from joins on the phrases' parts. Arithmetic is in decimals of 38 digits.

Defined results: a null text is empty; a null language is ``und``; texts of any length are read in windows that end where
pieces end; repeated rows count each; an empty table gives no rows. Extra columns do not take part.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.common import lean, lean_group, table
from touchline.llm.wordscan import Bitmap, Words, bitmap, byte_kinds, summed, windows
from touchline.session import discard, stored

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
CONTAINED_PERCENT = 100
SHARDS = 25
SHARD_BITS = 3
RUN_ROWS = 1024
WINDOW_BYTES = 1_000_000
KEPT_ENTRIES = 1_000_000
KEPT_PHRASES = 150_000
GROUP_BYTES = 16_000_000

# The characters that end a piece, and those that end a word inside it.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
BLANKS = " \t"

KIND = byte_kinds(BLANKS, PIECE_ENDS)


def seed_of(lang: str) -> int:
    return int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little")


def windows_by_language(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """Windows of the columns text and lang, both without nulls, after the number of the run of rows that they belong to.

    ``part`` is the task, so runs of different tasks begin at different numbers."""
    import pyarrow.compute as pc

    number = None
    for batch in batches:
        for at in range(0, batch.num_rows, RUN_ROWS):
            rows = batch.slice(at, RUN_ROWS)
            number = rows.column(2)[0].as_py() if number is None else number + 1
            text, lang = rows.column(0), rows.column(1)
            for name in pc.unique(lang).to_pylist():
                for _, data, starts in windows(text.filter(pc.equal(lang, name)), most, KIND):
                    yield number, name, data, starts


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.spark_partition_id().alias("part"))


def packed(h: np.ndarray) -> bytes:
    """The leading 48 bits of hashes, 6 bytes each: enough to keep phrases apart, but for a few that cost work only."""
    return np.ascontiguousarray((h >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(body: bytes) -> np.ndarray:
    out = np.zeros((len(body) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(body, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of packed rows and their summed counts."""
    counts = [np.frombuffer(b, np.uint32).astype(np.int64) for b in rows.column("counts").to_pylist()]
    return summed([unpacked(b) for b in rows.column("hashes").to_pylist()], counts)


def local_counts(docs: DataFrame, lengths: range, words: "Bitmap | None", pairs: "Bitmap | None", part_bits: int) -> DataFrame:
    """Packed counts of the phrases of some lengths, per language, shard and range of hashes, with the words read."""
    spark = docs.sparkSession
    words, pairs = (spark.sparkContext.broadcast(b) if b is not None else None for b in (words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, read = defaultdict(lambda: ([], [])), defaultdict(int)

        def entries() -> int:
            return sum(len(h) for hs, _ in kept.values() for h in hs)

        def emitted() -> pa.RecordBatch:
            rows = []
            for lang, shard in read:
                h, n = summed(*kept[lang, shard]) if kept[lang, shard][0] else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                for p, a, b in cut_by_range(h, part_bits):
                    if b > a or not p:
                        rows.append((lang, shard, p, read[lang, shard] if not p else 0, packed(h[a:b]), n[a:b].astype("<u4").tobytes()))
            kept.clear(), read.clear()
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["lang", "shard", "part", "words", "hashes", "counts"])

        for number, lang, data, starts in windows_by_language(batches, WINDOW_BYTES):
            found, key = Words(data, starts, KIND), (lang, number % SHARDS)
            read[key] += len(found.begin)
            known = single = None
            for k, h, inside in found.grams(lengths[-1], seed_of(lang)):
                if k == 1 and words is not None:
                    single = words.value.has(h)
                if k == 2:
                    known = inside & single[1:] & single[:-1] if single is not None else inside
                    known = known & pairs.value.has(h) if pairs is not None else known
                if k in lengths:
                    ok = inside
                    if k > 1:
                        ok = ok.copy()
                        for j in range(k - 1):
                            ok &= known[j : len(known) - k + 2 + j]
                    one, n = np.unique(h[ok], return_counts=True)
                    kept[key][0].append(one)
                    kept[key][1].append(n)
            if entries() > KEPT_ENTRIES:
                for name in kept:
                    h, n = summed(*kept[name])
                    kept[name] = ([h], [n])
                if entries() > KEPT_ENTRIES // 2:
                    yield emitted()
        if read:
            yield emitted()

    return _texts(docs).mapInArrow(lean(run), "lang string, shard int, part int, words long, hashes binary, counts binary")


def locally_frequent(blocks: DataFrame, min_count: int) -> DataFrame:
    """``hash`` of every phrase that reaches its shard's support in some shard; ``blocks`` is a stored table."""
    words = blocks.groupBy("lang", "shard").agg(F.sum("words").alias("shard_words"))
    total = words.groupBy("lang").agg(F.sum("shard_words").alias("lang_words"))
    support = stored(words.join(total, "lang"))

    def merge(rows: pa.Table) -> pa.Table:
        h, n = merged(rows)
        least = -(-min_count * rows.column("shard_words")[0].as_py() // max(rows.column("lang_words")[0].as_py(), 1))
        return pa.table({"hash": h[n >= least].astype(np.int64)})

    found = blocks.join(support, ["lang", "shard"]).groupBy("lang", "shard", "part").applyInArrow(lean_group(merge), "hash long")
    return found.distinct()


def cut_by_range(h: np.ndarray, part_bits: int) -> "list[tuple[int, int, int]]":
    """(part, begin, end) of every range of leading bits that sorted hashes have."""
    cuts = np.searchsorted(h, np.arange(1, 1 << part_bits, dtype=np.uint64) << np.uint64(64 - part_bits)).tolist() if part_bits else []
    return [(p, a, b) for p, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(h)]))]


def globally_frequent(docs: DataFrame, candidates: Bitmap, longest: int, min_count: int, part_bits: int) -> DataFrame:
    """``hash`` of the candidates with ``min_count`` occurrences in all documents."""
    held = docs.sparkSession.sparkContext.broadcast(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = [], []

        def emitted() -> pa.RecordBatch:
            rows = [(p, packed(hashes[0][a:b]), counts[0][a:b].astype("<u4").tobytes()) for p, a, b in cut_by_range(hashes[0], part_bits) if b > a]
            hashes.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, (pa.int32(), pa.binary(), pa.binary()))], names=["part", "hashes", "counts"])

        def merge() -> int:
            h, n = summed(hashes, counts)
            hashes[:], counts[:] = [h], [n]
            return len(h)

        for _, lang, data, starts in windows_by_language(batches, WINDOW_BYTES):
            for _, h, inside in Words(data, starts, KIND).grams(longest, seed_of(lang)):
                one, n = np.unique(h[inside & held.value.has(h)], return_counts=True)
                hashes.append(one)
                counts.append(n)
            if sum(map(len, hashes)) > KEPT_ENTRIES and merge() > KEPT_ENTRIES // 2:
                yield emitted()
        if hashes and merge():
            yield emitted()

    def frequent(rows: pa.Table) -> pa.Table:
        h, n = merged(rows)
        return pa.table({"hash": h[n >= min_count].astype(np.int64)})

    return _texts(docs).mapInArrow(lean(run), "part int, hashes binary, counts binary").groupBy("part").applyInArrow(lean_group(frequent), "hash long")


def exact_counts(docs: DataFrame, frequent: Bitmap, longest: int) -> DataFrame:
    """Occurrences of every phrase whose hash may be a frequent one's: ``lang``, ``phrase``, ``n``."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[bytes, int]] = defaultdict(dict)

        def emitted() -> Iterator[pa.RecordBatch]:
            for lang, counts in kept.items():
                phrases = pa.array(list(counts), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), phrases, pa.array(list(counts.values()), pa.int64())], names=["lang", "phrase", "n"])
            kept.clear()

        for _, lang, data, starts in windows_by_language(batches, WINDOW_BYTES):
            found, counts = Words(data, starts, KIND, 2), kept[lang]
            low, spaced = found.low.tobytes(), found.begin[1:] - found.end[:-1] == 1
            spaced &= found.low[found.end[:-1]] == 32 if len(spaced) else True
            for (k, h, inside), (_, other, _) in zip(found.grams(longest, seed_of(lang)), found.grams(longest, seed_of(lang), 1)):
                at = np.flatnonzero(inside & held.value.has(h))
                at = at[np.lexsort((other[at], h[at]))]
                new = np.flatnonzero(np.r_[True, (h[at][1:] != h[at][:-1]) | (other[at][1:] != other[at][:-1])]) if len(at) else at
                n = np.diff(np.r_[new, len(at)]).tolist()
                one = at[new]
                plain = np.ones(len(one), bool)
                for j in range(k - 1):
                    plain &= spaced[one + j]
                for i, b, e, straight, m in zip(one.tolist(), found.begin[one].tolist(), found.end[one + k - 1].tolist(), plain.tolist(), n):
                    phrase = low[b:e] if straight else b" ".join([low[found.begin[i + j] : found.end[i + j]] for j in range(k)])
                    counts[phrase] = counts.get(phrase, 0) + m
            if sum(map(len, kept.values())) > KEPT_PHRASES:
                yield from emitted()
        yield from emitted()

    counted = _texts(docs).mapInArrow(lean(run), "lang string, phrase string, n long")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def scored(frequent: DataFrame, words: DataFrame, top: int = TOP, contained_percent: int = CONTAINED_PERCENT) -> DataFrame:
    """The best phrases per language from all frequent phrases (``lang``, ``phrase``, ``k`` words, ``n`` occurrences), those of
    one word included, and the ``words`` of every language."""
    parts = F.split("phrase", " ")
    long = frequent.where("k > 1").withColumn("w", parts)
    cut = long.select("lang", "phrase", "w", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("left"), F.expr("array_join(slice(w, cut + 1, size(w)), ' ')").alias("right"))
    of = frequent.select("lang", "phrase", "n")
    cut = cut.join(of.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cut = cut.join(of.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]).join(words, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    exact = cut.withColumns({"over": F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"], "under": wide["l"] * wide["r"]})
    exact = exact.withColumn("score", F.expr("over div under"))
    best = exact.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), s -> array_join(slice(w, s, m), ' '))))")
    around = long.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("n").alias("longer"))
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = best.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(contained_percent) * F.col("a")))
    flat = free.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, contained_percent: int = CONTAINED_PERCENT) -> DataFrame:
    """The phrases of 2 to ``longest`` words that occur ``min_count`` times or more, best first per language."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part_bits = max(0, (6 * size // (SHARDS * GROUP_BYTES)).bit_length())
    blocks = stored(local_counts(docs, range(1, 2), None, None, part_bits))
    words = stored(blocks.groupBy("lang").agg(F.sum("words").alias("n")))

    def frequent_of(blocks: DataFrame) -> DataFrame:
        out = stored(locally_frequent(blocks, min_count))
        discard(blocks)
        return out

    singles = frequent_of(blocks)
    frequent_words = bitmap(singles)
    pairs = frequent_of(stored(local_counts(docs, range(2, 3), frequent_words, None, part_bits)))
    found = singles.unionByName(pairs)
    if longest > 2:
        found = found.unionByName(frequent_of(stored(local_counts(docs, range(3, longest + 1), frequent_words, bitmap(pairs), part_bits))))
    counted = stored(globally_frequent(docs, bitmap(found), longest, min_count, part_bits + SHARD_BITS))
    counted = exact_counts(docs, bitmap(counted), longest).where(F.col("n") >= min_count)
    frequent = stored(counted.withColumn("k", F.size(F.split("phrase", " "))))
    return scored(frequent, words, top, contained_percent)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2000 phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


# every phrase of every piece, counted and scored
OP13_SQL = """
WITH piece AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
worded AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang),
gram AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
freq AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY lang, k, phrase HAVING count(*) >= 100),
cand AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE k >= 2),
cut AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)),
score AS (
  SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cut c JOIN freq x ON c.lang = x.lang AND c.lp = x.phrase JOIN freq y ON c.lang = y.lang AND c.rp = y.phrase JOIN total t ON c.lang = t.lang),
low AS (SELECT lang, phrase, a, n, min(struct_pack(score := score, j := j, l := l, r := r)) AS m FROM score GROUP BY lang, phrase, a, n),
sub AS (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda s: array_to_string(w[s:s + m - 1], ' '))))) AS phrase FROM cand WHERE k > 2),
around AS (SELECT lang, phrase, max(a) AS longer FROM sub GROUP BY lang, phrase),
kept AS (SELECT low.* FROM low LEFT JOIN around USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY m.score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(m.l AS BIGINT) AS l,
    CAST(m.r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(m.score AS BIGINT) AS score FROM kept) WHERE rank <= 2000"""
