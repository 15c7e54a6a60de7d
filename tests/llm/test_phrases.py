"""Phrase collocations: equal to plain counting and SQL, windows, shards, odd rows."""

import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from touchline.llm import phrases

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, phrase string, n int, score double"


def plain(rows, min_count=100, longest=5, top=2000, percent=100):
    """(lang, rank, phrase, a, l, r, n, score) from (text, lang) rows."""
    total, f = Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        inside = {}
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside.get(p[i : i + k], 0), a)
        best = []
        for p, a in found.items():
            if 100 * inside.get(p, 0) >= percent * a:
                continue
            score, _, l, r = min((1000 * a * total[lang] // (counts[p[:j]] * counts[p[j:]]), j, counts[p[:j]], counts[p[j:]]) for j in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_table_against_plain_and_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.collect()]
    got = found(phrases.op13_phrase_collocations(spark, SF))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == plain(rows) == sorted(con.execute(phrases.OP13_SQL).fetchall())
    assert len(found(phrases.collocations(docs, 12))) > 20 and found(phrases.collocations(docs.repartition(30), 12)) == plain(rows, 12)


def test_odd_rows(spark):
    rnd = random.Random(3)
    vocabulary = ["Of", "of", "the", "THE", "Éa", "éa", "x\x00y", "co op", "\x1c", "日本", "b-c"]
    texts = ["".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r", "\x0b"]) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    rows = [(t, rnd.choice(["en", None, "und", ""])) for t in texts]
    rows += [(None, "en"), ("", "en"), (" .\n", None), ("z", "zz")]
    rows += [("aa aa aa aa aa aa", "en")] * 70 + [("hot passage of five words here", "en")] * 200  # overlaps, a hot text
    df = spark.createDataFrame([(i, t, lang, "p", 1, 0.5) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(40)
    for least, longest, top, percent in ((4, 5, 2000, 100), (2, 3, 7, 100), (1, 4, 2000, 60), (9, 2, 50, 100)):
        assert found(phrases.collocations(df, least, longest, top, percent)) == plain(rows, least, longest, top, percent)
    assert phrases.collocations(df.where("doc_id < 0")).collect() == []
    assert phrases.collocations(df.where("text IS NULL")).collect() == []


def test_products_beyond_64_bits(spark):
    frequent = spark.createDataFrame([("en", "a", 1, 4 * 10**12), ("en", "b", 1, 3 * 10**12), ("en", "a b", 2, 2 * 10**12)], "lang string, phrase string, k int, n long")
    words = spark.createDataFrame([("en", 9 * 10**15)], "lang string, n long")
    row = phrases.scored(frequent, words).first()
    assert row.score == 1000 * 2 * 10**12 * 9 * 10**15 // (12 * 10**24) == 1_500_000


def test_windows_keep_pieces_whole():
    texts = ["one two, three four. five six", "", "no end here at all " * 9, "a b c", "x, " * 50]
    array = pa.array(["skip", *texts]).slice(1)
    for most in (1, 7, 20, 64, 10_000):
        pieces = []
        for _, data, starts in phrases.windows(array, most, phrases.KIND):
            text = data.tobytes().decode()
            for a, b in zip(starts, [*starts[1:], len(text)]):
                pieces += [p.split() for p in re.split(r"[.,]", text[a:b]) if p.split()]
        assert pieces == [p.split() for t in texts for p in re.split(r"[.,]", t) if p.split()]


def test_local_support_keeps_every_frequent_phrase(spark):
    """The hashes of all globally frequent phrases are among those some shard finds."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(60)
    blocks = phrases.stored(phrases.local_counts(docs, range(1, 4), None, None, 2))
    hashes = {r.hash for r in phrases.locally_frequent(blocks, 30).collect()}
    assert blocks.select("shard").distinct().count() > 15
    counts = Counter()
    for r in docs.collect():
        for piece in re.split(r"[.,;:!?\n]", r.text.lower()):
            w = piece.split()
            counts.update((r.lang, " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    frequent = [p for p, n in counts.items() if n >= 30]
    for lang, p in frequent:
        data = np.frombuffer(p.encode(), np.uint8)
        *_, (_, h, _) = phrases.Words(data, np.array([0]), phrases.KIND).grams(len(p.split()), phrases.seed_of(lang))
        assert int((h >> np.uint64(16) << np.uint64(16)).astype(np.int64)[0]) in hashes
    assert len(hashes) < len(counts) / 2
