"""Vector best-fit packing of tokenised documents into as few sequences as possible.

A sequence has three capacities: tokens, documents and attention cost, the sum of its pieces' squared lengths. Pieces are
placed in falling size; a piece goes to the open sequence that can take it under every capacity and that fits best, by one
of two rules over capacities scaled to one: ``norm`` leaves the smallest weighted norm of what then remains, ``dot`` takes
the largest weighted product of the piece with what remains. Where none can take it, a sequence is opened. By default the
capacities of documents and cost are what the tokens alone allow, so that they cost no sequence; lower ones bind.

Texts are tokenised where they are read and only documents longer than a sequence are cut: all pieces but the first are full.
Full pieces are sequences of their own. The others are dealt to groups of about ``GROUP_PIECES`` by a hash of their place, so
no document id, source or length can load one group, and each group is packed by one task. A group's only loss is in its
last sequences. Columns ride along with the pieces, so a caller may keep the ids; the query moves their checksums only.

Defined results: a null or empty text is a document of the end token alone; equal rows and repeated ids are packed each; an
empty table gives no rows; texts of any length are cut. Other columns do not take part. A single piece always opens a
sequence, also where it alone exceeds the capacity of cost.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import table, worker_memo

CAPACITY = 2048
END_TOKEN = 0
GROUP_PIECES = 20_000
# weights of tokens, documents and attention cost
WEIGHTS = (1.0, 0.05, 0.05)
KEPT_WORDS = 300_000
LONGEST_KEPT = 40


class ByteEncoder:
    """Token ids of a text for a byte-level BPE whose pre-tokens never cross from a character into white space.

    So a text is the concatenation of runs of white space followed by other characters, and each run is encoded once, by the
    vocabulary's merges over bytes. Texts beyond Latin-1, whose classes of characters differ between libraries' Unicode
    tables, go to the tokenizer itself.
    """

    RUNS = re.compile(r"\s*\S+|\s+")
    # The pre-tokeniser's pattern.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in token): rank for token, rank in vocabulary.items()}
        self.encode = tiktoken.Encoding("bytes", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.kept: dict[str, bytes] = {}

    def run(self, run: str) -> bytes:
        out = np.array(self.encode(run), "<u4").tobytes()
        if len(run) <= LONGEST_KEPT:
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            self.kept[run] = out
        return out

    def __call__(self, text: str) -> bytes:
        if not text.isascii() and max(text) > "\xff":
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        kept, run = self.kept.get, self.run
        return b"".join([kept(w) or run(w) for w in self.RUNS.findall(text)])


def token_pieces(docs: DataFrame, tokenizer: str, end_token: int = END_TOKEN, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids`` (32-bit little-endian) and the document's ``place`` in the input."""
    end = np.array([end_token], "<u4").tobytes()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_memo(f"byte encoder {tokenizer}", lambda: ByteEncoder(tokenizer))
        for batch in batches:
            of, rows, held = [], [], 0
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for k, at in enumerate([0, *range(first, n, capacity)]):
                    size = capacity if k else first
                    of.append(i)
                    rows.append((k, at, size, ids[4 * at : 4 * (at + size)]))
                held += len(ids)
                if held > 32_000_000 or i + 1 == batch.num_rows:
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                    cut = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                    take = pa.array(of)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), *cut, batch.column(2).take(take)], names=["doc_id", "piece", "start", "length", "ids", "place"])
                    of, rows, held = [], [], 0

    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int, documents: int, cost: int, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece, pieces no longer than ``capacity``.

    A sequence's state is its used tokens, documents and cost. Pieces of equal length see the same scores, so a sequence
    keeps its score until it takes a piece.
    """
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    full = lengths == capacity
    sequence[full] = np.arange(full.sum())
    opened = int(full.sum())
    order = np.flatnonzero(~full)
    order = order[np.argsort(-lengths[order], kind="stable")]
    top, weight = np.array([capacity, documents, cost], float), np.array(weights)
    # free room of the open sequences: tokens, documents, cost; those that hold nothing more are left out from time to time
    room, name, size, least = np.zeros((1024, 3)), np.zeros(1024, np.int64), 0, lengths.min() if n else 0
    scores, scored_for = np.zeros(1024), -1.0

    def score(free: np.ndarray, need: np.ndarray) -> np.ndarray:
        left = free - need
        value = -(weight * (left / top) ** 2).sum(axis=1) if rule == "norm" else (weight * need * free / top**2).sum(axis=1)
        value[(left < 0).any(axis=1)] = -np.inf
        return value

    for i in order:
        length = float(lengths[i])
        need = np.array([length, 1.0, length * length])
        if length != scored_for:
            still = (room[:size, 0] >= least) & (room[:size, 1] >= 1) & (room[:size, 2] >= least * least)
            if still.sum() < 0.75 * size:
                keep = np.flatnonzero(still)
                room[: len(keep)], name[: len(keep)], size = room[keep], name[keep], len(keep)
            scores[:size], scored_for = score(room[:size], need), length
        k = int(scores[:size].argmax()) if size else 0
        if not size or scores[k] == -np.inf:
            if size == len(room):
                room, name, scores = np.concatenate([room, np.zeros_like(room)]), np.concatenate([name, np.zeros_like(name)]), np.concatenate([scores, np.zeros_like(scores)])
            k, room[size], name[size], opened, size = size, top, opened, opened + 1, size + 1
        sequence[i], offset[i] = name[k], capacity - room[k, 0]
        room[k] -= need
        scores[k] = score(room[k : k + 1], need)[0]
    return sequence, offset


def place(
    pieces: DataFrame,
    documents: int,
    capacity: int = CAPACITY,
    most_documents: "int | None" = None,
    most_cost: "int | None" = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; they need ``length``, ``piece`` and ``place``, other columns ride along.

    ``documents`` is the number of documents, from which the number of groups follows: each has one piece at most that is
    not full.
    """
    most_documents = capacity if most_documents is None else most_documents
    most_cost = capacity * capacity if most_cost is None else most_cost
    groups = max(1, -(-documents // group_pieces))
    keyed = pieces.withColumn("group", F.pmod(F.xxhash64("place"), F.lit(groups)))
    kept = [f for f in pieces.schema.fields if f.name != "place"]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(rows: pa.Table) -> pa.Table:
        # the order of shuffled rows may differ between runs
        rows = rows.take(pa.array(np.lexsort([rows.column("piece").to_numpy(), rows.column("place").to_numpy()])))
        base = rows.column("group")[0].as_py() << 36 if len(rows) else 0
        sequence, offset = best_fit(rows.column("length").to_numpy(), capacity, most_documents, most_cost, weights, rule)
        return rows.drop_columns(["group", "place"]).append_column("sequence_id", pa.array(base + sequence)).append_column("offset", pa.array(offset))

    return keyed.groupBy("group").applyInArrow(pack, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 2048 tokens as best fit finds; pieces with the checksum of their ids."""
    docs = table(spark, sf_dir, "documents")
    pieces = token_pieces(docs, default_tokenizer()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(pieces, docs.count()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
