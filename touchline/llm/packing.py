"""Cost-balanced packing of tokenised documents into training sequences.

A piece of L tokens costs ``LINEAR * L + QUADRATIC * L * L``: the feed-forward part and attention inside the document.
Pieces go in falling length to the cheapest sequence that still has room for them; a piece that fits nowhere whole is cut
to fill the roomiest one. Each group's sequences hold exactly its tokens: as many full ones as they fill, and for the
rest sequences of power-of-two length, which need no padding.

Packing happens where the texts are read: tasks cut their stream of documents into groups of bounded size, so texts and
tokens are never shuffled and no group grows with the data. Sequence ids name the partition, the group and the sequence.

Defined results: a null or empty text is a document of the end token alone, equal rows are packed each, an empty table
gives no rows, a text of any length is cut. Columns other than the id and the text do not take part.
"""

from __future__ import annotations

import array
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import table, worker_memo

CAPACITY = 4096
GROUP_SEQUENCES = 256
END_TOKEN = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
KEPT_WORDS = 150_000
LONGEST_KEPT = 40


class WordEncoder:
    """Token ids of a text as little-endian 32-bit bytes, for a lower-casing byte-level BPE with word-end marks.

    Words never share tokens across white space, so a text is the concatenation of its words and a word is encoded once.
    Inside a word the merges run on bytes, with the word-end mark as a byte that UTF-8 never uses. Only texts in Latin-1
    take this way, for which the pre-tokeniser's classes are listed below; any other text goes to the tokenizer itself.
    """

    # The pre-tokeniser's pattern with the letters, numbers and white space of lower-case Latin-1.
    PIECES = re.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\x20\x09-\x0D\x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+"
    )

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
        ranks = {}
        for token, rank in vocabulary.items():
            if not token.startswith("<|"):
                body = token.removesuffix("</w>")
                ranks[bytes(byte[c] for c in body) + b"\xff" * (body != token)] = rank
        self.merge = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.kept: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        ids = array.array("I")
        for piece in self.PIECES.findall(word.lower()):
            ids.extend(self.merge(piece.encode() + b"\xff"))
        out = ids.tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            self.kept[word] = out
        return out

    def __call__(self, text: str) -> bytes:
        if not text.isascii() and max(text) > "\xff":
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        kept, word = self.kept.get, self.word
        return b"".join([kept(w) or word(w) for w in text.replace("\n", " ").split(" ")])


def pack_group(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one group; every sequence is filled exactly."""
    full, rest = divmod(sum(lengths), capacity)
    room = np.array([capacity] * full + [1 << b for b in range(rest.bit_length())[::-1] if rest >> b & 1])
    used, cost = np.zeros(len(room), dtype=np.int64), np.zeros(len(room))
    todo = [(min(capacity, n - s), d, s) for d, n in enumerate(lengths) for s in range(0, n, capacity)]
    out = []
    for length, document, start in sorted(todo, key=lambda t: (-t[0], t[1], t[2])):
        while length:
            fits = room >= length
            k = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(room.argmax())
            n = min(length, int(room[k]))
            out.append((document, start, n, k, int(used[k])))
            room[k] -= n
            used[k] += n
            cost[k] += linear * n + quadratic * n * n
            length, start = length - n, start + n
    return out


def pack(docs: DataFrame, tokenizer: str, end_token: int = END_TOKEN, capacity: int = CAPACITY, group_sequences: int = GROUP_SEQUENCES) -> DataFrame:
    """One row per piece: id, start, length, the ids as 32-bit little-endian bytes, the document's tokens, sequence, offset."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    id_type = docs.schema["doc_id"].dataType
    end = np.array([end_token], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        encode = worker_memo(f"encoder {tokenizer}", lambda: WordEncoder(tokenizer))
        names, kinds = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"], [to_arrow_type(id_type), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        keys, bodies, tokens, groups, part = [], [], 0, 0, 0

        def packed():
            base = (part << 40) | (groups << 16)
            rows = pack_group([len(b) // 4 for b in bodies], capacity)
            cut = ([keys[d] for d, *_ in rows], [r[1] for r in rows], [r[2] for r in rows], [bodies[d][4 * s : 4 * (s + n)] for d, s, n, *_ in rows])
            cut += ([len(bodies[d]) // 4 for d, *_ in rows], [base | r[3] for r in rows], [r[4] for r in rows])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cut, kinds)], names=names)

        for batch in batches:
            for key, text, at in zip(*(batch.column(c) for c in range(3))):
                part = at.as_py()
                bodies.append(encode(text.as_py() or "") + end)
                keys.append(key.as_py())
                tokens += len(bodies[-1]) // 4
                if tokens >= group_sequences * capacity:
                    yield packed()
                    keys, bodies, tokens, groups = [], [], 0, groups + 1
        if keys:
            yield packed()

    return docs.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens; pieces with the checksum of their ids."""
    pieces = pack(table(spark, sf_dir, "documents"), default_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
