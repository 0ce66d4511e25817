"""Token counts with overlap resynchronisation for huge documents."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

#: Characters of a chunk and of its overlap with the next one at first.
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 512
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: No alternative of PATTERN matches across a change from other characters to white space, so the
#: splitter starts a piece at each such place, whatever stands around it: tokens left of it depend on
#: the left text only and tokens from it on depend on the right text only.
#: (The controls 0x1c to 0x1f are white space to `re` but not to the splitter: no place stands at them.)
PROOF = re.compile(r"(?<=\S)(?=[^\S\x1c-\x1f])")
_codecs: dict[int, Codec] = {}


class Codec:
    """A byte-level BPE whose token lengths in bytes give offsets."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.enc = tiktoken.Encoding("foliospark", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.size = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            self.size[rank] = len(token)

    def ids(self, text: str) -> list[int]:
        return self.enc.encode_ordinary(text)

    def ends(self, text: str) -> tuple[list[int], np.ndarray]:
        """Token ids and the byte offset at which each ends."""
        ids = self.ids(text)
        return ids, np.cumsum(self.size[np.asarray(ids, np.int64)]) if ids else np.zeros(0, np.int64)


def splice(codec: Codec, text: str, chunk: int, overlap: int, proof: re.Pattern[str] = PROOF) -> tuple[list[int], int, int]:
    """Ids of the whole text from overlapping chunks, the number of chunks, and how often an overlap was widened.

    A chunk starts at `start`, of which the tokens are known to be right; the next starts at the end of
    its core. Their common boundary is a place in the overlap that both encodings have as a token
    boundary and that `proof` shows to be independent of the text on the other side. Without such a
    place the left chunk is encoded again with twice the overlap, up to the end of the text.
    """
    out: list[int] = []
    start, chunks, widened = 0, 0, 0
    while True:
        chunks += 1
        nxt = start + chunk
        if nxt + overlap >= len(text):
            return out + codec.ids(text[start:]), chunks, widened
        wide = overlap
        while True:
            stop = min(len(text), nxt + wide)
            ids, left = codec.ends(text[start:stop])
            if stop == len(text):
                return out + ids, chunks, widened
            shared = text[nxt:stop]
            _, right = codec.ends(shared)
            base = len(text[start:nxt].encode("utf-8", "surrogatepass"))
            found = None
            seen = np.concatenate(([0], right))
            at, done = 0, 0
            for m in proof.finditer(shared, 1):
                at += len(shared[done : m.start()].encode("utf-8", "surrogatepass"))
                done = m.start()
                i = int(np.searchsorted(left, base + at))
                j = int(np.searchsorted(seen, at))
                if i < len(left) and left[i] == base + at and j < len(seen) and seen[j] == at:
                    found = (i + 1, m.start())
                    break
            if found:
                break
            wide *= 2
            widened += 1
        out += ids[: found[0]]
        start = nxt + found[1]


def _shipped(spark: SparkSession, tokenizer_path: str) -> Broadcast[bytes]:
    with open(tokenizer_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _codec(raw: bytes) -> Codec:
    """The codec of a vocabulary, one in each process."""
    key = hash(raw)
    if key not in _codecs:
        _codecs[key] = Codec(raw)
    return _codecs[key]


def encoded(codec: Codec, text: str | None, chunk_chars: int, overlap_chars: int) -> tuple[int | None, int, int]:
    """Tokens of the whole text, the chunks that it took, and how often an overlap was widened."""
    if text is None:
        return None, 0, 0
    if len(text) <= chunk_chars + overlap_chars:
        return len(codec.ids(text)), 1, 0
    ids, chunks, wide = splice(codec, text, chunk_chars, overlap_chars)
    return len(ids), chunks, wide


def count_column(rows: DataFrame, text: str, name: str, tokenizer_path: str = TOKENIZER, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """The rows with the number of tokens as column `name` (bigint) in place of the column `text`; NULL for NULL."""
    shipped = _shipped(rows.sparkSession, tokenizer_path)
    at = rows.columns.index(text)
    schema = StructType([StructField(name, LongType()) if i == at else f for i, f in enumerate(rows.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped.value)
        for b in batches:
            n = pa.array([encoded(codec, t, chunk_chars, overlap_chars)[0] for t in b.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([n if i == at else c for i, c in enumerate(b.columns)], schema.names)

    return rows.mapInArrow(run, schema)


def token_counts(docs: DataFrame, tokenizer_path: str = TOKENIZER, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_tokens, n_chunks, n_widened of every row, in one pass without a shuffle.

    Texts of up to chunk_chars + overlap_chars characters are encoded at once, longer ones in chunks
    (see `splice`); the count always equals that of the whole text. NULL text: n_tokens NULL and no
    chunk; empty text: 0 tokens, 1 chunk. Repeated rows and NULL doc_ids are rows like others; further
    columns are ignored, whatever their names. The vocabulary (fixed size) is broadcast.
    """
    shipped = _shipped(docs.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped.value)
        for b in batches:
            n, c, w = zip(*(encoded(codec, t, chunk_chars, overlap_chars) for t in b.column(1).to_pylist()), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(c, pa.int32()), pa.array(w, pa.int32())],
                ["doc_id", "n_tokens", "n_chunks", "n_widened"],
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_chunks int, n_widened int")
