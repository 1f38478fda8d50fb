"""Byte-level BPE: global distinct-word shuffle for encoding, a join with the token-byte table for decoding.

1. Every text is split into pre-tokens.  They are exploded with their positions in packed form: a block of documents keeps
   the distinct words of the block and, position by position, the number of the word (``places``).
2. The words go to buckets by hash; there the words of all blocks meet and each distinct word is encoded once.
3. Their ids return to the blocks, where the positions are filled in order and cut into documents.

About twelve bits per pre-token are stored, in a table bucketed by block, so that the return of the ids moves the ids and not
the positions.  Shuffled are the distinct words of each block and their ids, never one row per pre-token; a frequent word is
sent once per block.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import bucketed_table, shared_table

#: Splits text before the merges, as the rank files expect.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 256
BLOCK_TOKENS, BLOCK_WORDS = 3_500_000, 450_000
LEVEL = 9  # of zstd
KNOWN = 1_000_000  # words whose ids a task remembers; beyond, it forgets and encodes anew


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as four byte planes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=LEVEL).compress(planes.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def split_blocks(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """(block, doc_ids, counts, places, bucket_of, words): one row per block of documents.

    ``places`` holds the word number of each position, ``bucket_of`` the bucket of each word, ``words`` one blob per bucket.
    """

    def close(block: int, ids: list, counts: list, numbers: dict, places: list) -> pa.RecordBatch:
        import zlib

        flat = np.concatenate(places)
        raw = [w.encode() for w in numbers]
        # Numbers by falling frequency leave the upper bytes of most positions at 0.
        often = np.argsort(-np.bincount(flat, minlength=len(raw)), kind="stable")
        renumbered = np.empty(len(raw), np.uint32)
        renumbered[often] = np.arange(len(raw), dtype=np.uint32)
        bucket = np.fromiter((zlib.crc32(raw[i]) % buckets for i in often.tolist()), np.uint32, len(raw))
        words = []
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            mine = [raw[i] for i in often[order[cuts[b] : cuts[b + 1]]].tolist()]
            lengths = np.fromiter(map(len, mine), "<u4", len(mine))
            words.append(compressor.compress(len(mine).to_bytes(4, "little") + lengths.tobytes() + b"".join(mine)) if mine else None)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int64())),
                pa.array([_packed(renumbered[flat])], pa.binary()),
                pa.array([_packed(bucket)], pa.binary()),
                pa.array([words], pa.list_(pa.binary())),
            ],
            names=["block", "doc_ids", "counts", "places", "bucket_of", "words"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        block = TaskContext.get().partitionId() << 32
        ids, counts, numbers, places, held = [], [], _Numbers(), [np.empty(0, np.uint32)], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                tokens = find(text.as_py() or "")
                places.append(np.fromiter(map(numbers.__getitem__, tokens), np.uint32, len(tokens)))
                ids.append(doc_id)
                counts.append(len(tokens))
                held += len(tokens)
                if held >= BLOCK_TOKENS or len(numbers) >= BLOCK_WORDS:
                    yield close(block, ids, counts, numbers, places)
                    block += 1
                    ids, counts, numbers, places, held = [], [], _Numbers(), [np.empty(0, np.uint32)], 0
        if ids:
            yield close(block, ids, counts, numbers, places)

    columns = "block long, doc_ids array<long>, counts array<long>, places binary, bucket_of binary, words array<binary>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, columns)


def encode_words(blocks: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(block, bucket, ids): the ids of the words of each bucket, in order; each distinct word is encoded once per bucket."""
    table = blocks.sparkSession.sparkContext.broadcast(ranks)
    dealt = blocks.select("block", F.posexplode("words").alias("bucket", "words")).where("words is not null")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        # Each word is one match of the split already, so the pattern here takes all of it.
        one = tiktoken.Encoding("word", pat_str=r"(?s:.+)", mergeable_ranks=table.value, special_tokens={}).encode_ordinary
        known: dict[bytes, list[int]] = {}
        at = None
        for batch in batches:
            for block, bucket, blob in zip(*[batch.column(c).to_pylist() for c in ("block", "bucket", "words")], strict=True):
                if bucket != at:
                    known, at = {}, bucket
                data = zstandard.ZstdDecompressor().decompress(blob)
                n = int.from_bytes(data[:4], "little")
                stops = 4 + 4 * n + np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64)
                flat: list[int] = []
                sizes = []
                start = 4 + 4 * n
                for stop in stops.tolist():
                    word = data[start:stop]
                    start = stop
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        ids = known[word] = one(word.decode())
                    flat += ids
                    sizes.append(len(ids))
                out = np.array([*sizes, *flat], np.uint32)
                yield pa.RecordBatch.from_pydict(
                    {"block": pa.array([block], pa.int64()), "bucket": pa.array([bucket], pa.int32()), "n": pa.array([n], pa.int32()), "ids": pa.array([_packed(out)], pa.binary())}
                )

    return dealt.mapInArrow(scan, "block long, bucket int, n int, ids binary")


def encode(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_tokens and ids (binary: little-endian unsigned 32-bit integers) of every whole text, without special tokens.

    A null or empty text has no ids; a null doc_id and repeated rows are rows like any other; columns other than doc_id and
    text are ignored; no rows give no rows.
    """
    blocks = bucketed_table(split_blocks(docs, pattern, buckets), "block", "blocks")
    words = encode_words(blocks, read_ranks(ranks_path))
    gathered = words.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "ids"))).alias("encoded"))
    gathered = shared_table(gathered, "encoded-words")
    joined = blocks.select("block", "doc_ids", "counts", "places", "bucket_of").join(gathered, "block", "left").drop("block")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, counts = batch.column("doc_ids")[row].as_py(), batch.column("counts")[row].as_py()
                sizes, flats = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)]
                for part in batch.column("encoded")[row].as_py() or []:
                    numbers = _unpacked(part["ids"])
                    sizes.append(numbers[: part["n"]])
                    flats.append(numbers[part["n"] :])
                by_bucket, flat = np.concatenate(sizes).astype(np.int64), np.concatenate(flats)
                order = np.argsort(_unpacked(batch.column("bucket_of")[row].as_py()), kind="stable")
                size, begin = np.empty_like(by_bucket), np.empty_like(by_bucket)
                size[order], begin[order] = by_bucket, np.cumsum(by_bucket) - by_bucket
                places = _unpacked(batch.column("places")[row].as_py())
                out, rows, tokens, at, held = [], [], [], 0, 0
                for doc_id, count in zip(ids, counts, strict=True):
                    mine = places[at : at + count]
                    at += count
                    n = size[mine]
                    total = int(n.sum())
                    found = flat[np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(total)]
                    rows.append(doc_id)
                    tokens.append(total)
                    out.append(found.astype("<u4").tobytes())
                    held += total
                    if held > 1_000_000:
                        yield _encoded(rows, tokens, out)
                        out, rows, tokens, held = [], [], [], 0
                yield _encoded(rows, tokens, out)

    return joined.mapInArrow(fill, "doc_id long, n_tokens long, ids binary")


def _encoded(rows: list, tokens: list, out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(tokens, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids"])


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) plus ``decoded`` (binary).  The token-byte table has one row per id of the
    vocabulary, which is fixed, so it is sent to the tasks and joined there; an id that it lacks is an error."""
    table = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in read_ranks(ranks_path).items()})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = table.value.__getitem__
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            texts = [b"".join(map(lookup, np.frombuffer(ids, "<u4").tolist())) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "n_tokens", "ids")], pa.array(texts, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(scan, "doc_id long, n_tokens long, ids binary, decoded binary")
