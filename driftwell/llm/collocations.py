"""Phrase collocations by set-oriented mining over sorted occurrence relations.

The relation of length k holds one entry per occurrence of a frequent phrase of k words: the place where it begins and the code
of the phrase in its block, which stands for the phrase's number.  Places grow by one from word to word of a piece and by two
from piece to piece.  A relation is persisted in blocks of up to a million entries sorted by place, so each step is a scan:

1. merge-join a block with itself at the next place: two frequent phrases of k words that overlap give one of k + 1;
2. group and count: each block deals its distinct pairs and their number to parts, packed; in a part the pairs of all blocks
   meet and are summed, and those met often enough get a number;
3. semi-join: the numbers return to the blocks by (block, part) and entries of rarer phrases go before the next length.

Shuffled are the distinct words or pairs of each block, a few bytes for each, and the numbers of the frequent ones.  The pairs
of a block are not stored but merged again when their numbers return.  Words and phrases are told apart by their text or by
pairs of numbers, never by hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import bucketed_table, discard, running_total, shared_table
from driftwell.llm.feistel import mix64
from driftwell.llm.windows import column_bytes

LONGEST, LEAST, BEST = 5, 100, 2000
SLICE = 16 << 20  # bytes of text looked at together
BLOCK = 1 << 20  # entries of a block
PARTS, PART = 64, 1 << 20  # parts at least, words or pairs of blocks that meet in one

#: Bytes that end a piece, bytes between the words of a piece.
ENDS = np.isin(np.arange(256), list(b".,;:!?\x0a\x0b\x0c\x0d"))
BLANKS = np.isin(np.arange(256), list(b" \t"))
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)

DEALT = "part int, block long, lang string, n int, listed binary"
#: A part returns rows (block, part, n, at, ids) for the blocks and rows (id, ..., f) of its frequent words or pairs.
COUNTED = "block long, part int, n int, at binary, ids binary, id long, lang string, word binary, left long, right long, f long"
RELATION = "block long, n long, known int, ids binary, codes binary, steps binary, counted long"


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on as eight byte planes, of which the upper ones are mostly 0."""
    return np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(data: bytes, n: int, at: int = 0) -> np.ndarray:
    """The ``at``-th of the lists of ``n`` numbers that ``data`` begins with."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, 8 * n * at).reshape(8, n).T).view("<i8").reshape(-1)


def _packed(*lists: np.ndarray, tail: bytes = b"") -> bytes:
    return zstandard.ZstdCompressor().compress(b"".join([*map(_planes, lists), tail]))


def _unpacked(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows in the order of their part, where each part begins)."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _dealt(block: int, lang: str | None, cuts: np.ndarray, pack: Callable[[slice], bytes]) -> pa.RecordBatch:
    """A row for each part that has words or pairs of the block."""
    full = np.flatnonzero(np.diff(cuts))
    listed = [pack(slice(cuts[p], cuts[p + 1])) for p in full.tolist()]
    columns = [pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array([lang] * len(full), pa.string()), pa.array(np.diff(cuts)[full], pa.int32()), pa.array(listed, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "block", "lang", "n", "listed"])


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of each word, place of each word) of some texts."""
    inside = ~(ENDS[data] | BLANKS[data])
    filled = offsets[1:] > offsets[:-1]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    if not len(starts):
        return pa.array([], pa.binary()), starts, starts
    piece = np.searchsorted(np.flatnonzero(ENDS[data]), starts) + np.searchsorted(offsets, starts, "right")
    places = np.arange(1, len(starts) + 1) + np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(LOWER[data[inside]])])
    found = strings.dictionary_encode()
    return found.dictionary.cast(pa.binary()), found.indices.to_numpy(zero_copy_only=False).astype(np.int64), places


def occurrences(docs: DataFrame, longest: int = LONGEST, size: int = BLOCK) -> DataFrame:
    """Blocks of word occurrences: one row with the distinct words of a block and their number, and its entries.

    A block holds one language.  A run of words longer than a block goes on in the next one, which repeats no counted entry:
    entries from place ``counted`` on only complete the phrases that begin before.
    """

    def blocks(data: np.ndarray, offsets: np.ndarray, lang: str, names: Iterator[int]) -> Iterator[pa.RecordBatch]:
        words, codes, places = _words(data, offsets)
        for low in range(0, len(codes), size):
            own, high = min(low + size, len(codes)), min(low + size + longest - 1, len(codes))
            distinct, local = np.unique(codes[low:high], return_inverse=True)
            local = local.reshape(-1)
            met = np.bincount(local[: own - low], minlength=len(distinct))
            shift = places[low] - 1
            counted = int(places[own] - shift) if own < len(codes) else int(places[-1] - shift + 1)
            found = words.take(pa.array(distinct))
            data, ends = column_bytes(found)
            listed = _packed(met, np.diff(ends), tail=data[ends[0] : ends[-1]].tobytes())
            row = [next(names), own - low, len(distinct), lang, listed, high - low, _packed(local), _packed(np.diff(places[low:high] - shift, prepend=0)), counted]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["block", "words", "known", "lang", "listed", "n", "codes", "steps", "counted"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = iter(range(TaskContext.get().partitionId() << 40, 1 << 63))
        for batch in batches:
            order = np.argsort(np.array(batch.column("lang").to_pylist(), object), kind="stable")
            batch = batch.take(pa.array(order))
            langs = batch.column("lang").to_pylist()
            data, offsets = column_bytes(batch.column("text"))
            begin = 0
            while begin < len(langs):
                end = begin + 1
                while end < len(langs) and langs[end] == langs[begin] and offsets[end + 1] - offsets[begin] <= SLICE:
                    end += 1
                low, high = int(offsets[begin]), int(offsets[end])
                yield from blocks(data[low:high], offsets[begin : end + 1] - low, langs[begin], names)
                begin = end

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(scan, "block long, words long, known long, lang string, listed binary, n long, codes binary, steps binary, counted long")


class Words:
    """How blocks of words list their words, and how a part tells them apart."""

    columns = ("lang", "word")

    def __init__(self, parts: int):
        self.parts = parts

    def order(self, row: dict) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(words by part, where each part begins, (number, bytes, begin and size of each word))."""
        data, n = _unpacked(row["listed"]), row["known"]
        met, sizes = _numbers(data, n), _numbers(data, n, 1)
        letters = np.frombuffer(data, np.uint8, offset=16 * n)
        starts = _starts(sizes)
        inside = np.arange(len(letters)) - np.repeat(starts, sizes)
        mixed = mix64(np.add.reduceat(mix64((inside + 1) * 256 + letters), starts))
        return *_by_part((mixed % np.uint64(self.parts)).astype(np.int64), self.parts), (met, letters, starts, sizes)

    def deal(self, row: dict) -> pa.RecordBatch:
        order, cuts, (met, letters, starts, sizes) = self.order(row)
        size = sizes[order]
        begin = _starts(size)
        moved = letters[np.repeat(starts[order] - begin, size) + np.arange(len(letters))]
        ends = np.append(begin, len(moved))
        return _dealt(row["block"], row["lang"], cuts, lambda s: _packed(met[order[s]], size[s], tail=moved[ends[s.start] : ends[s.stop]].tobytes()))

    def meet(self, part: int, rows: list[dict]) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], dict]]:
        """(code of each listed word, its number, columns of some codes) of the rows of a language."""
        data = [_unpacked(r["listed"]) for r in rows]
        met, sizes = (np.concatenate([_numbers(x, r["n"], at) for x, r in zip(data, rows, strict=True)]) for at in (0, 1))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        letters = b"".join(x[16 * r["n"] :] for x, r in zip(data, rows, strict=True))
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
        return found.indices.to_numpy().astype(np.int64), met, lambda some: {"word": found.dictionary.take(pa.array(some)).cast(pa.binary())}

    def again(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words by part, where each part begins, code and place of each entry) of a block."""
        return *self.order(row)[:2], _numbers(_unpacked(row["codes"]), row["n"]), np.cumsum(_numbers(_unpacked(row["steps"]), row["n"]))


class Pairs:
    """The same for pairs of overlapping phrases: those whose numbers have a like sum, modulo the parts, meet in a part.

    In a part a pair is one number, from which both of its phrases follow; in a block it grows, so its steps are listed.
    """

    columns = ("left", "right")

    def __init__(self, parts: int, ids: int):
        self.parts, self.span = parts, ids // parts + 1
        if ids * self.span >= 1 << 63:
            raise ValueError(f"pairs of {ids} phrases pass 64 bits")

    def merge(self, row: dict) -> tuple[np.ndarray, ...]:
        """(left and right of each distinct pair, ascending; pair and place of each entry) of a block joined with itself at the next place."""
        known = _numbers(_unpacked(row["ids"]), row["known"])
        local, steps = (_numbers(_unpacked(row[c]), row["n"]) for c in ("codes", "steps"))
        first = np.flatnonzero(steps[1:] == 1)
        pairs, codes = np.unique(local[first] * len(known) + local[first + 1], return_inverse=True)
        return known[pairs // len(known)], known[pairs % len(known)], codes.reshape(-1), np.cumsum(steps)[first]

    def deal(self, row: dict) -> pa.RecordBatch:
        left, right, codes, places = self.merge(row)
        met = np.bincount(codes[places < row["counted"]], minlength=len(left))
        order, cuts = _by_part((left + right) % self.parts, self.parts)
        one, met = (left * self.span + right // self.parts)[order], met[order]
        return _dealt(row["block"], None, cuts, lambda s: _packed(met[s], np.diff(one[s], prepend=0)))

    def meet(self, part: int, rows: list[dict]) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], dict]]:
        data = [(_unpacked(r["listed"]), r["n"]) for r in rows]
        met = np.concatenate([_numbers(x, n) for x, n in data])
        pairs, codes = np.unique(np.concatenate([np.cumsum(_numbers(x, n, 1)) for x, n in data]), return_inverse=True)

        def named(some: np.ndarray) -> dict:
            left = pairs[some] // self.span
            return {"left": left, "right": pairs[some] % self.span * self.parts + (part - left) % self.parts}

        return codes.reshape(-1), met, named

    def again(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        left, right, codes, places = self.merge(row)
        return *_by_part((left + right) % self.parts, self.parts), codes, places


def numbered(blocks: DataFrame, name: str, least: int, listing: Words | Pairs) -> tuple[DataFrame, DataFrame]:
    """(words or pairs of ``blocks`` met at least ``least`` times with ``id`` and ``f``, relation of their entries)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield listing.deal(batch.slice(row, 1).to_pylist()[0])

    kinds = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("at", pa.binary()), ("ids", pa.binary()), ("id", pa.int64()), ("lang", pa.string()), ("word", pa.binary()), ("left", pa.int64()), ("right", pa.int64()), ("f", pa.int64())])

    def rows_of(columns: dict, size: int) -> pa.Table:
        return pa.table([pa.array(columns[k.name], k.type) if k.name in columns else pa.nulls(size, k.type) for k in kinds], schema=kinds)

    def count(dealt: pa.Table) -> pa.Table:
        part, made, out = dealt.column("part")[0].as_py(), 0, [kinds.empty_table()]
        lang_of = lambda r: r["lang"] or ""
        for lang, rows in groupby(sorted(dealt.to_pylist(), key=lang_of), lang_of):
            rows = list(rows)
            codes, met, named = listing.meet(part, rows)
            f = np.bincount(codes, weights=met).astype(np.int64)
            often = np.flatnonzero(f >= least)
            ids = np.full(len(f), -1)
            ids[often] = (made + np.arange(len(often))) * listing.parts + part
            made += len(often)
            out.append(rows_of({"id": ids[often], "lang": [lang] * len(often), "f": f[often]} | named(often), len(often)))
            back, end = [], 0
            for r in rows:
                mine = ids[codes[end : end + r["n"]]]
                end += r["n"]
                if len(at := np.flatnonzero(mine >= 0)):
                    back.append((r["block"], part, len(at), _packed(np.diff(at, prepend=0)), _packed(mine[at])))
            if back:
                out.append(rows_of(dict(zip(("block", "part", "n", "at", "ids"), zip(*back, strict=True), strict=True)), len(back)))
        return pa.concat_tables(out)

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                order, cuts, codes, places = listing.again(row)
                ids = np.full(len(order), -1)
                for r in row["back"]:
                    ids[order[cuts[r["part"]] + np.cumsum(_numbers(_unpacked(r["at"]), r["n"]))]] = _numbers(_unpacked(r["ids"]), r["n"])
                known, to = np.unique(ids, return_inverse=True)
                rare = int(known[0] < 0)
                codes = to.reshape(-1)[codes] - rare
                stay = codes >= 0
                values = [row["block"], int(stay.sum()), len(known) - rare, _packed(known[rare:]), _packed(codes[stay]), _packed(np.diff(places[stay], prepend=0)), row["counted"]]
                names = ["block", "n", "known", "ids", "codes", "steps", "counted"]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if c == "known" else None) for c, v in zip(names, values, strict=True)], names=names)

    counted = shared_table(blocks.mapInArrow(deal, DEALT).groupBy("part").applyInArrow(count, COUNTED), f"counted-{name}")
    frequent = counted.where("block is null").select("id", *listing.columns, "f")
    back = counted.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("part", "n", "at", "ids")).alias("back"))
    return frequent, bucketed_table(blocks.join(back, "block").mapInArrow(renumber, RELATION), "block", f"relation{name}")


def parts_for(listed: int | None) -> int:
    return max(PARTS, (listed or 0) // PART)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, size: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n words) and, for each length from 1, the phrases met at least ``least`` times in their language.

    Phrases: id, lang, phrase, last (its last word), f, prefixes and suffixes (f of the first and of the last 1, 2, ... words,
    itself last) and, from two words on, left and right (ids of the phrase without its last and without its first word).
    """
    # Bucketed by block: ids return to the entries without moving them.
    blocks = bucketed_table(occurrences(docs, longest, size), "block", "words")
    totals = shared_table(blocks.groupBy("lang").agg(F.sum("words").alias("n_words")), "totals")
    words, relation = numbered(blocks, "1", least, Words(parts_for(blocks.agg(F.sum("known")).first()[0])))
    text = F.col("word").cast("string")
    found = [words.select("id", "lang", text.alias("phrase"), text.alias("last"), "f", F.array("f").alias("prefixes"), F.array("f").alias("suffixes"))]
    for length in range(2, longest + 1):
        discard(blocks)
        short, blocks = found[-1], relation
        entries, ids = blocks.agg(F.sum("n")).first()[0], short.agg(F.max("id")).first()[0]
        pairs, relation = numbered(blocks, str(length), least, Pairs(parts_for(entries), (ids or 0) + 1))
        start = short.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.col("prefixes").alias("p"))
        rest = short.select(F.col("id").alias("right"), "last", F.col("suffixes").alias("s"))
        longer = pairs.join(start, "left").join(rest, "right")
        columns = ["id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f", "left", "right"]
        columns += [F.concat("p", F.array("f")).alias("prefixes"), F.concat("s", F.array("f")).alias("suffixes")]
        found.append(shared_table(longer.select(*columns), f"named-{length}"))
    discard(blocks, relation)
    return totals, found


def weakest_cut(prefixes: list[int], suffixes: list[int], words: int) -> tuple[int, int, int, int]:
    """(score, words before the cut, l, r) of the lowest-scoring cut, in integers of any size; ties go to the earliest cut."""
    a = prefixes[-1]
    cuts = ((1000 * a * words // (l * r), k + 1, l, r) for k, (l, r) in enumerate(zip(prefixes[:-1], suffixes[-2::-1], strict=True)))
    return min(cuts)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = 100) -> DataFrame:
    """lang, phrase, length, a, l, r, n, k (words before its weakest cut), score of phrases of 2 to ``longest`` words.

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and at blanks into words.  Left out are phrases met
    fewer than ``least`` times in their language, and those inside a longer phrase with at least ``covered`` percent of their
    occurrences (it is enough to look one word further: a phrase between the two is met as often as the longer one at least).
    Null languages are ``und``, null texts are empty, repeated rows count each time, other columns are ignored, and no rows give
    no rows.  A text is held by one task, with arrays of about ten times its bytes if it is longer than some megabytes.
    """
    totals, found = frequent_phrases(docs, longest, least)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, s, n = (batch.column(c).to_pylist() for c in ("prefixes", "suffixes", "n"))
            cuts = [weakest_cut(*x) for x in zip(p, s, n, strict=True)]
            score, k, l, r = (pa.array([c[i] for c in cuts], pa.int64()) for i in range(4))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "phrase", "a")), l, r, batch.column("n"), k, score], names=["lang", "phrase", "a", "l", "r", "n", "k", "score"])

    kept = None
    for at, phrases in enumerate(found[1:], 1):
        if at + 1 < len(found):
            longer = found[at + 1]
            inside = longer.select(F.col("left").alias("id"), "f").unionByName(longer.select(F.col("right").alias("id"), "f"))
            phrases = phrases.join(inside.groupBy("id").agg(F.max("f").alias("most")), "id", "left")
            phrases = phrases.where(F.coalesce(F.col("most") * 100 < F.col("f") * covered, F.lit(True)))
        phrases = phrases.select("lang", "phrase", F.col("f").alias("a"), "prefixes", "suffixes")
        kept = phrases if kept is None else kept.unionByName(phrases)
    rows = kept.join(totals.withColumnRenamed("n_words", "n"), "lang")
    scored = rows.mapInArrow(scan, "lang string, phrase string, a long, l long, r long, n long, k long, score long")
    return scored.withColumn("length", F.size(F.split("phrase", " ")))


def best(scored: DataFrame, per_lang: int = BEST) -> DataFrame:
    """The first ``per_lang`` phrases of each language with ``rank`` from 1: score, then a, descending, then phrase in byte order.

    Places are running totals over range partitions, so a language of any size is spread over tasks.
    """
    ordered = scored.withColumns({"__score": -F.col("score"), "__a": -F.col("a"), "__one": F.lit(1)})
    placed = running_total(ordered, ["lang"], ["__score", "__a", "phrase"], "__one").where(F.col("position") < per_lang)
    return placed.withColumn("rank", (F.col("position") + 1).cast("long")).drop("__score", "__a", "__one", "before", "position")
