"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs the votes.

1. One pass over the texts counts words, lines, symbols and repeats exactly (no hashes stand for words or lines).
2. Each rule votes bad (-1) or good (1) or abstains (0); a document is described by its votes.
3. Equal vote lists are counted with map-side combining.  k rules give at most 3^k lists whatever the number of documents, so
   expectation-maximisation runs over a table of fixed size that stands for all documents.
4. The posterior probability of good quality is a sum of one weight per vote, computed by column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import shared_table
from driftwell.llm.windows import SPACE, column_bytes

SLICE = 4 << 20  # bytes of text looked at together
REPEATED = 5  # words of a window
ROUNDS, TOLERANCE = 500, 1e-9
PRIOR_GOOD = 0.8  # before any evidence
CAUGHT, BLAMED = 0.3, 0.01  # shares of bad and of good documents on which a rule starts to vote bad
STRENGTH = 0.1  # weight of these starting points, as a share of all documents

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
DIGITS = np.isin(np.arange(256), list(b"0123456789"))
UPPER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
LETTERS = UPPER | np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz")) | (np.arange(256) >= 0x80)
CODE_POINTS = (np.arange(256) & 0xC0) != 0x80
ENDINGS = np.isin(np.arange(256), list(b".!?\""))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_letter_words", "n_digits", "n_upper"]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags between each two offsets."""
    out = np.zeros(len(offsets) - 1, np.int64)
    some = offsets[1:] > offsets[:-1]
    if some.any():
        out[some] = np.add.reduceat(flags, offsets[:-1][some], dtype=np.int64)
    return out


def _codes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Equal numbers for equal byte strings; ``data`` holds the strings one after another."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return strings.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].reshape(-1).astype(np.int64) if len(a) else a


def repeated_words(codes: np.ndarray, rows: np.ndarray, width: int = REPEATED) -> np.ndarray:
    """Marks words covered by a window of ``width`` words whose words are met twice or more in one row."""
    covered = np.zeros(len(codes), bool)
    count = len(codes) - width + 1
    if count < 1:
        return covered
    names, length = codes, 1  # names of the runs of ``length`` words that begin at each place
    while length < width:
        step = min(length, width - length)
        names = _pairs(names[:-step], names[step:])
        length += step
    inside = np.flatnonzero(rows[:count] == rows[width - 1 :])
    if not len(inside):
        return covered
    _, which, met = np.unique(names[inside] * (int(rows[-1]) + 1) + rows[inside], return_inverse=True, return_counts=True)
    again = inside[met[which.reshape(-1)] > 1]
    for step in range(width):
        covered[again + step] = True
    return covered


def _measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    filled = offsets[1:] > offsets[:-1]
    inside = ~SPACE[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    codes = _codes(data[inside], ends - starts) if len(starts) else np.empty(0, np.int64)
    covered = repeated_words(codes, row)
    lettered = np.add.reduceat(LETTERS[data], starts, dtype=np.int64) > 0 if len(starts) else np.empty(0, bool)

    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    line_row = np.repeat(np.arange(n), 1 + _per_row(data == 0x0A, offsets))
    last = np.searchsorted(starts, line_ends)
    worded = last > np.searchsorted(starts, line_starts)
    line_codes = _codes(data[data != 0x0A], line_ends - line_starts)
    distinct = np.unique(line_codes[worded] * n + line_row[worded]) % n
    lines = np.bincount(line_row[worded], minlength=n)
    ended = ENDINGS[data[ends[last[worded] - 1] - 1]]
    return {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": _per_row(inside & CODE_POINTS[data], offsets),
        "n_symbols": _per_row(SYMBOLS[data], offsets),
        "n_dup_lines": lines - np.bincount(distinct, minlength=n),
        "n_repeat_words": np.bincount(row[covered], minlength=n),
        "n_lines": lines,
        "n_ended_lines": np.bincount(line_row[worded][ended], minlength=n),
        "n_letter_words": np.bincount(row[lettered], minlength=n),
        "n_digits": _per_row(DIGITS[data], offsets),
        "n_upper": _per_row(UPPER[data], offsets),
    }


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    begin = 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SLICE, "right")) - 1)
        yield begin, end
        begin = end


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of ``COUNTS`` per row: words, code points in words, symbols, repeated lines, words in repeated
    windows, lines with a word, those that end a sentence, words with a letter, digits and capital letters.

    Null texts count as empty; repeated rows and null ids stay rows of their own; other columns are ignored; no rows give no
    rows.  Texts are read some megabytes at a time, a longer one alone, with arrays of about twelve times its bytes.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for begin, end in _slices(offsets):
                low, high = int(offsets[begin]), int(offsets[end])
                found = _measure(data[low:high], offsets[begin : end + 1] - low)
                columns = [batch.column("doc_id").slice(begin, end - begin).cast(pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(found[c].astype(np.int64)) for c in COUNTS], names=["doc_id", *COUNTS])

    schema = ", ".join(f"{c} long" for c in ["doc_id", *COUNTS])
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scan, schema)


def base_failed() -> Column:
    """Fewer than ten words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def rules() -> dict[str, tuple[Column, Column]]:
    """Name -> (votes bad, votes good); neither is an abstention.  All shares are compared without division."""
    words, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    symbols, repeats, copies = F.col("n_symbols"), F.col("n_repeat_words"), F.col("n_dup_lines")
    ended, letters, digits, upper = F.col("n_ended_lines"), F.col("n_letter_words"), F.col("n_digits"), F.col("n_upper")
    some = words > 0
    return {
        "length": (words < 10, words >= 40),
        "word_length": ((chars < words * 3) | (chars > words * 10), some & (chars * 2 >= words * 7) & (chars <= words * 8)),
        "symbols": (symbols * 10 > words, some & (symbols * 50 <= words)),
        "symbol_share": (symbols * 10 > chars, some & (symbols * 100 <= chars)),
        "letters": (letters * 10 < words * 8, some & (letters * 20 >= words * 19)),
        "copied_lines": (copies * 10 > lines * 3, (copies * 20 <= lines) & (lines > 1)),
        "repeats": (repeats * 10 > words, (repeats * 50 <= words) & (words >= 20)),
        "sentence_ends": (ended * 5 < lines, (ended * 10 >= lines * 6) & (lines > 0)),
        "digits": (digits * 5 > chars, some & (digits * 20 <= chars)),
        "capitals": (upper * 10 > chars * 4, some & (upper * 5 <= chars)),
    }


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def estimate(lists: Mapping[tuple[int, ...], int], n_rules: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(log odds of good before any vote, weight of each rule's bad vote, of its good vote), from counted vote lists.

    Expectation-maximisation: votes of a document count as independent given its quality, an abstention says nothing, and a
    weight is the logarithm of how much likelier the vote is on a good document.  A rule starts by voting bad on ``CAUGHT`` of
    bad and ``BLAMED`` of good documents, which stays in the estimate like votes on ``STRENGTH`` of all documents.  Without
    documents these starting values are the result.
    """
    order = sorted(lists)
    votes = np.array(order, np.int64).reshape(len(order), n_rules)
    counts = np.array([lists[k] for k in order], float)
    total, minus, plus = counts.sum(), (votes == -1).astype(float), (votes == 1).astype(float)
    start = np.repeat([[CAUGHT], [BLAMED]], n_rules, axis=1)
    blame, good, strength = start, PRIOR_GOOD, STRENGTH * total
    for _ in range(ROUNDS if order else 0):
        odds = math.log(good / (1 - good)) + minus @ np.log(blame[1] / blame[0]) + plus @ np.log((1 - blame[1]) / (1 - blame[0]))
        share = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        masses = np.stack([counts * (1 - share), counts * share])
        fresh = (masses @ minus + strength * start) / (masses @ minus + masses @ plus + strength)
        good = float((masses[1].sum() + strength * PRIOR_GOOD) / (total + strength))
        change, blame = np.abs(fresh - blame).max(), fresh
        if change < TOLERANCE:
            break
    return math.log(good / (1 - good)), np.log(blame[1] / blame[0]), np.log((1 - blame[1]) / (1 - blame[0]))


def judge(docs: DataFrame) -> DataFrame:
    """Counts of ``measures``, ``votes`` (array in the order of ``rules``), ``posterior``, ``base_failed`` and ``kept``.

    A document is kept if it passes the base and good quality is at least as likely as bad.  Texts without words fail the base.
    Rows, nulls and other columns are treated as by ``measures``.
    """
    counted = shared_table(measures(docs), "measures")
    named = rules()
    voted = counted.withColumn("votes", F.array(*(vote(bad, good) for bad, good in named.values())))
    lists = {tuple(r["votes"]): r["n"] for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 3 ** rules
    prior, bad, good = estimate(lists, len(named))
    odds = F.lit(prior)
    for j in range(len(named)):
        heard = F.col("votes")[j]
        odds = odds + F.when(heard == -1, F.lit(float(bad[j]))).when(heard == 1, F.lit(float(good[j]))).otherwise(F.lit(0.0))
    judged = voted.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
