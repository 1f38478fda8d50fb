"""WARC archives: writing with revisit records, reading by boundary-chain verification.

Archives are not compressed, so Spark reads them in blocks, cut wherever the record magic occurs - also inside payloads.
Each block lists its candidates (a magic followed by a header with a length) with the offset of their successor.  Chains
are followed to the end of the block in place; across blocks, pointer jumping from offset 0 of every file doubles its reach
in each round.  Only candidates on the chain from the start of their file are records.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwell.llm.common import shared_table

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
REVISIT_FROM = 1000  # bytes of payload from which equal payloads are stored once
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record per row of (page_id, url, html), one archive per task.

    Of payloads (UTF-8 of html; null: empty) that are equal and have at least 1000 bytes, the one with the largest page_id is
    stored as a response, the others as revisits of it; rows that share the largest page_id, or groups without any id, are
    responses.  A null url is left out; control characters in it become spaces; other columns are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumns({"n": F.octet_length("payload"), "digest": F.sha1("payload")})
    same = rows.where(F.col("n") >= REVISIT_FROM).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("copies"))
    # Written first: its size then decides between a broadcast and a shuffled join.
    same = shared_table(same.where("copies > 1").select("digest", "kept"), "equal-payloads")
    told = rows.join(same, "digest", "left").withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("kept")), F.lit(False)) & F.col("kept").isNotNull())

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("n").cast("string")), F.lit("\r\n"))
    url = F.regexp_replace("url", r"[\x00-\x1F\x7F]", " ")
    length = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("n"))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", _urn(F.col("kept"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
    )
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload").cast("string"))
    told.select(F.concat(head, body).alias("value")).write.option("lineSep", END.decode()).text(path)


FIELDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _header(text: bytes) -> dict[str, str] | None:
    """Fields of a record header by lower-case name; None without a length."""
    fields = {}
    for row in text.split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if colon:
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields if re.fullmatch(r"\d{1,18}", fields.get("content-length", "")) else None


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _record(fields: dict[str, str], block: bytes) -> tuple:
    """page_id, url, type, refers_to, payload bytes and digest, from the header and the whole block."""
    http, found, payload = block.partition(END)
    kind = fields.get("warc-type")
    if kind == "revisit":
        size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        n, digest = int(size[1]) if size else None, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    else:
        payload = payload if found else block
        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, _page(fields.get("warc-refers-to")), n, digest


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """(file, start of the block, its segments between magics), block by block: one block of a file is held at a time."""
    at, held = None, []
    for batch in batches:
        for file, start, value in zip(*[batch.column(c).to_pylist() for c in ("file", "start", "value")], strict=True):
            if (file, start) != at:
                if at is not None:
                    yield *at, held
                at, held = (file, start), []
            held.append(value)
    if at is not None:
        yield *at, held


def _segments(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def scan_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Per block one row with its ``covered`` bytes, and one per candidate: place, successor and exit from the block, all
    relative to the block, with the record's fields where its bytes lie in the block."""
    schema = f"file string, start long, covered long, place long, next long, exit long, length long, {FIELDS}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, parts in _blocks(batches):
            places, at = [], 0
            for part in parts:
                places.append(at - len(MAGIC))  # of the magic before the segment
                at += len(part) + len(MAGIC)
            covered = at
            found = {}
            for i, part in enumerate(parts):
                stop = part.find(END)
                if (i == 0 and start == 0) or stop < 0:
                    continue  # what comes before the first magic of a file, or no whole header
                fields = _header(part[:stop])
                if fields:
                    length = int(fields["content-length"])
                    found[places[i]] = [i, fields, stop + len(END), length, places[i] + len(MAGIC) + stop + len(END) + length + len(END)]
            exits: dict[int, int | None] = {}
            rows = [(file, start, covered, *[None] * 10)]
            for place in reversed(list(found)):
                i, fields, begin, length, successor = found[place]
                # The successor's magic may be the one that ends the block.
                exits[place] = successor if successor >= covered - len(MAGIC) else exits.get(successor)
                if exits[place] is None and successor not in found:
                    continue
                held, j = [parts[i][begin:]], i
                size = len(held[0])
                while size < length and j + 1 < len(parts):
                    j += 1
                    held += [MAGIC, parts[j]]
                    size += len(MAGIC) + len(parts[j])
                own = _record(fields, b"".join(held)[:length]) if size >= length else (None,) * 6
                rows.append((file, start, None, place, successor, exits[place], length if size < length else None, *own))
            frame = pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in schema.split(",")], dtype=object)
            yield pa.RecordBatch.from_pandas(frame, schema=target, preserve_index=False)

    kinds = {"string": pa.string(), "long": pa.int64()}
    target = pa.schema([(n, kinds[t]) for n, t in (c.strip().split(" ") for c in schema.split(","))])
    return _segments(spark, path).mapInArrow(scan, schema)


def reachable_entries(candidates: DataFrame) -> DataFrame:
    """(file, at): candidates where the chain from offset 0 enters a block.

    ``candidates`` has file, at and exit (null where the chain breaks).  Each round adds the images of what is reached and
    doubles the jump, until nothing is added.
    """
    targets = candidates.select("file", F.col("exit").alias("at")).where("at is not null").unionByName(candidates.where("at = 0").select("file", "at"))
    jump = candidates.join(targets.distinct(), ["file", "at"], "left_semi").select("file", "at", "exit").where("exit is not null")
    jump = shared_table(jump, "jump")
    reached = shared_table(candidates.where("at = 0").select("file", "at").distinct(), "reached")
    size = reached.count()
    while size:
        ahead = reached.join(jump, ["file", "at"]).select("file", F.col("exit").alias("at"))
        reached = shared_table(reached.unionByName(ahead).distinct(), "reached")
        before, size = size, reached.count()
        if before == size:
            break
        double = jump.join(jump.select("file", F.col("at").alias("exit"), F.col("exit").alias("far")), ["file", "exit"])
        jump = shared_table(double.select("file", "at", F.col("far").alias("exit")), "jump")
    return reached


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes and payload_digest of every record of the archives in ``path``.

    For a revisit, bytes and digest are those its header states of the full payload.  Empty archives give no rows; a chain that
    breaks (truncated file) ends there.
    """
    found = shared_table(scan_blocks(spark, path), "candidates")
    order = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    blocks = found.where("covered is not null").select("file", "start", "covered", F.coalesce(F.sum("covered").over(order), F.lit(0)).alias("base"))
    blocks = shared_table(blocks, "blocks")
    placed = found.where("place is not null").drop("covered").join(blocks, ["file", "start"])
    placed = placed.withColumns({"at": F.col("base") + F.col("place"), "next": F.col("base") + F.col("next"), "exit": F.col("base") + F.col("exit")})
    entries = reachable_entries(placed.select("file", "at", "exit"))
    marked = placed.join(entries.withColumn("entry", F.lit(True)), ["file", "at"], "left").drop("place", "exit", "covered", "base")

    def walk(block: pd.DataFrame) -> pd.DataFrame:
        successors = dict(zip(block["at"], block["next"], strict=True))
        kept = set()
        for at in block.loc[block["entry"].notna(), "at"]:
            while at in successors and at not in kept:
                kept.add(at)
                at = successors[at]
        return block[block["at"].isin(kept)]

    # At most the candidates of one block of a file meet in a task.
    columns = f"file string, at long, start long, next long, length long, {FIELDS}"
    names = [c.strip().split(" ")[0] for c in columns.split(",")]
    records = marked.groupBy("file", "start").applyInPandas(lambda b: walk(b)[names].astype(object).where(lambda x: x.notna(), None), columns)
    records = shared_table(records, "records")
    whole = records.where("length is null").select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")
    # Records with a magic inside that also run over the end of a block: at most one per block.
    cut = {(r["file"], r["at"]): r["length"] for r in records.where("length is not null").select("file", "at", "length").collect()}
    return whole.unionByName(_cut_records(spark, path, blocks, cut)) if cut else whole


def _cut_records(spark: SparkSession, path: str, blocks: DataFrame, cut: dict) -> DataFrame:
    """Reads the bytes of records that span blocks and puts them together."""
    base = {(r["file"], r["start"]): r["base"] for r in blocks.join(spark.createDataFrame([(f,) for f in {f for f, _ in cut}], "file string"), "file", "left_semi").collect()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, parts in _blocks(batches):
            if (file, start) not in base:
                continue
            data = (b"" if start == 0 else MAGIC) + MAGIC.join(parts)
            first = base[file, start] - (0 if start == 0 else len(MAGIC))
            out = [(file, at, max(first, at), data[max(0, at - first) : at + 4096 + length + 65_536 - first]) for (f, at), length in cut.items() if f == file and at < first + len(data) and at + length + 65_536 > first]
            if out:
                yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(("file", "at", "place", "bytes"), zip(*out, strict=True), strict=True)})

    pieces = _segments(spark, path).mapInArrow(scan, "file string, at long, place long, bytes binary")

    def join(group: pd.DataFrame) -> pd.DataFrame:
        parts, end = [], None
        for place, data in sorted(zip(group["place"], group["bytes"], strict=True)):
            data = data if end is None else data[max(0, end - place) :]
            parts.append(data)
            end = place + len(data) if end is None else max(end, place) + len(data)
        whole = b"".join(parts)
        stop = whole.find(END)
        fields = _header(whole[len(MAGIC) : stop])
        block = whole[stop + len(END) : stop + len(END) + int(fields["content-length"])]
        return pd.DataFrame([_record(fields, block)], columns=[c.strip().split(" ")[0] for c in FIELDS.split(",")], dtype=object)

    return pieces.groupBy("file", "at").applyInPandas(join, FIELDS)
