"""WARC archives with a two-level capture index.

Writing is a Spark job: one record per page as text, the record's header built by expressions, files
by Spark's own committer. A payload that another page of a smaller id has already is a ``revisit``
record without content. Reading takes whole files of bounded size and follows ``Content-Length``.

The index sorts its lines by reversed-host URL key and id, cuts them into blocks of ``BLOCK_LINES`` that
are compressed one by one, and keeps a sparse directory, a table of each block's first and last place. Many
look-ups are a Spark job (``look_up``): a place goes to the part of the index that can hold it, is searched
by halves in that part's directory, then in the block, and the record's range of its archive is checked.
``CaptureIndex`` answers a single look-up the same way.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from regatta.operators.common import checkpoint_folder, cut_lineage

# Fixed values of the formats: version line, line end, base32 letters, the date of all captures.
VERSION, EOL = "WARC/1.1", "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CAPTURE_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Records of an archive file by the longest payload in bytes, so that a file stays near 0.5 GB at most;
# payloads above the last bound have a file each.
FILE_RECORDS = ((1 << 17, 4000), (1 << 22, 128))
# Lines of an index block, and the place of a line without an id.
BLOCK_LINES = 3000
NO_ID = -(1 << 63)

ENTRY = ("url_key string, page_id long, url string, record_type string, payload_bytes long, "
         "payload_digest string, refers_to long, file string, offset long, length long")
PLACES = "first_key string, first_id long, last_key string, last_id long"
BLOCK = f"part int, block_no int, {PLACES}, lines int, block binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: twenty bits at a time."""
    digits = F.sha1(payload)
    letters = []
    for chunk in range(8):
        bits = F.conv(F.substring(digits, 5 * chunk + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(BASE32), place, F.lit(1)))
    return F.concat(*letters)


def with_first_captures(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)``; ``refers_to`` is set for revisits.

    A page refers to the smallest id among the pages of its payload unless that is its own; rows that
    repeat that id are responses as well, and so are pages of a payload that no page with an id has.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
    ).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    # A table of the repeated payloads alone: its size tells Spark whether the pages must move at all.
    first = cut_lineage(rows.groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    ).where(F.col("n") > 1).select("digest", "first"))
    other = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to")
    )


def _record(rows: DataFrame) -> Column:
    revisit = F.col("refers_to").isNotNull()
    size = F.octet_length("payload")

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL)), F.lit(""))

    # A header value is one line: its own line ends and percent signs are percent-encoded.
    url = F.col("url")
    for char, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        url = F.replace(url, F.lit(char), F.lit(code))
    return F.concat(
        F.lit(VERSION + EOL),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))),
        line("WARC-Date", F.lit(CAPTURE_DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, PROFILE)),
        line("X-Page-Id", F.col("page_id")),
        line("X-Refers-To-Page-Id", F.col("refers_to")),
        line("X-Payload-Bytes", size),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, 0).otherwise(size)),
        F.lit(EOL), F.when(revisit, "").otherwise(F.col("payload")), F.lit(EOL),
    )


def write_archives(
    pages: DataFrame, folder: str, file_records: tuple[tuple[int, int], ...] = FILE_RECORDS
) -> None:
    """WARC files in the folder, bounded in records and bytes; safe under task retries.

    Payloads up to a bound of ``file_records`` share files of so many records; longer ones than all bounds
    have one each. The first pass counts the longer ones, so classes that no page is in cost nothing.
    """
    rows = with_first_captures(pages)
    size = F.octet_length("payload")
    bounds = [-1, *(b for b, _ in file_records)]
    seen = Observation()
    counts = [F.count(F.when(size > b, 1)).alias(f"above{n}") for n, b in enumerate(bounds)]
    for n, records in enumerate([*(r for _, r in file_records), 1]):
        if n and not seen.get[f"above{n}"]:
            break
        held = rows if n else rows.observe(seen, *counts)
        held = held.where(size > bounds[n])
        if n + 1 < len(bounds):
            held = held.where(size <= bounds[n + 1])
        held.select(_record(held).alias("value")).write.mode("append").option("lineSep", EOL).option(
            "maxRecordsPerFile", records
        ).text(folder)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels in reverse, without ``www.``, then port, path and query."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return (url or "").strip()
    labels = [x for x in host.removeprefix("www.").split(".") if x]
    tail = f":{port}" if port and port not in (80, 443) else ""
    query = "?" + "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    return ",".join(reversed(labels)) + tail + ")" + (parts.path.rstrip("/") or "/").lower() + query


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes
    offset: int
    length: int


def parse_records(data: bytes, base: int = 0) -> Iterator[Record]:
    """Records one after another by their lengths, whatever their payloads contain."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8").split(EOL)
        if version != VERSION:
            raise ValueError(f"no record at {base + at}: {version[:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if data[stop: stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {base + at} does not end where it says")
        yield Record(headers, data[start:stop], base + at, stop + 4 - at)
        at = stop + 4


def _plain_url(headers: dict[str, str]) -> str | None:
    url = headers.get("WARC-Target-URI")
    if url is None:
        return None
    for code, char in (("%0A", "\n"), ("%0D", "\r"), ("%25", "%")):
        url = url.replace(code, char)
    return url


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = []
            for r in parse_records(content):
                h = r.headers
                digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                if h["WARC-Type"] == "response":
                    own = base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
                    if own != digest or len(r.payload) != int(h["X-Payload-Bytes"]):
                        raise ValueError(f"{path} at {r.offset}: the payload is not what was written")
                url = _plain_url(h)
                rows.append((url_key(url), _number(h.get("X-Page-Id")), url, h["WARC-Type"],
                             int(h["X-Payload-Bytes"]), digest, _number(h.get("X-Refers-To-Page-Id")),
                             path, r.offset, r.length))
            names = [c.split()[0] for c in ENTRY.split(", ")]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One index entry per record, payloads held against their digests."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInPandas(_entries, ENTRY)


def _place(line: dict) -> tuple[str, int]:
    return line["url_key"], NO_ID if line["page_id"] is None else int(line["page_id"])


def _blocks(block_lines: int):
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        part, number = TaskContext.get().partitionId(), 0

        def packed() -> pd.DataFrame:
            text = "\n".join(json.dumps(x, separators=(",", ":")) for x in held)
            first, last = _place(held[0]), _place(held[-1])
            done = pd.DataFrame({
                "part": [part], "block_no": [number], "first_key": [first[0]], "first_id": [first[1]],
                "last_key": [last[0]], "last_id": [last[1]],
                "lines": [len(held)], "block": [zlib.compress(text.encode())],
            })
            held.clear()
            return done

        for batch in batches:
            for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                held.append(row)
                if len(held) == block_lines:
                    yield packed()
                    number += 1
        if held:
            yield packed()

    return blocks


def write_index(entries: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> None:
    """Compressed blocks of sorted lines, numbered within their part, with their first and last place.

    Sorting is by ranges of (key, id, place), so one URL with many captures fills many blocks.
    """
    order = ["url_key", "page_id", "file", "offset"]
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        entries.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .mapInPandas(_blocks(block_lines), BLOCK).write.parquet(folder)
    )


def write_directory(spark: SparkSession, index: str, folder: str) -> None:
    """The sparse directory: one row a block, without the blocks themselves."""
    names = ["part", "block_no", *(c.split()[0] for c in PLACES.split(", "))]
    spark.read.schema(BLOCK).parquet(index).select(*names).write.parquet(folder)


def _places(frame: pd.DataFrame, key: str, number: str) -> list[tuple[str, int]]:
    return list(zip(frame[key], frame[number].astype("int64")))


def _holding(
    wanted: list[tuple[str, int]], first: list[tuple[str, int]], last: list[tuple[str, int]]
) -> Iterator[tuple[int, int]]:
    """``(wanted, holder)`` of sorted stretches that may hold a place, by binary search in both ends."""
    for n, place in enumerate(wanted):
        for at in range(bisect.bisect_left(last, place), bisect.bisect_right(first, place)):
            yield n, at


def look_up(spark: SparkSession, archives: str, index: str, directory: str, wanted: DataFrame) -> DataFrame:
    """``(page_id, url_key, record_type, payload_digest, sound)`` of the captures ``wanted (page_id, url)``.

    The driver holds the first and last place of each part of the index, of which there are as many as
    shuffle partitions. Places are searched in the directory of their part, then in their blocks, each in a
    task that holds one part's directory or one block. ``sound`` says that the record in the range of the
    archive names that id and digest and, of a response, that the payload has the digest. Repeated captures
    give a row each; ids that are not there give none, null ids are captures without an id.
    """
    table = spark.read.parquet(directory)
    ends = table.groupBy("part").agg(
        F.min(F.struct("first_key", "first_id")).alias("first"), F.max(F.struct("last_key", "last_id")).alias("last")
    ).collect()
    ends.sort(key=lambda r: tuple(r["first"]))
    parts = [r["part"] for r in ends]
    first, last = [tuple(r["first"]) for r in ends], [tuple(r["last"]) for r in ends]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = list(zip(map(url_key, batch["url"].where(batch["url"].notna(), None)), batch["id"]))
            rows = [(parts[at], *places[n]) for n, at in _holding(places, first, last)]
            yield pd.DataFrame(rows, columns=["part", "url_key", "id"])

    def in_directory(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("block_no")
        hits = list(_holding(_places(asked, "url_key", "id"), _places(held, "first_key", "first_id"),
                             _places(held, "last_key", "last_id")))
        out = asked.iloc[[n for n, _ in hits]].copy()
        out["block_no"] = held["block_no"].to_numpy()[[at for _, at in hits]] if hits else []
        return out[["part", "block_no", "url_key", "id"]]

    def in_block(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found: list[dict] = []
        if len(asked):
            for block in held["block"]:
                lines = block_lines_of(bytes(block))
                at = [_place(x) for x in lines]
                found += [lines[k] for _, k in _holding(_places(asked, "url_key", "id"), at, at)]
        names = [c.split()[0] for c in ENTRY.split(", ")]
        return pd.DataFrame(found, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    asked = wanted.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("id"), "url"
    ).distinct().mapInPandas(route, "part int, url_key string, id long")
    placed = asked.groupBy("part").cogroup(table.groupBy("part")).applyInPandas(
        in_directory, "part int, block_no int, url_key string, id long"
    )
    blocks = spark.read.schema(BLOCK).parquet(index).select("part", "block_no", "block")
    near = blocks.join(placed.select("part", "block_no").distinct(), ["part", "block_no"], "left_semi")
    lines = placed.groupBy("part", "block_no").cogroup(near.groupBy("part", "block_no")).applyInPandas(
        in_block, ENTRY
    )
    lines = cut_lineage(lines.select(
        F.col("file").alias("path"), "offset", "length", "page_id", "url_key", "record_type", "payload_digest"
    ))
    files = spark.read.format("binaryFile").load(archives).select("path", "content")
    ranges = files.join(lines, "path").withColumn(
        "record", F.substring("content", F.col("offset").cast("int") + 1, F.col("length").cast("int"))
    ).drop("content", "path", "offset", "length")
    return ranges.mapInPandas(
        _sound, "page_id long, url_key string, record_type string, payload_digest string, sound boolean"
    )


def _sound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        verdicts = []
        for data, number, kind, digest in zip(
            batch["record"], batch["page_id"], batch["record_type"], batch["payload_digest"]
        ):
            r = next(parse_records(bytes(data)))
            own = base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
            named = r.headers.get("X-Page-Id") == (None if pd.isna(number) else str(int(number)))
            verdicts.append(
                named and r.headers["WARC-Payload-Digest"] == f"sha1:{digest}"
                and r.headers["WARC-Type"] == kind and (kind != "response" or own == digest)
            )
        out = batch.drop(columns="record").assign(sound=verdicts)
        yield out.astype({"page_id": "Int64", "sound": bool})


def block_lines_of(block: bytes) -> list[dict]:
    return [json.loads(x) for x in zlib.decompress(block).decode().split("\n")]


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for block in batch["block"]:
            frame = pd.DataFrame(block_lines_of(block))
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every block."""
    return spark.read.schema(BLOCK).parquet(folder).select("block").mapInPandas(_decoded, ENTRY)


class CaptureIndex:
    """Look-ups through the sparse directory: two keys for each block of thousands of lines."""

    def __init__(self, spark: SparkSession, folder: str):
        self.blocks = spark.read.schema(BLOCK).parquet(folder)
        rows = self.blocks.select("first_key", "last_key").collect()
        self.directory = sorted((r["first_key"], r["last_key"]) for r in rows)
        self.spark = spark

    def find(self, url: str) -> list[dict]:
        """The lines of all captures of a URL, by binary search in the directory and in its blocks."""
        key = url_key(url)
        at = bisect.bisect_left(self.directory, (key,))
        while at > 0 and self.directory[at - 1][1] >= key:
            at -= 1
        spans = []
        while at < len(self.directory) and self.directory[at][0] <= key:
            spans.append(self.directory[at])
            at += 1
        if not spans:
            return []
        held = self.blocks.where(
            (F.col("first_key") >= spans[0][0]) & (F.col("first_key") <= spans[-1][0])
            & (F.col("last_key") >= key)
        )
        found = []
        for row in held.select("block").toLocalIterator():
            lines = block_lines_of(bytes(row["block"]))
            low = bisect.bisect_left(lines, key, key=lambda x: x["url_key"])
            high = bisect.bisect_right(lines, key, key=lambda x: x["url_key"])
            found += lines[low:high]
        return found

    def fetch(self, line: dict) -> Record:
        """The record of an index line: a range read through the file system of its archive."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(line["file"])
        stream = path.getFileSystem(context._jsc.hadoopConfiguration()).open(path)
        try:
            stream.seek(line["offset"])
            data = bytes(stream.readNBytes(line["length"]))
        finally:
            stream.close()
        return next(parse_records(data, line["offset"]))


def archive_pages(pages: DataFrame, folder: str | None = None) -> tuple[str, str]:
    """Write archives, their index and its directory below a folder; returns the first two places.

    A null payload is an empty one, a null URL has no target line and the empty key, null ids stay
    null, an empty table gives empty folders. Repeated rows are records of their own, with their own
    record ids; of equal payloads the smallest id is the response. Very long payloads have a file each.
    Other columns are not read.
    """
    root = folder or f"{checkpoint_folder(pages)}/warc-{uuid.uuid4().hex}"
    spark = pages.sparkSession
    write_archives(pages, f"{root}/archives")
    write_index(read_archives(spark, f"{root}/archives"), f"{root}/index")
    write_directory(spark, f"{root}/index", f"{root}/directory")
    return f"{root}/archives", f"{root}/index"


def directory_of(index: str) -> str:
    """Where ``archive_pages`` keeps the directory of an index."""
    return f"{index.removesuffix('/index')}/directory"
