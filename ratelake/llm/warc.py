"""WARC archives with a two-level capture index.

Writing: every task writes one archive of gzip members, one per record, into the shared folder, and returns
where each record lies. Pages with equal payloads of a minimum size are stored once; the others become
revisit records. The index sorts captures by reversed-host URL key, cuts them into compressed blocks, and keeps
a sparse directory with the first key of each block. A look-up finds the index part by its first key, the block
by binary search in that part's directory, the capture by binary search in the block, and then reads just
that range of the archive.

Files are named after the attempt that wrote them; only names in committed task output are ever read, so
retried or lost tasks leave no trace in the archive.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Payloads below this size are always stored.
MIN_REVISIT = 1000
#: Captures in a block of the index.
BLOCK = 512
#: Index parts at most; their first keys are all that a look-up holds in every task.
PARTS = 4096
#: Stands for a null page_id in keys.
NULL_PAGE = -(2**63)
DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "surt string, page_id bigint, file string, offset bigint, length bigint"


def surt(url: str | None) -> str:
    """The sort key of a URL: host labels reversed and comma-joined, then path and query, in lower case, on one line."""
    url = one_line(url)
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return "!" + url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    default = {"http": 80, "https": 443}.get(parts.scheme)
    return (",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, default) else "") + ")" + tail).lower()


def record_id(page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}"


def one_line(text: str | None) -> str:
    """A header value: control characters would end the header."""
    return re.sub(r"[\x00-\x1f\x7f]", "%20", text or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit whose block has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Target-URI: {one_line(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{record_id(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record; checks lengths and, where there is a payload, its digest."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    warc = dict(x.split(": ", 1) if ": " in x else (x.rstrip(": "), "") for x in lines[1:])
    size = int(warc["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http_head, payload = rest[:size].split(b"\r\n\r\n", 1)
    http = dict(x.split(": ", 1) for x in http_head.decode().split("\r\n")[1:])
    if warc["WARC-Type"] == "response" and "sha1:" + hashlib.sha1(payload).hexdigest() != warc["WARC-Payload-Digest"]:
        raise ValueError("a payload's digest is wrong")
    return warc, http, payload


class Files:
    """Range reads with the last few files held open."""

    def __init__(self, most: int = 16) -> None:
        self.most, self.open = most, OrderedDict()

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.open:
            fs, path = pafs.FileSystem.from_uri(uri)
            self.open[uri] = fs.open_input_file(path)
            if len(self.open) > self.most:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(uri)
        got = self.open[uri].read_at(length, offset)
        if len(got) != length:
            raise OSError(f"{uri} ends too early")
        return got


@dataclass
class Archive:
    """``captures``: where each record lies. ``parts``: one row for each part of the index, at most PARTS:
    part, first_surt, first_page, file, and the range of that file which holds the part's block directory."""

    captures: DataFrame
    parts: DataFrame


def _new_file(folder: str, kind: str) -> tuple[str, pa.NativeFile]:
    uri = f"{folder}/{kind}-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.gz"
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, fs.open_output_stream(path, compression=None)


def _as_uri(folder: str) -> str:
    return folder if re.match(r"\w+:", folder) else f"file://{folder}"


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses) for each page."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.col("html"), F.sha1(body).alias("digest"), F.octet_length(body).cast("bigint").alias("size"))
    last = rows.where(F.col("size") >= min_revisit).groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"))
    last = last.where("first < last").drop("first")
    refers = F.when(F.col("page_id") < F.col("last"), F.col("last"))
    return rows.join(last, ["digest", "size"], "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archive(pages: DataFrame, folder: str | None = None, min_revisit: int = MIN_REVISIT, block: int = BLOCK) -> Archive:
    """Write a WARC record for each page and the index over them.

    Of pages with equal payloads of at least ``min_revisit`` bytes, that with the largest page_id is stored and
    the others revisit it; rows that share that page_id are all stored. Null html is an empty payload, null urls
    have the key of an empty url, null page_ids are always stored. Other columns are not read.
    Very long payloads are written whole. Without pages the index is empty.
    """
    spark = pages.sparkSession
    folder = _as_uri(folder or common.stage_path(spark, "warc"))
    out = common.pa_schema(spark, CAPTURES)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, at = None, 0
        try:
            for batch in batches:
                if sink is None:
                    uri, sink = _new_file(folder, "records")
                rows = []
                for page, url, html, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    member = gzip.compress(record(page, url, (html or "").encode("utf-8", "replace"), digest, refers), 3, mtime=0)
                    sink.write(member)
                    rows.append({"surt": surt(url), "page_id": page, "file": uri, "offset": at, "length": len(member)})
                    at += len(member)
                yield pa.RecordBatch.from_pylist(rows, schema=out)
        finally:
            if sink is not None:
                sink.close()

    captures = common.materialize(plan_records(pages, min_revisit).mapInArrow(write, CAPTURES), "captures")
    return Archive(captures, build_index(captures, folder, block))


INDEX = "part int, first_surt string, first_page bigint, file string, offset bigint, length bigint, blocks int"


def _line(row: tuple) -> str:
    return "\t".join("" if x is None else str(x) for x in row)


def _lines(data: bytes) -> list[tuple[tuple[bytes, int], list[str]]]:
    """(key, fields) of the lines of a block or directory; the first two fields are the key."""
    rows = [x.split("\t") for x in zlib.decompress(data, 31).decode().split("\n")]
    return [(_key(x[0], int(x[1]) if x[1] else None), x) for x in rows]


def _key(surt_key: str, page: int | None) -> tuple[bytes, int]:
    return surt_key.encode(), NULL_PAGE if page is None else page


def build_index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Sort captures by key, write them as compressed blocks and close each file with its sparse block directory."""
    spark = captures.sparkSession
    out = common.pa_schema(spark, INDEX)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, at, held, directory = None, 0, [], []
        try:
            for batch in batches:
                if sink is None:
                    uri, sink = _new_file(folder, "index")
                held += zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
                while len(held) >= block:
                    at += _write_block(sink, held[:block], at, directory)
                    held = held[block:]
            if held:
                at += _write_block(sink, held, at, directory)
            if directory:
                data = gzip.compress("\n".join(map(_line, directory)).encode(), 6, mtime=0)
                sink.write(data)
                row = (TaskContext.get().partitionId(), *directory[0][:2], uri, at, len(data), len(directory))
                yield pa.RecordBatch.from_pylist([dict(zip(out.names, row, strict=True))], schema=out)
        finally:
            if sink is not None:
                sink.close()

    # The page id in the key lets a hot URL spread over parts.
    n = min(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = [F.encode("surt", "UTF-8"), F.coalesce("page_id", F.lit(NULL_PAGE))]
    ordered = captures.repartitionByRange(n, *key).sortWithinPartitions(*key)
    return common.materialize(ordered.select("surt", "page_id", "file", "offset", "length").mapInArrow(write, INDEX), "index")


def _write_block(sink, rows: list[tuple], at: int, directory: list[tuple]) -> int:
    data = gzip.compress("\n".join(map(_line, rows)).encode(), 6, mtime=0)
    sink.write(data)
    directory.append((*rows[0][:2], at, len(data)))
    return len(data)


FOUND = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def look_up(archive: Archive, wanted: DataFrame, with_payload: bool = True) -> DataFrame:
    """The captures of ``wanted`` (url, page_id), read through both levels of the index.

    A capture is returned once for each time it was written, however often it is asked for; unknown captures
    give no row. payload is null for revisits (their header has its size) and without ``with_payload``.
    """
    spark = archive.parts.sparkSession
    rows = archive.parts.collect()  # one for each part
    rows = sorted((_key(r["first_surt"], r["first_page"]), r["part"], (r["file"], r["offset"], r["length"])) for r in rows)
    starts, parts, places = [r[0] for r in rows], [r[1] for r in rows], {r[1]: r[2] for r in rows}

    def route(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"part": [], "surt": [], "page_id": []}
        for url, page in zip(batch["url"], batch["page_id"], strict=True):
            s = surt(url)
            key = _key(s, page)
            # Equal keys may end one part and start the next.
            for i in range(max(0, bisect.bisect_left(starts, key) - 1), bisect.bisect_right(starts, key)):
                for k, v in zip(out, (parts[i], s, page), strict=True):
                    out[k].append(v)
        return out

    routed = common.map_arrow(wanted.select("url", F.col("page_id").cast("bigint").alias("page_id")), route, "part int, surt string, page_id bigint", 8192)
    # A number, as the keys are small and the reading behind them is not: tasks would be merged by the size of the keys.
    routed = routed.repartition(len(parts) or 1, "part").sortWithinPartitions("part", F.encode("surt", "UTF-8"), F.coalesce("page_id", F.lit(NULL_PAGE)))
    schema = common.pa_schema(spark, FOUND)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, last, cached = Files(), None, None
        directory, keys, block, block_keys = [], [], [], []
        for batch in batches:
            out = []
            for asked in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                part, key = asked[0], _key(*asked[1:])
                if asked == last:
                    continue
                if last is None or part != last[0]:
                    directory = _lines(files.read(*places[part]))
                    keys = [k for k, _ in directory]
                last = asked
                i = max(0, bisect.bisect_left(keys, key) - 1)
                while i < len(keys) and keys[i] <= key:
                    if cached != (part, i):
                        block = _lines(files.read(places[part][0], *map(int, directory[i][1][2:4])))
                        block_keys, cached = [k for k, _ in block], (part, i)
                    for k in range(bisect.bisect_left(block_keys, key), bisect.bisect_right(block_keys, key)):
                        file, offset, length = block[k][1][2:5]
                        warc, http, payload = parse(zlib.decompress(files.read(file, int(offset), int(length)), 31))
                        out.append(_found(warc, http, payload if with_payload else None))
                    i += 1
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return routed.mapInArrow(read, FOUND)


def _found(warc: dict[str, str], http: dict[str, str], payload: bytes | None) -> dict:
    revisit = warc["WARC-Type"] == "revisit"
    return {
        "page_id": int(warc["X-Page-ID"]) if warc["X-Page-ID"] else None,
        "payload_bytes": int(http["Content-Length"]),
        "payload_digest": warc["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": warc["WARC-Type"],
        "refers_to": int(warc["X-Refers-To-Page"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def op7_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = look_up(write_archive(pages), pages, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
