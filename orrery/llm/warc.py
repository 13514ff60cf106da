"""Web archives of pages: written, normalised record by record, indexed and read back.

A writer that compresses its whole file as one gzip stream leaves an archive in which no record can be reached without
inflating all before it. `normalise` inflates such a stream once, from front to back and in pieces, writes every record
as a gzip member of its own, and beside the archive an index with each member's place (`<archive>.cdxj`). `read` needs the
index only: its splits are runs of members, which a task reaches by a seek.

Archives are files in a folder that all machines see (any URI that pyarrow's file systems take). A task writes under a name of
its own attempt and returns the name as a row; the table of these rows, written by Spark, says which files count. What
a lost or repeated attempt has left is named nowhere, so nothing is read twice.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Workspace, blank, delete, map_rows, qualified, small_batches

#: Bytes of records (uncompressed) after which a new archive begins, and of members that a reading task takes at least.
ARCHIVE, SPLIT = 64 << 20, 8 << 20
#: Bytes that are inflated, copied or read at a time; of a record's head at most.
PIECE, LONGEST_HEAD = 1 << 20, 1 << 20
#: Level of both compressions; payloads of fewer bytes are never revisits.
LEVEL, LEAST_REVISIT = 6, 0
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31  # zlib's window bits for a gzip wrapper

_PAGE = "urn:page:"
MANIFEST = "name string, records bigint, bytes bigint"
INDEX = "name string, offset bigint, length bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def digest32(payload: bytes) -> str:
    """SHA-1 in base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    """Without characters that would end the header's line or the value."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> tuple[bytes, bytes]:
    """Head and block. A revisit's block is the response's HTTP head only; its length and digest are of the whole payload."""
    named = lambda i: f"<{_PAGE}{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {named(page_id)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_uri(url)}"] if url is not None else []
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {named(refers_to)}"] if revisit else []
    head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode(), block


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields (names in lower case) and the block of one inflated record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = fields_of(head)
    return fields, rest[: int(fields["content-length"])]


def fields_of(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record begins with {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


class Inflated:
    """A file's inflated bytes, read in pieces: of one gzip stream, of several one after another, or of a plain file."""

    def __init__(self, source: BinaryIO):
        self.source, self.held, self.at = source, b"", 0
        self.raw, self.stream = source.read(PIECE), None
        self.plain = self.raw[:2] != b"\x1f\x8b"

    def _more(self) -> bytes:
        """The next inflated piece; empty at the end of the file."""
        while True:
            if not self.raw:
                self.raw = self.source.read(PIECE)
            if self.plain:
                out, self.raw = self.raw, b""
                return out
            if self.stream is None or self.stream.eof:
                self.raw = self.raw.lstrip(b"\0")  # padding between streams
                if not self.raw:
                    self.raw = self.source.read(PIECE)
                    if not self.raw:
                        return b""
                    continue
                self.stream = zlib.decompressobj(GZIP)
            ended = not self.raw
            out = self.stream.flush() if ended else self.stream.decompress(self.raw, PIECE)
            self.raw = self.stream.unconsumed_tail or self.stream.unused_data
            if out:
                return out
            if ended and not self.stream.eof:
                raise EOFError("the gzip stream ends early")

    def until(self, mark: bytes, most: int) -> bytes | None:
        """The bytes up to and with a mark; None if nothing but line ends is left."""
        while (end := self.held.find(mark, self.at)) < 0:
            if len(self.held) - self.at > most:
                raise ValueError("a record's head is too long")
            more = self._more()
            self.held, self.at = self.held[self.at :] + more, 0
            if not more:
                if self.held.strip():
                    raise EOFError("the file ends within a record's head")
                return None
        begin, self.at = self.at, end + len(mark)
        return self.held[begin : self.at]

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if self.at == len(self.held):
                self.held, self.at = self._more(), 0
                if not self.held:
                    raise EOFError("the file ends within a record")
            out = self.held[self.at : self.at + n]
            self.at += len(out)
            n -= len(out)
            yield out


def records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, Iterator[bytes]]]:
    """(fields, head, block in pieces) of each record; a block must be used up before the next record is asked for."""
    file = Inflated(source)
    while (head := file.until(b"\r\n\r\n", LONGEST_HEAD)) is not None:
        if head := head.lstrip(b"\r\n"):
            fields = fields_of(head[:-4])
            yield fields, head, file.pieces(int(fields["content-length"]))


def rewrite(source: BinaryIO, target: BinaryIO, level: int = LEVEL) -> Iterator[tuple[dict[str, str], int, int]]:
    """Each record as a gzip member of its own: (fields, offset, length) of each member as it is written. Holds a piece
    of a record at a time."""
    offset = 0
    for fields, head, block in records(source):
        pack, begin = zlib.compressobj(level, zlib.DEFLATED, GZIP), offset
        for piece in chain((head,), block, (b"\r\n\r\n",)):
            offset += _put(target, pack.compress(piece))
        offset += _put(target, pack.flush())
        yield fields, begin, offset - begin


def _put(target: BinaryIO, data: bytes) -> int:
    target.write(data)
    return len(data)


def _open(folder: str):
    """pyarrow's file system and path of a folder, which is made."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))
    where.create_dir(path, recursive=True)
    return where, path


def with_roles(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload (binary), response (the page_id of the record that the payload's group answers with), revisit.

    Groups are told by SHA-256. The largest page_id is found by partial aggregation, and the join back is one that is split
    at run time where a third of all pages have one payload.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(blank(F.col("html")), "UTF-8").alias("payload"))
    rows = rows.withColumn("_key", F.unhex(F.sha2("payload", 256)))
    groups = rows.where(F.length("payload") >= least).groupBy(F.col("_key").alias("_group")).agg(F.max("page_id").alias("response"))
    out = rows.join(groups, F.col("_key") == F.col("_group"), "left")
    revisit = F.col("_group").isNotNull() & ~F.col("response").eqNullSafe(F.col("page_id"))
    return out.select("page_id", "url", "payload", "response", revisit.alias("revisit"))


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive: int = ARCHIVE, least: int = LEAST_REVISIT, level: int = LEVEL) -> DataFrame:
    """Archives of all pages in the folder, each file one gzip stream; their manifest (a lazy table: write it once, its rows name
    the files that count). A task begins a new archive after `archive` bytes of records."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        where, path = _open(folder)
        name, file, pack, n, size = None, None, None, 0, 0

        def close():
            file.write(pack.flush())
            file.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["name", "records", "bytes"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    file, pack = where.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP)
                head, block = record(*row, date)
                for piece in (head, block, b"\r\n\r\n"):
                    file.write(pack.compress(piece))
                    size += len(piece)
                n += 1
                if size >= archive:
                    yield close()
                    file = None
        if file is not None:
            yield close()

    small_batches(pages.sparkSession)
    return with_roles(pages, least).select("page_id", "url", "payload", "response", "revisit").mapInArrow(run, MANIFEST)


def normalise(manifest: DataFrame, folder: str, into: str, level: int = LEVEL) -> DataFrame:
    """Rewrites the archives that the manifest (a written table) names with a member a record, into another folder, with a sidecar
    index each. Gives the index of all (name, offset, length). One task inflates an archive, holding a piece of it."""
    n = manifest.count()
    files = manifest.select("name").repartitionByRange(max(1, min(n, 10_000)), "name")

    def make():
        source, path = _open(folder)
        target, to = _open(into)

        def fn(cols):
            for (old,) in zip(*cols, strict=True):
                name = f"{uuid.uuid4().hex}.warc.gz"
                at, lengths, lines = [], [], []
                with source.open_input_stream(f"{path}/{old}", compression=None) as a, target.open_output_stream(f"{to}/{name}", compression=None) as b:
                    for fields, offset, length in rewrite(a, b, level):
                        at.append(offset)
                        lengths.append(length)
                        entry = {"id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "digest": fields.get("warc-payload-digest"), "offset": offset, "length": length, "filename": name}
                        lines.append(f"{fields.get('warc-target-uri', '-')} {re.sub(r'[^0-9]', '', fields.get('warc-date', ''))} {json.dumps(entry)}\n")
                with target.open_output_stream(f"{to}/{name}.cdxj") as side:
                    side.write("".join(sorted(lines)).encode())
                yield [[name] * len(at), at, lengths]

        return fn

    return map_rows(files, make, INDEX)


def page_of(urn: str | None) -> int | None:
    """The page_id in a record's name; None for a page without one."""
    text = (urn or "").strip("<>").removeprefix(_PAGE)
    return int(text) if text else None


def unpack(data: bytes) -> tuple:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (None for a revisit) of one member.
    A response whose payload doesn't have the digest of its head is an error; of other kinds of records the block is
    the payload."""
    fields, block = parse(zlib.decompress(data, GZIP))
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None, fields.get("warc-target-uri"), kind, None, len(block), digest32(block), block
    http, _, body = block.partition(b"\r\n\r\n")
    told = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        size, sha = len(body), digest32(body)
        if sha != told:
            raise ValueError(f"payload of {fields['warc-record-id']} has digest {sha}, not {told}")
        return page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, None, size, sha, body
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    return page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, page_of(fields["warc-refers-to"]), size, told, None


def read(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records (RECORD) at the places of an index, which may be any part of one. Neighbouring members that make a split
    together are read in one task by one seek and read; payload=False leaves payloads null, though they are read and checked."""
    split = F.floor(F.col("offset") / SPLIT)
    runs = index.groupBy("name", split.alias("split")).agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("members"))

    def make():
        where, path = _open(folder)

        def fn(cols):
            for name, _, members in zip(*cols, strict=True):
                with where.open_input_file(f"{path}/{name}") as f:
                    rows, held = [], 0
                    for m in members:
                        f.seek(m["offset"])
                        rows.append(unpack(f.read(m["length"])))
                        held += rows[-1][4] if payload else 0
                        if held >= PIECE << 3:
                            yield [list(c) for c in zip(*rows, strict=True)]
                            rows, held = [], 0
                    if rows:
                        columns = [list(c) for c in zip(*rows, strict=True)]
                        yield columns if payload else [*columns[:-1], [None] * len(rows)]

        return fn

    return map_rows(runs, make, RECORD)


def resolved(found: DataFrame) -> DataFrame:
    """Records with the payload of the response in place of a revisit's null; each payload's digest must be the record's own."""
    answers = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.first("payload").alias("_payload"))
    asked = F.when(F.col("record_type") == "revisit", F.col("refers_to")).otherwise(F.col("page_id"))
    out = found.join(answers, asked.eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return out.withColumn("payload", F.coalesce("payload", "_payload")).drop("_id", "_digest", "_payload")


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """Writes and normalises all pages in the shared folder: the index, a written table, and the folder of the archives, which goes
    when the driver ends."""
    ws = Workspace(pages.sparkSession)
    root = qualified(pages.sparkSession, ws.root)
    raw, done = f"{root}/raw", f"{root}/archives"
    index = ws.save(normalise(ws.save(write(pages, raw), "manifest"), raw, done), "index")
    delete(pages.sparkSession, raw)
    return index, done


def digest(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, payload_bytes, payload_digest, record_type, refers_to, read back from the normalised
    archives, a row for each row of pages.

    Null html is an empty payload, and empty payloads are equal to each other. Rows that repeat the largest page_id of
    their payload's group are all responses. A page without page_id counts as smaller than all others and comes back without
    one; a group of such pages only has nothing but responses. A null url has no header; control characters and blanks
    in it are percent-encoded. Other columns are ignored; an empty table gives an empty archive and no rows.
    """
    index, folder = archive(pages)
    return read(index, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
