"""Deterministic sharded WARC archives.

Records are sorted by key and made once, each its own gzip member. Archives roll
by compressed size: a record belongs to the archive in which its compressed start
falls when all records stand in one line, so names and bytes of archives follow
from the rows alone, not from partitions. Equal payloads are stored once; later
records revisit the first. Archives are written under temporary names, renamed
when whole, and count once the manifest names them.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kickframe.llm.batches import by_weight, stage_arrow
from kickframe.llm.files import Attempt, opened
from kickframe.session import scratch_path, stage

ROLL = 64 << 20
#: Fixed values of the format: version line, revisit profile, name space of record ids.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "1970-01-01T00:00:00Z"
RECORDS = "page_id long, copy int, url string, record_type string, refers_to long, task int, start long, size long, member binary"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line; percent signs make it reversible."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, copy: int, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One record: a response, or a revisit of page `first` without the payload."""
    sha, body = digest(payload), payload if first is None else b""
    ident = uuid.uuid5(IDS, f"{page_id}/{copy}/{sha}")
    lines = [VERSION, f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{ident}>",
             f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(body)}",
             "Content-Type: text/html; charset=utf-8", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {first}"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record; a wrong length or digest raises."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    body = rest[:int(fields["Content-Length"])]
    if version != VERSION or rest[len(body):] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != "sha1:" + digest(body):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields, body


def _member(data: bytes) -> bytes:
    """A gzip member without a time, so equal records give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _records(least: int):
    """Make the records of rows that are sorted by page with their revisit notes first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        page, notes, seen, copy = object(), {}, set(), 0
        for batch in batches:
            size = np.array([len(x or "") for x in batch.column("html").to_pylist()])
            for part in by_weight(size, 1 << 23):
                out = []
                for p, note, url, html, sha, first in zip(*(batch.column(c)[part].to_pylist() for c in ("page_id", "note", "url", "html", "sha", "first")), strict=True):
                    if p != page:
                        page, notes, seen, copy = p, {}, set(), 0
                    if note:
                        notes[sha] = first
                        continue
                    payload = (html or "").encode()
                    key = hashlib.sha1(payload).hexdigest()
                    # Of rows that repeat page and payload the first is the response.
                    refers = notes.get(key, p if key in seen and len(payload) >= least else None)
                    seen.add(key)
                    member = _member(record(p, copy, url, payload, refers))
                    out.append((p, copy, url, "response" if refers is None else "revisit", refers, task, at, len(member), member))
                    at += len(member)
                    copy += 1
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                            pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                        names=["page_id", "copy", "url", "record_type", "refers_to", "task", "start", "size", "member"])
    return run


def _archives(folder: str):
    """Write one archive per group; rows are sorted by archive and place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, sha, n = None, None, None, 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([out.commit()]), pa.array([n], pa.int64()),
                                               pa.array([out.size], pa.int64()), pa.array([sha.hexdigest()])],
                                              names=["archive", "file", "records", "bytes", "sha256"])
        for batch in batches:
            for archive, member in zip(batch.column("archive").to_pylist(), batch.column("member").to_pylist(), strict=True):
                if archive != now:
                    if out:
                        yield closed()
                    now, out, sha, n = archive, Attempt(folder, f"part-{archive:08d}", ".warc.gz"), hashlib.sha256(), 0
                out.write(member)
                sha.update(member)
                n += 1
        if out:
            yield closed()
    return run


def _members(folder: str, keep: bool):
    """Stream the records of archives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with opened(folder, name) as f:
                    rows, held, rest = [], 0, b""
                    while rest or (rest := f.read(1 << 20)):
                        z, parts = zlib.decompressobj(31), []
                        while not z.eof:
                            parts.append(z.decompress(rest))
                            rest = z.unused_data if z.eof else f.read(1 << 20)
                            if not rest and not z.eof:
                                raise ValueError(f"{name} ends within a record")
                        fields, body = parse(b"".join(parts))
                        response = fields["WARC-Type"] == "response"
                        sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if response and sha != digest(body):
                            raise ValueError(f"{name}: payload digest of {fields['WARC-Record-ID']}")
                        page, first, url = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID"), fields.get("WARC-Target-URI")
                        rows.append((page and int(page), len(body) if response else int(fields["X-Payload-Length"]), sha, fields["WARC-Type"],
                                     first and int(first), url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
                                     body if keep and response else None))
                        held += len(body) if keep else 0
                        if len(rows) == 5000 or held > 1 << 23:
                            yield _read_rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _read_rows(rows)
    return run


def _read_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])


@dataclass
class Archive:
    """A written collection; `manifest` has a row per archive: number, file, records, bytes, sha256."""

    folder: str
    manifest: DataFrame

    @classmethod
    def write(cls, pages: DataFrame, folder: str | None = None, least: int = 0, roll: int = ROLL) -> Archive:
        """Write `pages` (`page_id`, `url`, `html`).

        Null html is an empty payload. Of equal payloads of at least `least` bytes the
        smallest page is the response and the others revisit it; of rows that repeat page and
        payload the first is. Pages without an id come first, are responses unless their
        payload belongs to a page with one. An empty table makes an empty manifest.
        """
        spark = pages.sparkSession
        folder = folder or scratch_path(spark, "warc")
        rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
        sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
        keys = stage(rows.select("page_id", sha.alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")), "payloads")
        firsts = keys.where(F.col("n") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1 AND first IS NOT NULL")
        notes = keys.join(firsts, "sha").where("page_id IS NULL OR page_id <> first").select(
            "page_id", F.lit(True).alias("note"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "sha", "first").distinct()
        both = rows.select("page_id", F.lit(False).alias("note"), "url", "html", F.lit(None).cast("string").alias("sha"),
                           F.lit(None).cast("long").alias("first")).unionByName(notes)
        order = F.col("page_id").asc_nulls_first()
        line = both.repartitionByRange(order).sortWithinPartitions(
            order, F.col("note").desc(), F.col("url").asc_nulls_first(), F.col("html").asc_nulls_first())
        records = stage_arrow(line.mapInArrow(_records(least), RECORDS), "records")
        # A row per task: what all earlier ones hold.
        before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        totals = records.groupBy("task").agg(F.sum("size").alias("total"))
        bases = stage(totals.select("task", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "bases")
        placed = records.select("task", "start", "member").join(F.broadcast(bases), "task")  # as many rows as tasks
        placed = placed.select(F.floor((F.col("base") + F.col("start")) / F.lit(roll)).alias("archive"),
                               (F.col("base") + F.col("start")).alias("place"), "member")
        placed = placed.repartition("archive").sortWithinPartitions("archive", "place")
        manifest = stage_arrow(placed.mapInArrow(_archives(folder), "archive long, file string, records long, bytes long, sha256 string"), "manifest")
        return cls(folder, manifest)

    def read(self, payload: bool = True) -> DataFrame:
        """The records of all archives of the manifest, digests verified; a revisit's payload is null."""
        # With a number given, adaptive execution doesn't merge these few short rows into one task.
        archives = self.manifest.count()
        files = self.manifest.select("file").repartition(max(1, archives), "file")
        return files.mapInArrow(_members(self.folder, payload), READ)
