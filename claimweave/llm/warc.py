"""WARC archives (operator 3): a writer of record-per-gzip-member archives and a splittable reader.

The reader cuts every archive into byte ranges. A task looks in its range for the gzip magic, takes a
hit for a member only if the gzip header is sound and what it decodes begins with a WARC version line,
and owns the records whose member starts inside its range, reading on past the end for the last one.
So ranges of any size give every record once, and a false magic inside compressed data is passed over.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import ready, shared_dir, whole, written

MAGIC = b"\x1f\x8b\x08"
SPLIT = 8 << 20  #: bytes of a range
ROLL = 64 << 20  #: bytes after which a writing task starts another archive
STEP = 1 << 18
MOST_TASKS = 20_000  #: reading tasks; more ranges than that share them
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header alone, as its payload is the other record's."""
    body = _HTTP % len(payload) + (payload if kind == "response" else b"")
    clean = "".join(c for c in (url or "") if c >= " ")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {clean}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def parse(record: bytes) -> dict:
    """A decoded record: its type, ids, digest, declared payload length and payload bytes (None for a revisit)."""
    head, _, body = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    body = body[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    number = lambda x: int(x) if x.lstrip("-").isdigit() else None
    told = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["WARC-Type"]
    return {
        "page_id": number(fields["WARC-Record-ID"][10:-1]), "url": fields.get("WARC-Target-URI", ""), "record_type": kind, "payload_bytes": told,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": number(fields["WARC-Refers-To"][10:-1]) if "WARC-Refers-To" in fields else None,
        "payload": payload if kind == "response" else None,
    }


def _write(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    out, name, size, made = None, "", 0, []
    for pdf in batches:
        ids = zip(*(pdf[c].tolist() for c in ("page_id", "page_id_null", "refers_to", "refers_to_null")), strict=True)
        for (page, nameless, refers, first), url, html in zip(ids, pdf["url"], pdf["html"], strict=True):
            if out is None:
                name, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            payload = (html or "").encode("utf-8", "replace")
            data = member("response" if first else "revisit", None if nameless else page, url, payload, payload_digest(payload), None if first else refers)
            out.write(data)
            size += len(data)
            if size >= ROLL:
                out.close()
                made.append((f"{folder}/{name}", size))
                out = None
    if out is not None:
        out.close()
        made.append((f"{folder}/{name}", size))
    if made:
        yield pd.DataFrame(made, columns=["path", "bytes"])


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes page_id, url, html as archives; returns path, bytes of each.

    Of pages with equal payloads the one with the smallest page_id is a response, the others revisit it.
    A null html is an empty payload; rows with one page_id and payload are written alike; a null page_id
    revisits a numbered page of its payload if there is one. Ids are exact over all 64 bits. Other columns are
    ignored; an empty table gives no archives.
    """
    spark = pages.sparkSession
    ready(spark)
    folder = folder or shared_dir(spark, "warc")
    keyed = pages.select("page_id", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").drop("n")
    again = keyed.join(first, "digest").where("not (page_id <=> first_id)").selectExpr("page_id as again_id", "digest as again_digest", "first_id as refers_to").distinct()
    again = written(again, "revisits")
    full = pages.select("page_id", *(["url"] if "url" in pages.columns else [F.lit(None).cast("string").alias("url")]), "html").withColumn("digest", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    rows = full.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left").select(*whole("page_id"), "url", "html", *whole("refers_to"))
    return written(rows.mapInPandas(lambda it: _write(it, folder), "path string, bytes long"), "archives")


def _members(f, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of the gzip members that start in [start, end)."""
    at, tail = start, b""
    base = start  # file offset of tail[0]
    while True:
        k = tail.find(MAGIC, at - base)
        if k < 0 or base + k >= end:
            nxt = base + len(tail)
            if k >= 0 or nxt >= min(size, end + 2):
                return
            keep = max(0, len(tail) - 2)
            f.seek(nxt)
            base, tail = base + keep, tail[keep:] + f.read(STEP)
            at = max(at, base)
            continue
        at = base + k
        got = _decoded(f, at, tail[k:], size)
        if got is None:
            at += 1  # no member begins here
            continue
        record, used = got
        yield at, record
        at += used
        if at - base > len(tail):
            base, tail = at, b""
        if at >= end:
            return


def _decoded(f, at: int, have: bytes, size: int) -> tuple[bytes, int] | None:
    """The record of the member at an offset and the member's length, or None if it isn't one."""
    unpack, out, read, checked = zlib.decompressobj(31), [], at + len(have), False
    data, got = have, 0
    while True:
        try:
            piece = unpack.decompress(data)
        except zlib.error:
            return None
        out.append(piece)
        got += len(piece)
        if not checked and got >= 5:
            if not b"".join(out).startswith(b"WARC/"):
                return None
            checked = True
        if unpack.eof:
            return (b"".join(out), read - len(unpack.unused_data) - at) if checked else None
        if read >= size:
            return None
        f.seek(read)
        data = f.read(STEP)
        read += len(data)


def _read(batches: Iterator[pd.DataFrame], payloads: bool) -> Iterator[pd.DataFrame]:
    columns = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if payloads else [])]
    for pdf in batches:
        for s in pdf.itertuples():
            fs, path = pafs.FileSystem.from_uri(s.path)
            with fs.open_input_file(path) as f:
                rows, held = [], 0
                for _, record in _members(f, s.start, s.end, s.bytes):
                    got = parse(record)
                    if got["payload"] is not None and (len(got["payload"]), payload_digest(got["payload"])) != (got["payload_bytes"], got["payload_digest"]):
                        raise ValueError(f"damaged record of page {got['page_id']} in {s.path}")
                    rows.append([got[c] for c in columns])
                    held += len(record)
                    if held > PIECE:
                        yield _frame(rows, columns)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, columns)


PIECE = 16 << 20


def _frame(rows: list, columns: list[str]) -> pd.DataFrame:
    whole_ids = ("page_id", "refers_to")  # never by way of floats
    return pd.DataFrame({c: pd.array(v, dtype="Int64") if c in whole_ids else list(v) for c, v in zip(columns, zip(*rows, strict=True), strict=True)})


def read_archives(spark: SparkSession, archives: DataFrame, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """Records of archives (path, bytes): page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    payload_bytes is the length that the HTTP header states, which for a response is checked, with the
    digest, against the payload read; a revisit's payload is null. Repeated records are all given; a record
    without an id has a null page_id. Ranges are dealt by number, so that small ones don't end in one task.
    """
    ready(spark)
    ranges = archives.select("path", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split}L)")).alias("start")).withColumn("end", F.expr(f"least(start + {split}L, bytes)"))
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    tasks = max(1, min(MOST_TASKS, ranges.count()))
    return ranges.repartition(tasks, "path", "start").mapInPandas(lambda it: _read(it, payloads), schema)


def archived(pages: DataFrame, split: int = SPLIT, folder: str | None = None) -> DataFrame:
    """Writes pages and reads the archives back; a row per page. An empty table gives no rows."""
    return read_archives(pages.sparkSession, write_archives(pages, folder), split, payloads=False)
