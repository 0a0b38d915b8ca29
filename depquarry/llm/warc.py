"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. A reading task owns the records that start inside its byte
range: it looks for the gzip magic, takes a candidate as a record only if the member decodes to a WARC
header, and reads the last record past the range's end. Chance magic bytes inside a member are so
left out, and no index file is needed.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depquarry.llm.common import filesystem, put_file, release, shuffle_partitions, sliced, small_batches, written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

#: A file is closed when it holds so many bytes.
FILE_BYTES = 256 << 20

#: Parts that the copies of one payload are dealt to.
SALTS = 32
READ = 1 << 20


def _head(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n"


def record(page: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None, revisit: bool) -> bytes:
    """A gzip member: a response with its payload, or a revisit with the HTTP head alone.

    What can't stand in a header is percent-encoded; a url that this changes, or that is null, is kept as it is
    in a field of its own.
    """
    clean = "".join(c if " " < c < "\x7f" or c > "\xa0" else quote(c, errors="surrogatepass") for c in url or "")
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Date", DATE), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", digest)]
    if clean != url:
        fields.append(("Source-URL", json.dumps(url)))
    if revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(_head(fields) + block + b"\r\n\r\n") + z.flush()


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``pages`` with sha1, payload_bytes and refers_to (null for a response).

    Of equal payloads of at least ``least`` bytes the row with the largest page_id is the response; a
    group whose page_ids are all null refers to none and has responses only. Rows that repeat the
    largest page_id are responses too.
    """
    html = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha1"), F.octet_length(html).cast("long").alias("payload_bytes"))
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    copies = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).where(F.octet_length("html") >= least)
    copies = copies.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("sha1"), F.octet_length("html").cast("long").alias("payload_bytes"))
    # a row per payload that occurs again, without the payload, for each part of its copies
    groups = copies.groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return p.join(groups, ["sha1", "payload_bytes", "salt"], "left").select("page_id", "url", "html", "sha1", "payload_bytes", refers.alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, least: int = 1000) -> DataFrame:
    """Writes ``pages`` (page_id, url, html, any others) as WARC files; returns (path, n_bytes), a row per file, once all are there.

    Null html is an empty payload; every row gives a record, repeated rows too. A text of any length is one
    record, which its task holds whole. Other columns of ``pages`` are not read.
    """
    small_batches(pages)

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        rows = (tuple(b.column(c)[i].as_py() for c in ("page_id", "url", "html", "sha1", "refers_to")) for b in sliced(batches) for i in range(b.num_rows))
        seq, ahead = 0, next(rows, None)

        def members() -> Iterator[bytes]:
            nonlocal ahead
            size = 0
            while ahead is not None and size < FILE_BYTES:
                page, url, html, sha1, refers_to = ahead
                got = record(page, url, html.encode("utf-8", "surrogatepass"), sha1, refers_to, refers_to is not None)
                size += len(got)
                yield got
                ahead = next(rows, None)

        while ahead is not None:
            path = f"{folder}/{at:06d}-{seq:04d}.warc.gz"
            size = put_file(path, members())
            yield pa.RecordBatch.from_pydict({"path": [path], "n_bytes": [size]})
            seq += 1

    return written(with_revisits(pages, least).mapInArrow(run, "path string, n_bytes long"), "warc-manifest")


class Ranged:
    """Bytes of a file by absolute place, a piece at a time."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.data = f, size, 0, b""

    def get(self, start: int, n: int) -> bytes:
        if start < self.at or start + n > self.at + len(self.data):
            self.f.seek(start)
            self.at, self.data = start, self.f.read(min(max(n, READ), self.size - start))
        return self.data[start - self.at : start - self.at + n]


def member_at(src: Ranged, start: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member that starts here and holds a WARC record, or None."""
    z, out, at = zlib.decompressobj(31), [], start
    try:
        checked = False
        while not z.eof:
            data = src.get(at, min(64 << 10, src.size - at))
            if not data:
                return None
            at += len(data)
            out.append(z.decompress(data))
            if not checked and (len(out) > 1 or len(out[0]) >= len(VERSION) or z.eof):
                if not b"".join(out).startswith(VERSION):
                    return None
                checked = True
    except zlib.error:
        return None
    return b"".join(out), at - len(z.unused_data)


def records_in(src: Ranged, start: int, end: int) -> Iterator[bytes]:
    """The records that start in [start, end)."""
    at = start
    while at < end:
        piece = src.get(at, min(READ, src.size - at, end - at + len(MAGIC) - 1))
        k = piece.find(MAGIC)
        if k < 0:
            at += max(1, len(piece) - len(MAGIC) + 1) if len(piece) >= len(MAGIC) else end - at
            continue
        if at + k >= end:
            return
        got = member_at(src, at + k)
        if got:
            yield got[0]
            at = got[1]
        else:
            at += k + 1


def parsed(raw: bytes) -> dict:
    """A record's fields: header names in lower case, the HTTP block's length, its payload and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    return fields | {"payload": payload, "payload_bytes": n}


def splits(files: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """(path, size, start, end): byte ranges of at most ``split_bytes``, dealt out evenly."""
    n = F.ceil(F.col("n_bytes") / split_bytes)
    at = F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k")
    out = files.where("n_bytes > 0").select("path", F.col("n_bytes").alias("size"), at)
    return out.select("path", "size", (F.col("k") * split_bytes).alias("start"), F.least((F.col("k") + 1) * split_bytes, F.col("size")).alias("end"))


def read_warc(files: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """The records of ``files`` (path, n_bytes): page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    A response's digest is worked out from its payload and must equal its header's; a revisit has its
    response's length and digest from its headers, and a null payload. Files without records give no rows.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def number(x: str | None):
        x = (x or "").removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x else None

    def run(batches):
        for batch in batches:
            for path, size, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start", "end"))):
                store, at = filesystem(path)
                rows, held = [], 0
                with store.open_input_file(at) as f:
                    for raw in records_in(Ranged(f, size), start, end):
                        r = parsed(raw)
                        digest = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
                        response = r["warc-type"] == "response"
                        if response and hashlib.sha1(r["payload"]).hexdigest() != digest:
                            raise ValueError(f"{path}: a payload differs from its digest: {r['warc-record-id']}")
                        url = json.loads(r["source-url"]) if "source-url" in r else r["warc-target-uri"]
                        rows.append({"page_id": number(r["warc-record-id"]), "url": url, "record_type": r["warc-type"], "refers_to": number(r.get("warc-refers-to")), "payload_bytes": r["payload_bytes"], "payload_digest": digest, "payload": r["payload"] if response else None})
                        held += len(raw)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=out)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)
                del rows
        release()

    spark = files.sparkSession
    small_batches(files)

    return splits(files, split_bytes).repartition(shuffle_partitions(spark), "path", "start").mapInArrow(run, schema)
