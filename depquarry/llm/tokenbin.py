"""Token ids as binary files: one array of all documents' ids, Elias-Fano coded document boundaries.

A file holds a run of documents in ascending order: a head (magic, id width, counts, section
lengths), the ids end to end, the boundaries (a number more than documents, the first 0) and the
documents' own numbers, both Elias-Fano coded. Documents without a number come last, in files whose
numbers' section is empty.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depquarry.llm.bpe import tokenizer
from depquarry.llm.common import filesystem, order_bounds, put_file, range_bucket, release, shared_path, shuffle_partitions, sliced, small_batches
from depquarry.llm.eliasfano import EliasFano

MAGIC = b"DQTOKEF1"
HEAD = struct.Struct("<8sQQQQQq")

#: What keeps a text from being cut here: neighbouring white space by the widest definition, or a stop
#: or comma that follows no letter or digit.
WIDE, STRAY = re.compile(r"\s\s"), re.compile(r"[\W_][.,]")


def _class(byte: int) -> int:
    """w in words, s white space, . stop or comma, p other ASCII and the second bytes of the two signs among the accented letters; x: not judged by bytes."""
    c = chr(byte)
    if byte < 0x80:
        return ord("w" if c.isalnum() else "x" if byte == 0 else "s" if c.isspace() else "." if c in ".," else "p")
    return ord("p" if byte in (0x97, 0xB7) else "w" if byte < 0xC0 or byte == 0xC3 else "x")


CLASSES = bytes(map(_class, range(256)))


def can_be_cut(text: str) -> bool:
    """By bytes where the text is of ASCII and accented letters alone, else by the patterns."""
    kinds = text.encode("utf-8", "surrogatepass").translate(CLASSES)
    if b"x" in kinds:
        return not ("\0" in text or text[:1] in (".", ",") or WIDE.search(text) or STRAY.search(text))
    return not (kinds[:1] == b"." or b"ss" in kinds or b".." in kinds or b"s." in kinds or b"p." in kinds)


#: Pieces that a worker keeps in each of two generations, some 80 MB; between tasks it keeps one.
PIECES_KEPT = 400_000

#: Fixed value: how byte-level tokens write a blank.
BLANK = "Ġ"

SHARD_BYTES = 32 << 20


class Encoder:
    """Ids of whole texts as the library gives them, as little-endian bytes.

    A text is cut where the tokenizer's own cut always begins a word: before a blank, before a stop or
    comma after a letter or digit, and on both sides of a line break; so its ids are those of the pieces
    in turn. Each piece goes through the library once and is kept, those in use longest. Texts with
    neighbouring white space, a stop or comma elsewhere, or a special token's string go through the
    library whole.
    """

    def __init__(self, path: str):
        self.t = tokenizer(path)
        if self.t.normalizer is not None or type(self.t.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError("a byte-level tokenizer without a normalizer is needed")
        self.dtype = np.dtype("<u2" if self.t.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.t.get_added_tokens_decoder().values()]
        self.opens = np.zeros(self.t.get_vocab_size(), bool)  # tokens that begin with a blank
        for token, i in self.t.get_vocab().items():
            self.opens[i] = token.startswith(BLANK)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def __call__(self, text: str) -> bytes:
        if not can_be_cut(text) or any(s in text for s in self.special):
            return self._whole(text)
        pieces = text.replace(" ", "\0 ").replace(".", "\0.").replace(",", "\0,").replace("\n", "\0\n\0").split("\0")
        got = list(map(self.known.get, pieces))
        if None in got:
            at = [i for i, x in enumerate(got) if x is None]
            new = self._learn({pieces[i] for i in at})
            for i in at:
                got[i] = new[pieces[i]]
        return b"".join(got)

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        older = self.older
        out = {p: x for p in pieces if (x := older.get(p)) is not None}
        words = [p for p in pieces if p not in out]
        # words with a blank before them and none in them go through the library in one text
        spaced = [p for p in words if p[0] == " " and len(p) > 1 and len(p.split()) == 1 and not p[-1].isspace()]
        if spaced:
            at = np.array(self.t.encode_batch_fast(["".join(spaced)], add_special_tokens=False)[0].ids, self.dtype)
            starts = np.flatnonzero(self.opens[at]).tolist()
            if len(starts) == len(spaced):
                raw, n = at.tobytes(), self.dtype.itemsize
                ends = [*starts[1:], len(at)]
                out.update((p, raw[a * n : b * n]) for p, a, b in zip(spaced, starts, ends))
        rest = [p for p in words if p not in out]
        for p, e in zip(rest, self.t.encode_batch_fast(rest, add_special_tokens=False)):
            out[p] = np.array(e.ids, self.dtype).tobytes()
        if len(self.known) > PIECES_KEPT:
            self.older, self.known = self.known, {"": b""}
        self.known.update(out)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; what it keeps serves the tasks after."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def sections(ids: list[bytes], docs: list[int | None], dtype: np.dtype) -> Iterator[bytes]:
    """A file's bytes; documents' numbers are all null or none."""
    sizes = np.fromiter((len(x) // dtype.itemsize for x in ids), np.int64, len(ids))
    bounds = EliasFano.encode(np.concatenate([[0], np.cumsum(sizes)])).tobytes()
    base = docs[0] or 0 if docs else 0
    names = EliasFano.encode(np.array(docs, np.int64) - base).tobytes() if docs and docs[0] is not None else b""
    yield HEAD.pack(MAGIC, dtype.itemsize, len(docs), int(sizes.sum()), len(bounds), len(names), base)
    yield from ids
    yield bounds
    yield names


class TokenFile:
    """A file's parts: ``doc_ids``, ``bounds`` (select gives offsets) and ``ids(i)`` by position."""

    def __init__(self, data: bytes):
        magic, width, self.n_docs, self.n_tokens, n_bounds, n_names, base = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("no token file")
        self.width, self.data, at = width, data, HEAD.size + width * self.n_tokens
        self.bounds = EliasFano.frombytes(data[at : at + n_bounds])
        named = data[at + n_bounds : at + n_bounds + n_names]
        self.doc_ids = pa.array(EliasFano.frombytes(named).select_all().astype(np.int64) + base) if n_names else pa.nulls(self.n_docs, pa.int64())

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.data, f"<u{self.width}", end - start, HEAD.size + start * self.width)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text, any others) with ``end_id`` after each document.

    Files come in ascending doc_id order, equal doc_ids by their text, null ones last; returns the manifest
    (bucket, seq, path, n_docs, n_tokens, n_bytes), a row per file. Null and empty texts have the end id
    alone; repeated rows are written as often; no rows give no file. Buckets are ranges of doc_id of about
    equal row counts; a file is closed at SHARD_BYTES, a longer text ends its file.
    """
    spark = docs.sparkSession
    small_batches(docs)
    folder = folder or shared_path(spark, "tokens")
    parts = 2 * shuffle_partitions(spark)
    bounds = order_bounds(docs, "doc_id", parts)

    def run(batches):
        encode, seq, ids, names, size = encoder(tokenizer_path), 0, [], [], 0
        end = np.array([end_id], encode.dtype).tobytes()
        bucket = None

        def close():
            path = f"{folder}/{bucket:08d}-{seq:05d}"
            n = put_file(path, sections(ids, names, encode.dtype))
            tokens = sum(map(len, ids)) // encode.dtype.itemsize
            return pa.RecordBatch.from_pydict({"bucket": [bucket], "seq": [seq], "path": [path], "n_docs": [len(ids)], "n_tokens": [tokens], "n_bytes": [n]}, schema=out)

        out = pa.schema([("bucket", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
        for batch in sliced(batches):
            for b, doc, text in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                if names and (b != bucket or size >= SHARD_BYTES):
                    yield close()
                    seq, ids, names, size = seq + 1 if b == bucket else 0, [], [], 0
                bucket = b
                ids.append(encode(text.as_py() or "") + end)
                names.append(doc)
                size += len(ids[-1])
        if names:
            yield close()
        del ids
        encode.older = {}
        release()

    # without a number there is no order, so such rows are dealt out by their text
    bucket = F.when(F.col("doc_id").isNull(), F.lit(parts) + F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")).otherwise(range_bucket(F.col("doc_id"), bounds))
    dealt = docs.select(bucket.alias("bucket"), "doc_id", "text").repartition("bucket").sortWithinPartitions("bucket", "doc_id", "text")
    return dealt.mapInArrow(run, "bucket int, seq int, path string, n_docs long, n_tokens long, n_bytes long")


def head_of(path: str) -> tuple:
    store, at = filesystem(path)
    with store.open_input_file(at) as f:
        return HEAD.unpack(f.read(HEAD.size))


def heads(files: DataFrame) -> DataFrame:
    """``files`` (bucket, seq, path) with n_docs and n_tokens as the files' heads have them."""

    def run(batches):
        for batch in batches:
            got = list(map(head_of, batch.column("path").to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([h[2] for h in got], pa.int64()), pa.array([h[3] for h in got], pa.int64())], [*batch.schema.names, "n_docs", "n_tokens"])

    return files.select("bucket", "seq", "path").mapInArrow(run, "bucket int, seq int, path string, n_docs long, n_tokens long")


def file_starts(files: DataFrame) -> DataFrame:
    """``files`` (bucket, seq, path) with n_docs, n_tokens and ``start``: ids in all files before.

    Counts come from the files' heads. Only ranges, of which there are few, are summed in one place.
    """
    files = heads(files)
    within = Window.partitionBy("bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ranges = files.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    before = ranges.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    start = F.coalesce(F.sum("n_tokens").over(within), F.lit(0)) + F.col("before")
    return files.join(before, "bucket").withColumn("start", start).drop("before")


def read_token_files(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids, width): every document of the files of ``files`` (path, start).

    ``ids`` are little-endian unsigned integers of ``width`` bytes, as in the file; without ``with_ids``
    they stay out. The CRC is that of the ids as 32-bit integers.
    """

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                store, at = filesystem(path)
                with store.open_input_file(at) as f:
                    file = TokenFile(f.read())
                bounds = file.bounds.select_all().astype(np.int64)
                for i in range(0, file.n_docs, 2000):
                    some = bounds[i : i + 2001]
                    own = file.ids(int(some[0]), int(some[-1]))
                    wide, edges = memoryview(own.astype("<u4")).cast("B"), ((some - some[0]) * 4).tolist()
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip(edges, edges[1:])]
                    out = [file.doc_ids[i : i + 2000], pa.array(some[:-1] + base), pa.array(np.diff(some)), pa.array(crc, pa.int64())]
                    if with_ids:
                        offsets = ((some - some[0]) * file.width).astype(np.int32)
                        ids = pa.BinaryArray.from_buffers(pa.binary(), len(some) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(own)])
                        out += [ids, pa.array(np.full(len(ids), file.width, np.int32))]
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids", "width"][: len(out)])
                del file
        release()

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary, width int" * with_ids
    return files.select("path", "start").repartition(shuffle_partitions(files.sparkSession), "path").mapInArrow(run, schema)
