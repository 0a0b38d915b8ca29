"""BPE encoding and decoding by a table of distinct words.

Texts are cut into segments at ASCII white space. For the tokenizer file in use no token and no match of
its patterns crosses it, so a text's ids are those of its segments in turn; what a
segment holds beside (other white space, special tokens, combining marks) is left to the library.

Rows are taken in chunks of bounded size. Each chunk gives its distinct segments once, in blocks by a
hash of the segment; equal segments of all chunks so meet in one partition, where the library encodes
each once (again only where a block's segments exceed a bound of bytes). Blocks of ids go back to their chunks, and each text is put together by the positions of
its segments. Blocks hold many segments in one deflated row, so little is shuffled beside the texts.
Decoding joins ids with the table of pieces, which the vocabulary bounds.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depquarry.llm.common import release, shuffle_partitions, small_batches

#: UTF-8 bytes of the texts of a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20

#: Bytes of segments and their ids that a task keeps of a block; beyond them it starts anew, and encodes again what comes back.
KNOWN_BYTES = 128 << 20

#: What a segment takes beside its characters and ids: two objects' heads and a place in the table.
OBJECT_BYTES = 200

CHUNK_FIELDS = "chunk long, doc_id {id}, words binary"


class Numbered(defaultdict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Chunk:
    """Rows of about CHUNK_BYTES: a name, the doc_ids, the distinct segments by falling frequency, each text's numbers of them.

    The name is a digest of the texts in order: chunks of one name have the same texts and numbers.
    """

    def __init__(self):
        self.ids, self.at, self.numbers, self.size, self.digest = [], [], Numbered(), 0, xxhash.xxh3_64()

    def add(self, doc, raw: bytes) -> None:
        words = raw.split()
        self.ids.append(doc)
        self.at.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.size += len(raw)
        self.digest.update(len(raw).to_bytes(8, "little"))
        self.digest.update(raw)

    def close(self) -> tuple[int, list, list[bytes], list[np.ndarray]]:
        words = list(self.numbers)
        often = np.bincount(np.concatenate(self.at), minlength=len(words))
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        return self.digest.intdigest() - (1 << 63), self.ids, [words[i] for i in order.tolist()], [rank[x] for x in self.at]


def chunks(batches) -> Iterator[tuple[int, list, list[bytes], list[np.ndarray]]]:
    """The closed chunks of rows (doc_id, text) in turn."""
    c = Chunk()
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if c.ids and c.size + len(raw) > CHUNK_BYTES:
                yield c.close()
                c = Chunk()
            c.add(doc, raw)
    if c.ids:
        yield c.close()
    del c
    release()


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as byte planes, deflated: most are small."""
    return zlib.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).reshape(-1)


def tokenizer(path: str):
    """The library's tokenizer of a file, on the task's own thread, without truncation and padding."""
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Texts by which a tokenizer file is tried: whether what it makes of them is what it makes of their segments.
TRIALS = ("hello big world", "a\tb\nc\x0bd\x0ce\rf", " two  blanks ", "It's 3.5 %, (no?) word-word", "\u00fcber\u4f60 \u597d \U0001f600 x")


def must_split_at_space(path: str) -> None:
    """Fails for a tokenizer whose tokens reach across white space, as byte-level ones do: its ids are not those of the segments."""
    t = tokenizer(path)
    for text in TRIALS:
        parts = t.encode_batch(text.split(), add_special_tokens=False)
        if t.encode(text, add_special_tokens=False).ids != [i for p in parts for i in p.ids]:
            raise ValueError(f"{path}: its tokens don't end at white space ({text!r}), so texts can't be encoded by words")


def distinct_words(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, chunk, numbers, words): each chunk's distinct segments in blocks by their hash, with their numbers in the chunk."""

    def run(batches):
        for name, _, words, _ in chunks(batches):
            block = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % blocks
            order = np.argsort(block, kind="stable")
            edges = np.searchsorted(block[order], np.arange(blocks + 1))
            out = [[], [], [], []]
            for b in range(blocks):
                at = order[edges[b] : edges[b + 1]]
                if len(at):
                    gaps = np.diff(at, prepend=0).astype(np.uint32)
                    for column, v in zip(out, (b, name, packed(gaps), zlib.compress(b"\n".join([words[i] for i in at.tolist()]), 1))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["block", "chunk", "numbers", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, "block int, chunk long, numbers binary, words binary")


def encoded_words(words: DataFrame, path: str, blocks: int) -> DataFrame:
    """(chunk, numbers, sizes, ids): all chunks' blocks of one hash are in one partition, and each segment is encoded there once."""

    def run(batches):
        t, known, here, size = tokenizer(path), {}, None, 0
        for batch in batches:
            out = [[], [], []]
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist()):
                if block != here or size > KNOWN_BYTES:
                    known, here, size = {}, block, 0
                got = zlib.decompress(raw).decode("utf-8", "surrogatepass").split("\n")
                new = [w for w in got if w not in known]
                for i in range(0, len(new), 8192):
                    part = new[i : i + 8192]
                    known.update((w, np.array(e.ids, np.uint32).tobytes()) for w, e in zip(part, t.encode_batch_fast(part, add_special_tokens=False)))
                    size += sum(len(w) + len(known[w]) + OBJECT_BYTES for w in part)
                ids = list(map(known.__getitem__, got))
                out[1].append(packed(np.fromiter(map(len, ids), np.uint32, len(ids)) // 4))
                out[2].append(packed(np.frombuffer(b"".join(ids), np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("numbers"), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["chunk", "numbers", "sizes", "ids"])

    return words.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(run, "chunk long, numbers binary, sizes binary, ids binary")


def numbered_texts(docs: DataFrame, id_type: str) -> DataFrame:
    """(chunk, doc_id, words): each text as the numbers of its segments."""

    def run(batches):
        for name, ids, _, at in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), name, np.int64)), pa.array(ids, arrow_id), pa.array([packed(x) for x in at], pa.binary())], ["chunk", "doc_id", "words"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.select("doc_id", "text").mapInArrow(run, CHUNK_FIELDS.format(id=id_type))


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text, any others); ids: unsigned 32-bit, little-endian.

    ``decoded`` adds ``text``, what :func:`decode` makes of the ids, in the same task.

    The rows of ``docs`` are read twice and must come in the same order both times, as they do from
    files and written tables; if they don't, the run fails rather than return other ids. Null and
    empty texts have no ids. Repeated rows give repeated rows; a null doc_id stays null. A tokenizer file
    whose tokens reach across white space is refused.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def join(key, texts, words):
        number = np.concatenate([np.cumsum(unpacked(x.as_py()), dtype=np.int64) for x in words.column("numbers")] or [np.empty(0, np.int64)])
        count = np.concatenate([unpacked(x.as_py()) for x in words.column("sizes")] or [np.empty(0, np.uint32)]).astype(np.int64)
        data = np.concatenate([unpacked(x.as_py()) for x in words.column("ids")] or [np.empty(0, np.uint32)])
        known = int(number.max()) + 1 if len(number) else 0
        start, size = np.zeros(known, np.int64), np.full(known, -1, np.int64)
        start[number], size[number] = np.cumsum(count) - count, count
        out, said = [], []
        piece = held.value.get if decoded else None
        for x in texts.column("words"):
            at = unpacked(x.as_py())
            if len(at) and (int(at.max()) >= known or (size[at] < 0).any()):
                raise ValueError("the input came in another order when it was read again; write it to a table first")
            n = size[at]
            ends = np.cumsum(n)
            index = np.repeat(start[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(n) else 0)
            ids = data[index]
            out.append(ids.tobytes())
            if decoded:
                said.append(joined(ids, piece))
        made = {"doc_id": texts.column("doc_id"), "ids": pa.array(out, pa.binary())}
        return pa.table(made | ({"text": pa.array(said, pa.string())} if decoded else {}))

    must_split_at_space(path)
    small_batches(docs)
    held = held_pieces(docs.sparkSession, path) if decoded else None
    blocks = shuffle_partitions(docs.sparkSession)
    words = encoded_words(distinct_words(docs, blocks), path, blocks)
    texts = numbered_texts(docs, id_type)
    return texts.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(join, f"doc_id {id_type}, ids binary{', text string' if decoded else ''}")


def pieces(spark, path: str) -> DataFrame:
    """(id, piece): the vocabulary with its added tokens; its size is that of the tokenizer file."""
    t = tokenizer(path)
    vocab = t.get_vocab(with_added_tokens=True)
    return spark.createDataFrame(sorted((i, p) for p, i in vocab.items()), "id int, piece string")


def held_pieces(spark, path: str):
    """The table of pieces in each task: it is as long as the vocabulary, whatever the input."""
    table = pieces(spark, path)
    if (size := table.count()) > 1_000_000:
        raise ValueError(f"{size} pieces are too many for each task to hold")
    return spark.sparkContext.broadcast({r["id"]: r["piece"] for r in table.toLocalIterator()})


def joined(ids: np.ndarray, piece) -> str:
    """The pieces of ids; the file has no decoder, for which the library puts a blank between them."""
    return " ".join(filter(None, map(piece, ids.tolist())))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (…, ids) with the column ``text``: ids joined to the table of pieces. Ids without a piece give none."""
    held = held_pieces(encoded.sparkSession, path)
    schema = encoded.select("*", F.lit("").alias("text")).schema

    def run(batches):
        piece = held.value.get
        for batch in batches:
            text = [joined(np.frombuffer(x or b"", np.uint32), piece) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "text"])

    return encoded.mapInArrow(run, schema)
