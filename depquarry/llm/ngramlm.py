"""Stupid-backoff language model scores over token n-grams.

S(w | u v) = c(u v w) / c(u v) if that count is positive, else ``alpha`` times S(w | v), and so on;
a token alone scores (c(w) + 1) / (N + V). With ``leave_out`` a document's own n-grams are taken off
the counts, so that no document vouches for itself.

Texts are tokens of a byte-level tokenizer, kept in chunks of bounded size. Each chunk's distinct n-grams
with their counts are exploded to blocks by a hash: a block is a partition of the count table, summed
over all chunks, and joined there to the n-grams that the chunks ask for. The totals go back to their
chunks, where each document's token scores are summed. A block's share of a chunk is one deflated row,
as a row for each n-gram takes many times the disk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depquarry.llm.common import release, shuffle_partitions, sliced, small_batches, written
from depquarry.llm.minhash import mix
from depquarry.llm.tokenbin import encoder

#: Tokens of a chunk, and documents; a longer text is a chunk of its own.
CHUNK_TOKENS, CHUNK_DOCS = 1 << 20, 1 << 16

#: Tokens of the corpus to a block of the count table.
BLOCK_TOKENS = 4 << 20

#: The context before a text's first token; n-grams of up to three tokens are numbers of 16 bits a token, longer ones hashes, below a tag of their order.
START = 0xFFFF
EXACT, TAG = 3, 60


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as byte planes, deflated: most are small."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T), 1)


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").reshape(-1)


def packed_tokens(tokens: bytes) -> bytes:
    return zlib.compress(np.ascontiguousarray(np.frombuffer(tokens, np.uint8).reshape(-1, 2).T), 1)


def unpacked_tokens(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(2, -1).T).view("<u2").reshape(-1)


class Chunk:
    """The tokens of a chunk's documents end to end, and the n-gram that ends at each."""

    def __init__(self, sizes: list[int], tokens: bytes, order: int):
        self.sizes, self.order = np.array(sizes, np.int64), order
        n = int(self.sizes.sum())
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        # before each document stand as many START as the longest context has tokens
        self.at = np.arange(n) + (self.doc + 1) * (order - 1)
        self.flat = np.full(n + len(sizes) * (order - 1), START, np.uint64)
        self.flat[self.at] = unpacked_tokens(tokens)

    def grams(self, k: int) -> np.ndarray:
        """Below the tag of order k."""
        out = np.zeros(len(self.at), np.uint64)
        for i in range(min(k, EXACT) - 1, -1, -1):
            out = out << np.uint64(16) | self.flat[self.at - i]
        for i in range(EXACT, k):
            out = mix(out + np.uint64(i) + (self.flat[self.at - i] << np.uint64(40))) >> np.uint64(64 - TAG)
        return out

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, counts) of all orders, each order's ascending, order by order."""
        got = []
        for k in range(1, self.order + 1):
            g = np.sort(self.grams(k))
            first = starts(g)
            got.append((g[first] | np.uint64((k - 1) << TAG), np.diff(np.append(first, len(g)))))
        return np.concatenate([g for g, _ in got]), np.concatenate([n for _, n in got])

    def placed(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct k-grams as in :meth:`distinct`; for each token the place of its own among them, and how often its own document has it."""
        g = self.grams(k)
        if k <= EXACT:
            pair = g << np.uint64(16) | self.doc.astype(np.uint64)
            by = np.argsort(pair)
            pair = pair[by]
            new, g = starts(pair), pair >> np.uint64(16)
        else:
            by = np.lexsort((self.doc, g))
            g, d = g[by], self.doc[by]
            new = np.union1d(starts(g), starts(d))
        first = starts(g)
        runs = np.diff(np.append(new, len(g)))
        place, own = np.empty(len(g), np.int32), np.empty(len(g), np.int32)
        place[by] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(g))))
        own[by] = np.repeat(runs.astype(np.int32), runs)
        return g[first] | np.uint64((k - 1) << TAG), place, own


def starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def dealt(grams: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, edges): the places of the n-grams by block, ascending in each, and where each block's begin."""
    block = (mix(grams) % np.uint64(blocks)).astype(np.uint16 if blocks < 1 << 16 else np.uint32)
    order = np.argsort(block, kind="stable")
    return order, np.searchsorted(block[order], np.arange(blocks + 1))


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(chunk, doc_ids, sizes, tokens) of ``docs`` (doc_id, text, any others) as a written table, a row per chunk.

    Null and empty texts have no tokens; repeated rows stand as often. A chunk is named when it is written, so
    the scores, which read it several times, need no order of rows. Fails for vocabularies of 65535 or more.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(docs)
    id_type = docs.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)

    def run(batches):
        from pyspark import TaskContext

        encode, name = encoder(path), TaskContext.get().partitionId() << 32
        if encode.dtype.itemsize != 2:
            raise ValueError("a vocabulary of less than 65535 tokens is needed")
        ids, tokens, size = [], [], 0

        def close():
            row = [pa.array([name]), pa.array([ids], pa.list_(arrow_id)), pa.array([[len(t) // 2 for t in tokens]], pa.list_(pa.int32())), pa.array([packed_tokens(b"".join(tokens))], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["chunk", "doc_ids", "sizes", "tokens"])

        for batch in sliced(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                t = encode(text.as_py() or "")
                if ids and (size + len(t) > 2 * CHUNK_TOKENS or len(ids) >= CHUNK_DOCS):
                    yield close()
                    name, ids, tokens, size = name + 1, [], [], 0
                ids.append(doc)
                tokens.append(t)
                size += len(t)
        if ids:
            yield close()
        del ids, tokens
        encode.older = {}
        release()

    return written(docs.select("doc_id", "text").mapInArrow(run, f"chunk long, doc_ids array<{id_type.simpleString()}>, sizes array<int>, tokens binary"), "lm-tokens")


def chunk_rows(batches) -> Iterator[tuple[int, list, bytes]]:
    """(name, sizes, tokens) of the chunks."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("chunk")[i].as_py(), batch.column("sizes")[i].as_py(), batch.column("tokens")[i].as_py()
    release()


def exploded(tokens: DataFrame, order: int, blocks: int, asks: bool) -> DataFrame:
    """(block, chunk, asks, grams, counts): each chunk's distinct n-grams of all orders, by block."""

    def run(batches):
        for name, sizes, raw in chunk_rows(batches):
            grams, counts = Chunk(sizes, raw, order).distinct()
            at, edges = dealt(grams, blocks)
            own = [(b, at[edges[b] : edges[b + 1]]) for b in range(blocks) if edges[b] < edges[b + 1]]
            rows = [[b for b, _ in own], [name] * len(own), [asks] * len(own), [packed(np.diff(grams[x], prepend=np.uint64(0))) for _, x in own], [packed(counts[x]) for _, x in own]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], ["block", "chunk", "asks", "grams", "counts"])

    return tokens.select("chunk", "sizes", "tokens").mapInArrow(run, "block int, chunk long, asks boolean, grams binary, counts binary")


def sums(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, totals, place of each row's n-grams end to end) of a block's rows."""
    every = np.concatenate([np.cumsum(unpacked(x.as_py()), dtype=np.uint64) for x in rows.column("grams")])
    grams, at = np.unique(every, return_inverse=True)
    del every
    counts = np.concatenate([unpacked(x.as_py()) for x in rows.column("counts")])
    return grams, np.bincount(at, counts, len(grams)).astype(np.int64), at


def count_table(tokens: DataFrame, order: int = 3) -> DataFrame:
    """(gram, total) over every row of ``tokens``: the blocks' tables, a row per n-gram (as signed 64-bit) of up to ``order`` tokens."""

    def run(rows):
        grams, totals, _ = sums(rows)
        return pa.table([pa.array(grams.view(np.int64)), pa.array(totals)], names=["gram", "total"])

    small_batches(tokens)
    blocks = block_count(tokens)[0]
    return exploded(tokens, order, blocks, False).groupBy("block").applyInArrow(run, "gram long, total long")


def block_count(corpus: DataFrame) -> tuple[int, int, int, int]:
    """(blocks, documents, tokens, distinct tokens) of a corpus; tasks hand on a row for each token of the vocabulary at most."""

    def run(batches):
        n, docs = np.zeros(1 << 16, np.int64), 0
        for _, sizes, raw in chunk_rows(batches):
            docs += len(sizes)
            n += np.bincount(unpacked_tokens(raw), minlength=1 << 16)
        on = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(on, -1)), pa.array(np.append(n[on], docs))], ["token", "n"])

    each = corpus.select("chunk", "sizes", "tokens").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    one = F.col("token") >= 0
    got = each.agg(F.sum(F.when(~one, F.col("n"))).alias("docs"), F.sum(F.when(one, F.col("n"))).alias("n"), F.count_if(one).alias("kinds")).first()
    n = int(got["n"] or 0)
    return max(2 * shuffle_partitions(corpus.sparkSession), n // BLOCK_TOKENS + 1), int(got["docs"] or 0), n, int(got["kinds"] or 0)


def score(tokens: DataFrame, order: int = 3, corpus: DataFrame | None = None, alpha: float = 0.4) -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score, n_backed_off) for every document of ``tokens``, a table of :func:`tokenized`.

    Counts are over ``corpus``, another such table; without one, over ``tokens`` itself, and then each
    document's own n-grams are taken off. No tokens: the sum 0 and a null mean. Repeated rows give repeated
    rows, which vouch for each other; a null doc_id stays null; no rows give none.
    """
    if not 2 <= order <= 8:
        raise ValueError("an order from 2 to 8 is needed")
    small_batches(tokens)
    leave_out = corpus is None
    blocks, n_docs, n_all, n_kinds = block_count(tokens if leave_out else corpus)
    id_type = tokens.schema["doc_ids"].dataType.elementType.simpleString()
    rows = exploded(tokens, order, blocks, True)
    if not leave_out:
        rows = rows.unionByName(exploded(corpus, order, blocks, False))

    def totals(group):
        if leave_out:
            _, total, at = sums(group)
        else:
            grams, total, _ = sums(known) if (known := group.filter(pa.compute.invert(group.column("asks")))).num_rows else (np.empty(0, np.uint64), np.empty(0, np.int64), None)
            group = group.filter(group.column("asks"))
            every = np.concatenate([np.cumsum(unpacked(x.as_py()), dtype=np.uint64) for x in group.column("grams")] or [np.empty(0, np.uint64)])
            at = np.searchsorted(grams, every)
            at[np.append(grams, np.uint64(0))[at] != every] = len(grams)
            total = np.append(total, 0)
        ends = np.cumsum([len(unpacked(x.as_py())) for x in group.column("counts")], dtype=np.int64)
        found = [packed(total[at[a:b]]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return pa.table([group.column("block"), group.column("chunk"), pa.array(found, pa.binary())], names=["block", "chunk", "totals"])

    def doc_scores(key, mine, found):
        out = {"doc_id": [], "n_tokens": [], "log_score": [], "mean_log_score": [], "n_backed_off": []}
        if mine.num_rows:
            c = Chunk(mine.column("sizes")[0].as_py(), mine.column("tokens")[0].as_py(), order)
            placed = [c.placed(k) for k in range(1, order + 1)]
            grams = np.concatenate([g for g, _, _ in placed])
            at, edges = dealt(grams, blocks)
            total = np.zeros(len(grams), np.int64)
            for b, x in zip(found.column("block").to_pylist(), found.column("totals")):
                total[at[edges[b] : edges[b + 1]]] = unpacked(x.as_py()).astype(np.int64)
            kinds = np.searchsorted(grams, np.arange(order + 1, dtype=np.uint64) << np.uint64(TAG))
            n, own_docs = c.sizes, 1 if leave_out else 0
            first = np.concatenate([[0], np.cumsum(n)[:-1]])[n > 0]
            p = before = backed = None
            for k in range(1, order + 1):
                _, place, own = placed[k - 1]
                seen = total[kinds[k - 1] : kinds[k]][place] - (own if leave_out else 0)
                if k == 1:
                    p = (seen + 1) / (np.maximum(1, n_all - (n[c.doc] if leave_out else 0)) + n_kinds)
                else:
                    # the context of the n-gram that ends here is the shorter one that ends one token before; that of a first token, all starts
                    context = np.concatenate([[0], before[:-1]]) if len(before) else before
                    context[first] = n_docs - own_docs
                    on = (seen > 0) & (context > 0)
                    p = np.where(on, seen / np.maximum(context, 1), alpha * p)
                    backed = ~on
                before = seen
            logs = np.bincount(c.doc, np.log(p), len(n))
            out = {"doc_id": mine.column("doc_ids")[0].values, "n_tokens": n, "log_score": logs, "mean_log_score": pa.array(logs / np.maximum(n, 1), pa.float64(), mask=n == 0), "n_backed_off": np.bincount(c.doc, backed, len(n)).astype(np.int64)}
        types = {"doc_id": mine.schema.field("doc_ids").type.value_type, "n_tokens": pa.int64(), "log_score": pa.float64(), "mean_log_score": pa.float64(), "n_backed_off": pa.int64()}
        return pa.table({k: v if isinstance(v, pa.Array) else pa.array(v, types[k]) for k, v in out.items()})

    replies = rows.groupBy("block").applyInArrow(totals, "block int, chunk long, totals binary")
    return tokens.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(doc_scores, f"doc_id {id_type}, n_tokens long, log_score double, mean_log_score double, n_backed_off long")
