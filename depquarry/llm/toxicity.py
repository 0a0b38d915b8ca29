"""Toxicity: a convolutional text classifier, trained in numpy.

A word's embedding is a sum over a few features (the word, its first 4 and first 6 letters), each
hashed by two functions into one table, so that a chance collision gives half a signal. Filters of
several widths run over the words; the largest value of each over the whole text goes to a logistic
output. Thresholds are calibrated by language on rows left out of the fit.

The fit uses every labelled row. A share of them of bounded size, picked by a hash of the id, gives the model to start
from; from it, shards of all rows are trained apart, a pass each, and what they changed is averaged. Scoring uses
every word of every text.
"""

from __future__ import annotations

import copy
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depquarry.llm.common import LOWER, filesystem, put_file, shared_path, sliced, small_batches


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18
    dim: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 12
    start_rows: int = 6000
    shards: int = 64
    chunk_bytes: int = 96 << 20
    calibration_share: int = 8
    epochs: int = 6
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7


FEATURES = 6


class Features(dict):
    """The table rows of a word's features, as bytes of 32-bit integers; each worked out once, bounded."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 120_000:
            self.clear()
        bare = word.strip(b".,;:!?\"'()[]{}*#%$&-_<>/\\|") or word
        out = []
        letters = bare.decode("utf-8", "ignore")
        for tag, part in ((b"w", bare), (b"4", letters[:4].encode()), (b"6", letters[:6].encode())):
            h = xxhash.xxh64_intdigest(tag + part)
            out += [h % self.buckets, (h >> 32) % self.buckets]
        got = self[word] = np.array(out, np.int32).tobytes()
        return got


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


@dataclass
class Model:
    settings: Settings
    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, s: Settings) -> Model:
        rng = np.random.default_rng(s.seed)
        table = rng.normal(0, 0.02, (s.buckets, s.dim)).astype(np.float32)
        filters = [rng.normal(0, 1 / np.sqrt(w * s.dim), (w * s.dim, s.filters)).astype(np.float32) for w in s.widths]
        return cls(s, table, filters, [np.full(s.filters, 0.1, np.float32) for _ in s.widths], rng.normal(0, 0.1, len(s.widths) * s.filters).astype(np.float32), 0.0)

    def forward(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """texts: (distinct feature rows, each word's place in them). (scores, pooled, place of each maximum, rows laid end to end)."""
        s = self.settings
        pad = max(s.widths) - 1
        size = [len(at) for _, at in texts]
        base = np.cumsum([0] + [len(d) for d, _ in texts])
        words = self.table[np.concatenate([d for d, _ in texts])].sum(axis=1) if base[-1] else np.zeros((0, s.dim), np.float32)
        total = sum(size) + pad * len(texts)
        laid = np.full(total + pad, -1, np.int64)
        start, first = 0, []
        for (_, at), b in zip(texts, base):
            first.append(start)
            laid[start : start + len(at)] = at + b
            start += len(at) + pad
        x = np.zeros((len(laid), s.dim), np.float32)
        on = laid >= 0
        x[on] = words[laid[on]]
        n = total
        pooled, places = [], []
        for w, f, b in zip(s.widths, self.filters, self.bias):
            conv = x[:n] @ f[: s.dim]
            for i in range(1, w):
                conv += x[i : n + i] @ f[i * s.dim : (i + 1) * s.dim]
            conv += b
            top = np.zeros((len(texts), s.filters), np.float32)
            place = np.zeros((len(texts), s.filters), np.int64)
            for i, (a, k) in enumerate(zip(first, size)):
                if k:
                    p = conv[a : a + k].argmax(axis=0)
                    top[i], place[i] = conv[a + p, np.arange(s.filters)], a + p
            pooled.append(np.maximum(top, 0))
            places.append(place)
        pooled = np.concatenate(pooled, axis=1)
        z = pooled @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), pooled, np.stack(places), [x, laid]

    def score(self, texts: list[str | None], known: Features, most: int = 60_000) -> np.ndarray:
        """Scores of whole texts; short ones go through the net together, a longer one alone."""
        out, part, n = [], [], 0
        for t in texts:
            f = features(t, known)
            if part and n + len(f[1]) > most:
                out.append(self.forward(part)[0])
                part, n = [], 0
            part.append(f)
            n += len(f[1])
        if part:
            out.append(self.forward(part)[0])
        return np.concatenate(out) if out else np.empty(0)


def features(text: str | None, known: Features) -> tuple[np.ndarray, np.ndarray]:
    words = words_of(text)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    rows = np.frombuffer(b"".join([known[w] for w in number]), np.int32).reshape(-1, FEATURES)
    return rows, np.fromiter(map(number.__getitem__, words), np.int32, len(words))


class Trainer:
    """A model in training, with what its optimisers hold; weights are those of the labels 0 and 1."""

    def __init__(self, s: Settings, weights: tuple[float, float]):
        self.model, self.weights = Model.fresh(s), np.array(weights, np.float32)
        self.squares = np.full(s.buckets, 1e-8, np.float32)  # AdaGrad by table row
        self.state: dict = {}
        self.t, self.bias = 0, np.zeros(1, np.float32)

    def passes(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int) -> None:
        y, rng = np.array(labels, np.int32), np.random.default_rng(self.model.settings.seed)
        for _ in range(epochs):
            order = rng.permutation(len(rows)) if epochs > 1 else np.arange(len(rows))
            for i in range(0, len(order), 32):
                pick = order[i : i + 32]
                self.batch([rows[j] for j in pick], y[pick])

    def batch(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
        """Adam over a mini-batch; only the places of the maxima carry a gradient."""
        m, s = self.model, self.model.settings
        weight = self.weights[y]
        self.t += 1
        t = self.t

        def step(name, value, grad, t):
            a, b = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
            a += 0.1 * (grad - a)
            b += 0.001 * (grad * grad - b)
            value -= s.rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

        p, pooled, places, (x, laid) = m.forward(rows)
        d = ((p - y) * weight / len(rows)).astype(np.float32)
        back = d[:, None] * m.out[None, :] * (pooled > 0)
        grads = {}
        every, values = [], []
        for k, w in enumerate(s.widths):
            g = back[:, k * s.filters : (k + 1) * s.filters]
            at = places[k]
            fg = np.zeros_like(m.filters[k])
            for j in range(w):
                near = x[at + j]
                fg[j * s.dim : (j + 1) * s.dim] = np.einsum("bfd,bf->df", near, g)
                every.append((at + j).reshape(-1))
                values.append((g[:, :, None] * m.filters[k][j * s.dim : (j + 1) * s.dim].T[None]).reshape(-1, s.dim))
            grads[k] = fg + s.decay * m.filters[k]
            step(f"b{k}", m.bias[k], g.sum(axis=0), t)
        step("out", m.out, pooled.T @ d + s.decay * m.out, t)
        step("bias", self.bias, np.array([d.sum()], np.float32), t)
        m.out_bias = float(self.bias[0])
        for k, g in grads.items():
            step(f"f{k}", m.filters[k], g, t)
        at, val = np.concatenate(every), np.concatenate(values)
        word = laid[at]
        on = (word >= 0) & (np.abs(val).sum(axis=1) > 0)
        if on.any():
            distinct = np.concatenate([r[0] for r in rows])
            hit = distinct[word[on]]
            flat, inverse = np.unique(hit.reshape(-1), return_inverse=True)
            g = np.zeros((len(flat), s.dim), np.float32)
            np.add.at(g, inverse.reshape(-1), np.repeat(val[on], FEATURES, axis=0))
            g += s.decay * m.table[flat]
            self.squares[flat] += (g * g).mean(axis=1)
            m.table[flat] -= 0.05 * g / np.sqrt(self.squares[flat])[:, None]

    def dense(self) -> np.ndarray:
        m = self.model
        return np.concatenate([x.reshape(-1) for x in (*m.filters, *m.bias, m.out, self.bias)])


#: Rows of the table of embeddings in a block of what a shard changed; the block -1 is all the rest.
BLOCK = 1 << 12


def changes(start: Trainer, now: Trainer):
    """(block, n, values) of what a shard changed: n marks the table rows it touched, as others say nothing of them."""
    moved = now.squares != start.squares
    for at in range(0, len(moved), BLOCK):
        rows = np.flatnonzero(moved[at : at + BLOCK]).astype(np.int32)
        if len(rows):
            yield at // BLOCK, rows.tobytes(), (now.model.table[at + rows] - start.model.table[at + rows]).tobytes()
    yield -1, b"", (now.dense() - start.dense()).tobytes()


def mean_change(key, group):
    """The mean of a block's changes over the shards that touched it, each row of the table by itself."""
    block = key[0].as_py()
    if block < 0:
        out = np.mean([np.frombuffer(v, np.float32) for v in sorted(group.column("change").to_pylist())], axis=0, dtype=np.float64)
        return pa.table({"block": pa.array([block], pa.int32()), "touched": [b""], "change": [out.astype(np.float32).tobytes()]})
    total, times = None, np.zeros(BLOCK, np.int32)
    # in one order, so that the sum is the same at every run
    for rows, v in sorted((r.as_py(), v.as_py()) for r, v in zip(group.column("touched"), group.column("change"))):
        at = np.frombuffer(rows, np.int32)
        x = np.frombuffer(v, np.float32).reshape(len(at), -1)
        total = np.zeros((BLOCK, x.shape[1])) if total is None else total
        total[at] += x
        times[at] += 1
    at = np.flatnonzero(times).astype(np.int32)
    out = (total[at] / times[at, None]).astype(np.float32)
    return pa.table({"block": pa.array([block], pa.int32()), "touched": [at.tobytes()], "change": [out.tobytes()]})


def merged(start: Trainer, blocks) -> Model:
    """The model of ``start`` with the mean changes (block, touched, change) of all shards put in."""
    m = start.model
    for block, touched, change in blocks:
        x = np.frombuffer(change, np.float32)
        if block >= 0:
            m.table[block * BLOCK + np.frombuffer(touched, np.int32)] += x.reshape(-1, m.settings.dim)
            continue
        at = 0
        for part in (*m.filters, *m.bias, m.out, start.bias):
            part += x[at : at + part.size].reshape(part.shape)
            at += part.size
    m.out_bias = float(start.bias[0])
    return m


def constant(s: Settings, score: float) -> Model:
    """A model that says the same of every text."""
    m = Model.fresh(s)
    m.out[:] = 0
    m.out_bias = score
    return m


#: Thresholds that a calibration tries.
GRID = np.linspace(0.05, 0.95, 91)


def best_threshold(reached: np.ndarray) -> float:
    """The middle of the widest best stretch of thresholds for F1; 0.5 where the rows can't tell.

    ``reached`` counts rows by label (2) and by how many of GRID their score reaches (0 to 91).
    """
    if not reached.sum(axis=1).all():
        return 0.5
    # those that reach a threshold at least
    above = reached[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
    f1 = 2 * above[1] / np.maximum(1, above.sum(axis=0) + reached[1].sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    return float(GRID[max(runs, key=len)].mean())


#: Bits of the bitmap that ids have to pass before their texts are dealt out: for each label, and in all (8 MB).
LABEL_BITS, BITMAP_BITS = 16, 1 << 26


def labelled(docs: DataFrame, given: DataFrame, n: int, shards: Column) -> DataFrame:
    """(shard, doc_id, toxic, text, lang) of the rows of ``docs`` whose ids ``given`` (doc_id, toxic) has, a shard in one task.

    ``n``: about how many labels there are; ``shards``: an id's shard. Texts pass a bitmap of the labels' ids, of a size that is
    bounded, and are shuffled once, by the shard; there they meet their labels. A join would deal out all texts, by their ids.
    """
    bits = min(BITMAP_BITS, 1 << max(15, (LABEL_BITS * n - 1).bit_length()))
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(bits)) + 1
    pieces = given.groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    lang = F.col("lang") if "lang" in docs.columns else F.lit("").alias("lang")
    texts = docs.select("doc_id", F.struct("text", lang).alias("row")).where("doc_id is not null")
    texts = texts.join(F.broadcast(pieces), F.bitmap_bucket_number(at) == F.col("piece")).where(F.getbit(byte, F.pmod(place, F.lit(8))) == 1)
    both = texts.select("doc_id", "row").unionByName(given, allowMissingColumns=True)
    one = both.withColumn("shard", shards).repartition("shard").groupBy("shard", "doc_id").agg(F.min("row").alias("row"), F.max("toxic").alias("toxic"))
    return one.where("row is not null and toxic is not null").select("shard", "doc_id", "toxic", "row.*")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, s: Settings = Settings()) -> Model:
    """A model from all rows of ``labels`` (doc_id, toxic) for which ``usable`` (over doc_id) holds.

    Documents and labels join by doc_id; null labels, and labels without a document, are left out. Of rows that
    repeat a doc_id that with the least text counts, of labels that contradict each other the larger. One of
    ``calibration_share`` ids, by hash, is left out of the training; on all of these the thresholds are set. A task
    trains the start on about ``start_rows`` rows; the driver reads that and the changes of a model, and gets counts.
    """
    small_batches(docs)
    h, cal = F.xxhash64("doc_id"), F.pmod(F.xxhash64("doc_id"), F.lit(s.calibration_share)) == 0
    id_type = labels.schema["doc_id"].dataType
    if docs.schema["doc_id"].dataType != id_type:  # an id has one hash on both sides
        docs = docs.withColumn("doc_id", F.col("doc_id").try_cast(id_type))
    given = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(usable).select("doc_id", F.col("toxic").cast("int"))
    marked = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = marked.join(docs.select("doc_id"), "doc_id", "left_semi").where(~cal).groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in found}
    if len(n) < 2:  # one label alone: its score for every text
        return constant(s, 0.0 if not n else 4.0 if 1 in n else -4.0)
    total = n[0] + n[1]
    cuts = -(-total // s.start_rows)
    shards = min(cuts, s.shards)
    # the lowest bits tell the calibration's rows
    cut = F.pmod(F.shiftright(h, 8), F.lit(cuts))

    def rows(which: Column) -> DataFrame:
        return labelled(docs.where(which), given.where(which), total, F.pmod(cut, F.lit(shards)).cast("int"))

    def ordered(x: DataFrame) -> DataFrame:
        return x.sortWithinPartitions("shard", F.xxhash64("doc_id"), "doc_id").select("shard", "toxic", "text")

    weights, kind = (total / 2 / n[0], total / 2 / n[1]), "block int, touched binary, change binary"
    # both models go through files of the shared folder, which are smaller than what Spark's driver holds to collect or send them
    folder = shared_path(docs.sparkSession, "toxicity")
    began = f"{folder}/start"
    made = ordered(rows(~cal & (cut == 0))).mapInArrow(shard_trainer((s, weights), s.epochs, began), kind).count()
    start = pickle.loads(read_file(began)) if made else Trainer(s, weights)
    model = start.model
    if cuts > 1:
        if not made:
            put_file(began, [pickle.dumps(start)])
        changed = ordered(rows(~cal)).mapInArrow(shard_trainer(began, 1), kind)
        changed.groupBy("block").applyInArrow(mean_change, kind).write.parquet(f"{folder}/changes")
        model = merged(start, table_rows(f"{folder}/changes"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    reach = sum(((F.col("score") >= F.lit(float(g))).cast("int") for g in GRID), F.lit(0))
    scored = scored_by(held, rows(cal).select("toxic", "lang", "text"))
    counts = scored.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "toxic", reach.alias("reach")).count().collect()
    by: dict[str, np.ndarray] = {}
    for r in counts:
        by.setdefault(r["lang"], np.zeros((2, len(GRID) + 1), np.int64))[r["toxic"], r["reach"]] += r["count"]
    held.destroy()
    model.thresholds = {g: best_threshold(by[g]) for g in sorted(by)}
    return model


def read_file(uri: str) -> bytes:
    files, path = filesystem(uri)
    with files.open_input_stream(path) as f:
        return f.read()


def table_rows(uri: str):
    """The rows of a small Parquet table in the shared folder, a file at a time."""
    from pyarrow import fs, parquet

    files, path = filesystem(uri)
    for f in sorted(x.path for x in files.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet")):
        yield from zip(*[c.to_pylist() for c in parquet.ParquetFile(files.open_input_file(f)).read().columns], strict=True)


def shard_trainer(held, epochs: int, to: str | None = None):
    """For ``mapInArrow`` over (shard, toxic, text) with each shard's rows together: trains each from the same start.

    ``held``: the start's file, or what a trainer is made of. Gives a shard's changes, or one row after the trainer was put
    in the file ``to``. Rows are taken in chunks of ``chunk_bytes`` of their features, of which each is passed over ``epochs`` times.
    """

    def run(batches):
        given = None
        shard, now, part, y, size = None, None, [], [], 0

        def results():
            now.passes(part, y, epochs)
            if to:
                put_file(to, [pickle.dumps(now)])
            out = [(0, b"", b"")] if to else list(changes(given, now))
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], ["block", "touched", "change"])

        for batch in sliced(batches):
            for k, label, text in zip(batch.column("shard"), batch.column("toxic"), batch.column("text")):
                k = k.as_py()
                if given is None:
                    given = Trainer(*held) if isinstance(held, tuple) else pickle.loads(read_file(held))
                    s = given.model.settings
                    known = Features(s.buckets)
                if k != shard:
                    if now is not None:
                        yield results()
                    shard, now, part, y, size = k, copy.deepcopy(given), [], [], 0
                f = features(text.as_py(), known)
                part.append(f)
                y.append(label.as_py())
                size += f[0].nbytes + f[1].nbytes
                if size > s.chunk_bytes or epochs == 1 and len(part) == 32:
                    now.passes(part, y, epochs)
                    part, y, size = [], [], 0
        if now is not None:
            yield results()

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) of the whole text; null and empty texts score alike. A column score is replaced."""
    small_batches(docs)
    return scored_by(docs.sparkSession.sparkContext.broadcast(model), docs.select(*[c for c in docs.columns if c != "score"]))


def scored_by(held, kept: DataFrame) -> DataFrame:
    """``kept`` with the ``score`` of a model that is broadcast."""

    def run(batches):
        m = held.value
        known = Features(m.settings.buckets)
        for batch in sliced(batches):
            texts = (t.as_py() for t in batch.column("text"))
            got = m.score(texts, known)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got.astype(np.float64))], [*batch.schema.names, "score"])

    return kept.mapInArrow(run, kept.select("*", F.lit(0.0).alias("score")).schema)


def by_language(model: Model) -> Column:
    """Whether a scored row (score, lang) reaches its language's threshold; languages without one have 0.5."""
    out = F.lit(0.5)
    for g, t in model.thresholds.items():
        out = F.when(F.col("lang") == g, F.lit(t)).otherwise(out)
    return F.col("score") >= out
