"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of 1,000 bytes. Each passage is encoded by the shares of byte
classes, of pairs of classes and of word forms in it; a layer of tanh units follows. Gated attention
(a tanh and a sigmoid projection, multiplied) gives each passage its weight, and the weighted sum is
scored by a logistic unit. Only document labels are needed. All is learned here, with Adam.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh, save, ship, trim

PASSAGE = 1000
HIDDEN, ATTENTION, EPOCHS, BATCH = 24, 12, 30, 64
#: Labelled documents that the model is fitted on at most (those with the least hashes of their ids).
SAMPLE = 3000
#: Bytes of encoded passages that the driver holds at a time. With more than that, the bags are read again from
#: their table in every epoch; the steps of the fit are the same.
FIT_BYTES = 256 << 20


def _classes() -> np.ndarray:
    """A class for each byte value: each ASCII symbol and digit group its own, letters by case, UTF-8 bytes by place."""
    out = np.zeros(256, np.int64)
    names: dict[object, int] = {}
    for b in range(256):
        c = chr(b)
        if b >= 192:
            name = "lead"
        elif b >= 128:
            name = "trail"
        elif c.isdigit():
            name = "digit"
        elif c.isalpha():
            name = ("vowel" if c.lower() in "aeiou" else "consonant", c.isupper())
        elif c in "\t\x0b\x0c\r ":
            name = " "
        elif b < 32 and c != "\n":
            name = "control"
        else:
            name = c
        out[b] = names.setdefault(name, len(names))
    return out


CLASSES = _classes()
N = int(CLASSES.max()) + 1
COARSE = 8
#: Letters low and high, marks of sentences, symbols, digits, white space, line ends, UTF-8.
_COARSE = np.array([7 if b >= 128 else 6 if b == 10 else 5 if chr(b).isspace() else 4 if chr(b).isdigit() else 1 if chr(b).isupper() else 0 if chr(b).isalpha() else 2 if chr(b) in ".,;:'\"!?-()" else 3 for b in range(256)])
FORMS = 6
WIDTH = N + COARSE * COARSE + FORMS


def encode(text: bytes) -> np.ndarray:
    """Passages x features. An empty text is one passage without features."""
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    if not n:
        return np.zeros((1, WIDTH), np.float32)
    passages = -(-n // PASSAGE)
    at = np.arange(n) // PASSAGE
    size = np.bincount(at, minlength=passages).astype(np.float32)[:, None]
    one = np.bincount(at * N + CLASSES[data], minlength=passages * N).reshape(passages, N)
    coarse = _COARSE[data]
    two = np.bincount(at[1:] * COARSE * COARSE + coarse[:-1] * COARSE + coarse[1:], minlength=passages * COARSE * COARSE).reshape(passages, -1)
    start = np.flatnonzero((coarse != 5) & (coarse != 6) & np.concatenate([[True], (coarse[:-1] == 5) | (coarse[:-1] == 6)]))
    forms = np.zeros((passages, FORMS), np.float32)
    if len(start):
        length = np.diff(np.append(start, n)).astype(np.float32)
        of = at[start]
        words = np.maximum(np.bincount(of, minlength=passages), 1)
        # a hash of the first bytes tells how varied the words are
        pad = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
        lead = ((pad[start] * 31 + pad[start + 1]) * 31 + pad[start + 2]) % 509
        kinds = np.bincount(np.unique(of * 509 + lead) // 509, minlength=passages)
        forms[:, 0] = np.bincount(of, length, passages) / words / 10
        forms[:, 1] = np.sqrt(np.maximum(np.bincount(of, length**2, passages) / words / 100 - forms[:, 0] ** 2, 0))
        forms[:, 2] = kinds / words
        forms[:, 3] = words / size[:, 0]
    forms[:, 4] = np.log1p(n) / 12
    forms[:, 5] = size[:, 0] / PASSAGE
    return np.hstack([np.sqrt(one / size), np.sqrt(two / size), forms]).astype(np.float32)


class Model:
    """Weights and forward pass; bags are passages stacked, with the number of each."""

    NAMES = ("w", "b", "v", "u", "a", "o", "c")

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.w, self.b = r.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN)
        self.v, self.u = r.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), r.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION))
        self.a, self.o, self.c = r.normal(0, ATTENTION**-0.5, ATTENTION), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> tuple:
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ self.w + self.b)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        s = (t * g) @ self.a
        first = np.cumsum(sizes) - sizes
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), sizes))
        alpha = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(alpha[:, None] * h, first)
        p = 1 / (1 + np.exp(-np.clip(z @ self.o + self.c, -30, 30)))
        return x, h, t, g, alpha, z, p, first

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        x, h, t, g, alpha, z, p, first = self.forward(x, sizes)
        dl = weight * (p - y) / len(y)
        dz = np.repeat(dl[:, None] * self.o, sizes, axis=0)
        dalpha = (dz * h).sum(axis=1)
        ds = alpha * (dalpha - np.repeat(np.add.reduceat(alpha * dalpha, first), sizes))
        dt, dg = ds[:, None] * self.a * g * (1 - t**2), ds[:, None] * self.a * t * g * (1 - g)
        dh = (alpha[:, None] * dz + dt @ self.v.T + dg @ self.u.T) * (1 - h**2)
        return [x.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ dg, (t * g).T @ ds, z.T @ dl, np.array([dl.sum()])]

    def fit(self, sizes: np.ndarray, y: np.ndarray, read: Callable[[np.ndarray], list[np.ndarray]], seed: int = 9) -> Model:
        """Learn from bags of so many passages with labels y; read(numbers) gives some bags, which are held together."""
        n = len(y)
        if not n or y.min() == y.max():
            # nothing to tell apart: the share of the only label, held off the ends
            self.o[:], self.c[:] = 0, np.log((y.sum() + 1) / (n - y.sum() + 1)) if n else 0
            return self
        held: tuple[bytes, list[np.ndarray]] = b"", []

        def parts(order: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
            """The bags in that order, in mini-batches."""
            nonlocal held
            bytes_ = np.cumsum(sizes[order]) * WIDTH * 4
            ends = [k + BATCH for k in range(0, n, BATCH)]
            first = 0
            while first < n:
                # as many mini-batches as fit the memory, one at least
                base = bytes_[first - 1] if first else 0
                end = max([first + BATCH, *(e for e in ends if e > first and bytes_[min(e, n) - 1] - base <= FIT_BYTES)])
                pick = np.sort(order[first:end])
                if held[0] != pick.tobytes():
                    held = b"", []
                    held = pick.tobytes(), read(pick)
                of = {int(i): bag for i, bag in zip(pick, held[1], strict=True)}
                for k in range(first, min(end, n), BATCH):
                    yield order[k : k + BATCH], [of[int(i)] for i in order[k : k + BATCH]]
                first = end

        count, one, two = 0, np.zeros(WIDTH), np.zeros(WIDTH)
        for _, bags in parts(np.arange(n)):
            for x in bags:
                count, one, two = count + len(x), one + x.sum(axis=0, dtype=float), two + np.square(x, dtype=float).sum(axis=0)
        self.mean = (one / count).astype(np.float32)
        self.scale = (np.sqrt(np.maximum(two / count - (one / count) ** 2, 0)) + 0.02).astype(np.float32)
        weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
        rng, m, v, step = np.random.default_rng(seed), [0.0] * 7, [0.0] * 7, 0
        for epoch in range(EPOCHS):
            for pick, bags in parts(rng.permutation(n)):
                grads = self.gradients(np.concatenate(bags), sizes[pick], y[pick], weight[pick])
                step += 1
                rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
                for j, (name, grad) in enumerate(zip(self.NAMES, grads, strict=True)):
                    value = getattr(self, name)
                    grad = grad + 1e-4 * value
                    m[j], v[j] = 0.9 * m[j] + 0.1 * grad, 0.999 * v[j] + 0.001 * grad**2
                    value -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        return self.forward(np.concatenate(bags), np.array([len(b) for b in bags]))[6] if bags else np.zeros(0)


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents that are not held out, with all their passages; the sample is fixed by a hash of their ids.

    Of rows that share a doc_id the largest text counts (a null one is the smallest), of several
    labels the better one; rows with a null doc_id or label are not learned from.
    """
    spark = docs.sparkSession
    ship(spark)
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [encode((t.as_py() or "").encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(x) for x in bags], pa.int64()), pa.array([x.astype("<f4").tobytes() for x in bags], pa.binary())], names=["doc_id", "quality", "size", "bag"])

    # at most sample rows: a proven bound for the broadcast and for the driver's list of bags
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.max(F.col("quality").cast("int")).alias("quality"))
    table = save(texts.mapInArrow(run, "doc_id long, quality int, size long, bag binary"), "bags")
    rows = sorted(table.select("doc_id", "quality", "size").collect())
    ids = [r.doc_id for r in rows]

    def read(pick: np.ndarray) -> list[np.ndarray]:
        some = table.select("doc_id", "bag")
        if len(pick) < len(ids):
            some = some.where(F.col("doc_id").isin([ids[k] for k in pick]))
        return [np.frombuffer(r.bag, "<f4").reshape(-1, WIDTH) for r in sorted(some.collect(), key=lambda r: r.doc_id)]

    return Model().fit(np.array([r["size"] for r in rows], np.int64), np.array([float(r.quality == 1) for r in rows]), read)


def score_quality(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """docs with a column of scores (0 to 1), computed from the whole text alone.

    Null and empty texts are bags of one passage without features and get a score as well; repeated
    rows get equal scores; an empty table stays empty. Other columns are kept, whatever their names;
    a column with the name of the new one is replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    whole = fresh("text", docs.withColumn(into, F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, score = batch.column(batch.schema.get_field_index(whole)), []
            for k in range(0, len(texts), 200):
                score.append(shared.value.score([encode((t.as_py() or "").encode()) for t in texts[k : k + 200]]))
            at = batch.schema.get_field_index(into)
            yield batch.set_column(at, into, pa.array(np.concatenate([np.zeros(0), *score])))
        trim()

    wide = docs.withColumn(whole, F.col("text").cast("string")).withColumn(into, F.lit(0.0))
    return wide.mapInArrow(run, wide.schema).drop(whole)
