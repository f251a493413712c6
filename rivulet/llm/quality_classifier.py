"""Document quality by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Weights (a power of two): words and pairs of words are hashed to them.
BUCKETS = 1 << 18

#: Labelled documents that are learned from at most: those of the least hash of their id.
SAMPLE = 8_000

#: Entries (bucket and count, 8 bytes) of the examples that the one learning task holds at most: examples are taken in
#: the order of the hash until the next would exceed it.
SAMPLE_ENTRIES = 24_000_000

#: Score from which a document counts as good.
THRESHOLD = 0.3

EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1

_BLOCK = 1 << 20


def features(text: str | None):
    """Buckets of the words and of the pairs of neighbours, repeats included. Words are parted by ASCII white space.

    All pairs of a word with itself share one bucket, so that stuttering is learned whatever the word.
    """
    import numpy as np
    from xxhash import xxh3_64_digest

    words = (text or "").encode().split()
    shift = np.uint64(65 - BUCKETS.bit_length())
    h = np.frombuffer(b"".join(map(xxh3_64_digest, words)), "<u8")
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
        pairs[h[:-1] == h[1:]] = 0
    return np.concatenate([h >> shift, pairs >> shift]).astype(np.int32)


class Ftrl:
    """FTRL-proximal with a learning rate for each weight. Bias is the last weight and isn't regularised."""

    def __init__(self):
        import numpy as np

        self.z, self.n = np.zeros(BUCKETS + 1, np.float32), np.zeros(BUCKETS + 1, np.float32)

    def weights(self, at):
        import numpy as np

        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        w[np.abs(z) <= L1] = 0
        return w

    def step(self, at, value, label: float) -> None:
        import numpy as np

        w = self.weights(at)
        w[-1] = -self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n, g = self.n[at], g.astype(np.float32)
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def final(self):
        import numpy as np

        w = self.weights(slice(None))
        w[-1] = -self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA)
        return w.astype(np.float32)


def counted(text: str | None):
    """Distinct buckets of a text, ascending, and their counts."""
    import numpy as np

    buckets, counts = np.unique(features(text), return_counts=True)
    return buckets.astype(np.int32), counts.astype(np.int32)


def fit(examples: list[tuple[float, object, object]]):
    """Weights, from (label, buckets, counts) in their order, EPOCHS times."""
    import numpy as np

    model = Ftrl()
    for _ in range(EPOCHS):
        for label, buckets, counts in examples:
            value = np.append(counts / np.sqrt(max(1, counts.sum())), 1.0).astype(np.float32)
            model.step(np.append(buckets, BUCKETS), value, label)
    return model.final()


def score(texts: list[str | None], weights) -> list[float]:
    import numpy as np

    out = []
    for text in texts:
        at = features(text)
        dot = weights[at].sum(dtype=np.float64) / np.sqrt(max(1, len(at))) + weights[-1]
        out.append(float(1 / (1 + np.exp(-np.clip(dot, -35, 35)))))
    return out


def _remainder(column: str):
    return F.crc32(F.col(f"`{column}`").cast("string").cast("binary")) % 5


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, entries: int = SAMPLE_ENTRIES):
    """Weights learned from the labelled rows of df whose crc32(id as text) mod 5 isn't 0.

    At most `sample` labelled ids are learned from, those of the least hash, and of these in that order as many as have
    `entries` distinct features together: bounds on the rows and the memory of the one task that learns. Of an id
    with several labels the least counts, of one with several texts the least; ids or labels that are null, or not 0
    or 1, don't. Texts are read whole, however long. Without examples all weights are 0 and all scores 0.5.
    """
    import numpy as np

    usable = labels.where(F.col(label_col).isin(0, 1)).where(_remainder(id_col) != 0)
    chosen = usable.groupBy(id_col).agg(F.min(label_col).cast("double").alias("__label"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(id_col).alias("__id"), "__label")
    texts = df.select(F.col(f"`{id_col}`").alias("__doc"), shared.text_of(text_col).alias("__t"))
    texts = texts.join(shared.sized(chosen), F.col("__doc") == F.col("__id")).groupBy("__id", "__label").agg(F.min("__t").alias("__t"))

    def make(found: list[str | None]) -> list[pa.Array]:
        vectors = [counted(t) for t in found]
        return [pa.array([v[i] for v in vectors], pa.list_(pa.int32())) for i in (0, 1)]

    fields = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("buckets", "counts")]
    vectors = shared.text_map(texts, "__t", ["__id", "__label"], fields, make)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, held, full = [], 0, False
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy()
            buckets, counts = (batch.column(i).values.to_numpy() for i in (2, 3))
            for y, a, b in zip(batch.column(1).to_pylist(), ends[:-1], ends[1:]):
                held += b - a
                full = full or held > entries and bool(examples)
                if not full:
                    examples.append((y, buckets[a:b].copy(), counts[a:b].copy()))
        yield pa.RecordBatch.from_arrays([pa.array([fit(examples).tobytes()], pa.binary())], names=["weights"])

    # The sample is bounded, so one task learns from it, in the order of the hash.
    ordered = vectors.repartition(1).sortWithinPartitions(F.xxhash64("__id"), "__id")
    rows = ordered.mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(bytes(rows[0][0]), np.float32) if rows else np.zeros(BUCKETS + 1, np.float32)


def classify(df: DataFrame, weights, keep: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Columns `keep`, score (0 to 1) and predicted (1 if score >= threshold) of each whole text; only texts are scored.

    A null text counts as empty; its score is the bias's. Rows stay, repeated or of null id; no shuffle.
    """
    sent: Broadcast = df.sparkSession.sparkContext.broadcast(weights.tobytes())  # 1 MB, whatever the input

    def make(texts: list[str | None]) -> list[pa.Array]:
        import numpy as np

        found = score(texts, np.frombuffer(sent.value, np.float32))
        return [pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())]

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return shared.text_map(df, text_col, keep, fields, make)


def held_out(id_col: str = "doc_id"):
    """True if crc32 of the id as text is 0 modulo 5; a null id isn't held out."""
    return F.coalesce(_remainder(id_col) == 0, F.lit(False))
