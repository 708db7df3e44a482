"""Quality classifier: a factorisation machine.

Inputs are the hashed words of the whole text (log counts, scaled to length
one), structure statistics and the text's own metadata (lengths), cut into bins.
With x the inputs, w their weights and V their vectors of a low rank,

    score = sigmoid(w0 + w.x + 1/2 sum_f ((sum_i V_if x_i)**2 - sum_i V_if**2 x_i**2))

so all pairs count in time linear in the inputs. The model is fitted by AdaGrad
on the driver, on a sample of labelled rows that is bounded both in rows and in
inputs, and is a few MB whatever the corpus; scoring is a map over the documents
without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.llm.common import stored, utf8_slices
from loomwell.llm.quality_rules import counts_of

#: Hash slots of words, bins of each statistic, rank, labelled rows that are learned from at most, and all their inputs (8 bytes each) at most.
SLOTS, BINS, RANK, SAMPLE, BUDGET = 1 << 16, 16, 8, 6_000, 8_000_000

#: From this score on a document is predicted to be good.
THRESHOLD = 0.7

#: Statistics, each a ratio or a logarithm, with the range that BINS cover.
STATISTICS = {
    "log_words": (0.0, 10.0), "log_chars": (0.0, 12.0), "word_length": (0.0, 16.0), "symbols": (0.0, 0.5), "repeats": (0.0, 1.0), "dup_lines": (0.0, 1.0),
    "capitals": (0.0, 1.0), "marks": (0.0, 1.0), "letters": (0.0, 1.5), "variety": (0.0, 8.0), "line_words": (0.0, 8.0),
}

SIZE = SLOTS + BINS * len(STATISTICS)


def statistics(texts: list[bytes]) -> np.ndarray:
    """The bins that the texts' statistics fall into: (texts, statistics)."""
    c = {k: v.astype(float) for k, v in counts_of(texts).items()}
    n_bytes = np.fromiter(map(len, texts), float, len(texts))
    words, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    values = {
        "log_words": np.log1p(c["n_words"]), "log_chars": np.log1p(n_bytes), "word_length": c["word_chars"] / words, "symbols": c["n_symbols"] / words, "repeats": c["n_repeat_words"] / words, "dup_lines": c["n_dup_lines"] / lines,
        "capitals": c["n_upper"] / np.maximum(c["n_letters"], 1), "marks": c["n_marks"] / words, "letters": c["n_letters"] / np.maximum(c["word_chars"], 1), "variety": c["n_distinct"] / words**0.7, "line_words": np.log1p(c["n_words"] / lines),
    }
    return np.stack([np.clip((values[k] - lo) / (hi - lo) * BINS, 0, BINS - 1).astype(np.int64) for k, (lo, hi) in STATISTICS.items()], axis=1)


def inputs(texts: list[bytes], slot: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse inputs of some texts: (offsets of the texts, slots, values).
    ``slot`` remembers words' slots and is kept small here."""
    if len(slot) > 300_000:
        slot.clear()
    words = [t.split() for t in texts]
    for w in set().union(*words) - slot.keys() if words else ():
        slot[w] = zlib.crc32(w.lower()) % SLOTS
    n = np.fromiter(map(len, words), np.int64, len(words))
    which = np.fromiter((slot[w] for ws in words for w in ws), np.int64, int(n.sum()))
    key, count = np.unique(np.repeat(np.arange(len(texts)), n) * SLOTS + which, return_counts=True)
    doc, at = np.divmod(key, SLOTS)
    x = np.log1p(count)
    x /= np.sqrt(np.bincount(doc, x * x, len(texts)))[doc]
    stats = statistics(texts) + SLOTS + BINS * np.arange(len(STATISTICS)) if texts else np.zeros((0, len(STATISTICS)), np.int64)
    doc = np.concatenate([doc, np.repeat(np.arange(len(texts)), len(STATISTICS))])
    at, x = np.concatenate([at, stats.ravel()]), np.concatenate([x, np.full(stats.size, 0.5)])
    order = np.argsort(doc, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]), at[order], x[order]


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    @classmethod
    def new(cls, rank: int = RANK, seed: int = 42) -> Machine:
        return cls(0.0, np.zeros(SIZE, np.float32), np.random.default_rng(seed).normal(0, 0.05, (SIZE, rank)).astype(np.float32))

    def _sums(self, ends: np.ndarray, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.factor[at] * x[:, None].astype(np.float32)
        s = np.add.reduceat(vx, ends[:-1], axis=0)
        linear = np.add.reduceat(self.weight[at] * x, ends[:-1])
        return s, self.bias + linear + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), ends[:-1]))

    def score(self, ends: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """0 to 1. Every text has inputs, its statistics at least."""
        if len(ends) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self._sums(ends, at, x)[1].astype(float), -40, 40)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 12, rate: float = 0.1, l2: float = 1e-5, batch: int = 64, seed: int = 42) -> Machine:
        """AdaGrad on the logistic loss, both classes weighing the same."""
        rng = np.random.default_rng(seed)
        n1 = max(1, int(y.sum()))
        weight = np.where(y > 0, len(y) / (2 * n1), len(y) / (2 * max(1, len(y) - n1)))
        g0, gw, gv = 1e-6, np.full(SIZE, 1e-6, np.float32), np.full(self.factor.shape, 1e-6, np.float32)
        for _ in range(rounds):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                pick = order[k : k + batch]
                ends = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in pick])])
                at, x = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
                s, z = self._sums(ends, at, x)
                e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[pick]) * weight[pick] / len(pick)
                per = np.repeat(np.arange(len(pick)), np.diff(ends))
                ex = (e[per] * x).astype(np.float32)
                used, back = np.unique(at, return_inverse=True)
                dw = np.bincount(back, ex, len(used)) + l2 * self.weight[used]
                of_pair = ex[:, None] * (s[per] - self.factor[at] * x[:, None].astype(np.float32))
                dv = np.stack([np.bincount(back, of_pair[:, f], len(used)) for f in range(of_pair.shape[1])], axis=1).astype(np.float32) + l2 * self.factor[used]
                g0 += float(e.sum()) ** 2
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.bias -= rate * float(e.sum()) / np.sqrt(g0)
                self.weight[used] -= rate * dw / np.sqrt(gw[used])
                self.factor[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
        return self


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality", budget: int = BUDGET) -> Machine:
    """Learn from at most ``sample`` labelled ids that aren't held out, those
    with the least hashes, one text for each (that of least hash, if rows repeat
    an id), in that order as long as all their inputs stay within ``budget``.
    Null labels and ids don't count, and ids with several labels count once.
    Without a row the machine scores by its bias alone."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``sample`` rows are broadcast
    # copies of an id are dropped before the shuffle, so it carries ``sample`` texts of a task at most
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("t")).select("doc_id", F.col("t")["text"].alias("text"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot: dict[bytes, int] = {}
        for batch in batches:
            for a, b, data, ends in utf8_slices(batch.column(1), 1 << 20):
                raw, e = data.tobytes(), ends.tolist()
                n, at, x = inputs([raw[p:q] for p, q in zip(e, e[1:], strict=False)], slot)
                lists = [pa.ListArray.from_arrays(pa.array(n.astype(np.int32)), pa.array(v)) for v in (at.astype(np.int32), x.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b].cast(pa.int32()), *lists], names=["doc_id", "y", "at", "x"])

    found = stored(rows.select(F.col("doc_id").cast("long"), "text", F.col("y").cast("int")).mapInArrow(run, "doc_id long, y int, at array<int>, x array<float>"), "labelled")
    sizes = found.select("doc_id", F.size("at").alias("n"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").toArrow()  # at most ``sample`` rows
    fits = np.cumsum(sizes["n"].to_numpy()) <= budget
    if not fits.all():
        found = found.filter(F.col("doc_id").isin(sizes["doc_id"].to_numpy()[fits].tolist()))
    found = found.toArrow().sort_by([("doc_id", "ascending")])
    data = [(np.asarray(a, np.int64), np.asarray(x)) for a, x in zip(found["at"].to_numpy(), found["x"].to_numpy(), strict=True)]
    machine = Machine.new()
    return machine.fit(data, found["y"].to_numpy().astype(float)) if data else machine


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``, in one map.

    Null and empty texts are scored by their statistics; only the text enters a
    score; other columns are not read; an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(machine)  # a few MB, fixed by SLOTS and RANK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot: dict[bytes, int] = {}
        for batch in batches:
            for a, b, data, ends in utf8_slices(batch.column(1), 1 << 20):
                raw, e = data.tobytes(), ends.tolist()
                p = held.value.score(*inputs([raw[i:j] for i, j in zip(e, e[1:], strict=False)], slot))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(p)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType
    scored = docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
