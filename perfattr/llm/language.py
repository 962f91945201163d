"""Language of texts by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes forwards and backwards; the two states at a byte give the
probabilities of its language. A document's probabilities are the mean over all its bytes. It is
trained here by backpropagation through time, on windows of a bounded sample of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfattr.llm.common import bounded_sample, held_out, ship, slices, text_bytes

#: Bytes that the network reads from a fresh state; a long text is many windows.
WINDOW = 128
STATE = 8
#: Documents that it is trained on, at most, and windows of each.
MOST_LABELLED = 4000
WINDOWS_EACH = 6
STEPS = 300
BATCH = 128
UNKNOWN = "und"
_AT_ONCE = 2048

_DOUBLE = np.float32(0.5)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= _DOUBLE
    np.tanh(x, out=x)
    x *= _DOUBLE
    x += _DOUBLE
    return x


@dataclass
class Direction:
    """Gates z, r and candidate n: h = (1 - z) n + z h', n = tanh(in_n + r (U_n h' + b_n))."""

    inputs: np.ndarray  # 257 x 3H, the row of a byte or of padding; biases included
    state: np.ndarray  # H x 3H
    bias: np.ndarray  # H, of the candidate's state part

    def run(self, bytes_: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (T x H x B) for bytes (T x B); with keep also what backward needs."""
        steps, batch = bytes_.shape
        size = self.state.shape[0]
        inputs, state = np.ascontiguousarray(self.inputs.T), np.ascontiguousarray(self.state.T)
        bias = self.bias[:, None]
        out = np.empty((steps, size, batch), np.float32)
        before = np.zeros((size, batch), np.float32)
        kept = []
        for t in range(steps):
            x = inputs.take(bytes_[t], axis=1)
            u = state @ before
            gates = x[: 2 * size]
            gates += u[: 2 * size]
            gates = _sigmoid(gates)
            z, r = gates[:size], gates[size:]
            un = u[2 * size :] + bias
            n = r * un
            n += x[2 * size :]
            np.tanh(n, out=n)
            after = out[t]
            np.subtract(before, n, out=after)
            after *= z
            after += n
            if keep:
                kept.append((before, z, r, n, un))
            before = after
        return out, kept

    def backward(self, bytes_: np.ndarray, kept: list, slope: np.ndarray) -> "Direction":
        """Gradients, given the loss's slope at each state."""
        size = self.state.shape[0]
        state, bias = np.zeros_like(self.state), np.zeros_like(self.bias)
        down = np.zeros_like(slope[0])
        rows = np.empty((len(bytes_), 3 * size, bytes_.shape[1]), np.float32)
        for t in range(len(bytes_) - 1, -1, -1):
            before, z, r, n, un = kept[t]
            down = down + slope[t]
            dn = down * (1 - z) * (1 - n * n)
            dz = down * (before - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r])
            rows[t] = np.concatenate([dz, dr, dn])
            state += before @ du.T
            bias += (dn * r).sum(axis=1)
            down = down * z + self.state @ du
        flat = bytes_.ravel()
        inputs = [np.bincount(flat, weights=rows[:, k].ravel(), minlength=257) for k in range(3 * size)]
        return Direction(np.array(inputs, np.float32).T, state, bias)

    def arrays(self) -> list[np.ndarray]:
        return [self.inputs, self.state, self.bias]


@dataclass
class Network:
    """Both directions and the layer that gives every byte its class probabilities."""

    forward: Direction
    back: Direction
    out: np.ndarray  # 2H x C
    bias: np.ndarray  # C

    @classmethod
    def random(cls, classes: int, size: int = STATE, seed: int = 0) -> "Network":
        random = np.random.default_rng(seed)

        def normal(*shape, by):
            return random.normal(0, by, shape).astype(np.float32)

        def direction() -> Direction:
            return Direction(
                normal(257, 3 * size, by=0.3), normal(size, 3 * size, by=size**-0.5), np.zeros(size, np.float32)
            )

        return cls(direction(), direction(), normal(2 * size, classes, by=0.3), np.zeros(classes, np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [*self.forward.arrays(), *self.back.arrays(), self.out, self.bias]

    def probabilities(self, bytes_: np.ndarray) -> np.ndarray:
        """Of each byte (T x B) the class probabilities (T x C x B)."""
        return self._label(self.forward.run(bytes_)[0], self.back.run(bytes_[::-1])[0][::-1])

    def _label(self, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
        size = self.out.shape[0] // 2
        x = self.out[:size].T @ ahead
        x += self.out[size:].T @ behind
        x += self.bias[:, None]
        return _softmax(x)

    def gradients(self, bytes_: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the bytes that are not padding, and its gradients."""
        ahead, kept_a = self.forward.run(bytes_, keep=True)
        behind, kept_b = self.back.run(bytes_[::-1], keep=True)
        behind = behind[::-1]
        chance = self._label(ahead, behind)
        counted = (bytes_ < 256).astype(np.float32)
        counted /= max(1.0, float(counted.sum()))
        batch = np.arange(len(label))
        loss = float(-(np.log(np.maximum(chance[:, label, batch], 1e-12)) * counted).sum())
        slope = chance
        slope[:, label, batch] -= 1
        slope *= counted[:, None]
        size = self.out.shape[0] // 2
        out = np.concatenate([np.einsum("thb,tcb->hc", x, slope, optimize=True) for x in (ahead, behind)])
        a = self.forward.backward(bytes_, kept_a, self.out[:size] @ slope)
        b = self.back.backward(bytes_[::-1], kept_b, (self.out[size:] @ slope)[::-1])
        return loss, [*a.arrays(), *b.arrays(), out, slope.sum(axis=(0, 2))]


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of all rows in windows (n x size, padded with 256), and the row of each window."""
    sizes = np.diff(offsets)
    counts = -(-sizes // size)
    row = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (offsets[row] + place * size)[:, None] + np.arange(size)
    inside = at < offsets[row + 1][:, None]
    out = np.full(at.shape, 256, np.int16)
    out[inside] = data[at[inside]]
    return out, row


def fit(some: np.ndarray, label: np.ndarray, classes: int, *, steps: int = STEPS, seed: int = 0) -> Network:
    """Adam on random batches of windows."""
    random = np.random.default_rng(seed)
    network = Network.random(classes, seed=seed)
    if classes < 2 or not len(some):
        return network
    parameters = network.arrays()
    means, squares = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, steps + 1):
        pick = random.integers(0, len(some), BATCH)
        _, gradients = network.gradients(some[pick].T, label[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradients))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        rate = 0.02 * (1 - step / (steps + 1))
        for p, g, m, s in zip(parameters, gradients, means, squares):
            g = g * scale
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
    return network


def pooled(network: Network, data: np.ndarray, offsets: np.ndarray, classes: int) -> np.ndarray:
    """Mean class probabilities over the bytes of each row; equal ones for empty rows."""
    n = len(offsets) - 1
    total = np.zeros((n, classes))
    some, row = windows(data, offsets)
    for at in range(0, len(some), _AT_ONCE):
        part = np.ascontiguousarray(some[at : at + _AT_ONCE].T)
        chance = network.probabilities(part)
        chance *= (part < 256)[:, None]
        np.add.at(total, row[at : at + _AT_ONCE], chance.sum(axis=0).T)
    sizes = np.diff(offsets)[:, None]
    return np.where(sizes > 0, total / np.maximum(sizes, 1), 1 / max(1, classes))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few windows of each document, spread evenly over it."""
    for batch in slices(batches, "text", 1 << 20):
        some, row = windows(*text_bytes(batch.column("text")))
        counts = np.bincount(row, minlength=batch.num_rows)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        of = counts[row]
        take = np.where(of <= WINDOWS_EACH, True, (place * WINDOWS_EACH) // of != ((place - 1) * WINDOWS_EACH) // of)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x.tobytes() for x in some[take]], pa.binary()),
                batch.column("lang").take(pa.array(row[take])),
            ],
            ["bytes", "lang"],
        )


def train(documents: DataFrame, *, most_labelled: int = MOST_LABELLED, steps: int = STEPS) -> tuple[list[str], Network]:
    """Languages and network, from documents (doc_id, text, lang) that are not held out.

    At most `most_labelled` documents and six windows of 128 bytes of each reach the driver.
    """
    known = documents.where(
        F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    )
    sample = bounded_sample(known, "doc_id", most_labelled).select("text", "lang")
    rows = sample.mapInArrow(_sampled, "bytes binary, lang string").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r["bytes"])))  # the same for any order of tasks
    languages = sorted({r.lang for r in rows})
    place = {name: k for k, name in enumerate(languages)}
    some = np.frombuffer(b"".join(bytes(r["bytes"]) for r in rows), np.int16).reshape(-1, WINDOW)
    return languages, fit(some, np.array([place[r.lang] for r in rows], np.int64), len(languages), steps=steps)


def _labeller(model):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, network = model.value
        for batch in slices(batches, "text", 1 << 20):
            if languages:
                chance = pooled(network, *text_bytes(batch.column("text")), len(languages))
            else:
                chance = np.zeros((batch.num_rows, 1))
            best = chance.argmax(axis=1)
            letters = batch.column("letters").to_pylist()
            known = [bool(x) and bool(languages) for x in letters]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([languages[k] if x else UNKNOWN for k, x in zip(best.tolist(), known)], pa.string()),
                    pa.array([float(c[k]) if x else 0.0 for c, k, x in zip(chance, best, known)], pa.float64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return label


def languages(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    **options,
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the pooled probability).

    Learns from documents whose crc32(id) mod 5 is not 0; null languages teach nothing. Null
    text and text without a letter, or a table without any language, give `und` with score 0.
    Ties go to the first language in order of name. Repeated rows get a row each; extra columns are not read.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).alias("text"),
        F.col(lang_column).alias("lang"),
    )
    model = spark.sparkContext.broadcast(train(rows, **options))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), letters.alias("letters"), "text"
    ).mapInArrow(_labeller(model), "doc_id long, held_out boolean, lang_pred string, score double")
