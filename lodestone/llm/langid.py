"""Language identification by a convolutional network over bytes.

Filters of several widths slide over a window of bytes, each keeps its largest value,
and a softmax over these gives the language.  As bytes are few, embedding and filters
fold into tables after training: what a filter answers to two neighbouring bytes is one
look-up.  Training is numpy, forward and backward; a text is all its windows of one
fixed length, scored in batches, and their log-probabilities are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

#: Bytes of a window; filter widths and filters of each; size of a byte's embedding.
WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 16, 8
#: Bounds of the training sample: labelled rows of each language, and windows taken of each row.
ROWS_EACH, WINDOWS_EACH = 400, 4
EPOCHS, BATCH, RATE = 6, 64, 0.004
#: Windows scored at a time.
AT_ONCE = 2048


def windows(arr: pa.Array, window: int = WINDOW) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, row, length) by block: the texts' bytes cut in windows, the last
    of each filled up with zeros."""
    data, off = tc.buffers(arr)
    for a, b in tc.blocks(off, AT_ONCE * window):
        size = np.diff(off[a : b + 1])
        many = -(-size // window)
        row = np.repeat(np.arange(b - a), many)
        start = np.repeat(off[a:b], many) + (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * window
        length = np.minimum(window, np.repeat(off[a + 1 : b + 1], many) - start)
        if not len(row):
            yield a, np.zeros((0, window), np.uint8), row, length
            continue
        for k in range(0, len(row), AT_ONCE):
            s, n = start[k : k + AT_ONCE], length[k : k + AT_ONCE]
            at = s[:, None] + np.arange(window)
            inside = np.arange(window) < n[:, None]
            yield a, np.where(inside, data[np.minimum(at, len(data) - 1)], 0), row[k : k + AT_ONCE], n


class Network:
    """Embedding, convolutions, max pooling, softmax."""

    def __init__(self, languages: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"e": r.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"f{w}"] = r.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["o"] = r.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.p["c"] = np.zeros(len(languages), np.float32)
        self.tables: dict | None = None

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
        """Adam on the cross entropy."""
        r, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for k, a in self.p.items():
            m[k], v[k] = np.zeros_like(a), np.zeros_like(a)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                some = order[lo : lo + BATCH]
                t += 1
                for k, g in self._gradients(x[some], y[some]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self.fold()
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n, rows = self.p, len(x), np.arange(len(x))
        e = p["e"][x]
        pooled, where = [], []
        for w in WIDTHS:
            long = x.shape[1] - w + 1
            a = sum(e[:, k : k + long].reshape(-1, EMBEDDING) @ p[f"f{w}"][k] for k in range(w)).reshape(n, long, FILTERS) + p[f"b{w}"]
            at = a.argmax(1)
            where.append(at)
            pooled.append(np.maximum(0, np.take_along_axis(a, at[:, None], 1)[:, 0]))
        h = np.concatenate(pooled, 1)
        z = h @ p["o"] + p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[rows, y] -= 1
        z /= n
        g = {"o": h.T @ z, "c": z.sum(0), "e": np.zeros_like(p["e"])}
        dh = (z @ p["o"].T) * (h > 0)
        for j, w in enumerate(WIDTHS):
            d = dh[:, j * FILTERS : (j + 1) * FILTERS]
            f = np.zeros_like(p[f"f{w}"])
            for k in range(w):
                b = x[rows[:, None], where[j] + k]  # the byte that each filter saw, n x FILTERS
                f[k] = np.einsum("nf,nfe->ef", d, p["e"][b])
                np.add.at(g["e"], b, d[:, :, None] * p[f"f{w}"][k].T[None])
            g[f"f{w}"], g[f"b{w}"] = f, d.sum(0)
        return g

    def fold(self) -> None:
        """Tables of what each byte, and each two, contribute to the filters."""
        one = {(w, k): self.p["e"] @ self.p[f"f{w}"][k] for w in WIDTHS for k in range(w)}
        self.tables = {w: [np.ascontiguousarray((one[w, k][:, None] + one[w, k + 1][None]).reshape(65536, FILTERS)) if k + 1 < w else one[w, k] for k in range(0, w, 2)] for w in WIDTHS}

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of windows."""
        pooled = []
        two = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        for lo in range(0, len(x), 128):
            some, pair = x[lo : lo + 128], two[lo : lo + 128]
            own = []
            for w in WIDTHS:
                long, a = x.shape[1] - w + 1, None
                for j, t in enumerate(self.tables[w]):
                    at = pair[:, 2 * j : 2 * j + long] if 2 * j + 1 < w else some[:, 2 * j : 2 * j + long]
                    part = t.take(at.reshape(-1), axis=0)
                    a = part if a is None else np.add(a, part, out=a)
                own.append(np.maximum(0, a.reshape(len(some), long, FILTERS).max(1) + self.p[f"b{w}"]))
            pooled.append(np.concatenate(own, 1))
        z = np.concatenate(pooled) @ self.p["o"] + self.p["c"] if pooled else np.zeros((0, len(self.languages)), np.float32)
        z -= z.max(1, keepdims=True) if len(z) else 0
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def cut(text: str, windows_each: int = WINDOWS_EACH) -> list[bytes]:
    """Up to so many windows of a text, spread over all of it."""
    raw = text.lower().encode()
    return [raw[at : at + WINDOW] for at in np.linspace(0, max(0, len(raw) - WINDOW), min(windows_each, max(1, len(raw) // WINDOW))).astype(int).tolist()]


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows_each: int = ROWS_EACH, windows_each: int = WINDOWS_EACH) -> list[tuple[list[bytes], str]]:
    """(windows, language) of about ``rows_each`` rows of each language, the same ones each
    time, and never more than twice as many: rows whose hash is below what the language's
    count asks for.  Windows are cut where the texts are."""
    named = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(doc_id, F.length(text)).alias("h"))
    # the languages there are: a handful, whatever the corpus
    counts = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, rows_each / n))])
    some = named.filter((F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))) < share[F.col("lang")])

    @F.arrow_udf("array<binary>")
    def pieces(texts: pa.Array) -> pa.Array:
        return pa.array([cut(x, windows_each) for x in texts.to_pylist()], pa.list_(pa.binary()))

    rows = some.select("h", "lang", pieces("text").alias("w")).orderBy("h", "lang", "w").limit(2 * rows_each * len(counts)).select("w", "lang")
    return [(r["w"], r["lang"]) for r in rows.toArrow().to_pylist()]


def train(labelled: list[tuple[str | list[bytes], str]], windows_each: int = WINDOWS_EACH, epochs: int = EPOCHS) -> Network | None:
    """A network of the languages of (text or its windows, language).  None for an empty sample."""
    languages = sorted({lang for _, lang in labelled})
    if not languages:
        return None
    r, xs, ys = np.random.default_rng(3), [], []
    for text, lang in labelled:
        for raw in cut(text, windows_each) if isinstance(text, str) else text:
            # short texts are met too: every third window is cut somewhere
            n = int(r.integers(24, WINDOW)) if r.random() < 1 / 3 else WINDOW
            x = np.zeros(WINDOW, np.uint8)
            part = np.frombuffer(raw[:n], np.uint8)
            x[: len(part)] = part
            xs.append(x)
            ys.append(languages.index(lang))
    return Network(languages).fit(np.stack(xs), np.array(ys), epochs)


def identify(docs: DataFrame, network: Network | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, language, confidence, n_windows) of every row.

    Windows count by their length; confidence is the probability after the average.  A
    null or empty text has no windows, and language and confidence are null, as they are
    for all rows if there was nothing to train on; a null doc_id passes through; repeated
    rows each give a row; an empty table gives an empty one; very long texts are taken
    whole; other columns are ignored.
    """
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.lower(F.col(text)).alias("text"))
    schema = "doc_id bigint, language string, confidence double, n_windows int"
    if network is None:
        return given.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence"), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / WINDOW).cast("int").alias("n_windows"))
    held = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        names = np.array(net.languages, object)
        for batch in batches:
            n = batch.num_rows
            total, weight, many = np.zeros((n, len(names))), np.zeros(n), np.zeros(n, np.int32)
            for a, x, row, length in windows(batch.column(1)):
                if len(x):
                    np.add.at(total, a + row, net.scores(x) * length[:, None])
                    np.add.at(weight, a + row, length)
                    np.add.at(many, a + row, 1)
            z = total / np.maximum(weight, 1)[:, None]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            none = many == 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[z.argmax(1)], pa.string(), mask=none), pa.array(np.round(z.max(1), 6), pa.float64(), mask=none), pa.array(many)], ["doc_id", "language", "confidence", "n_windows"])

    return given.mapInArrow(run, schema)
