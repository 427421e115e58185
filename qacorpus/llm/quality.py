"""Quality classifier: a regularised quadratic discriminant over document statistics (operator 9)."""

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices, stored, utf8

#: Kinds of bytes whose shares are features, with the share that a very short text is drawn towards: fixed values.
KINDS = {
    "lower": (b"abcdefghijklmnopqrstuvwxyz", 0.75),
    "upper": (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.02),
    "digit": (b"0123456789", 0.005),
    "space": (b" \t\n\r\x0b\x0c", 0.16),
    "stop": (b".,;:?'\"-()", 0.03),
    "mark": (b"!", 0.001),
    "symbol": (b"#$%&*+/<=>@[\\]^_`{|}~", 0.002),
    "control": (bytes([*range(9), *range(14, 32), 127]), 0.001),
    "beyond": (bytes(range(128, 256)), 0.03),
}
_kind = np.zeros(256, np.int64)
for _k, (_bytes, _) in enumerate(KINDS.values()):
    _kind[list(_bytes)] = _k
_usual = np.array([p for _, p in KINDS.values()])
#: Bytes and words of usual text that each document is thought to have besides its own.
PRIOR_BYTES, PRIOR_WORDS = 40.0, 8.0


def statistics(text: bytes) -> np.ndarray:
    """Transformed statistics of a text: logarithms of sizes and ratios and log odds of shares."""
    n = len(text)
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (np.bincount(_kind, by_byte, len(KINDS)) + PRIOR_BYTES * _usual) / (n + PRIOR_BYTES)
    words = text.split()
    m = len(words)
    count = Counter(words)
    top = max(count.values(), default=0)
    lines = text.split(b"\n")
    filled = [x for x in lines if x.strip()]
    packed = len(zlib.compress(text, 1)) if n else 0
    stops = int(by_byte[46] + by_byte[33] + by_byte[63])
    p = by_byte[by_byte > 0] / max(n, 1)
    share = np.array(
        [
            (top + 0.08 * PRIOR_WORDS) / (m + PRIOR_WORDS),
            (len(filled) - len(set(filled)) + 0.05) / (len(filled) + 1.0),
            (sum(c for c in count.values() if c == 1) + 0.6 * PRIOR_WORDS) / (m + PRIOR_WORDS),
            (stops + 0.08 * PRIOR_WORDS) / (m + stops + PRIOR_WORDS),
        ]
    )
    odds = np.concatenate([np.delete(shares, 3), share])
    return np.concatenate(
        [
            np.log(np.clip(odds, 1e-6, 1 - 1e-6) / (1 - np.clip(odds, 1e-6, 1 - 1e-6))),
            [
                np.log1p(n),
                np.log((n + 6 * PRIOR_WORDS) / (m + PRIOR_WORDS)),
                np.log((len(count) + PRIOR_WORDS) / (m + PRIOR_WORDS)) + 0.15 * np.log1p(m),
                np.log((packed + PRIOR_BYTES) / (n + PRIOR_BYTES)),
                float(-(p * np.log(p)).sum()) * n / (n + PRIOR_BYTES) + 2.9 * PRIOR_BYTES / (n + PRIOR_BYTES),
            ],
        ]
    )


SIZE = len(statistics(b""))


@dataclass
class Discriminant:
    """Class means, and inverses and log determinants of Cholesky factors. classes holds 0 and 1, or fewer if training
    rows had fewer."""

    classes: list[int]
    prior: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    volume: np.ndarray

    @classmethod
    def fit(cls, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.1, ridge: float = 0.1) -> "Discriminant":
        """moments: of each class, how many rows, their sum and the sum of their outer products.

        A class covariance is drawn towards the covariance of all rows about their class means by `pooled`, and its
        variances are raised by `ridge` of their mean.
        """
        classes = sorted(k for k, m in moments.items() if m[0] > 0)
        means = [moments[k][1] / moments[k][0] for k in classes]
        scatter = [moments[k][2] - moments[k][0] * np.outer(m, m) for k, m in zip(classes, means)]
        total = sum(moments[k][0] for k in classes)
        whiten, volume = [], []
        for k, s in zip(classes, scatter):
            covariance = (1 - pooled) * s / max(moments[k][0], 1.0) + pooled * sum(scatter) / max(total, 1.0)
            covariance += (ridge * np.trace(covariance) / len(covariance) + 1e-9) * np.eye(len(covariance))
            factor = np.linalg.cholesky(covariance)
            whiten.append(np.linalg.inv(factor))
            volume.append(np.log(np.diag(factor)).sum())
        return cls(classes, np.array([moments[k][0] / total for k in classes]), np.array(means), np.array(whiten), np.array(volume))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row; 0.5 where nothing was learned."""
        if len(self.classes) < 2:
            return np.full(len(x), float(self.classes[0]) if self.classes else 0.5)
        density = []
        for mean, whiten, volume, prior in zip(self.mean, self.whiten, self.volume, self.prior):
            z = whiten @ (x - mean).T
            density.append(np.log(prior) - volume - 0.5 * (z * z).sum(0))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text; null counts as empty."""

    def of(batches):
        for batch in slices(batches):
            x = np.concatenate([statistics(t) for t in utf8(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(np.arange(0, len(x) + 1, SIZE, dtype=np.int32), pa.array(x))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, x array<double>")


def fit(measured_docs: DataFrame, labels: DataFrame, label: str = "quality", pooled: float = 0.1, ridge: float = 0.1) -> Discriminant:
    """Learns from all rows of labels with label 0 or 1 whose documents aren't held out.

    Tasks sum the moments of their rows; what comes together is one number per class and entry of the moments.
    """

    def of(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column("x").values.to_numpy().reshape(-1, SIZE) if batch.num_rows else np.zeros((0, SIZE))
            y = batch.column("y").to_numpy()
            for k in (0, 1):
                part = x[y == k]
                flat = np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
                sums[k] = sums.get(k, 0) + flat
        for k, flat in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))], names=["y", "flat"])

    known = labels.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    rows = measured_docs.filter(~held_out(3, 1)).join(known, "doc_id").select("x", "y").mapInArrow(of, "y int, flat array<double>")
    summed = rows.select("y", F.posexplode("flat").alias("k", "v")).groupBy("y", "k").agg(F.sum("v").alias("v"))
    moments = {}
    for r in summed.collect():  # at most twice 1 + d + d * d numbers
        moments.setdefault(r.y, np.zeros(1 + SIZE + SIZE * SIZE))[r.k] = r.v
    return Discriminant.fit({k: (m[0], m[1 : 1 + SIZE], m[1 + SIZE :].reshape(SIZE, SIZE)) for k, m in moments.items()}, pooled, ridge)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null texts count as empty and are scored too; repeated ids get a row each; rows of labels with a null id or label
    teach nothing, repeated ones count as often as they occur. Without labels of both kinds every score is the only
    label seen, or 0.5. Other columns of either table aren't read.
    """
    rows = stored(measured(docs), "quality")
    model = fit(rows, labels, label)

    def of(batches):
        for batch in batches:
            if batch.num_rows:
                s = model.score(batch.column("x").values.to_numpy().reshape(-1, SIZE))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", held_out(3, 1).alias("held_out"), "x").mapInArrow(of, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame, label: str = "quality", least: float = 0.5) -> DataFrame:
    """The documents with a score of at least `least`, as they are; learned and scored as in score()."""
    model = fit(stored(measured(docs), "quality"), labels, label)

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = slices([pa.RecordBatch.from_arrays([texts], names=["text"])])
            yield pa.array(model.score(np.array([statistics(t) for x in parts for t in utf8(x.column("text"))]).reshape(-1, SIZE)))

    return docs.filter(of(F.col("text")) >= least)
