"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

``features``   statistics of a whole text (lengths, shares of character classes, repetition of words and lines).
               Nothing but the text enters.
``fit``        standardises the statistics, maps them to ``RFF`` random cosines that approximate a Gaussian kernel,
               sums the normal equations per partition and adds the sums in Spark (their size does not depend on
               the data), and solves the ridge system on the driver.  Four fifths of the labelled rows fit the
               ridge scores, the rest calibrate them: the calibration rows are counted in ``BINS`` score bins
               and pooled by adjacent violators.
``score``      calibrated score in 0..1; the raw score breaks ties within a pooled block.

Null or empty text: the statistics of an empty text, scored like any other.  Labels with a null quality or id are
not learned from; repeated label rows count repeatedly.  With no label, or labels of one class only, the score
is 0.5 or that class.  Null ids and repeated documents stay rows; an empty table gives an empty result.
"""
from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stargraph.llm.common import by_value, remainder

FEATURES = 16
RFF = 128
RIDGE = 1e-3
WIDTH = 3.0  # of the Gaussian kernel, in standard deviations of the statistics
BINS = 400
SEED = 20_24
THRESHOLD = 0.3

_CLASS = np.zeros(256, dtype=np.int64)  # 0 control, 1 blank, 2 digit, 3 upper, 4 lower, 5 mark, 6 symbol, 7 beyond ASCII
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 2, 3, 4, 7
_CLASS[[33, *range(34, 48), 58, 59, 60, 61, 62, 63, 64, *range(91, 97), *range(123, 127)]] = 6
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5


def text_statistics(text: bytes | None) -> list[float]:
    """The statistics of one UTF-8 text."""
    text = text or b""
    words, lines = text.split(), text.split(b"\n")
    n, size = len(words), max(1, len(text))
    octets = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    shares = np.bincount(_CLASS, weights=octets, minlength=8) / size
    distinct = len(set(words))
    again = sum(map(operator.eq, words, words[1:]))
    apart = sum(map(operator.eq, words, words[2:]))
    letters = max(1e-9, shares[3] + shares[4])
    return [
        np.log1p(n),
        np.log1p(len(text)) - np.log1p(n),
        shares[1],
        shares[2],
        shares[3] / letters if shares[3] + shares[4] else 0.0,
        shares[5],
        min(1.0, 4 * shares[6]),
        shares[7],
        octets[33] / size,
        octets[124] / size,
        octets[46] / max(1, n),
        distinct / max(1, n),
        np.log1p(n) - np.log1p(distinct),
        again / max(1, n),
        apart / max(1, n),
        1 - len(set(lines)) / len(lines),
    ]


def features(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [text_statistics(t.as_py()) for t in texts.cast(pa.binary())]
        flat = np.array(rows, dtype=np.float64).reshape(-1)
        return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, FEATURES, dtype=np.int32), flat)

    return run(text)


def _matrix(column: pa.Array) -> np.ndarray:
    """n x FEATURES from a column of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.freq = draw.normal(0.0, 1.0 / WIDTH, (FEATURES, RFF))
        self.phase = draw.uniform(0.0, 2 * np.pi, RFF)
        self.weights = np.zeros(RFF + 1)
        self.knots_x, self.knots_y = np.array([0.0]), np.array([0.5])

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6.0, 6.0)
        z = np.sqrt(2.0 / RFF) * np.cos(x @ self.freq + self.phase)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        calibrated = np.interp(raw, self.knots_x, self.knots_y)
        return np.clip(0.98 * calibrated + 0.02 * np.clip((raw + 1) / 3, 0, 1), 0.0, 1.0)


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over ``stats, quality`` rows: sums per partition, added up in Spark."""
    width = RFF + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((width, width)), False
        for batch in batches:
            if batch.num_rows:
                z = model.cosines(_matrix(batch.column("stats")))
                zy = np.hstack([z, batch.column("quality").to_numpy()[:, None].astype(float)])
                total, some = total + zy.T @ zy, True
        if some:
            flat = pa.ListArray.from_arrays(np.arange(0, width * width + 1, width, dtype=np.int32), total.ravel())
            yield pa.record_batch([pa.array(np.arange(width), pa.int32()), flat], names=["i", "values"])

    sums = (
        rows.select("stats", "quality")
        .mapInArrow(run, "i int, values array<double>")
        .select("i", F.posexplode("values").alias("j", "v"))
        .groupBy("i", "j")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    total = np.zeros((width, width))
    for i, j, v in sums:
        total[i, j] = v
    return total[:-1, :-1], total[:-1, -1]


def pool_adjacent(x: list[float], y: list[float], n: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of weighted points in ascending x: knots (block mean x, pooled y)."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n):
        blocks.append([xi * ni, yi * ni, ni])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(rows: DataFrame) -> Model:
    """``stats, quality (0/1), calibrate (boolean)`` rows to a model."""
    moments = (
        rows.select(F.posexplode("stats").alias("j", "v"))
        .groupBy("j")
        .agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("dev"))
        .collect()
    )
    mean, scale = np.zeros(FEATURES), np.ones(FEATURES)
    for j, m, d in moments:
        mean[j], scale[j] = m, d if d and d > 1e-9 else 1.0
    model = Model(mean, scale)
    seen = {(r.calibrate, r.quality): r.n for r in rows.groupBy("calibrate", "quality").agg(F.count("*").alias("n")).collect()}
    classes = {quality for _, quality in seen}
    if len(classes) < 2:
        model.knots_y = np.array([float(*classes) if classes else 0.5])
        return model
    both = lambda part: all(seen.get((part, q)) for q in (0, 1))
    learn = rows.filter(~F.col("calibrate")) if both(False) and both(True) else rows
    judge = rows.filter(F.col("calibrate")) if both(False) and both(True) else rows
    zz, zy = _normal_equations(learn, model)
    n = zz[-1, -1]  # the constant's square sum is the number of rows
    model.weights = np.linalg.solve(zz / n + RIDGE * np.eye(len(zz)), zy / n)

    @F.arrow_udf("double")
    def raw(stats: pa.Array) -> pa.Array:
        return pa.array(model.raw(_matrix(stats)))

    binned = (
        judge.select("quality", raw("stats").alias("raw"))
        .groupBy(F.floor(F.greatest(F.least(F.col("raw"), F.lit(2.0)), F.lit(-1.0)) * (BINS / 3)).alias("bin"))
        .agg(F.avg("raw").alias("x"), F.avg(F.col("quality").cast("double")).alias("y"), F.count("*").alias("n"))
        .orderBy("bin")
        .collect()
    )
    model.knots_x, model.knots_y = pool_adjacent([r.x for r in binned], [r.y for r in binned], [r.n for r in binned])
    return model


def labelled(stats: DataFrame, labels: DataFrame, held_out: int = 0, modulus: int = 5) -> DataFrame:
    """The rows to learn from: labelled, and not held out; one of the other remainders calibrates."""
    part = remainder(F.col("doc_id"), modulus)
    known = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    return stats.filter(part != held_out).join(known, "doc_id").select(
        "stats", "quality", (part == (held_out + modulus - 1) % modulus).alias("calibrate")
    )


def score(stats: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(rows)))

    return run(stats)


by_value(__name__)
