"""Embedding whitening: Welford's rank-one updates in partition iterators, merged by the parallel formula, symmetric QR.

Each partition of the distinct vectors streams through a state (count, mean, sum of outer products about the mean, exact
sums); states meet by the parallel update in rounds of a few dozen per task until few are left, and only those reach the
driver: their size is a matter of dimensions, not of rows. There a Householder reduction and QR steps with implicit
shifts give the eigenvectors. Every vector is then projected in one pass; the covariance of the projected fit list is
gathered the same way as the first and tells the identity error.

Scale: the vectors are exchanged once, for the distinct ones, with partial aggregation, so copies meet in their own
partitions first. All other passes are scans. Sums, deviations and counts are whole numbers and exact.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries are dropped, as are vectors without
entries; entries beyond the range of long saturate, as Spark's floor has it. Vectors of each length are a list of their
own, fitted and numbered by itself. Fewer dimensions than components give fewer components. A component without
variance (a constant or dependent dimension, a single vector) has whitened null, explained 0, and takes no part in the
identity error, which is null if all are such. A deviation beyond long is null there; deviation_exact has it. Equal
eigenvalues keep the order in which the solver finds them; repeated rows and null vec_ids give their rows; an empty
table gives none; further columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.llm.common import written

COMPONENTS, SCALE, FAN_IN = 4, 256, 32
_STATE = "d int, state binary"


class Welford:
    """Count, mean, sum of outer products about the mean, and exact sums of whole numbers if asked for."""

    def __init__(self, d: int):
        self.d, self.n, self.mean, self.outer, self.sums = d, 0, np.zeros(d), np.zeros((d, d)), np.zeros(d, object)

    def add(self, x: np.ndarray) -> None:
        """One more vector: a rank-one update."""
        self.n += 1
        before = x - self.mean
        self.mean += before / self.n
        self.outer += before[:, None] * (x - self.mean)

    def merge(self, other: Welford) -> None:
        """The parallel update by another state."""
        if not other.n:
            return
        n, apart = self.n + other.n, other.mean - self.mean
        self.mean = self.mean + apart * (other.n / n)
        self.outer = self.outer + other.outer + np.outer(apart, apart) * (self.n * other.n / n)
        self.n, self.sums = n, self.sums + other.sums

    def covariance(self) -> np.ndarray:
        return (self.outer + self.outer.T) / (2 * self.n)

    def to_bytes(self) -> bytes:
        sums = ",".join(map(str, self.sums)).encode()
        return np.int64(self.n).tobytes() + self.mean.tobytes() + self.outer.tobytes() + sums

    @classmethod
    def from_bytes(cls, d: int, raw: bytes) -> Welford:
        out, at = cls(d), 8 * (1 + d + d * d)
        out.n = int(np.frombuffer(raw, np.int64, 1)[0])
        out.mean, out.outer = np.frombuffer(raw, np.float64, d, 8).copy(), np.frombuffer(raw, np.float64, d * d, 8 + 8 * d).reshape(d, d).copy()
        out.sums = np.array([int(s) for s in raw[at:].split(b",")], object)
        return out


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix."""
    t, d = np.array(a, np.float64), len(a)
    q = np.eye(d)
    for k in range(d - 2):  # Householder reflections leave three diagonals
        v = t[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0:
            continue
        v[0] += norm if v[0] >= 0 else -norm
        v /= np.linalg.norm(v)
        t[k + 1 :] -= 2 * np.outer(v, v @ t[k + 1 :])
        t[:, k + 1 :] -= 2 * np.outer(t[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    main, side = np.diag(t).copy(), np.diag(t, 1).copy()
    rows, high = q.T.copy(), d - 1  # rows are the vectors: rotations touch whole rows
    small = np.finfo(float).eps
    while high > 0:
        off = np.abs(side[:high]) <= small * (np.abs(main[:high]) + np.abs(main[1 : high + 1]))
        side[:high][off] = 0
        if side[high - 1] == 0:
            high -= 1
            continue
        zero = np.flatnonzero(side[:high] == 0)
        low = int(zero[-1]) + 1 if len(zero) else 0
        # Wilkinson's shift: the eigenvalue of the last two rows that is nearest to the last entry
        half, last = (main[high - 1] - main[high]) / 2, side[high - 1]
        shift = main[high] - last * last / (half + np.copysign(np.hypot(half, last), half))
        x, z = main[low] - shift, side[low]
        for k in range(low, high):  # the bulge is chased down
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                side[k - 1] = r
            p, o, w = main[k], side[k], main[k + 1]
            main[k], main[k + 1] = c * c * p + 2 * c * s * o + s * s * w, s * s * p - 2 * c * s * o + c * c * w
            side[k] = (c * c - s * s) * o + c * s * (w - p)
            if k + 1 < high:
                x, z = side[k], s * side[k + 1]
                side[k + 1] *= c
            upper = c * rows[k] + s * rows[k + 1]
            rows[k + 1] = c * rows[k + 1] - s * rows[k]
            rows[k] = upper
    order = np.argsort(-main, kind="stable")
    return main[order], rows[order].T


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the lists of each length in a batch; nothing in them is null."""
    lists = batch.column(column)
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    size = np.diff(ends)
    for d in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == d)
        yield at, values[ends[at][:, None] + np.arange(d)]


def _exact(parts: np.ndarray, most: int) -> np.ndarray:
    """Whole numbers in int64 if sums of products up to `most` fit, else as Python's."""
    return parts if most < 1 << 62 else parts.astype(object)


def fitted(vectors: DataFrame, column: str) -> dict[int, Welford]:
    """The state of the vectors of each length; whole numbers in `column` are summed exactly."""

    def states(held: dict[int, Welford]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([w.to_bytes() for w in held.values()], pa.binary())], names=["d", "state"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Welford] = {}
        for batch in batches:
            for _, m in _groups(batch, 0):
                own = held.setdefault(m.shape[1], Welford(m.shape[1]))
                for x in m.astype(np.float64):
                    own.add(x)
                if m.dtype.kind == "i":
                    own.sums = own.sums + _exact(m, int(np.abs(m.astype(np.float64)).max()) * len(m)).sum(axis=0).astype(object)
        if held:
            yield states(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Welford] = {}
        for batch in batches:
            for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(d, Welford(d)).merge(Welford.from_bytes(d, raw))
        if held:
            yield states(held)

    rows = written(vectors.select(column).mapInArrow(stream, _STATE), "states")
    while (parts := rows.groupBy("d").count().agg(F.max("count")).first()[0] or 0) > FAN_IN:
        rows = written(rows.repartition(-(-parts // FAN_IN)).mapInArrow(meet, _STATE), "states")
    out: dict[int, Welford] = {}
    for r in rows.collect():  # at most FAN_IN states of each length
        out.setdefault(r.d, Welford(r.d)).merge(Welford.from_bytes(r.d, bytes(r.state)))
    return out


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that have entries, all of them finite."""
    value = lambda c: c.cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(value(c)) & (F.abs(value(c)) < float("inf"))
    sound = vectors.where((F.size("embedding") > 0) & F.forall("embedding", finite))
    return sound.select("vec_id", F.transform("embedding", lambda c: F.floor(value(c) * SCALE)).alias("x"))


class Projection:
    """What a list's fit says: eigenvectors of the first components over the roots of their eigenvalues."""

    def __init__(self, fit: Welford, components: int):
        values, vectors = symmetric_qr(fit.covariance())
        self.n, self.sums, self.components = fit.n, [int(s) for s in fit.sums], min(components, fit.d)
        live = values > fit.d * np.finfo(float).eps * max(values[0], 0) if values[0] > 0 else np.zeros(fit.d, bool)
        total = float(np.trace(fit.covariance()))
        self.live = live[: self.components]
        self.weights = vectors[:, : self.components] / np.sqrt(np.where(self.live, values[: self.components], 1))
        self.explained = [float(e / total) if ok else 0.0 for e, ok in zip(values[: self.components], self.live, strict=True)]
        # S / n to double precision, whatever the size of S
        self.mean = np.array([float(s // self.n) + (s % self.n) / self.n for s in self.sums])

    def whitened(self, m: np.ndarray) -> np.ndarray:
        return (m - self.mean) @ self.weights

    def deviations(self, m: np.ndarray) -> list[int]:
        sums = np.array(self.sums, object)
        reach = 2 * max(self.n * int(np.abs(m.astype(np.float64)).max() + 1), *(abs(s) for s in self.sums), 1)
        if len(self.sums) * reach * reach < 1 << 62:
            own = m * self.n - sums.astype(np.int64)
        else:
            own = m.astype(object) * self.n - sums
        return (own * own).sum(axis=1).tolist()


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining vector and component: see the module."""
    rows = whole_numbers(vectors.select("vec_id", "embedding"))
    fit_list = written(rows.select("x").distinct(), "fit-list")
    models = {d: Projection(w, components) for d, w in fitted(fit_list, "x").items()}

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, m in _groups(batch, 0):
                model = models[m.shape[1]]
                # the length stays with the list: components of one list must not meet another's
                y = np.concatenate([model.whitened(m)[:, model.live], np.full((len(m), 1), float(m.shape[1]))], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(y[:, -1].astype(np.int32)), pa.array(list(y[:, :-1]), pa.list_(pa.float64()))], names=["d", "y"])

    errors: dict[int, float | None] = {}
    for d, model in models.items():
        own = fit_list.mapInArrow(projected, "d int, y array<double>").where(F.col("d") == d)
        got = fitted(own.where(F.size("y") > 0), "y") if model.live.any() else {}
        errors[d] = max((float(np.abs(w.covariance() - np.eye(w.d)).max()) for w in got.values()), default=None)

    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in _groups(batch, 1):
                model = models[m.shape[1]]
                k, y, far = model.components, model.whitened(m), model.deviations(m)
                each = np.repeat(np.arange(len(m)), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at)).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1), len(m)), pa.int32()),
                    pa.array([model.n] * len(each), pa.int64()),
                    pa.array([v if v < 1 << 63 else None for v in far], pa.int64()).take(pa.array(each)),
                    pa.array(y.reshape(-1), pa.float64(), mask=~np.tile(model.live, len(m))),
                    pa.array(model.explained * len(m), pa.float64()),
                    pa.array([errors[m.shape[1]]] * len(each), pa.float64()),
                    pa.array([Decimal(v) if v < 10**38 else None for v in far], pa.decimal128(38, 0)).take(pa.array(each)),
                ], names=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(scan, schema)


def digest(vectors: DataFrame) -> DataFrame:
    return whiten(vectors)
