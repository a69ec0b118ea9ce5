"""Quality scores by a factorisation machine.

A row's features are its distinct words, hashed into buckets, and structure statistics of the whole text (shares of letters, capitals,
digits, marks and bars, repeated words and lines, lengths), each cut into bins. Pairs of features interact through low-rank vectors, and
the sum over all pairs is taken in linear time as half of (square of the sum - sum of the squares) in each of the ``rank`` dimensions.

Null and empty texts have statistics of zero and no words; they get a score like any other row. Extra columns are not read: language,
source and id are never inputs. Without labelled rows of both kinds every score is 0.5.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, text_of, tidy
from .training import labelled_sample

BUCKETS = 1 << 14
#: Upper edges of the bins of each statistic.
EDGES = {
    "letters": (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95),
    "capitals": (0.005, 0.02, 0.05, 0.1, 0.3, 0.6),
    "digits": (0.002, 0.02, 0.1, 0.3),
    "marks": (0.005, 0.02, 0.03, 0.05, 0.08, 0.15, 0.25),
    "bars": (0.001, 0.02, 0.1, 0.3),
    "same as before": (0.005, 0.02, 0.1, 0.3, 0.6),
    "distinct": (0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 0.95),
    "distinct lines": (0.2, 0.4, 0.6, 0.8, 0.95),
    "word length": (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0),
    "words": (0.5, 5.0, 20.0, 60.0, 200.0, 1000.0, 5000.0),
}
_FIRST = {}
_next = BUCKETS
for _name, _edges in EDGES.items():
    _FIRST[_name] = _next
    _next += len(_edges) + 1
SIZE = _next


class Features:
    """Feature numbers and values of one text."""

    def __init__(self, most: int = 50_000):
        self.bucket: dict[str, int] = {}
        self.most = most

    def of(self, text: str):
        import bisect
        from operator import eq

        import numpy as np

        words = text.split()
        lower = set(text.lower().split())
        if len(self.bucket) > self.most:
            self.bucket.clear()
        known = self.bucket
        for w in [w for w in lower if w not in known]:
            known[w] = zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS
        buckets = np.unique(np.fromiter(map(known.__getitem__, lower), np.int64, len(lower)))
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        upper, digit, chars = raw[65:91].sum(), raw[48:58].sum(), max(1, int(raw[:128].sum() + raw[192:].sum()))
        letter = upper + raw[97:123].sum() + raw[192:].sum()
        blank = raw[9:14].sum() + raw[32]
        n, lines = max(1, len(words)), [x for x in text.split("\n") if x.strip()]
        stats = {
            "letters": letter / max(1, chars - blank),
            "capitals": upper / chars,
            "digits": digit / chars,
            "marks": (raw[33:127].sum() - upper - digit - raw[97:123].sum()) / chars,
            "bars": raw[124] / n,
            "same as before": sum(map(eq, words, words[1:])) / n,
            "distinct": len(lower) / n,
            "distinct lines": len(set(lines)) / max(1, len(lines)),
            "word length": (chars - blank) / n,
            "words": len(words),
        }
        bins = [_FIRST[k] + bisect.bisect_left(EDGES[k], v) for k, v in stats.items()]
        index = np.concatenate([buckets, np.array(bins, np.int64)])
        value = np.ones(len(index))
        value[: len(buckets)] = 1 / math.sqrt(max(1, len(buckets)))
        return index, value


class FactorisationMachine:
    """score = w0 + sum(w x) + 1/2 sum over dimensions of ((sum v x)^2 - sum (v x)^2)."""

    def __init__(self, rank: int = 8, seed: int = 3):
        import numpy as np

        self.w0, self.w = 0.0, np.zeros(SIZE)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (SIZE, rank))

    def logit(self, index, value) -> float:
        vx = self.v[index] * value[:, None]
        s = vx.sum(0)
        return self.w0 + float(self.w[index] @ value) + 0.5 * float((s * s).sum() - (vx * vx).sum())

    def fit(self, rows: list, y, epochs: int = 6, rate: float = 0.1, l2: float = 1e-4, seed: int = 11) -> None:
        """AdaGrad over single rows."""
        import numpy as np

        rng = np.random.default_rng(seed)
        g0, gw, gv = 1e-6, np.full(SIZE, 1e-6), np.full(self.v.shape, 1e-6)
        share = float(np.mean(y))
        weight = np.where(np.asarray(y) > 0, 0.5 / share, 0.5 / (1 - share))
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                index, value = rows[i]
                vx = self.v[index] * value[:, None]
                s = vx.sum(0)
                z = self.w0 + self.w[index] @ value + 0.5 * ((s * s).sum() - (vx * vx).sum())
                d = weight[i] * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y[i])
                dw = d * value + l2 * self.w[index]
                dv = d * value[:, None] * (s - vx) + l2 * self.v[index]
                g0 += d * d
                gw[index] += dw * dw
                gv[index] += dv * dv
                self.w0 -= rate * d / math.sqrt(g0)
                self.w[index] -= rate * dw / np.sqrt(gw[index])
                self.v[index] -= rate * dv / np.sqrt(gv[index])


def fit(df: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, most_rows: int = 8_000, id_col: str = "doc_id", text_col: str = "text") -> FactorisationMachine | None:
    """A machine fitted on at most ``most_rows`` labelled rows; executors send their feature numbers, not their texts."""
    import numpy as np

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        f = Features()
        for batch in batches:
            index = [f.of(t)[0].tolist() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("id").cast(pa.string()), pa.array(index, pa.list_(pa.int32())), batch.column("y")], names=["id", "x", "y"])

    sample = labelled_sample(df, labels, "quality", folds, held_out, most_rows, id_col, text_col)
    with arrow_rows(df.sparkSession):
        table = sample.mapInArrow(tidy(read), "id string, x array<int>, y int").toArrow().sort_by("id")
    y = table.column("y").to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return None
    rows = []
    for x in table.column("x").to_pylist():
        index = np.array(x, np.int64)
        words = int((index < BUCKETS).sum())
        value = np.ones(len(index))
        value[:words] = 1 / math.sqrt(max(1, words))
        rows.append((index, value))
    machine = FactorisationMachine()
    machine.fit(rows, y)
    return machine


def score_quality(df: DataFrame, machine: FactorisationMachine | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the column ``out``, the probability that a row is good text."""

    def score(batches):
        import pandas as pd

        f = Features()
        for texts in batches:
            z = [machine.logit(*f.of(t)) if machine else 0.0 for t in texts]
            yield pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in z], dtype=float)

    return df.withColumn(out, F.pandas_udf(score, "double", F.PandasUDFType.SCALAR_ITER)(text_of(df, text_col)))
