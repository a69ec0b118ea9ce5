"""Tokens of texts with their features and tags, in one scan: an Arrow batch is cut by arithmetic on its bytes, so no token is a Python object, and
no token is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Catalog
from .detect import _matches, _parts


class _Cut:
    """The tokens of an Arrow array of texts: row, first and last byte, and the bytes themselves."""

    def __init__(self, texts, blanks: bytes):
        import numpy as np
        import pyarrow as pa

        size = np.array([0 if x is None else len(x) for x in texts.cast(pa.binary()).to_pylist()], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(size)])
        self.data = np.frombuffer(b"".join(x for x in texts.cast(pa.binary()).to_pylist() if x is not None), np.uint8)
        table = np.ones(256, bool)
        table[list(blanks)] = False
        inside = table[self.data]
        first = np.zeros(len(self.data) + 1, bool)
        first[self.bounds] = True
        opens = inside & (np.concatenate([[True], ~inside[:-1]])[: len(inside)] | first[:-1])
        closes = inside & (np.concatenate([~inside[1:], [True]])[: len(inside)] | first[1:])
        self.start, self.stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.row = np.searchsorted(self.bounds, self.start, side="right") - 1
        self.inside = inside
        chars = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        self.base = chars[self.bounds[:-1]]
        self.s, self.e = chars[self.start] - self.base[self.row], chars[self.stop] - self.base[self.row]

    def strings(self, keep=None, data=None):
        """The tokens as an Arrow array; with ``keep`` only those of their bytes, from ``data`` if given."""
        import numpy as np
        import pyarrow as pa

        keep = self.inside if keep is None else self.inside & keep
        at = np.concatenate([[0], np.cumsum(keep)])
        ends = np.concatenate([[0], at[self.stop]]).astype(np.int32) if len(self.stop) else np.zeros(1, np.int32)
        return pa.StringArray.from_buffers(len(self.start), pa.py_buffer(ends.tobytes()), pa.py_buffer((self.data if data is None else data)[keep].tobytes()))

    def count(self, mask):
        """How many bytes of each token ``mask`` holds for."""
        import numpy as np

        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[self.stop] - sums[self.start]


def token_features(df: DataFrame) -> DataFrame:
    """``functions.text.token_features`` of (doc_id, text): tokens between blanks, tabs and line ends, with shape features and neighbours."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in _parts(batch, batch.column(1)):
                cut = _Cut(part.column(1), b" \t\n")
                if not len(cut.start):
                    continue
                x = cut.data
                upper, lower, digit = (x >= 65) & (x <= 90), (x >= 97) & (x <= 122), (x >= 48) & (x <= 57)
                kind = upper + 2 * lower + 3 * digit.astype(np.uint8)
                repeated = np.zeros(len(x), bool)
                repeated[1:] = (kind[1:] > 0) & (kind[1:] == kind[:-1])
                repeated[cut.start] = False
                shape = np.where(upper, 88, np.where(lower, 120, np.where(digit, 100, x))).astype(np.uint8)
                chars, n_upper = cut.e - cut.s, cut.count(upper)
                vowel = np.zeros(256, bool)
                vowel[list(b"AEIOUaeiou")] = True
                token = cut.strings()
                index = np.arange(len(cut.start))
                same = np.zeros(len(index) + 1, bool)  # is a token of the same text as the one before?
                same[1:-1] = cut.row[1:] == cut.row[:-1]
                opening = np.searchsorted(cut.row, cut.row)
                near = lambda i, ok: pa.compute.fill_null(token.take(pa.array(i, pa.int64(), mask=~ok)), "")
                before, after = near(np.maximum(index - 1, 0), same[:-1]), near(np.minimum(index + 1, len(index) - 1), same[1:])
                numbers = [pa.array(v.astype(np.int64)) for v in (chars, n_upper, cut.count(digit), cut.count(vowel[x]))]
                title = (chars >= 2) & upper[cut.start] & (cut.count(lower) == chars - 1)
                flags = [pa.array(v) for v in (title, (chars >= 2) & (n_upper == chars), cut.count(x == 64) > 0)]
                yield pa.record_batch(
                    [part.column(0).take(pa.array(cut.row)), pa.array((index - opening).astype(np.int64)), token, *numbers, cut.strings(~repeated, shape), *flags, before, after],
                    names=["doc_id", "pos", "token", "n_chars", "n_upper", "n_digit", "n_vowel", "shape", "is_title", "is_caps", "has_at", "before", "after"],
                )

    schema = "pos long, token string, n_chars long, n_upper long, n_digit long, n_vowel long, shape string, is_title boolean, is_caps boolean, has_at boolean, before string, after string"
    base = df.select("doc_id", "text").where("text IS NOT NULL")
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, {schema}")


def tagged(df: DataFrame, families: tuple[str, ...] | None = None, catalog: Catalog | None = None) -> DataFrame:
    """Tokens between white space of (doc_id, text) as doc_id, s, e, token, tag, by what the patterns find: the tags of ``feedback.bio_tags``."""
    catalog = catalog or Catalog()
    chosen = tuple(f for f in catalog.families if families is None or f.name in families)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in _parts(batch, batch.column(1)):
                texts = part.column(1)
                cut = _Cut(texts, b" \t\r\n")
                if not len(cut.start):
                    continue
                tags: dict[int, str] = {}
                spans = sorted({(row, s, -e, kind) for row, _, kind, _, _, s, e in _matches(texts, chosen, texts.to_pylist())})
                for row, s, e, kind in spans:
                    at, to = np.searchsorted(cut.row, [row, row + 1])
                    low = at + int(np.searchsorted(cut.e[at:to], s, side="right"))
                    high = at + int(np.searchsorted(cut.s[at:to], -e, side="left"))
                    for i in range(low, high):
                        tags.setdefault(i, ("B-" if s >= cut.s[i] else "I-") + kind)
                tag = np.zeros(len(cut.start), np.int32)
                names = ["O", *sorted(set(tags.values()))]
                code = {name: i for i, name in enumerate(names)}
                for i, name in tags.items():
                    tag[i] = code[name]
                yield pa.record_batch(
                    [part.column(0).take(pa.array(cut.row)), pa.array(cut.s.astype(np.int64)), pa.array(cut.e.astype(np.int64)), cut.strings(), pa.array(names).take(pa.array(tag))], names=["doc_id", "s", "e", "token", "tag"]
                )

    base = df.select("doc_id", "text").where(F.col("text").isNotNull())
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, s long, e long, token string, tag string")
