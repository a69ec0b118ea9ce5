"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts and test items are sequences of words (lower case; letters, digits and characters beyond ASCII). The corpus is counted first: in how
many texts does each n-gram of an item occur? Of any ``window`` n-grams in a row, an item's rarest becomes a seed, so every run of
``n + window - 1`` (four) unchanged words holds one, however common the passage is. A text that holds a seed is aligned with the item around it,
word by word, and the score is the share of a perfect alignment.

Items are held in blocks of bounded size, each scanned against all texts; no text is shuffled. Null and empty texts and items match
nothing. An item shorter than n words is one seed of its own. Repeated rows are reported each;
of alignments with equal scores the one that begins last in the text counts. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, text_of, tidy
from .words import Lookup, in_chunks, mix, small_batches, word_hashes

MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 8 << 20


def grams(h, n: int):
    """Hashes of the runs of n words that begin at each word; the last n - 1 do not exist."""
    import numpy as np

    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0x100000001B3) + h[k : len(h) - n + 1 + k]
        return mix(out + np.uint64(n))


def smith_waterman(item, text) -> tuple[float, int, int]:
    """The best local alignment as a share of a perfect one, and where it begins and ends in ``text`` (end exclusive)."""
    import numpy as np

    width = len(text)
    j = np.arange(width + 1)
    above, above_from = np.zeros(width + 1), j.copy()
    best, span = 0.0, (0, 0)
    for w in item:
        step = np.where(text == w, MATCH, MISMATCH)
        value, origin = np.zeros(width + 1), j.copy()
        diagonal, up = above[:-1] + step, above[1:] + GAP
        value[1:] = np.maximum(np.maximum(diagonal, up), 0)
        origin[1:] = np.where(value[1:] == 0, j[1:], np.where(diagonal >= up, above_from[:-1], above_from[1:]))
        # Along the row: the best of all earlier cells, less a gap for each word between.
        raised = value - GAP * j
        top = np.maximum.accumulate(raised)
        where = np.maximum.accumulate(np.where(raised == top, j, 0))
        above, above_from = top + GAP * j, origin[where]
        end = int(np.argmax(above))
        if above[end] > best:
            best, span = float(above[end]), (int(above_from[end]), end)
    return best / (MATCH * max(1, len(item))), *span


class Items:
    """Test items of one block: their words and n-grams."""

    def __init__(self, rows: list[tuple], n: int):
        import numpy as np

        self.n, self.ids, self.words = n, [], []
        for item_id, text in rows:
            h, _ = word_hashes([(text or "").lower().encode("utf-8", "replace")])
            if len(h):
                self.ids.append(item_id)
                self.words.append(h)
        self.lengths = sorted({min(n, len(w)) for w in self.words})
        self.grams = [grams(w, min(n, len(w))) for w in self.words]
        self.all = np.unique(np.concatenate(self.grams)) if self.grams else np.empty(0, np.uint64)

    def seeds(self, df: dict[int, int], window: int) -> dict:
        """n-gram hash: [(item number, place in the item)]. Of neighbours the rarest that some text holds; one that none holds finds nothing."""
        out: dict[int, list[tuple[int, int]]] = {}
        for i, gs in enumerate(self.grams):
            chosen = set()
            for a in range(max(1, len(gs) - window + 1)):
                held = [k for k in range(a, min(a + window, len(gs))) if df.get(int(gs[k]), 0)]
                if held:
                    chosen.add(min(held, key=lambda k: (df[int(gs[k])], k)))
            for k in sorted(chosen):
                out.setdefault(int(gs[k]), []).append((i, k))
        return out


def _counts(docs: DataFrame, items: Items) -> dict[int, int]:
    """In how many texts each n-gram of the items occurs; as many numbers as the block has n-grams."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        look = Lookup(items.all)
        total = np.zeros(len(look.keys), np.int64)
        for batch in small_batches(batches):
            raw = [t.lower().encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            for i, j in in_chunks(raw):
                h, bounds = word_hashes(raw[i:j])
                for n in items.lengths:
                    at, key = look.find(grams(h, n))
                    doc = np.searchsorted(bounds, at, side="right") - 1
                    inside = at + n <= bounds[doc + 1]
                    pairs = np.unique(np.stack([doc[inside], key[inside]]), axis=1)
                    np.add.at(total, pairs[1], 1)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(look.keys[some].view(np.int64)), pa.array(total[some])], names=["gram", "n"])

    with arrow_rows(docs.sparkSession):
        rows = docs.select("text").mapInArrow(tidy(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r["gram"] & (2**64 - 1): r["n"] for r in rows}


def _aligned(docs: DataFrame, items: Items, seeds: dict, least: float, schema: T.StructType) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        look = Lookup(np.array(list(seeds), np.uint64))
        places = [seeds[int(k)] for k in look.keys]
        for batch in small_batches(batches):
            ids, out = batch.column("id").to_pylist(), []
            raw = [t.lower().encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            for i, j in in_chunks(raw):
                h, bounds = word_hashes(raw[i:j])
                found: dict[tuple[int, int], list[int]] = {}
                for n in items.lengths:
                    at, key = look.find(grams(h, n))
                    doc = np.searchsorted(bounds, at, side="right") - 1
                    for a, k, d in zip(at.tolist(), key.tolist(), doc.tolist(), strict=True):
                        if a + n <= bounds[d + 1]:
                            for item, place in places[k]:
                                if min(items.n, len(items.words[item])) == n:
                                    found.setdefault((d, item), []).append(a - int(bounds[d]) - place)
                for (d, item), begins in sorted(found.items()):
                    text, want = h[bounds[d] : bounds[d + 1]], items.words[item]
                    best = _best(want, text, sorted(set(begins)))
                    if best[0] >= least:
                        out.append((ids[i + d], items.ids[item], *best))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (batch.schema.field("id").type, kind, pa.float64(), pa.int32(), pa.int32()), strict=True)], names=["id", "item_id", "score", "start_word", "end_word"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema["item_id"].dataType)
    return docs.mapInArrow(tidy(run), schema)


def _best(item, text, begins: list[int]) -> tuple[float, int, int]:
    """The best alignment around the places where the item would begin; windows that overlap are aligned as one."""
    size = len(item)
    for b in begins:
        if 0 <= b <= len(text) - size and (text[b : b + size] == item).all():
            return 1.0, b, b + size
    slack = size // 2 + 4
    best = (0.0, 0, 0)
    i = 0
    while i < len(begins):
        low, high = begins[i] - slack, begins[i] + size + slack
        i += 1
        while i < len(begins) and begins[i] - slack <= high:
            high = begins[i] + size + slack
            i += 1
        low, high = max(0, low), min(len(text), high)
        score, a, b = smith_waterman(item, text[low:high])
        best = max(best, (score, low + a, low + b))
    return best


def contaminated(df: DataFrame, benchmark: DataFrame, n: int = 3, window: int = 2, least: float = 0.6, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per text and test item that it holds: id, item_id, score (``least`` to 1), start_word, end_word."""
    docs = df.select(df[id_col].alias("id"), text_of(df, text_col).alias("text"))
    items = benchmark.select(benchmark[item_col].alias("item_id"), text_of(benchmark, item_text).alias("text"))
    schema = T.StructType([docs.schema["id"], items.schema["item_id"], T.StructField("score", T.DoubleType()), T.StructField("start_word", T.IntegerType()), T.StructField("end_word", T.IntegerType())])
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // block_bytes)
    out = df.sparkSession.createDataFrame([], schema)
    for k in range(blocks):
        # About block_bytes of items, whatever the benchmark's size.
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        block = Items([tuple(r) for r in rows], n)
        if block.ids:
            found = _aligned(docs, block, block.seeds(_counts(docs, block), window), least, schema)
            out = found if blocks == 1 else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` without those that hold a test item, all columns kept; rows of a flagged id go together."""
    from .common import free_name, key_bitmap, materialise, with_hit

    key, hit = free_name(df, "_key"), free_name(df, "_hit")
    bad = materialise(contaminated(df, benchmark, id_col=id_col, **options).select(F.col(id_col).alias(key)).distinct(), "leaks")
    marked = with_hit(df.withColumn(key, df[id_col]), key, key_bitmap(bad, key), hit)
    alone, some = marked.where(~F.col(hit)).drop(key, hit), marked.where(F.col(hit)).drop(hit)
    other = free_name(some, "_bad")
    return alone.unionByName(some.join(bad.withColumnRenamed(key, other), F.col(key).eqNullSafe(F.col(other)), "left_anti").drop(key))
