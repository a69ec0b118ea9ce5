"""Katz back-off language model: bigrams over unigrams, counted and evaluated in blocks of texts.

Texts are cut into blocks of bounded size. A block knows the distinct words and pairs of words that it holds, and asks for what the whole
corpus knows of them: requests are dealt by ranges of hashed keys, so no word, however common, is more than one entry per block. The
counting side adds up the training counts of all blocks, keeps them as tables partitioned by key range, and answers each block.

Counts up to five are discounted by Good-Turing; the mass that this frees goes to words unseen after a history, by their unigram
probability, with back-off weights that make each distribution sum to one. Unigrams give theirs to the one class of unknown words. A pair
that several blocks hold is summed into its history's weight by one of them, its owner.

The history of a text's first token is the end token. Null and empty texts are the end token alone. Repeated rows count and score like
others. Extra columns are not read. An empty table gives an empty result; a model without training text knows only the unknown class.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, discard, fold_of, fresh_path, materialise, release, text_of, tidy
from .words import NOT_BLANK, in_chunks, mix, small_batches, word_hashes

END = 0x5851F42D4C957F2D
BLOCK_BYTES = 8 << 20
#: Keys that one counting task holds.
PART_KEYS = 500_000
#: Blocks that a Python worker gets at once.
FEW = 2
LARGEST = 5  # counts beyond this are not discounted


def squeeze(a, delta: bool = False) -> bytes:
    """An array as compressed bytes, byte planes apart; sorted keys as their differences."""
    import numpy as np
    import pyarrow as pa

    if delta:
        a = np.diff(a, prepend=a.dtype.type(0))
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    head = len(a).to_bytes(7, "little") + bytes([a.itemsize])
    return head + pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(a) else head


def narrow(a):
    """Whole numbers in 32 bits where all of them fit, else in 64."""
    import numpy as np

    fits = not len(a) or -(2**31) < a.min() <= a.max() < 2**31
    return a.astype(np.int32 if fits else np.int64)


def expand(raw: bytes, kind, delta: bool = False):
    """The array back; whole numbers come in the width that they were stored in."""
    import numpy as np
    import pyarrow as pa

    n, kind = int.from_bytes(raw[:7], "little"), np.dtype(f"{np.dtype(kind).kind}{raw[7]}")
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(raw[8:], n * kind.itemsize, "zstd", asbytes=True), np.uint8)
    a = np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n)
    return np.cumsum(a, dtype=kind) if delta else a


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, ids, held, lengths, vocab, tokens): tokens are places in the block's sorted vocabulary, every text ends with the end token."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list = []
        sizes: list = []
        hashes: list = []
        size = 0

        def full():
            nonlocal made, size
            every = np.concatenate(hashes)
            vocab, tokens = np.unique(every, return_inverse=True)
            row = [[(task << 24) + made], [list(ids)], [list(held)], [squeeze(np.concatenate(sizes).astype(np.uint32))], [squeeze(vocab, True)], [squeeze(tokens.astype(np.uint32))]]
            made, size = made + 1, 0
            for x in (ids, held, sizes, hashes):
                x.clear()
            del every, vocab, tokens
            release()
            types = [pa.int64(), pa.list_(kind), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(row, types, strict=True)], names=["block", "ids", "held", "lengths", "vocab", "tokens"])

        for batch in small_batches(batches):
            kind = batch.schema.field("id").type
            who, out = batch.column("id").to_pylist(), batch.column("held").to_pylist()
            raw = batch.column("raw").to_pylist()
            for i, j in in_chunks(raw):
                h, bounds = word_hashes(raw[i:j], NOT_BLANK)
                hashes.append(np.insert(h, bounds[1:], np.uint64(END)))
                sizes.append(np.diff(bounds) + 1)
                ids += who[i:j]
                held += out[i:j]
                size += sum(map(len, raw[i:j])) + 64 * (j - i)
                if size >= block_bytes:
                    yield full()
        if ids:
            yield full()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), f"block long, ids array<{kind}>, held array<boolean>, lengths binary, vocab binary, tokens binary")


class Block:
    """One block's tokens and pairs, as arrays."""

    def __init__(self, row: dict):
        import numpy as np

        self.id, self.ids = row["block"], row["ids"]
        self.held = np.array(row["held"], bool)
        self.lengths = expand(row["lengths"], np.uint32).astype(np.int64)
        self.vocab = expand(row["vocab"], np.uint64, True)
        self.tokens = expand(row["tokens"], np.uint32)
        self.first = np.cumsum(self.lengths) - self.lengths
        end = np.searchsorted(self.vocab, np.uint64(END)).astype(np.uint32)
        self.history = np.concatenate([self.tokens[:1], self.tokens[:-1]])
        self.history[self.first] = end

    def trained(self):
        import numpy as np

        return np.repeat(~self.held, self.lengths)

    def pair_keys(self):
        import numpy as np

        a, b = self.vocab[self.history], self.vocab[self.tokens]
        with np.errstate(over="ignore"):
            return mix(a * np.uint64(0x9E3779B97F4A7C15) ^ mix(b + np.uint64(0x632BE59BD9B4E019)))


def _cuts(keys, parts: int):
    """Where each of ``parts`` equal ranges of 64-bit keys begins in the sorted ``keys``."""
    import numpy as np

    at = np.array([min((i << 64) // parts, (1 << 64) - 1) for i in range(1, parts)], np.uint64)
    return [0, *np.searchsorted(keys, at).tolist(), len(keys)]


def _ranges(keys, parts: int):
    """(part, slice) of the parts in which the sorted ``keys`` has any: as many as there are keys at most, however many parts there are."""
    cut = _cuts(keys, parts)
    return [(p, slice(cut[p], cut[p + 1])) for p in range(parts) if cut[p] < cut[p + 1]]


def _messages(rows: list[tuple], types: tuple, names: list[str], most: int = 20_000) -> Iterator:
    """All messages of a block in few batches."""
    import pyarrow as pa

    for i in range(0, len(rows), most):
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows[i : i + most], strict=True), types, strict=True)], names=names)


def _rows_of(batches: Iterator) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
            release()


def _requests(table: DataFrame, parts: tuple[int, int]) -> DataFrame:
    """(what, part, block, keys, counts): each block's words (1) and pairs (2) with their training counts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for row in _rows_of(batches):
            b = Block(row)
            trained = b.trained()
            words = np.bincount(b.tokens[trained], minlength=len(b.vocab))
            keys = b.pair_keys()
            order = np.argsort(keys)
            keys = keys[order]
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            pairs = np.add.reduceat(trained[order].astype(np.int64), begin)
            rows = []
            for what, k, c in ((1, b.vocab, words), (2, keys[begin], pairs)):
                for p, s in _ranges(k, parts[what - 1]):
                    rows.append((what, p, b.id, squeeze(k[s], True), squeeze(narrow(c[s]))))
            yield from _messages(rows, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), ["what", "part", "block", "keys", "counts"])

    return table.mapInArrow(tidy(run), "what int, part int, block long, keys binary, counts binary")


ANSWER = "what int, part int, block long, keys binary, counts binary, total long, types long, of_count array<long>"


def _counted(key, table):
    """The sums of one key range: a table row, and an answer to every block. A negative answer makes the block the pair's owner."""
    import numpy as np
    import pyarrow as pa

    release()

    blocks = table.column("block").to_numpy()
    order = np.argsort(blocks)
    keys = [expand(table.column("keys")[int(i)].as_py(), np.uint64, True) for i in order]
    counts = [expand(table.column("counts")[int(i)].as_py(), np.int32) for i in order]
    every = np.concatenate(keys)
    place, first, inverse = np.unique(every, return_index=True, return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(place)).astype(np.int64)
    answer = total[inverse]
    answer[first] *= -1
    what, part, rows, at = key[0].as_py(), key[1].as_py(), [], 0
    seen = total > 0
    of_count = np.bincount(np.minimum(total, LARGEST + 2), minlength=LARGEST + 3)[: LARGEST + 2]
    rows.append((what, part, -1, squeeze(place[seen], True), squeeze(narrow(total[seen])), int(total.sum()), int(seen.sum()), of_count.tolist()))
    for i, k in zip(order, keys, strict=True):
        rows.append((what, part, int(blocks[i]), None, squeeze(narrow(answer[at : at + len(k)])), None, None, None))
        at += len(k)
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["what", "part", "block", "keys", "counts", "total", "types", "of_count"])


def discounts(of_count: list[int]) -> list[float]:
    """Good-Turing factors for counts 0 to LARGEST + 1 (the last stands for all larger ones), from numbers of types by count.

    Where these numbers cannot support a Good-Turing estimate (none of some count, or a factor outside 0 to 1) a fixed amount is
    subtracted instead.
    """
    n, k = of_count, LARGEST
    out = [0.0] + [1.0] * (k + 1)
    if n[1] <= 0:
        return out
    excess = (k + 1) * n[k + 1] / n[1]
    amount = n[1] / (n[1] + 2 * n[2])
    for c in range(1, k + 1):
        d = ((c + 1) * n[c + 1] / (c * n[c]) - excess) / (1 - excess) if n[c] and excess < 1 else 0.0
        out[c] = d if 0 < d < 1 else (c - min(amount, 0.9)) / c
    return out


class Model:
    """What the driver knows: total N, types V and discounts of words and pairs."""

    def __init__(self, stats: dict[int, tuple[int, int, list[int]]]):
        import numpy as np

        none = (0, 0, [0] * (LARGEST + 2))
        self.n, self.v, words = stats.get(1, none)
        self.d1, self.d2 = np.array(discounts(words)), np.array(discounts(stats.get(2, none)[2]))
        used = sum(self.d1[c] * c * words[c] for c in range(1, LARGEST + 1))
        self.unknown = (sum(c * words[c] for c in range(1, LARGEST + 1)) - used) / self.n if self.n else 1.0
        if self.n and self.unknown <= 0:  # no word is rare: one occurrence is set aside
            self.n_words, self.unknown = self.n + 1, 1 / (self.n + 1)
        else:
            self.n_words = self.n

    def unigram(self, c):
        import numpy as np

        return np.where(c > 0, self.d1[np.minimum(c, LARGEST + 1)] * c / max(1, self.n_words), self.unknown)


def _joined(table: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """Blocks with their answers of one kind, in the order of parts. The table is bucketed by block, so only answers are shuffled."""
    each = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "counts"))).alias(name))
    return table.join(each, "block")


def _answers(row: dict, name: str, kind):
    import numpy as np

    return np.concatenate([expand(x["counts"], kind) for x in row[name]])


def _weights_asked(table: DataFrame, model: Model, parts: int) -> DataFrame:
    """For every word as a history: the discounted counts and unigram mass of the pairs that this block owns."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for row in _rows_of(batches):
            b = Block(row)
            words = np.abs(_answers(row, "words", np.int32))
            keys, index = np.unique(b.pair_keys(), return_index=True)
            c = -_answers(row, "pairs", np.int32).astype(np.int64)
            own = c > 0
            h, w = b.history[index[own]], b.tokens[index[own]]
            used = np.bincount(h, weights=model.d2[np.minimum(c[own], LARGEST + 1)] * c[own], minlength=len(b.vocab))
            mass = np.bincount(h, weights=model.unigram(words[w]), minlength=len(b.vocab))
            rows = [(p, b.id, squeeze(b.vocab[s], True), squeeze(narrow(words[s])), squeeze(used[s]), squeeze(mass[s])) for p, s in _ranges(b.vocab, parts)]
            yield from _messages(rows, (pa.int32(), pa.int64(), *[pa.binary()] * 4), ["part", "block", "keys", "seen", "used", "mass"])

    return table.mapInArrow(tidy(run), "part int, block long, keys binary, seen binary, used binary, mass binary")


def _weighed(key, table):
    """Back-off weights of one range of histories. A history without mass to spare has one occurrence added to it (a negative weight says so)."""
    import numpy as np
    import pyarrow as pa

    blocks = table.column("block").to_numpy()
    get = lambda name, kind, delta=False: [expand(x.as_py(), kind, delta) for x in table.column(name)]
    keys = get("keys", np.uint64, True)
    place, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    seen = np.concatenate(get("seen", np.int32))[first].astype(float)
    used = np.bincount(inverse, weights=np.concatenate(get("used", np.float64)), minlength=len(place))
    mass = np.bincount(inverse, weights=np.concatenate(get("mass", np.float64)), minlength=len(place))
    spare = seen - used
    short = (seen > 0) & (spare <= 1e-9 * seen)
    left = np.where(short, 1 / (seen + 1), spare / np.maximum(seen, 1))
    weight = np.where(used > 0, left / np.maximum(1 - mass, 1e-300), 1.0) * np.where(short, -1, 1)
    rows, at = [(key[0].as_py(), -1, squeeze(place, True), squeeze(weight))], 0
    for b, k in zip(blocks, keys, strict=True):
        rows.append((key[0].as_py(), int(b), None, squeeze(weight[inverse[at : at + len(k)]])))
        at += len(k)
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "keys", "counts"])


def katz(model: Model, words, pairs, weights, history, token):
    """log10 of the probability of each token after its history: the pair's if it was seen, else the weight times the word's."""
    import numpy as np

    own, c = weights[history], pairs.astype(float)
    seen = words[history] + (own < 0)
    direct = model.d2[np.minimum(pairs, LARGEST + 1)] * c / np.maximum(seen, 1)
    return np.log10(np.where(pairs > 0, direct, np.abs(own) * model.unigram(words[token])))


def _scored(table: DataFrame, model: Model, kind: str) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for row in _rows_of(batches):
            b = Block(row)
            words = np.abs(_answers(row, "words", np.int32)).astype(np.int64)
            weights = _answers(row, "weights", np.float64)
            _, inverse = np.unique(b.pair_keys(), return_inverse=True)
            pairs = np.abs(_answers(row, "pairs", np.int32)).astype(np.int64)[inverse]
            logs = katz(model, words, pairs, weights, b.history, b.tokens)
            c = words[b.tokens]
            base = np.log10((c + 0.5) / (model.n + 0.5 * (model.v + 1)))
            per = lambda x: np.add.reduceat(x, b.first)
            n = len(b.ids)
            yield pa.record_batch(
                [pa.array(b.ids, kind_), pa.array(b.held), pa.array(b.lengths), pa.array(per((c > 0).astype(np.int64))), pa.array(np.full(n, model.n, np.int64)), pa.array(per(base)), pa.array(per(logs))],
                names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    kind_ = to_arrow_type(table.schema["ids"].dataType.elementType)
    return table.mapInArrow(tidy(run), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_texts(df: DataFrame, folds: int = 5, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, part_keys: int = PART_KEYS) -> DataFrame:
    """One row per row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text)."""
    spark = df.sparkSession
    docs = df.select(df[id_col].alias("id"), (fold_of(df[id_col], folds) == held_out).alias("held"), text_of(df, text_col).cast("binary").alias("raw"))
    size = docs.agg(F.sum(F.octet_length("raw") + 64)).first()[0] or 0
    name, path = f"palisade_lm_{uuid.uuid4().hex}", fresh_path(spark, "lm-blocks")
    buckets = int(min(50_000, max(1, 2 * size // block_bytes)))
    with arrow_rows(spark):
        _blocks(docs, block_bytes).write.format("parquet").option("compression", "none").option("path", path).bucketBy(buckets, "block").saveAsTable(name)
    try:
        table = spark.table(name)
        tokens = size / 6
        parts = (max(1, int(0.2 * tokens / part_keys)), max(1, int(0.8 * tokens / part_keys)))
        asked = _requests(table, parts)
        answers = materialise(asked.groupBy("what", "part").applyInArrow(_counted, ANSWER), "lm-counts", rows=FEW)
        per = answers.where("block = -1").groupBy("what").agg(F.sum("total"), F.sum("types"), *[F.sum(F.element_at("of_count", c + 1)) for c in range(LARGEST + 2)]).collect()
        model = Model({r[0]: (r[1], r[2], list(r[3:])) for r in per})
        replies = answers.where("block >= 0")
        known = _joined(_joined(table, replies.where("what = 1"), "words"), replies.where("what = 2"), "pairs")
        weights = _weights_asked(known, model, parts[0]).groupBy("part").applyInArrow(_weighed, "part int, block long, keys binary, counts binary")
        weights = materialise(weights, "lm-weights", rows=FEW)
        result = _scored(_joined(known, weights.where("block >= 0"), "weights"), model, docs.schema["id"].dataType.simpleString())
        return materialise(result.withColumnRenamed("id", id_col), "lm-scores", rows=FEW)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(spark, path)
