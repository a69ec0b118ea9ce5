"""Packing of tokenised documents into fixed-length sequences by shortest-pack-first over the length histogram.

Documents are tokenised and end with one end id. Documents longer than a sequence are cut into full pieces and one rest. Only the histogram
of piece lengths (at most ``seq_len`` numbers) reaches the driver, where lengths are placed longest first: each goes into the shortest
open pattern, the one with the most room left, counts of patterns being split as needed; where that one is full, a new sequence is opened. A pattern is joined back to pieces by their rank
among all pieces of that length; ranks come from per-file counts, so no length is ever gathered in one task.

Null and empty texts are the end id alone. An empty table gives an empty result. Repeated rows are packed like any others. A padding id is
not stored: sequences shorter than ``seq_len`` are padded by whoever reads them.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, text_of, tidy

#: What a piece holds besides its document's id; ``ids`` are unsigned 16-bit little-endian where the vocabulary allows, else 32-bit.
PIECES = "start long, length long, ids binary, ids_crc32 long, doc_tokens long, part int, local_rank long"
#: Rows (one for each file and length) up to which the table of ranks may be broadcast.
BROADCAST_ROWS = 200_000

#: Bytes of text that are split into words at once.
CHUNK = 1 << 20
#: Longer words are not kept in the table.
KEPT_BYTES = 64

#: The vocabulary's own rules, for text in Latin-1: 0 white space, 1 letters, 2 numerals, which stand alone, 3 other marks.
_LETTERS, _NUMERALS = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ÿ]"), re.compile("[0-9²³¹¼-¾]")
_BLANKS = {*range(9, 14), 0x20, 0x85, 0xA0}
_KINDS = bytes(0 if b in _BLANKS else 1 if _LETTERS.match(chr(b)) else 2 if _NUMERALS.match(chr(b)) else 3 for b in range(256))
_LOWER = bytes(ord(chr(b).lower()) for b in range(256))
_BLANK = re.compile(b"[%s]" % re.escape(bytes(sorted(_BLANKS))))


def split_words(raw: bytes):
    """Words of lower-case Latin-1 text that ends in two blanks: where each begins, and the words themselves as an Arrow array.

    Words are runs of letters, single numerals, runs of other marks, and 's, 't, 'm, 'd, 're, 've, 'll where no mark stands before them.
    """
    import numpy as np
    import pyarrow as pa

    text = np.frombuffer(raw, np.uint8)
    kind = np.frombuffer(raw.translate(_KINDS), np.uint8)
    first = kind == 2
    first[0] = kind[0] != 0
    first[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] != 0)
    at = np.flatnonzero(text == ord("'"))
    at = at[first[at] & (kind[at + 1] == 1)]  # a mark alone, with a letter after it
    b, c = text[at + 1], text[at + 2]
    is_ = lambda x, letters: np.isin(x, np.frombuffer(letters, np.uint8))
    two = is_(b, b"stmd")
    three = (is_(b, b"rv") & (c == ord("e"))) | ((b == ord("l")) & (c == ord("l")))
    first[at[two | three] + 1] = False
    after = np.concatenate([at[two] + 2, at[three] + 3])
    first[after[kind[after] == 1]] = True
    inked = kind != 0
    edges = np.append(np.flatnonzero(first[inked]), np.count_nonzero(inked)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(text[inked])])
    return np.flatnonzero(first), words


class WordTokenizer:
    """Ids of whole texts. The words of Latin-1 text are split by array operations and looked up in a table that the library's own
    model fills; any other text goes to the library whole. The table has two generations of ``most`` words each: when the young one is full it
    becomes the old one, and what is used again moves over."""

    def __init__(self, path: str, most: int = 60_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.tokenize = self.whole.model.tokenize
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.marks = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.most = most
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _made(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that the young table lacks."""
        import numpy as np

        found = list(map(self.old.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        flat: list[int] = []
        ends: list[int] = []
        for i in new:
            word = words[i]
            marks = word.decode() if word.isalnum() else word.decode("latin-1").encode().decode("latin-1").translate(self.marks)
            flat += [t.id for t in self.tokenize(marks)]
            ends.append(4 * len(flat))
        raw = np.array(flat, "<u4").tobytes()
        for i, a, b in zip(new, [0, *ends], ends):
            found[i] = raw[a:b]
        for word, ids in zip(words, found, strict=True):
            if len(word) <= KEPT_BYTES:
                if len(self.young) >= self.most:
                    self.old, self.young = self.young, {}
                self.young[word] = ids
        return found

    def _joined(self, texts: list[bytes]) -> list[bytes]:
        """Ids of lower-case Latin-1 texts."""
        import numpy as np
        import pyarrow as pa

        begins, words = split_words(b"  ".join(texts) + b"  ")
        if not len(begins):
            return [b""] * len(texts)
        words = words.dictionary_encode()
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.young.get, known))
        lacking = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(lacking, self._made([known[i] for i in lacking]), strict=True):
            ids[i] = x
        taken = pa.array(ids, pa.large_binary()).take(words.indices)
        edges = np.frombuffer(taken.buffers()[1], np.int64)
        flat = memoryview(taken.buffers()[2])
        bounds = np.cumsum([0, *(len(t) + 2 for t in texts)])
        at = edges[np.searchsorted(begins, bounds)].tolist()
        return [bytes(flat[a:b]) for a, b in zip(at, at[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        import numpy as np

        out: list[bytes] = [b""] * len(texts)
        plain: list[bytes] = []
        at: list[int] = []
        for i, text in enumerate(texts):
            try:
                raw = None if any(s in text for s in self.special) else text.encode("latin-1").translate(_LOWER)
            except UnicodeEncodeError:
                raw = None
            if raw is None:
                out[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            elif len(raw) > CHUNK:
                out[i] = b"".join([self._joined([part])[0] for part in _cut(raw)])
            else:
                plain.append(raw)
                at.append(i)
        for i, ids in zip(at, self._joined(plain) if plain else [], strict=True):
            out[i] = ids
        return out


def _cut(raw: bytes) -> Iterator[bytes]:
    """A long text in parts of about ``CHUNK`` bytes, each but the last ending in a blank."""
    at = 0
    while at < len(raw):
        blank = _BLANK.search(raw, min(at + CHUNK, len(raw)))
        end = blank.end() if blank else len(raw)
        yield raw[at:end]
        at = end


_coder: tuple | None = None


def tokenizer_of(path: str) -> WordTokenizer:
    """The tokenizer of that file. A worker keeps the last one, whose table has a fixed size, for its next task."""
    global _coder
    seen = os.stat(path)
    key = path, seen.st_mtime_ns, seen.st_size
    if _coder is None or _coder[0] != key:
        _coder = key, WordTokenizer(path)
    return _coder[1]


def tokenised_pieces(df: DataFrame, tokenizer_path: str, seq_len: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece; ``local_rank`` counts pieces of that length within the task ``part``."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        schema = None
        coder, part = tokenizer_of(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(seq_len + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("doc_id"), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("local_rank", pa.int64())])
            size_of = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            chunk_of = (np.cumsum(size_of, dtype=np.int64) - size_of) // CHUNK  # rows that begin in the same chunk go together
            cuts = [*np.flatnonzero(np.diff(chunk_of, prepend=-1)).tolist(), batch.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                piece = batch.slice(at, to - at)
                cols: list[list] = [[] for _ in range(8)]
                for doc_id, raw in zip(piece.column(0).to_pylist(), coder.encode(piece.column(1).to_pylist()), strict=True):
                    raw += end
                    n = len(raw) // 4
                    for start in range(0, n, seq_len):
                        ids = raw[4 * start : 4 * (start + seq_len)]
                        size = len(ids) // 4
                        wide = np.frombuffer(ids, "<u4")
                        for col, x in zip(cols, (doc_id, start, size, (wide.astype("<u2") if wide.max() < 65536 else wide).tobytes(), zlib.crc32(ids), n, part, int(seen[size])), strict=True):
                            col.append(x)
                        seen[size] += 1
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    docs = df.select(df[id_col].alias("doc_id"), text_of(df, text_col).alias("text"))
    return docs.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}")


def shortest_pack_first(histogram: dict[int, int], seq_len: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, longest first) and their counts. Lengths are placed longest first, into the open pattern with the most room."""
    import bisect

    open_: dict[int, dict[tuple[int, ...], int]] = {}  # room left: patterns
    rooms: list[int] = []
    done: dict[tuple[int, ...], int] = {}

    def put(pattern: tuple[int, ...], count: int, room: int) -> None:
        if not room:
            done[pattern] = done.get(pattern, 0) + count
            return
        if room not in open_:
            open_[room] = {}
            bisect.insort(rooms, room)
        open_[room][pattern] = open_[room].get(pattern, 0) + count

    for length in sorted((k for k, v in histogram.items() if v), reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:  # the shortest has no room: a new sequence, then the shortest until it is full, and so on
                each = seq_len // length
                full, rest = divmod(left, each)
                if full:
                    put((length,) * each, full, seq_len - each * length)
                if rest:
                    put((length,) * rest, 1, seq_len - rest * length)
                break
            room = rooms[-1]
            pattern, count = open_[room].popitem()
            if not open_[room]:
                del open_[room]
                rooms.pop()
            take = min(count, left)  # one each: a sequence that has got one is no longer the shortest while others have more room
            if take < count:
                put(pattern, count - take, room)
            put((*pattern, length), take, room - length)
            left -= take
    for group in open_.values():
        for pattern, count in group.items():
            done[pattern] = done.get(pattern, 0) + count
    return sorted(((list(p), n) for p, n in done.items()), key=lambda x: (x[0], x[1]), reverse=True)


def placements(patterns: list[tuple[list[int], int]]) -> dict[int, tuple]:
    """For each length: arrays (first rank, copies in the pattern, first sequence, offset of the first copy), by rising rank."""
    import numpy as np

    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, count in patterns:
        at, i = 0, 0
        while i < len(lengths):
            length, j = lengths[i], i
            while j < len(lengths) and lengths[j] == length:
                j += 1
            first = used.get(length, 0)
            rows.setdefault(length, []).append((first, j - i, sequence, at))
            used[length] = first + count * (j - i)
            at += length * (j - i)
            i = j
        sequence += count
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in rows.items()}


def pack(df: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id (of whatever type), start, length, ids, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = materialise(tokenised_pieces(df, tokenizer_path, seq_len, end_id, id_col, text_col), "pack-pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    # Files of the same length, one after the other: where each file's ranks begin. One row per file and length.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialise(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most seq_len rows
    where = placements(shortest_pack_first(histogram, seq_len))
    # Few rows go to every task; more than that are joined by file and length, which are spread over all files.
    firsts = counts.select("part", "length", "first")
    firsts = F.broadcast(firsts) if counts.count() <= BROADCAST_ROWS else firsts.hint("merge")
    ranked = pieces.join(firsts, ["part", "length"]).withColumn("rank", F.col("first") + F.col("local_rank"))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length, rank):
        import numpy as np
        import pandas as pd

        size, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
        order = np.argsort(size, kind="stable")
        edges = np.flatnonzero(np.diff(size[order], prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            rows = order[a:b]
            first, copies, sequence, at = where[int(size[rows[0]])]
            k = np.searchsorted(first, r[rows], side="right") - 1
            q, c = np.divmod(r[rows] - first[k], copies[k])
            seq[rows], off[rows] = sequence[k] + q, at[k] + c * size[rows]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn("at", place("length", "rank")).select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset")
