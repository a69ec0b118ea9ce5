"""Pattern recognition: one scan of the text, every match with its code-point offsets and its surroundings.

Texts come in Arrow batches. For every pattern the batch is searched as one array by an automaton that tells which texts hold a match (after
the gate of the pattern's family), and only in those are matches taken one by one. Patterns keep to the syntax that all engines share, and
match ASCII classes. Nothing is shuffled, and what later passes want to know of a text is carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import SPARK
from ..functions.text import FIELDS, STOP_VALUES
from ..plans.catalog import DEFAULT_LABEL, LABELS, Catalog, Family

#: Characters kept on either side of a match.
BEFORE, AFTER = 200, 200
#: Texts that are searched at once, and about how many bytes of them; a longer text is searched alone.
ROWS, BYTES = 500, 1 << 21
FOUND = "family string, entity_type string, pattern string, score double, s bigint, e bigint, value string, before string, after string"


@lru_cache(1)
def _letters() -> str:
    """All letters of Unicode as ranges of a character class."""
    import sys
    import unicodedata
    from itertools import groupby

    runs = groupby(range(sys.maxunicode + 1), lambda c: unicodedata.category(chr(c))[0] == "L")
    spans = [(cs[0], cs[-1]) for cs in (list(g) for letter, g in runs if letter)]
    return "".join(f"{chr(x)}-{chr(y)}" for x, y in spans)


@lru_cache(4096)
def _compiled(pattern: str) -> re.Pattern:
    """With ASCII classes, as in the other engines; letters of all scripts are spelled out, since Python has no name for them."""
    if "\\p{L}" in pattern:
        pattern = re.sub(r"\[((?:[^\]\\]|\\.)*?)\\p\{L\}", lambda m: "[" + m.group(1) + _letters(), pattern).replace("\\p{L}", f"[{_letters()}]")
    return re.compile(pattern, re.ASCII)


def _matches(texts, families: tuple[Family, ...], strings: list[str]) -> Iterator[tuple]:
    """(row, family, entity type, pattern, score, start, end) of all matches in an Arrow array of texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for f in families:
        rows = pc.indices_nonzero(pc.match_substring_regex(texts, f.gate)) if f.gate else pa.array(range(len(texts)), pa.uint64())
        if not len(rows):
            continue
        some = texts.take(rows)
        for p in f.patterns:
            for k in pc.indices_nonzero(pc.match_substring_regex(some, p.regex)).to_pylist():
                row = rows[k].as_py()
                for m in _compiled(p.regex).finditer(strings[row]):
                    yield row, f.name, f.entity_type, p.name, p.score, m.start(), m.end()


def _parts(batch, texts) -> Iterator:
    """Slices of a batch of at most ``ROWS`` rows and about ``BYTES`` bytes of its column ``texts``, so that long texts do not pile up in memory."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        n = max(1, min(ROWS, int(np.searchsorted(ends, before + BYTES, side="right")) - at))
        yield batch.slice(at, n)
        at += n


_SUFFIX = re.compile("(?:ing|tion|ment|ness)$")


def _fields(texts, strings: list[str]) -> Iterator[tuple]:
    """The values of labelled fields, without those that are no value."""
    import pyarrow.compute as pc

    for rule, kind, score, rx in FIELDS:
        for row in pc.indices_nonzero(pc.match_substring_regex(texts, rx)).to_pylist():
            for m in _compiled(rx).finditer(strings[row]):
                whole = m.group(1)
                value = whole.strip(" ")
                start = m.start(1) + len(whole) - len(whole.lstrip(" "))
                short = kind == "PHONE_NUMBER" and sum(c in "0123456789" for c in value) < 7
                if value and value.lower() not in STOP_VALUES and not short and not (kind == "PERSON" and _SUFFIX.search(value)):
                    yield row, "labelled", kind, rule, score, start, start + len(value)


def _scan(families: tuple[Family, ...], fields: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in _parts(batch, batch.column(1)):
                texts = part.column(1)
                strings = texts.to_pylist()
                found = list(_matches(texts, families, strings))
                if fields:
                    found += _fields(texts, strings)
                if not found:
                    continue
                row, family, entity, pattern, score, start, end = (list(x) for x in zip(*found, strict=True))
                value = [strings[r][a:b] for r, a, b in zip(row, start, end, strict=True)]
                before = [strings[r][max(0, a - BEFORE) : a] for r, a in zip(row, start, strict=True)]
                after = [strings[r][b : b + AFTER] for r, b in zip(row, end, strict=True)]
                index = pa.array(row, pa.int64())
                cols = [pa.array(x, pa.string()) for x in (family, entity, pattern)] + [pa.array(score, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())] + [pa.array(x, pa.string()) for x in (value, before, after)]
                more = [part.column(i).take(index) for i in range(2, part.num_columns)]
                names = ["doc_id", *(x.split(" ")[0] for x in FOUND.split(", ")), *part.schema.names[2:]]
                yield pa.record_batch([part.column(0).take(index), *cols, *more], names=names)

    return run


def detect(df: DataFrame, families: tuple[str, ...] | None = None, catalog: Catalog | None = None, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, str] | None = None, fields: bool = False) -> DataFrame:
    """One row per match: doc_id (of whatever type), family, entity_type, pattern, score, s, e, value, before, after. Null text matches nothing.

    ``carry`` adds columns that are expressions over the columns of ``df``, with the text as ``text``; they are taken where the text is
    read, so no later pass joins it back. ``fields`` adds the values of labelled fields, as family "labelled".
    """
    catalog = catalog or Catalog()
    chosen = tuple(f for f in catalog.families if families is None or f.name in families)
    named = df.where(df[text_col].isNotNull()).select(df[id_col].alias("doc_id"), df[text_col].alias("text"), *[c for c in df.columns if c.lower() not in ("doc_id", "text", id_col.lower(), text_col.lower())])
    if len(chosen) == 1 and not fields:  # the gate as a filter, before anything leaves the JVM
        named = named.where(F.expr(SPARK.matches("text", chosen[0].gate)))
    base = named.selectExpr("doc_id", "text", *[f"{e} AS {name}" for name, e in (carry or {}).items()])
    extra = "".join(f", `{x.name}` {x.dataType.simpleString()}" for x in base.schema.fields[2:])
    return base.mapInArrow(_scan(chosen, fields), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, {FOUND}{extra}")


def unmatched(df: DataFrame, families: tuple[str, ...] | None = None, catalog: Catalog | None = None, text_col: str = "text") -> DataFrame:
    """Rows in which no pattern matches, all columns kept; null text matches nothing."""
    catalog = catalog or Catalog()
    chosen = tuple(f for f in catalog.families if families is None or f.name in families)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in _parts(batch, batch.column(text_col)):
                texts = part.column(text_col)
                hit = {found[0] for found in _matches(texts, chosen, texts.to_pylist())}
                yield part.take(pa.array([r for r in range(part.num_rows) if r not in hit], pa.int64()))

    return df.mapInArrow(run, df.schema)


def redact(df: DataFrame, families: tuple[str, ...] | None = None, catalog: Catalog | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows with a match, all columns kept, with ``redactions`` and ``redacted``: matches that overlap are one stretch, which becomes the label
    of its best match (by score, then the first by start, the longest, the first by type). Done where the text is read, without a shuffle."""
    catalog = catalog or Catalog()
    chosen = tuple(f for f in catalog.families if families is None or f.name in families)
    base = df.where(df[text_col].isNotNull())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in _parts(batch, batch.column(text_col)):
                texts = part.column(text_col)
                strings = texts.to_pylist()
                by_row: dict[int, list[tuple]] = {}
                for row, _, entity, _, score, start, end in _matches(texts, chosen, strings):
                    by_row.setdefault(row, []).append((start, end, -score, entity))
                if not by_row:
                    continue
                rows = sorted(by_row)
                done = [_redacted(strings[r], by_row[r]) for r in rows]
                kept = part.take(pa.array(rows, pa.int64()))
                yield pa.record_batch([*kept.columns, pa.array([n for n, _ in done], pa.int64()), pa.array([x for _, x in done], pa.string())], names=[*part.schema.names, "redactions", "redacted"])

    return base.mapInArrow(run, ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in base.schema.fields) + ", redactions long, redacted string")


def _redacted(text: str, found: list[tuple]) -> tuple[int, str]:
    stretches: list[list] = []  # start, end, (order of the best match)
    for start, end, order, entity in sorted(found):
        best = (order, start, -end, entity)
        if stretches and start < stretches[-1][1]:
            last = stretches[-1]
            last[1], last[2] = max(last[1], end), min(last[2], best)
        else:
            stretches.append([start, end, best])
    out, at = [], 0
    for start, end, best in stretches:
        out += [text[at:start], LABELS.get(best[3], DEFAULT_LABEL)]
        at = end
    return len(stretches), "".join([*out, text[at:]])
