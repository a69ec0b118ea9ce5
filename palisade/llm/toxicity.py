"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, report, other; marks and words like "but" are pauses, ends of sentences are ends).
Three transducers read them one after the other, each the output of the one before:

 1. negation: an insult or a threat up to three words after a negation becomes a negated one;
 2. report: one after a verb of saying, in its clause or in the one that the verb opens ("he said, ..."), becomes a reported one;
 3. aim: at the end of a clause that held a plain insult or threat and a target, it puts out an aimed one, too.

Their composition is one table of states and weighted arcs. Every insult and threat is decided by itself, and what the arcs put out, clause by
clause, is what counts: a document's score adds the weights of its outputs, by logarithms of their numbers. Weights of arcs are logistic
weights fitted on labelled rows.

The insult lexicon holds a short fixed list and what the labels show: words, and beginnings of words, that labelled toxic rows have far more
often than others; terms with equal counts are all in or all out. Words are runs of letters and digits, lower case; they are looked up by hash
for whole blocks of texts, and only sentences with an insult or a threat are read by the grammar.

Null and empty texts have no clause and get the score of the intercept. Rows are scored one by one, so repeated rows and extra columns change
nothing; an empty table gives an empty result; without labels of both kinds the fixed list and fixed weights are used.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, fold_of, text_of, tidy
from .training import fit_logistic, labelled_sample
from .words import Lookup, Scan, in_chunks, word_hashes

SYMBOLS = ("other", "insult", "threat", "target", "negation", "report", "pause", "end", "negated insult", "negated threat", "reported insult", "reported threat", "aimed insult", "aimed threat")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, PAUSE, END, NEGATED_INSULT, NEGATED_THREAT, REPORTED_INSULT, REPORTED_THREAT, AIMED_INSULT, AIMED_THREAT = range(14)
EVENTS = (INSULT, THREAT, NEGATED_INSULT, NEGATED_THREAT, REPORTED_INSULT, REPORTED_THREAT, AIMED_INSULT, AIMED_THREAT)

#: Fixed word lists. A contraction ends in the word "t", which negates.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown imbecile dumb vermin idiota estúpido imbécil dummkopf abschaum connard crétin".split()
THREATS = "kill hurt destroy murder attack beat shoot stab töten tuer matar".split()
TARGETS = "you your he she they them him her this that these those people tu vous toi du dich ihr sie usted ustedes".split()
NEGATIONS = "not no never t nobody nicht kein keine pas jamais nunca".split()
REPORTS = "said says wrote quoted called reported according claimed sagte dit dijo".split()
PAUSES = "but aber mais pero".split()

STEMS = (5, 6, 7)  # bytes of a word's beginning
SCOPE = 3


class Transducer:
    """``arcs[state][symbol]`` is (next state, output, weight); state 0 starts."""

    def __init__(self, arcs: list[list[tuple[int, int, float]]]):
        self.arcs = arcs

    def __matmul__(self, after: Transducer) -> Transducer:
        """The machine that reads what this one reads and puts out what ``after`` makes of it; weights add up."""
        number: dict[tuple[int, int], int] = {(0, 0): 0}
        todo, arcs = [(0, 0)], []
        while todo:
            a, b = todo.pop(0)
            row = []
            for to, middle, weight in self.arcs[a]:
                next_, out, more = after.arcs[b][middle]
                pair = (to, next_)
                if pair not in number:
                    number[pair] = len(number)
                    todo.append(pair)
                row.append((number[pair], out, weight + more))
            arcs.append(row)
        return Transducer(arcs)

    def weighted(self, weight: dict[int, float]) -> Transducer:
        """The same machine with the weights of outputs on its arcs."""
        return Transducer([[(to, out, weight.get(out, 0.0)) for to, out, _ in row] for row in self.arcs])


def _build(states: int, step) -> Transducer:
    """From ``step(state, symbol)``, which gives the next state and the output."""
    return Transducer([[(*step(s, x), 0.0) for x in range(len(SYMBOLS))] for s in range(states)])


def _negate(left: int, x: int) -> tuple[int, int]:
    """The state is how many words the negation still covers."""
    if x in (PAUSE, END):
        return 0, x
    if x == NEGATION:
        return SCOPE, OTHER
    return max(0, left - 1), {INSULT: NEGATED_INSULT, THREAT: NEGATED_THREAT}.get(x, x) if left else x


def _report(state: int, x: int) -> tuple[int, int]:
    """0: nobody speaks, 1: the word before was a verb of saying, 2: what follows is reported."""
    if x == END:
        return 0, x
    if x == PAUSE:
        return (2 if state == 1 else 0), x
    if x == REPORT:
        return 1, OTHER
    return (2 if state else 0), {INSULT: REPORTED_INSULT, THREAT: REPORTED_THREAT}.get(x, x) if state else x


def _aim(state: int, x: int) -> tuple[int, int]:
    """Bits of the state: 1 a target, 2 a plain insult, 4 a plain threat was read in this clause."""
    if x in (PAUSE, END):
        return 0, AIMED_THREAT if state & 5 == 5 else AIMED_INSULT if state & 3 == 3 else OTHER
    return state | {TARGET: 1, INSULT: 2, THREAT: 4}.get(x, 0), x if x in EVENTS else OTHER


def grammar() -> Transducer:
    return _build(SCOPE + 1, _negate) @ _build(3, _report) @ _build(8, _aim)


FEATURES = (*(SYMBOLS[x] for x in EVENTS), "strongest", "sum")
FIXED_WEIGHTS = (2.0, 0.3, 0.0, 0.0, 0.2, 0.0, 1.0, 3.0, 0.6, 0.2, -2.0)

#: Marks that are no part of words, beyond ASCII, become blanks.
_MARKS = re.compile("[\u00a0-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u303f]")
_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def plain(text: str) -> bytes:
    text = text.lower()
    return (text if text.isascii() else _MARKS.sub(" ", text)).encode("utf-8", "replace")


class Grammar:
    """Reads texts and gives their features. ``words`` and ``stems`` map insults and their beginnings, as bytes, to weights."""

    def __init__(self, words: dict[bytes, float], stems: dict[bytes, float], weights: tuple = FIXED_WEIGHTS):
        import numpy as np

        table = {w.encode(): (k, 0.0) for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (PAUSE, PAUSES)) for w in ws}
        table |= {w.encode(): (INSULT, 1.0) for w in INSULTS} | {w: (INSULT, x) for w, x in words.items()}
        self.whole = self._lookup(table)
        self.stems = {n: self._lookup({w: (INSULT, x) for w, x in stems.items() if len(w) == n}) for n in STEMS if any(len(w) == n for w in stems)}
        self.machine = grammar().weighted(dict(zip(EVENTS, weights, strict=False)))
        byte = np.zeros((2, 256), bool)
        byte[0, list(b",:")] = byte[1, list(b".!?;\n")] = True
        self.marks = byte

    @staticmethod
    def _lookup(table: dict[bytes, tuple[int, float]]):
        import numpy as np

        by_hash = {int(word_hashes([w])[0][0]): v for w, v in table.items()}
        look = Lookup(np.array(sorted(by_hash), np.uint64))
        found = [by_hash[int(k)] for k in look.keys]
        return look, np.array([k for k, _ in found], np.int8), np.array([x for _, x in found], float)

    def _sentences(self, raw: list[bytes]) -> Iterator[tuple[int, int, list[int], list[float], list[int]]]:
        """(text, first word, symbols, weights, marks after each word) of the sentences that hold an insult or a threat."""
        import numpy as np

        for i, j in in_chunks(raw):
            scan = Scan(raw[i:j])
            symbol, weight = np.zeros(len(scan.start), np.int8), np.zeros(len(scan.start))
            look, kinds, weights = self.whole
            at, k = look.find(scan.hashes())
            symbol[at], weight[at] = kinds[k], weights[k]
            for n, (look, _, weights) in self.stems.items():
                long, h = scan.beginnings(n)
                at, k = look.find(h)
                symbol[long[at]] = INSULT
                weight[long[at]] = np.maximum(weight[long[at]], weights[k])
            hits = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
            if not len(hits):
                continue
            # Marks between each word and the next: 1 a pause, 2 an end; the last word of a text is an end.
            upto = np.concatenate([scan.start[1:], [len(scan.raw)]])
            after = np.zeros(len(symbol), np.int8)
            for value in (1, 2):
                count = np.concatenate([[0], np.cumsum(self.marks[value - 1][scan.raw], dtype=np.int32)])
                after[count[upto] > count[scan.end]] = value
            last = scan.bounds[1:][np.diff(scan.bounds) > 0] - 1
            after[last] = 2
            ends = np.flatnonzero(after == 2)
            for s in np.unique(np.searchsorted(ends, hits)):
                a, b = (int(ends[s - 1]) + 1 if s else 0), int(ends[s]) + 1
                text = int(np.searchsorted(scan.bounds, a, side="right")) - 1
                yield i + text, a - int(scan.bounds[text]), symbol[a:b].tolist(), weight[a:b].tolist(), after[a:b].tolist()

    def read(self, symbols: list[int], marks: list[int]) -> Iterator[tuple[int, int, float]]:
        """(word, output, weight) of one sentence; ``marks`` are what follows each word."""
        state = 0
        for i, x in enumerate(symbols):
            state, out, weight = self.machine.arcs[state][x]
            if out:
                yield i, out, weight
            if marks[i]:
                state, out, weight = self.machine.arcs[state][PAUSE if marks[i] == 1 else END]
                if out:
                    yield i, out, weight

    def matches(self, text: str) -> list[tuple[int, str, float]]:
        """(word number, output, weight) of everything that the grammar puts out for a text."""
        return [(first + i, SYMBOLS[out], w) for _, first, symbols, _, marks in self._sentences([plain(text)]) for i, out, w in self.read(symbols, marks)]

    def features(self, texts: list[str]):
        """A row for each text."""
        import numpy as np

        column = {x: i for i, x in enumerate(EVENTS)}
        x = np.zeros((len(texts), len(FEATURES)))
        for t, _, symbols, weights, marks in self._sentences([plain(t) for t in texts]):
            for i, out, _ in self.read(symbols, marks):
                x[t, column[out]] += 1
                if out == INSULT:
                    x[t, 8] = max(x[t, 8], weights[i])
                    x[t, 9] += weights[i]
        strongest = x[:, 8].copy()
        x = np.log1p(x)
        x[:, 8] = strongest
        return x


def _counts(batches: Iterator) -> Iterator:
    """Rows (term, whole, toxic rows, other rows) of one task: words, and beginnings of words."""
    import pyarrow as pa

    count: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            words = {w.encode() for w in _WORD.findall(plain(text).decode("utf-8", "replace"))}
            count[int(y > 0)].update({(w, True) for w in words} | {(w[:n], False) for w in words for n in STEMS if len(w) >= n})
    terms = list(count[0].keys() | count[1].keys())
    cols = [[t for t, _ in terms], [whole for _, whole in terms], [count[1][t] for t in terms], [count[0][t] for t in terms]]
    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["term", "whole", "toxic", "clean"])


def fit(df: DataFrame, labels: DataFrame | None, folds: int = 5, held_out: int = 0, most_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict, dict, tuple]:
    """Words, stems and weights. ``most_rows`` bounds the labelled sample, and so all that reaches the driver."""
    import numpy as np

    if labels is None:
        return {}, {}, FIXED_WEIGHTS
    sample = labelled_sample(df, labels, "toxic", folds, held_out, most_rows, id_col, text_col).persist()
    try:
        with arrow_rows(df.sparkSession):
            n = {bool(r["y"]): r["n"] for r in sample.groupBy((F.col("y") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
            if min(n.get(True, 0), n.get(False, 0)) < 10:
                return {}, {}, FIXED_WEIGHTS
            terms = sample.mapInArrow(tidy(_counts), "term binary, whole boolean, toxic long, clean long").groupBy("term", "whole").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
            odds = F.log((F.col("t") + 0.5) / n[True]) - F.log((F.col("c") + 0.5) / n[False])
            # A term that a few toxic rows have and no clean row may be chance; one that more have is not.
            strong = (F.col("t") >= 5) & (odds > 3.0) & (F.col("t") >= 20 * F.col("c"))
            rows = terms.where(strong).select("term", "whole", odds.alias("w")).collect()
            words, stems = ({bytes(r["term"]): min(r["w"], 8.0) / 4 for r in sorted(rows, key=lambda r: bytes(r["term"])) if r["whole"] == whole} for whole in (True, False))

            def read(batches: Iterator) -> Iterator:
                import pyarrow as pa

                g = Grammar(words, stems)
                for batch in batches:
                    yield pa.record_batch([pa.array(g.features(batch.column("text").to_pylist()).tolist(), pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])

            table = sample.mapInArrow(tidy(read), "x array<double>, y int").toArrow()
    finally:
        sample.unpersist()
    rows = sorted(zip(table.column("x").to_pylist(), table.column("y").to_pylist(), strict=True))  # sums do not depend on the order of rows
    return words, stems, tuple(fit_logistic(np.array([x for x, _ in rows], float), np.array([y > 0 for _, y in rows], float)))


def score_toxicity(df: DataFrame, model: tuple[dict, dict, tuple], text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the column ``out``, the probability that a row is toxic, from its whole text."""
    words, stems, weights = model

    def score(batches):
        import numpy as np
        import pandas as pd

        g, w = Grammar(words, stems), np.array(weights)
        for texts in batches:
            z = [g.features(texts.iloc[i : i + 500].tolist()) @ w[:-1] + w[-1] for i in range(0, len(texts), 500)]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.concatenate([*z, np.empty(0)]), -30, 30))))

    return df.withColumn(out, F.pandas_udf(tidy(score), "double", F.PandasUDFType.SCALAR_ITER)(text_of(df, text_col)))


def held_out(df: DataFrame, folds: int = 5, fold: int = 0, id_col: str = "doc_id"):
    return fold_of(df[id_col], folds) == fold
