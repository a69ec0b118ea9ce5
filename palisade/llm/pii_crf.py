"""Personal data by fixed patterns and a linear-chain conditional random field over word shapes.

The patterns give the base spans of four kinds: email, ip, card and phone. The field reads the text as words between white space, each
described by its shape (runs of letters and digits, marks kept), a few properties and its neighbours, and labels it as the beginning or
inside of a kind or as neither. It is trained by maximum likelihood on a small labelled table that is generated here, and decoded by
Viterbi over batches of sequences in arrays.

Words without digits and without an at sign can only be labelled "neither"; that is part of the model, in training as in decoding. Between
them the chain falls apart into runs of other words, and decoding these runs alone gives the best labelling of the whole text.
Spans of the field that touch no base span are added; base spans stay.

Null and empty texts have no spans. Rows are read one by one, so repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, tidy

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Longer words, and what is known of them, are not kept for later.
KEPT_WORD = 100

#: Fixed patterns of the base spans.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_DIGITS = re.compile("[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The leftmost non-overlapping matches of each kind that meet its condition."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    # An address is the longest local part before an at sign that is not part of the match before.
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out["email"].append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    first = _DIGIT.search(text)
    if first is None:
        return out
    # A match of numbers and points starts where a number starts: from inside the number it would fail as well.
    for m in _IP.finditer(text, first.start()):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0")[:3] or 0) <= 255 for x in m.group().split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text, first.start()):
        if 13 <= m.end() - m.start() and 13 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out["phone"].append(m.span())
    return out


_LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> tuple[str, ...]:
    """Names of what a word looks like, whatever its length."""
    return _short(word) if len(word) <= KEPT_WORD else _features(word)


def _features(word: str) -> tuple[str, ...]:
    core = word.strip(".,;:!?\"'*#$%&|<>")
    digits = sum(c.isdigit() for c in core)
    shape = _DIGITS.sub(lambda m: f"d{len(m.group())}" if len(m.group()) < 20 else "d20", _LETTERS.sub("a", core))
    rough = re.sub(r"d\d+", "d", shape)
    return (
        f"shape={shape}",
        f"rough={rough}",
        f"digits={min(digits, 20)}",
        f"at={'@' in core}",
        f"dots={min(core.count('.'), 4)}",
        f"dashes={min(core.count('-'), 4)}",
        f"plus={core[:1] == '+'}",
        f"letters={any(c.isalpha() for c in core)}",
        f"start={_DIGITS.sub('d', core[:1])}" if core[:1].isdigit() or not core[:1].isalpha() else "start=a",
    )


_short = lru_cache(20_000)(_features)

#: Words that announce a kind.
CUES = {w: k for k, ws in {"email": "email e-mail mail contact courriel correo", "ip": "ip host server address adresse", "card": "card visa mastercard amex carte karte tarjeta kreditkarte", "phone": "phone tel call mobile fax cell telefon téléphone teléfono"}.items() for w in ws.split()}


def cue(word: str) -> str:
    return CUES.get(word.lower().strip(".,;:!?\"'*#$%&|<>()"), "")


def tagged(word: str) -> bool:
    """May the word be part of a span?"""
    return "@" in word or _DIGIT.search(word) is not None


def training_table(n: int = 700, seed: int = 23) -> list[tuple[list[str], list[str]]]:
    """Labelled sentences, made from a seed: every kind in several forms, numbers that are none of them, and plain words."""
    import random

    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvé") for _ in range(r.randint(2, 9)))

    def email():
        return [r.choice([f"{word()}.{num(2)}@mail{num(1)}.example.com", f"{word()}@{word()}.org", f"{word()}_{num(3)}@{word()}.co", f"{word()}.{word()}@{word()}.{word()}.net"])]

    def ip():
        return [".".join(str(r.randint(0, 255)) for _ in range(4)) + r.choice(["", "", "", f":{num(4)}"])]

    def card():
        return r.choice([[num(16)], [num(4) for _ in range(4)], ["-".join(num(4) for _ in range(4))], [num(15)], [num(4), num(6), num(5)]])

    def phone():
        return r.choice([["+1", f"({num(3)})", f"{num(3)}-{num(4)}"], [f"+{num(2)}", num(3), num(7)], [f"({num(3)})", f"{num(3)}-{num(4)}"], [f"{num(3)}-{num(3)}-{num(4)}"], [f"+{num(11)}"], [f"{num(3)}.{num(3)}.{num(4)}"]])

    def other():
        return r.choice([[num(r.randint(1, 6))], [f"{num(1)}.{num(1)}"], [f"{r.randint(1, 28)}/{r.randint(1, 12)}/20{num(2)}"], [f"20{num(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}"], [f"${num(3)}.{num(2)}"], [f"{num(2)}%"], [f"v{num(1)}.{num(1)}.{num(2)}"], [f"{num(1)}.{num(1)}.{num(1)}"], [f"{num(1)}.{num(2)}.{num(1)}"], [f"{num(2)}.{num(2)}.20{num(2)}"], [f"{num(2)}:{num(2)}"], ["".join(r.choice("0123456789abcdef") for _ in range(40))], [f"{word()}{num(2)}"], [num(r.randint(22, 30))], [f"@{word()}"], [f"{num(1)},{num(3)},{num(3)}"], [f"{num(3)}-{num(2)}"]])

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        words, tags = [], []
        for _ in range(r.randint(1, 4)):
            for _ in range(r.randint(0, 4)):
                words.append(word() + r.choice(["", "", "", ".", ","]))
                tags.append("O")
            kind = r.choice([*KINDS, "O", "O"])
            if kind != "O" and r.random() < 0.4:
                words.append(r.choice([w for w, k in CUES.items() if k == kind]) + r.choice(["", ":"]))
                tags.append("O")
            parts = other() if kind == "O" else make[kind]()
            parts[-1] += r.choice(["", "", "", ".", ",", "***", ")"]) if kind == "O" else r.choice(["", "", "", ".", ",", "***"])
            words += parts
            tags += ["O"] * len(parts) if kind == "O" else [f"B-{kind}", *[f"I-{kind}"] * (len(parts) - 1)]
        out.append((words, tags))
    return out


class Field:
    """The conditional random field: weights of features by label, and of label pairs."""

    def __init__(self):
        import numpy as np

        self.names: dict[str, int] = {}
        k = len(LABELS)
        self.w = np.zeros((0, k))
        #: Inside follows only the beginning or inside of its kind.
        self.barred = np.array([[b.startswith("I-") and a[2:] != b[2:] for b in LABELS] for a in LABELS])
        self.trans = np.zeros((k, k))
        self.rows: dict[str, object] = {}

    def _of(self, words: list[str], i: int) -> list[str]:
        out = [*features(words[i]), f"cue={cue(words[i - 1]) if i else ''}"]
        for d in (-1, 1):
            j = i + d
            near = features(words[j])[1] if 0 <= j < len(words) and tagged(words[j]) else "plain"
            out.append(f"{d}{near}")
        return out

    def fit(self, table: list[tuple[list[str], list[str]]], steps: int = 90, rate: float = 0.2, l2: float = 1e-3) -> None:
        """Gradient ascent (Adam) on the likelihood of all sentences, forward and backward passes over all of them at once."""
        import numpy as np

        at = {x: i for i, x in enumerate(LABELS)}
        longest, n, k = max(len(w) for w, _ in table), len(table), len(LABELS)
        index, place = [], []
        for s, (words, _) in enumerate(table):
            for i in range(len(words)):
                for name in self._of(words, i):
                    index.append(self.names.setdefault(name, len(self.names)))
                    place.append(s * longest + i)
        index, place = np.array(index), np.array(place)
        gold = np.zeros((n, longest), int)
        real = np.zeros((n, longest), bool)
        free = np.zeros((n, longest), bool)
        for s, (words, tags) in enumerate(table):
            gold[s, : len(tags)] = [at[t] for t in tags]
            real[s, : len(tags)] = True
            free[s, : len(tags)] = [tagged(w) for w in words]
        self.w = np.zeros((len(self.names), k))
        hard = np.where(self.barred, -1e4, 0.0)
        start = np.where([x.startswith("I-") for x in LABELS], -1e4, 0.0)
        forced = np.where(free[:, :, None], 0.0, np.where(np.arange(k) == 0, 0.0, -1e4))
        want = np.zeros((n, longest, k))
        np.put_along_axis(want, gold[:, :, None], 1.0, 2)
        want *= real[:, :, None]
        want_t = np.zeros((k, k))
        np.add.at(want_t, (gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), 1)
        m = [np.zeros_like(self.w), np.zeros_like(self.trans)]
        v = [np.zeros_like(self.w), np.zeros_like(self.trans)]
        for step in range(1, steps + 1):
            e = np.zeros((n * longest, k))
            np.add.at(e, place, self.w[index])
            e = e.reshape(n, longest, k) + forced
            t = self.trans + hard
            alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
            alpha[:, 0] = start + e[:, 0]
            for i in range(1, longest):
                x = alpha[:, i - 1, :, None] + t
                top = x.max(1, keepdims=True)
                alpha[:, i] = np.where(real[:, i, None], (np.log(np.exp(x - top).sum(1)) + top[:, 0]) + e[:, i], alpha[:, i - 1])
            for i in range(longest - 2, -1, -1):
                x = t + (e[:, i + 1] + beta[:, i + 1])[:, None, :]
                top = x.max(2, keepdims=True)
                beta[:, i] = np.where(real[:, i + 1, None], np.log(np.exp(x - top).sum(2)) + top[:, :, 0], 0.0)
            last = alpha[:, -1]
            z = np.log(np.exp(last - last.max(1, keepdims=True)).sum(1)) + last.max(1)
            p = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * real[:, :, None]
            x = alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
            pt = (np.exp(np.minimum(x, 0)) * real[:, 1:, None, None]).sum((0, 1))
            gw = np.zeros_like(self.w)
            np.add.at(gw, index, (want - p).reshape(-1, k)[place])
            for j, (a, g) in enumerate(((self.w, gw / n - l2 * self.w), (self.trans, (want_t - pt) / n - l2 * self.trans))):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                a += rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)

    def emission(self, words: list[str], i: int):
        """The score of each label at a word; words that look alike in like company share it."""
        names = self._of(words, i)
        key = "\0".join(names)
        row = self.rows.get(key)
        if row is None:
            known = [self.names[x] for x in names if x in self.names]
            row = self.w[known].sum(0)
            if len(self.rows) > 30_000:
                self.rows.clear()
            if len(key) < 10 * KEPT_WORD:
                self.rows[key] = row
        return row

    def viterbi(self, runs: list) -> list[list[int]]:
        """The best labels of each run (an array of emissions by word), all runs of about one length at a time."""
        import numpy as np

        out: list = [None] * len(runs)
        zero, stop = np.where([x.startswith("I-") for x in LABELS], -1e4, 0.0), self.trans[:, 0]
        t = self.trans + np.where(self.barred, -1e4, 0.0)
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        for a in range(0, len(order), 1000):
            part = order[a : a + 1000]
            size = np.array([len(runs[i]) for i in part])
            e = np.zeros((len(part), size.max(), len(LABELS)))
            for k, i in enumerate(part):
                e[k, : size[k]] = runs[i]
            score = e[:, 0] + self.trans[0] + zero  # the word before is "neither"
            back = np.zeros(e.shape, np.int8)
            for i in range(1, e.shape[1]):
                x = score[:, :, None] + t
                back[:, i] = x.argmax(1)
                score = np.where((i < size)[:, None], x.max(1) + e[:, i], score)
            label = (score + stop).argmax(1)
            path = np.zeros((len(part), e.shape[1]), int)
            for i in range(e.shape[1] - 1, -1, -1):
                path[:, i] = label
                if i:
                    label = np.where(i < size, back[np.arange(len(part)), i, label], label)
            for k, i in enumerate(part):
                out[i] = path[k, : size[k]].tolist()
        return out


def runs_of(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words that may be tagged, as spans; one forward pass, whatever the lengths of words."""
    out: list[list[tuple[int, int]]] = []
    end = -1
    for m in _TRIGGER.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        low = max(end, 0)
        while start > low and not text[start - 1].isspace():
            start -= 1
        stop = _BLANK.search(text, m.end())
        stop = stop.start() if stop else len(text)
        if out and end >= 0 and text[out[-1][-1][1] : start].isspace():
            out[-1].append((start, stop))
        else:
            out.append([(start, stop)])
        end = stop
    return out


_TRIGGER = re.compile("[0-9@]")
_BLANK = re.compile(r"\s")


def word_before(text: str, at: int) -> str:
    """The word that ends before the blanks before ``at``."""
    while at and text[at - 1].isspace():
        at -= 1
    start = at
    while start and not text[start - 1].isspace():
        start -= 1
    return text[start:at]


def touched(spans: list[tuple[int, int]]):
    """A test whether (a, b) overlaps any of ``spans``: of those that begin before b, does one end after a?"""
    from bisect import bisect_left
    from itertools import accumulate

    spans = sorted(spans)
    starts, ends = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def test(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k > 0 and ends[k - 1] > a

    return test


class Finder:
    """Base spans and the field's spans of batches of texts."""

    def __init__(self, field: Field):
        self.field = field

    def find(self, texts: list[str]) -> list[dict[str, list[tuple[int, int, bool]]]]:
        import numpy as np

        runs, owners, found = [], [], []
        for i, text in enumerate(texts):
            found.append({k: [(a, b, True) for a, b in v] for k, v in base_spans(text).items()})
            for run in runs_of(text):
                words = [text[a:b] for a, b in run]
                context = [word_before(text, run[0][0]), *words]
                runs.append(np.array([self.field.emission(context, j + 1) for j in range(len(words))]))
                owners.append((i, run))
        last, test = -1, None
        for (i, run), labels in zip(owners, self.field.viterbi(runs), strict=True):
            for kind, a, b in _spans(texts[i], run, labels):
                if i != last:  # the runs of a text follow each other
                    last, test = i, touched([(x, y) for spans in found[i].values() for x, y, base in spans if base])
                if not test(a, b):
                    found[i][kind].append((a, b, False))
        return found


def _spans(text: str, run: list[tuple[int, int]], labels: list[int]) -> Iterator[tuple[str, int, int]]:
    j = 0
    while j < len(run):
        if LABELS[labels[j]].startswith("B-"):
            kind, k = LABELS[labels[j]][2:], j + 1
            while k < len(run) and LABELS[labels[k]] == f"I-{kind}":
                k += 1
            a, b = run[j][0], run[k - 1][1]
            while a < b and not (text[a].isalnum() or text[a] in "+("):
                a += 1
            while a < b and not text[b - 1].isalnum():
                b -= 1
            if a < b:
                yield kind, a, b
            j = k
        else:
            j += 1


def train() -> Field:
    field = Field()
    field.fit(training_table())
    return field


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row per row of ``df``: id, spans (kind, start, end, base), by kind as listed and then by start."""
    field = field or train()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        finder = Finder(field)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [[{"kind": k, "start": a, "end": b, "base": base} for k in KINDS for a, b, base in sorted(f[k])] for f in finder.find(part.column(1).to_pylist())]
                yield pa.record_batch([part.column(0), pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])))], names=["id", "spans"])

    docs = df.select(df[id_col].alias("id"), text_of(df, text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), f"id {kind}, spans array<struct<kind: string, start: long, end: long, base: boolean>>").withColumnRenamed("id", id_col)
