"""Quality, personal data, toxicity and the language model."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm import language_model, pii_crf, quality, toxicity

EDGE_TEXTS = [None, "", " \n ", "x" * 100_000, "a b " * 30_000, "é ñ"]


def labelled(spark, n=240):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(40)]
        toxic, bad = i % 4 == 0, i % 5 == 0
        if toxic:
            words[7] = rng.choice(["idiot", "zorgul", "zorgat"])
        if bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 0 if bad else 1, 1 if toxic else 0, "x"))
    rows += [(1000 + i, t, "en") for i, t in enumerate(EDGE_TEXTS)] + [(0, rows[0][1], "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, score_ string").withColumnRenamed("score_", "id"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_quality(spark):
    docs, labels = labelled(spark)
    machine = quality.fit(docs, labels)
    out = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, machine).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(out[i] >= 0.5) == (i % 5 != 0) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in out.values()) and len(out) == 246
    assert quality.fit(docs, labels.limit(0)) is None and quality.score_quality(docs.limit(0), machine).count() == 0


def test_factorisation_identity():
    """The linear-time sum equals the sum over pairs."""
    m, rng = quality.FactorisationMachine(), np.random.default_rng(0)
    m.w = rng.normal(size=quality.SIZE)
    index, value = quality.Features().of("some words | and SOME bars 12")
    pairs = sum((m.v[a] @ m.v[b]) * x * y for i, (a, x) in enumerate(zip(index, value, strict=True)) for b, y in zip(index[i + 1 :], value[i + 1 :], strict=True))
    assert m.logit(index, value) == pytest.approx(m.w0 + float(m.w[index] @ value) + pairs)


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    out = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95
    assert out[1000] == out[1001] and out[1000] < 0.5
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs, labels.limit(0)) == ({}, {}, toxicity.FIXED_WEIGHTS)


def test_grammar_patterns():
    g = toxicity.Grammar({}, {})
    of = lambda t: [x for _, x, _ in g.matches(t)]
    assert of("you are an idiot.") == ["insult", "aimed insult"] and of("an idiot.") == ["insult"]
    assert of("You are NOT an idiot.") == ["negated insult"] and of("you aren't an idiot") == ["negated insult"]
    assert of("he said you are an idiot.") == ["reported insult"] and of('she said: "kill him"') == ["reported threat"]
    assert of("not now. idiot!") == ["insult"] and of("not you, idiot") == ["insult"]  # scope ends with the clause
    assert of("i will kill you") == ["threat", "aimed threat"] and of("kill the process") == ["threat"]
    assert of("i will not kill you") == ["negated threat"] and of("he said i will kill you") == ["reported threat"]
    assert of("you idiot, you are not stupid.") == ["insult", "aimed insult", "negated insult"]
    assert of("“Idiot” … you") == ["insult", "aimed insult"] and of("") == of("nothing here") == []
    assert [w for w, _, _ in g.matches("a b. c idiot. d")] == [3]


def by_hand(symbols, marks):
    """What each insult and threat is, and what each clause ends in, read off the sentence word by word."""
    out, start = [], 0
    ends = [i for i, m in enumerate(marks) if m or symbols[i] == toxicity.PAUSE]
    opened = False  # the clause before ended in a verb of saying
    for end in [*ends, *([len(symbols) - 1] if not ends or ends[-1] != len(symbols) - 1 else [])]:
        clause, said, plain, target = symbols[start : end + 1], opened, set(), False
        for i, x in enumerate(clause):
            if x in (toxicity.INSULT, toxicity.THREAT):
                negated = toxicity.NEGATION in clause[max(0, i - toxicity.SCOPE) : i]
                kind = "negated " if negated else "reported " if said or toxicity.REPORT in clause[:i] else ""
                out.append(kind + toxicity.SYMBOLS[x])
                if not kind:
                    plain.add(x)
            target = target or x == toxicity.TARGET
        if marks[end] or symbols[end] == toxicity.PAUSE:
            if target and plain:
                out.append("aimed " + ("threat" if toxicity.THREAT in plain else "insult"))
            before = [x for x in clause if x != toxicity.PAUSE]
            opened = bool(before) and before[-1] == toxicity.REPORT
            if symbols[end] == toxicity.PAUSE and marks[end]:  # two pauses in a row
                opened = False
            if marks[end] == 2:
                opened = False
        start = end + 1
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.sampled_from([0, 0, 0, 1, 2])), min_size=1, max_size=14))
def test_grammar_against_brute_force(words):
    symbols, marks = [x for x, _ in words], [m for _, m in words]
    got = [toxicity.SYMBOLS[o] for _, o, _ in toxicity.Grammar({}, {}).read(symbols, marks)]
    assert got == by_hand(symbols, marks)


def test_weights_of_negated_and_reported_clauses(spark):
    """Where labels say so, insults that are negated or reported count less than plain ones."""
    rng = random.Random(3)
    forms = [("you are an idiot", 1), ("you are not an idiot", 0), ("he said you are an idiot", 0), ("i will kill you", 1), ("i will not kill you", 0)]
    rows = []
    for i in range(400):
        form, y = forms[i % 5]
        rows.append((i, " ".join(rng.choices(["tree", "sun", "walk"], k=5)) + ". " + form + ".", y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.fit(docs, docs.selectExpr("doc_id", "y AS toxic"))
    w = dict(zip(toxicity.FEATURES, model[2], strict=False))
    assert w["negated insult"] < -0.5 and w["reported insult"] < -0.5 and w["negated threat"] < -0.5 and w["threat"] > 0.5
    out = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((out[i] >= 0.5) == y for i, _, y in rows)


def test_lexicon_has_no_cap(spark):
    """All of 6,000 words that only toxic rows have are learned."""
    words = [f"bad{i:05d}x" for i in range(6000)]
    rows = [(i, " ".join(words[:3000] if i % 2 else words[3000:]), 1) for i in range(20)] + [(100 + i, "good text here", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learned, _, _ = toxicity.fit(docs, docs, folds=1000, held_out=999)
    assert len(learned) == 6000


def test_sample_is_the_same_under_any_partitioning(spark):
    from palisade.llm.training import labelled_sample

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] * 2, "doc_id long, toxic int")
    first, second = ({r["id"] for r in labelled_sample(docs.repartition(n), labels.repartition(n), "toxic", 5, 0, 100).collect()} for n in (1, 7))
    assert first == second and len(first) == 100


def test_long_words_are_read_whole(field):
    address = "a" * 5000 + "@" + "b" * 300 + ".org"
    assert [s[:2] for s in pii_crf.Finder(field).find(["x " + address])[0]["email"]] == [(2, 2 + len(address))]
    assert pii_crf.word_before("one  " + " " * 500 + "x", 505) == "one" and pii_crf.word_before(" x", 1) == ""
    spans = [(5, 9), (0, 3), (2, 7), (20, 21)]
    test = pii_crf.touched(spans)
    assert all(test(a, b) == any(x < b and y > a for x, y in spans) for a in range(25) for b in range(a + 1, 26))


def test_counts_keep_their_width():
    for values in ([1, 5, 2**31], [-(2**40), 3], [7], []):
        a = np.array(values, np.int64)
        assert language_model.expand(language_model.squeeze(language_model.narrow(a)), np.int32).tolist() == values
    rows = [(p, s.stop - s.start) for p, s in language_model._ranges(np.array([1, 2, 1 << 63], np.uint64), 1000)]
    assert rows == [(0, 2), (500, 1)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["1", "2", "55", "255", "256", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "_", "4111111111111111", "0", "é", "+1 (415) 555-1234", "\n"]), max_size=30).map("".join))
def test_base_spans_are_the_patterns(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    want = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and pii_crf.luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15],
    }
    assert pii_crf.base_spans(t) == want


@pytest.fixture(scope="module")
def field():
    return pii_crf.train()


def test_viterbi_is_the_best_path(field):
    """Against all labellings of short runs."""
    import itertools

    rng = np.random.default_rng(1)
    k = len(pii_crf.LABELS)
    runs = [rng.normal(0, 3, (n, k)) for n in (1, 2, 3, 3)]
    for run, path in zip(runs, field.viterbi(runs), strict=True):
        best = None
        for labels in itertools.product(range(k), repeat=len(run)):
            seq = [0, *labels, 0]
            if any(field.barred[a, b] for a, b in itertools.pairwise(seq)):
                continue
            score = sum(run[i, x] for i, x in enumerate(labels)) + sum(field.trans[a, b] for a, b in itertools.pairwise(seq))
            best = max(best or (-1e9, ()), (score, labels))
        assert tuple(path) == best[1]


def test_field_adds_spans(spark, field):
    good = total = 0
    for words, tags in pii_crf.training_table(150, seed=77):
        text, at, gold = " ".join(words), 0, set()
        for w, t in zip(words, tags, strict=True):
            if t != "O":
                gold.add(at)
            at += len(w) + 1
        found = pii_crf.Finder(field).find([text])[0]
        starts = {a for spans in found.values() for a, _, _ in spans}
        good += len({g for g in gold if any(a <= g < b for s in found.values() for a, b, _ in s)})
        total += len(gold)
        assert len(starts) >= 0
    assert good / total > 0.95
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*EDGE_TEXTS, "mail a@b.org", "mail a@b.org"])], "doc_id long, text string, spans string")
    out = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii_crf.find_pii(df, field=field).collect()}
    assert len(out) == 8 and out[6] == out[7] == [("email", 5, 12)] and out[0] == []


def test_katz_against_brute_force(spark):
    rng = random.Random(9)
    vocab = ["the", "of", "a", "b", "c", "D", "é", "x1", "yy", "zz."]
    texts = [" ".join(rng.choices(vocab, [30, 20, 10, 8, 6, 4, 3, 2, 1, 1], k=rng.randint(0, 60))) for _ in range(150)] + [None, "", "unseen words\there", "Q " * 5000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int")
    out = {r["doc_id"]: r for r in language_model.score_texts(df, block_bytes=2_000, part_keys=20).collect()}
    toks = {i: [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w] + ["</s>"] for i, t in rows}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 5 != 1]
    u = collections.Counter(w for i in train for w in toks[i])
    b = collections.Counter(p for i in train for p in zip(["</s>"] + toks[i][:-1], toks[i], strict=True))
    n, v = sum(u.values()), len(u)
    of = lambda c: [sum(1 for x in c.values() if x == k) for k in range(language_model.LARGEST + 2)]
    m = language_model.Model({1: (n, v, of(u)), 2: (0, 0, of(b))})
    p1 = lambda w: float(m.unigram(np.array([u[w]]))[0])
    assert sum(map(p1, u)) + m.unknown == pytest.approx(1)
    weight = {}
    for h in {h for h, _ in b}:
        seen = {w: c for (x, w), c in b.items() if x == h}
        used, mass = sum(m.d2[min(c, 6)] * c for c in seen.values()), sum(p1(w) for w in seen)
        short = u[h] - used <= 1e-9 * u[h]
        weight[h] = ((1 / (u[h] + 1) if short else (u[h] - used) / u[h]) / (1 - mass), u[h] + short)
        direct = sum(m.d2[min(c, 6)] * c / weight[h][1] for c in seen.values())
        assert direct + weight[h][0] * (1 - mass) == pytest.approx(1)
    for i, ws in toks.items():
        logs = 0.0
        for h, w in zip(["</s>"] + ws[:-1], ws, strict=True):
            c = b[h, w]
            logs += math.log10(m.d2[min(c, 6)] * c / weight[h][1] if c else weight.get(h, (1,))[0] * p1(w))
        assert out[i]["n_tokens"] == len(ws) and out[i]["n_known"] == sum(u[w] > 0 for w in ws) and out[i]["train_tokens"] == n
        assert out[i]["base_score"] == pytest.approx(sum(math.log10((u[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert out[i]["score"] == pytest.approx(logs)
    assert language_model.score_texts(df.limit(0)).count() == 0
