"""Near-duplicates, decontamination, packing and the pipeline."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from palisade.llm import decontaminate, near_dedup, packing
from palisade.llm.queries import tokenizer_path


def words_of(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())


def bag(t):
    w = words_of(t)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum((a | b).values()))


def test_signature_is_unbiased():
    """The share of equal registers estimates the weighted Jaccard similarity."""
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    a[:40], b[260:] = 0, 0
    same = [np.mean(near_dedup.signature(values[a > 0], a[a > 0], 128, seed) == near_dedup.signature(values[b > 0], b[b > 0], 128, seed)) for seed in range(30)]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs(np.mean(same) - want) < 0.02


def test_classes_are_the_components(spark):
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(300)]
    base = [" ".join(rng.choices(vocab, k=80)) for _ in range(12)]
    texts = []
    for t in base:
        texts.append(t)
        for _ in range(8):
            w = t.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    texts += [base[0].upper(), base[0] + "!", None, "", "", "two words", "Two  words", "x " * 3000, "one"]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [(100, texts[0])]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, rep int")
    out = near_dedup.near_groups(df).collect()
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and jaccard(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
    least, empties = {}, sum(not x for x in bags)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), 10**9), i)
    want = collections.Counter((i, least[find(k)]) for k, (i, _) in enumerate(rows))
    assert collections.Counter((r["doc_id"], r["class_id"]) for r in out) == want
    assert empties == 3 and sum(r["kept"] for r in out) == len(least)
    kept = near_dedup.deduplicate_near(df)
    assert kept.columns == df.columns and kept.count() == len(least)
    assert near_dedup.near_groups(df.limit(0)).count() == 0


def test_only_bags_of_pairs_are_shuffled(spark):
    """Signatures and bags move where a pair asks for them and nowhere else; without broadcast joins, as on large tables."""
    import time

    rng = random.Random(9)
    vocab = ["w%d" % i for i in range(5000)]
    rows = []
    for i in range(240):
        words = rng.choices(vocab, k=300)
        other = list(words)
        for k in range(0, 1 if i < 200 else 300, 20):  # the last ones share most bands' buckets and are below the threshold
            other[k] = "new"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        time.sleep(0.3)
        spark.range(1).count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved()
        out = near_dedup.near_groups(df).collect()
        after = moved()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert sorted((r["doc_id"], r["class_id"]) for r in out if r["doc_id"] < 400) == [(k, k - k % 2) for k in range(400)]
    bytes_of_bags = 12 * sum(len(bag(t)) for _, t in rows)
    assert after - before < 4 * bytes_of_bags, (after - before, bytes_of_bags)


def test_smith_waterman():
    def plain(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        return h.max()

    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        score, start, end = decontaminate.smith_waterman(a, b)
        assert score == pytest.approx(plain(a, b) / (2 * len(a)))
        assert 0 <= start <= end <= len(b)


def test_decontamination(spark):
    rng = random.Random(6)
    vocab = ["v%d" % i for i in range(500)]
    items = [(i, " ".join(rng.choices(vocab, k=30))) for i in range(20)] + [(90, ""), (91, None), (92, "tiny item")]
    edited = items[3][1].split()
    for k in (4, 11, 19, 26):
        edited[k] = "changed"
    del edited[15]
    filler = lambda n: " ".join(rng.choices(vocab, k=n))
    rows = [(0, filler(50) + " " + items[0][1].upper() + ". " + filler(50)), (1, filler(20) + " " + " ".join(edited) + " " + filler(9)), (2, filler(3000)), (3, None), (4, ""), (5, " ".join(items[7][1].split()[:9])), (6, "a tiny item here"), (7, items[1][1] + "\n" + items[2][1])]
    rows += [(100 + i, items[5][1]) for i in range(60)] + [(100, items[5][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 1500):  # one block, several blocks
        out = decontaminate.contaminated(df, bench, block_bytes=size).collect()
        got = collections.Counter((r["doc_id"], r["item_id"]) for r in out)
        want = collections.Counter([(0, 0), (1, 3), (6, 92), (7, 1), (7, 2), *[(100 + i, 5) for i in range(60)], (100, 5)])
        assert got == want
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()) == [2, 3, 4, 5]
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_seeds_are_held_by_texts(spark):
    """A copy whose unchanged runs are exactly three words is aligned; an item that no text shares a run with has no seed."""
    item = ["w%d" % i for i in range(40)]
    copy = ["new%d" % i if i % 4 == 3 else w for i, w in enumerate(item)]
    df = spark.createDataFrame([(1, "before it " + " ".join(copy) + " after"), (2, "nothing of that sort")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "held by no text at all")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()] == [(1, 7)]
    assert decontaminate.contaminated(df.where("doc_id = 2"), bench).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    texts = ["It's the DON'T ½ x² €5 naïve ÀÉ b", "a b<|endoftext|>c", "Ω σΣ İ", "", None, "  ", "''s 's'' a'sb !!'t", "x" * 9000, "é " * 5000, "\x1c a\x1fb   c", "the quick brown fox " * 1500]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50 + i, "word " * (i % 37)) for i in range(200)] + [(50, "word")]
    out = packing.pack(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, offset int").repartition(3), tokenizer_path(), seq_len=256).collect()
    got = collections.defaultdict(dict)
    used = collections.defaultdict(list)
    for r in out:
        ids = np.frombuffer(r["ids"], "<u2").astype("<u4")
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        got[r["doc_id"], r["doc_tokens"]].setdefault(r["start"], []).append(ids.tolist())
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in used.values():  # gapless from 0, within the sequence
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 256
    for i, t in rows:
        want = library.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = got[i, len(want)]
        assert sum((pieces[s][0] for s in sorted(pieces)), []) == want
    total = sum(r["length"] for r in out)
    assert total / (256 * len(used)) > 0.95
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_words_agree_with_the_library(monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(5)
    marks = ["'", "'", "'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "'r", "'l", " ", "a", "e", "s", "it", "DON", "7", "!", "-", "\n"]
    texts = [chr(b) for b in range(256)] + [f"a{chr(b)}b" for b in range(256)] + [f"a {chr(b)}'s{chr(b)} 7" for b in range(256)]
    texts += ["".join(rng.choices(marks, k=rng.randrange(12))) for _ in range(3000)]
    texts += ["".join(chr(rng.randrange(256)) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["Ω 'tis", "caf\u0065\u0301", "x<|startoftext|>y", "", " ", "'", "'r", "'s", "\x85", "w" * 200]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    coder = packing.WordTokenizer(tokenizer_path(), most=50)
    assert coder.encode(texts) == want and coder.encode(texts) == want
    assert [coder.encode([t])[0] for t in texts[-40:]] == want[-40:] and coder.encode([]) == []
    monkeypatch.setattr(packing, "CHUNK", 20)  # longer texts are cut at blanks
    assert coder.encode(texts) == want


def test_a_word_goes_to_the_model_once(monkeypatch):
    """However many stand between its repeats, and whatever mark stands beside it; tables of parts and words asked again for most of them."""
    coder = packing.WordTokenizer(tokenizer_path(), most=100)
    asked, model = [], coder.whole.model
    monkeypatch.setattr(coder, "tokenize", lambda word: asked.append(word) or model.tokenize(word))
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(500)]
    texts = [" ".join(w + mark for w in words) for mark in (",", ".", "", "?", "'s")]
    coder.encode(texts)
    assert sorted(asked) == sorted([*words, ",", ".", "?", "'s"])
    assert packing.tokenizer_of(tokenizer_path()) is packing.tokenizer_of(tokenizer_path())  # from task to task


def test_long_texts_are_encoded_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 100)
    texts = ["one two, three " * n for n in (1, 40, 3, 0, 90, 2)]
    rows = [(i, t) for i, t in enumerate(texts)]
    want = {i: len(texts[i].split()) + texts[i].count(",") + 1 for i, _ in rows}
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), tokenizer_path()).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in out} == want


def test_packing_keeps_any_id(spark):
    df = spark.createDataFrame([("a", "one two"), (None, "three"), ("b", None)], "doc_id string, text string")
    out = packing.pack(df, tokenizer_path())
    assert {r["doc_id"] for r in out.collect()} == {"a", None, "b"} and dict(out.dtypes)["length"] == "bigint"
    big, packing.BROADCAST_ROWS = packing.BROADCAST_ROWS, 0  # the join without a broadcast
    try:
        assert sorted((r["sequence_id"], r["offset"], r["length"]) for r in packing.pack(df, tokenizer_path()).collect()) == sorted((r["sequence_id"], r["offset"], r["length"]) for r in out.collect())
    finally:
        packing.BROADCAST_ROWS = big


def test_decontamination_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "the quick brown fox jumps over it", 7.5, "k"), (2, "nothing of that kind", 1.5, "k")], "doc_id long, text string, _bad double, _key string")
    items = spark.createDataFrame([(9, "quick brown fox jumps")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.decontaminate(df, items).collect()] == [(2, "nothing of that kind", 1.5, "k")]


def test_patterns_use_the_histogram():
    rng = random.Random(1)
    hist = collections.Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    patterns = packing.shortest_pack_first(hist, 2048)
    used = collections.Counter()
    for lengths, n in patterns:
        assert sum(lengths) <= 2048 and lengths == sorted(lengths, reverse=True)
        for x in lengths:
            used[x] += n
    assert used == hist


def test_patterns_take_the_shortest_pack():
    """Longest first, one piece at a time, into the sequence with the most room."""
    assert packing.shortest_pack_first({1500: 1, 1200: 1, 500: 1}, 2048) == [([1500], 1), ([1200, 500], 1)]
    rng = random.Random(2)
    for most, n in ((2048, 3000), (60, 3000), (700, 400)):
        hist = collections.Counter(min(most, int(rng.lognormvariate(4, 1.5)) + 1) for _ in range(n))
        rooms: list[int] = []
        for length in sorted(hist.elements(), reverse=True):
            k = max(range(len(rooms)), key=rooms.__getitem__, default=None)
            if k is None or rooms[k] < length:
                rooms.append(2048 - length)
            else:
                rooms[k] -= length
        patterns = packing.shortest_pack_first(hist, 2048)
        assert sorted(2048 - sum(p) for p, count in patterns for _ in range(count)) == sorted(rooms)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    import duckdb

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == before.columns and docs.join(before, "doc_id", "left_anti").count() == 0
    rows = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    kept = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
    bags = {i: bag(rows[i]) for i in kept}
    assert all(jaccard(bags[a], bags[b]) < 0.8 for a in kept for b in kept if a < b)
    items = [" ".join(words_of(t)) for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    flat = {i: f" {' '.join(words_of(rows[i]))} " for i in rows}
    leaks = {i for i in rows if any(f" {t} " in flat[i] for t in items)}
    assert not kept & leaks
    # Every document that went is toxic, a copy of one kept or gone, or a leak.
    assert len(kept) > 0.7 * len({t.lower() for t in rows.values()}) - len(leaks)
