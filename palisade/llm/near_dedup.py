"""Near-duplicates by BagMinHash signatures, banding and exact multiset overlap.

A text is the multiset of its runs of five words (ASCII letters and digits and all other characters beyond ASCII; lower case). Each run x
of multiplicity w owns a Poisson process over (weight, time): the weight axis is cut into the intervals (0, 1], (1, 2], (2, 4], ... whose
points are drawn interval by interval, so that a text sees the points below its own w and two texts share those below the smaller. Every
point falls into one of the signature's registers, which keeps the earliest; two texts agree in a register with the probability of their
weighted Jaccard similarity. Registers are grouped into bands; texts that agree in a whole band are candidates, and candidates are linked
when the exact similarity of their multisets reaches the threshold. Classes are the connected components of these links.

No group is expanded into all its pairs:
 1. texts with the same words are collapsed to one representative;
 2. in each bucket every member is held against the bucket's least member, and members that are linked so far become one component;
 3. in buckets that hold several components, every member is held against the most central member: the one with the largest share of runs
    that other members have too;
 4. what is left are strays outside a bucket's largest component. Two texts have at most those runs in common that each shares with
    anyone, summed over classes of runs, which bounds their similarity; strays whose bound is below the threshold have no link at all, and the others are held against
    those members of other components for which the bound allows one. That makes the result that of all pairs of candidates.
Which runs are shared is kept in a table of counters of fixed size, in which two runs may meet; that loosens the bound and loses nothing.

Signatures and bags are large beside ids and keys. Before they are shuffled, a broadcast bitmap of the ids or keys asked for leaves out the
rows that nothing can meet; what it lets through by chance finds no partner in the join that follows.

Null and empty texts, and those without words, are never linked: each is its own class. Rows that repeat an id with the same words are
copies of it. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, bitmap_bits, free_name, key_bitmap, materialise, text_of, tidy, with_hit
from .words import in_chunks, mix, shingle_hashes, small_batches, word_hashes

BANDS, ROWS, SHINGLE, THRESHOLD = 25, 5, 5, 0.8


def signature(values, counts, registers: int, seed: int = 1):
    """Times of the first point in each register, for a multiset of 64-bit ``values`` with integer ``counts``."""
    import numpy as np

    first = np.full(registers, np.inf)
    # One process for each value and interval of the weight axis: interval 0 is (0, 1], interval j is (2^(j-1), 2^j].
    key, rate, part = [values], [np.ones(len(values))], [np.ones(len(values))]
    low, level, above = 1, 1, counts > 1
    while above.any():
        key.append(mix(values[above] + np.uint64(level)))
        rate.append(np.full(int(above.sum()), float(low)))
        part.append(np.minimum(1.0, (counts[above] - low) / low))
        low, level = 2 * low, level + 1
        above = counts > low
    key, rate, part = np.concatenate(key), np.concatenate(rate), np.concatenate(part)
    now, step = np.zeros(len(key)), 0
    # About as many points as registers take to fill are drawn at first, then single ones until no process can come before the last register.
    need = registers * (np.log(registers) + 2)
    batch = int(np.clip(np.ceil(need / max(rate.sum(), 1e-9)), 1, 400))
    while len(key):
        with np.errstate(over="ignore"):
            salt = np.arange(step, step + batch, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)
            draw = mix(key[:, None] ^ mix(salt)[None, :])
        gap = -np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / rate[:, None]
        gap[:, 0] += now  # one addition a point, however many are drawn at once: equal draws give equal bits
        times = np.cumsum(gap, 1)
        more = mix(draw)
        register = (more % np.uint64(registers)).astype(np.int64)
        seen = (times < first.max()) & ((mix(more) >> np.uint64(12)).astype(np.float64) * 2.0**-52 < part[:, None])
        t, r = times[seen], register[seen]
        order = np.argsort(-t)
        fresh = np.full(registers, np.inf)
        fresh[r[order]] = t[order]  # the earliest is written last
        first = np.minimum(first, fresh)
        now, step = times[:, -1], step + batch
        active = now < first.max()
        key, rate, part, now = key[active], rate[active], part[active], now[active]
        batch = 1 if len(key) * 1.0 > registers else min(64, 1 + registers // max(1, len(key)))
    return first


def band_keys(first, bands: int, rows: int):
    """One 64-bit key for each band: the bits of its registers."""
    import numpy as np

    bits = first.view(np.uint64).reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, k])
    return out.view(np.int64)


def _bags(texts: list[str], n: int):
    """For each text: values and counts of its runs."""
    import numpy as np

    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    for i, j in in_chunks(raw):
        h, bounds = word_hashes(raw[i:j])
        runs, at = shingle_hashes(h, bounds, n)
        for k in range(j - i):
            yield h[bounds[k] : bounds[k + 1]], np.unique(runs[at[k] : at[k + 1]], return_counts=True)


def signatures(rows: DataFrame, bands: int, band_rows: int, n: int) -> DataFrame:
    """(rid, id, hash, words, bands): ``words`` is a 128-bit hash of the sequence of words, null where there is none."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in small_batches(batches):
            words, keys = [], []
            for h, (values, counts) in _bags(batch.column("text").to_pylist(), n):
                if not len(values):
                    words.append(None)
                    keys.append(None)
                    continue
                with np.errstate(over="ignore"):
                    place = mix(np.arange(1, len(h) + 1, dtype=np.uint64))
                    words.append(np.array([mix(h ^ place).sum(), mix(h + place * np.uint64(3)).sum()], np.uint64).tobytes() + len(h).to_bytes(4, "little"))
                keys.append(band_keys(signature(values, counts, bands * band_rows), bands, band_rows))
            yield pa.record_batch([batch.column("rid"), batch.column("id"), batch.column("hash"), pa.array(words, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["rid", "id", "hash", "words", "bands"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"rid long, id {kind}, hash binary, words binary, bands array<long>")


def multisets(rows: DataFrame, n: int) -> DataFrame:
    """(rep, total, bag): the bag is its sorted runs and their counts, as bytes."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in small_batches(batches):
            bags, totals = [], []
            for _, (values, counts) in _bags(batch.column("text").to_pylist(), n):
                bags.append(values.tobytes() + counts.astype("<u4").tobytes())
                totals.append(int(counts.sum()))
            yield pa.record_batch([batch.column("rep"), pa.array(totals, pa.int64()), pa.array(bags, pa.binary())], names=["rep", "total", "bag"])

    return rows.mapInArrow(tidy(run), "rep long, total long, bag binary")


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard of two bags."""
    import numpy as np

    def split(x):
        k = len(x) // 12
        return np.frombuffer(x, np.uint64, k), np.frombuffer(x, "<u4", k, 8 * k).astype(np.int64)

    (u, m), (v, n) = split(a), split(b)
    if not len(u) or not len(v):
        return 0.0
    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
    same = v[at] == u
    both = int(np.minimum(m[same], n[at[same]]).sum())
    return both / (int(m.sum()) + int(n.sum()) - both)


def _among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key`` is in ``wanted``, a written table of one column, and by chance some others. Nothing of ``rows`` is shuffled."""
    bits, hit = bitmap_bits(wanted.count()), free_name(rows, "_hit")
    return with_hit(rows, key, key_bitmap(wanted, wanted.columns[0], bits), hit, bits).where(F.col(hit)).drop(hit)


def verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold. Totals alone rule out many before a bag is read, and only bags of the others move."""

    def linked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in small_batches(batches, 200):
            yes = [similarity(x, y) >= threshold for x, y in zip(batch.column("ba").to_pylist(), batch.column("bb").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    size = bags.select(F.col("rep").alias("b"), F.col("total").alias("tb"))
    near = pairs.join(bags.select(F.col("rep").alias("a"), F.col("total").alias("ta")), "a").join(size, "b")
    near = materialise(near.where(F.least("ta", "tb") >= threshold * F.greatest("ta", "tb")).select("a", "b"), "near-pairs")
    left = _among(bags, "rep", near.select("a")).select(F.col("rep").alias("a"), F.col("bag").alias("ba"))
    right = _among(bags, "rep", near.select("b")).select(F.col("rep").alias("b"), F.col("bag").alias("bb"))
    both = near.join(right, "b").join(left, "a")
    return both.select("a", "b", "ba", "bb").mapInArrow(tidy(linked), "a long, b long")


def components(edges: DataFrame, name: str = "near-components") -> DataFrame:
    """(node, comp) of every node with an edge (a, b); comp is the least node it is connected to.

    In each round a node takes the least label around it and then the label of that label, so chains shorten by half. Labels only sink,
    and the rounds end when none does.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    label = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), name)
    while True:
        seen = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        moved = materialise(label.join(seen, label["node"] == seen["a"]).select("node", "comp", F.least("comp", "near").alias("next")), name)
        far = label.select(F.col("node").alias("at"), F.col("comp").alias("jump"))
        to = F.least("next", F.coalesce("jump", "next"))
        after = materialise(moved.join(far, moved["next"] == far["at"], "left").select("node", to.alias("comp"), (to != F.col("comp")).alias("changed")), name)
        label = after.select("node", "comp")
        if after.where("changed").isEmpty():
            return label


def _with_comp(df: DataFrame, label: DataFrame, node: str, out: str) -> DataFrame:
    named = label.select(F.col("node").alias(node), F.col("comp").alias(out))
    return df.join(named, node, "left").withColumn(out, F.coalesce(out, node))


def _open(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members, with their components, of buckets that hold several components."""
    named = materialise(_with_comp(members, label, "rep", "comp"), "near-open")
    several = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    return materialise(named.join(materialise(several, "near-open"), "key"), "near-open")


#: Bits of the number of counters (the least and the most), segments in which tasks send theirs, and classes that runs are dealt into by their hash.
COUNTER_BITS, SEGMENTS, CLASSES = (16, 26), 64, 64
#: Tasks whose counters are added up in one group.
GROUPED = 256


def _place(values, counters: int):
    import numpy as np

    return (values >> np.uint64(36)).astype(np.int64) & (counters - 1)


def shared_runs(bags: DataFrame) -> DataFrame:
    """(rep, total, common, parts): how many of a text's runs some other text of ``bags`` may have too, and how many of these by class.

    Two texts have at most as many runs in common as the smaller of both counts, summed over classes. Each task counts texts in a table of counters, eight
    for each run of ``bags`` as far as the largest table goes; tasks send it in segments that are added up in two steps, and the sums (one
    bit a counter, 8 MB at most) go to every task.
    """
    runs = bags.agg(F.sum(F.octet_length("bag") / 12)).first()[0] or 0
    counters = 1 << min(max(int(8 * runs).bit_length(), COUNTER_BITS[0]), COUNTER_BITS[1])
    part = counters // SEGMENTS

    import numpy as np
    import pyarrow as pa

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        group = TaskContext.get().partitionId() // GROUPED
        seen, some = np.zeros(counters, np.uint8), False
        for batch in small_batches(batches):
            for bag in batch.column("bag").to_pylist():
                at = np.unique(_place(np.frombuffer(bag, np.uint64, len(bag) // 12), counters))
                seen[at] = np.minimum(seen[at] + 1, 2)
                some = True
        for i in range(SEGMENTS if some else 0):
            cut = seen[i * part : (i + 1) * part]
            if cut.any():
                yield pa.record_batch([pa.array([i]), pa.array([group], pa.int64()), pa.array([pa.compress(cut.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["segment", "group", "counts"])

    def add(key, table):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(part, np.uint8)
        for x in table.column("counts"):
            total = np.minimum(total + np.frombuffer(pa.decompress(x.as_py(), part, "zstd", asbytes=True), np.uint8), 2)
        return pa.table({"segment": pa.array([key[0].as_py()]), "group": pa.array([0], pa.int64()), "counts": pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary())})

    kind = "segment long, group long, counts binary"
    with arrow_rows(bags.sparkSession):
        sums = bags.select("bag").mapInArrow(tidy(count), kind).groupBy("segment", "group").applyInArrow(add, kind).groupBy("segment").applyInArrow(add, kind).collect()
    unpack = lambda x: np.packbits(np.frombuffer(pa.decompress(bytes(x), part, "zstd", asbytes=True), np.uint8) > 1).tobytes()
    bits = {r["segment"]: unpack(r["counts"]) for r in sums}
    table = bags.sparkSession.sparkContext.broadcast(b"".join(bits.get(i, bytes(part // 8)) for i in range(SEGMENTS)))

    def share(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        packed = np.frombuffer(table.value, np.uint8)
        for batch in small_batches(batches):
            out, parts = [], []
            for bag in batch.column("bag").to_pylist():
                k = len(bag) // 12
                values = np.frombuffer(bag, np.uint64, k)
                at = _place(values, counters)
                also = (packed[at >> 3] >> (7 - (at & 7))) & 1 == 1
                counts = np.frombuffer(bag, "<u4", k, 8 * k)[also]
                out.append(int(counts.sum()))
                parts.append(np.bincount((values[also] % np.uint64(CLASSES)).astype(np.int64), weights=counts, minlength=CLASSES).astype(np.int64))
            cols = [batch.column("rep"), batch.column("total"), pa.array(out, pa.int64()), pa.array(parts, pa.list_(pa.int64()))]
            yield pa.record_batch(cols, names=["rep", "total", "common", "parts"])

    return bags.select("rep", "total", "bag").mapInArrow(tidy(share), "rep long, total long, common long, parts array<long>")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = SHINGLE, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """One row per row of ``df``: id, class_id (the least id of its class), class_size, copies (rows with the same words), kept, text_hash."""
    text = text_of(df, text_col)
    rows = df.select(F.monotonically_increasing_id().alias("rid"), df[id_col].alias("id"), F.unhex(F.md5(text)).alias("hash"), text.alias("text"))
    signed = materialise(signatures(rows, bands, band_rows, n), "near-signatures")
    # 1. Texts with the same words: one row stands for all. Rows without words stand for themselves.
    reps = materialise(signed.where("words is not null").groupBy("words").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies")), "near-reps")
    stand = _standing(signed.where("words is not null"), reps)
    spread = stand.select("rep", F.explode("bands").alias("key"))
    buckets = spread.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("least"))
    buckets = materialise(buckets.where("members > 1").drop("members"), "near-buckets")
    members = materialise(_among(spread, "key", buckets.select("key")).join(buckets, "key"), "near-members")
    wanted = stand.select("rep", "hash").join(members.select("rep").distinct(), "rep", "left_semi")
    bags = materialise(multisets(_texts(df.select(F.unhex(F.md5(text)).alias("hash"), text.alias("text")), materialise(wanted, "near-wanted")), n), "near-bags")
    # 2. Every member against the least of its bucket.
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    tried = materialise(members.where("rep != least").select(*pair("rep", "least")).distinct(), "near-tried")
    edges = materialise(verified(tried, bags, threshold), "near-edges")
    label = components(edges)
    # 3. Against the most central member of buckets that hold several components.
    open_ = _open(members, label)
    shares = materialise(shared_runs(_among(bags, "rep", materialise(open_.select("rep").distinct(), "near-open"))), "near-shares")
    open_ = open_.join(shares, "rep").where(F.col("common") >= threshold * F.col("total"))
    open_ = materialise(open_, "near-open")
    central = materialise(open_.groupBy("key").agg(F.max_by("rep", F.col("common") / F.col("total") - F.col("rep") * 1e-18).alias("other")), "near-central")
    leader = _with_comp(open_.join(central, "key"), label, "other", "theirs").where("comp != theirs").select(*pair("rep", "other")).distinct()
    leader = materialise(leader.join(tried, ["a", "b"], "left_anti"), "near-tried")
    edges = edges.union(materialise(verified(leader, bags, threshold), "near-edges"))
    label = components(edges)
    # 4. Strays that may still have a link, against members of other components with which the bound allows one.
    open_ = _open(open_.drop("comp"), label)
    w = Window.partitionBy("key").orderBy(F.desc("m"), "comp")
    main = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")).withColumn("main", F.row_number().over(w) == 1)
    strays = open_.join(materialise(main.where("not main").select("key", "comp"), "near-main"), ["key", "comp"]).select("key", F.col("rep").alias("x"), F.col("comp").alias("cx"), F.col("total").alias("nx"), F.col("common").alias("sx"), F.col("parts").alias("px"))
    rest = open_.select("key", F.col("rep").alias("y"), F.col("comp").alias("cy"), F.col("total").alias("ny"), F.col("common").alias("sy"), F.col("parts").alias("py"))
    enough = lambda most: most >= threshold * (F.col("nx") + F.col("ny") - most)
    by_class = F.aggregate(F.zip_with("px", "py", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda a, x: a + x)
    may = (F.col("cx") != F.col("cy")) & enough(F.least("sx", "sy")) & enough(by_class)
    left = strays.join(rest.withColumnRenamed("key", "key2"), (F.col("key") == F.col("key2")) & may).select(*pair("x", "y")).distinct()
    left = left.join(tried, ["a", "b"], "left_anti").join(leader, ["a", "b"], "left_anti")
    last = materialise(verified(left, bags, threshold), "near-edges")
    if not last.isEmpty():
        label = components(edges.union(last))
    # Classes over all rows.
    named = materialise(_with_comp(reps, label, "rep", "comp").select("words", "copies", "comp"), "near-named")
    plain = signed.select("rid", "id", "hash", "words")
    rowwise = materialise(plain.join(named, "words", "left").withColumn("comp", F.coalesce("comp", "rid")).drop("words"), "near-rows")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
    classes = materialise(rowwise.groupBy("comp").agg(least.alias("least"), F.count(F.lit(1)).alias("class_size")), "near-classes")
    return rowwise.join(classes, "comp").select(
        F.col("id").alias(id_col), F.col("least.id").alias("class_id"), "class_size", F.coalesce("copies", F.lit(1)).alias("copies"), (F.col("rid") == F.col("least.rid")).alias("kept"), F.col("hash").alias("text_hash")
    )


def _standing(signed: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, hash, bands) of the rows that stand for their words. Only rows whose words may repeat are shuffled."""
    copied = reps.where("copies > 1").select("words")
    bits = bitmap_bits(copied.count())
    bitmap = key_bitmap(copied, "words", bits)
    seen = with_hit(signed.select("rid", "hash", "bands", "words"), "words", bitmap, "hit", bits)
    some = with_hit(reps.select("rep", "words"), "words", bitmap, "hit", bits).where("hit").select("rep")
    first = seen.where("hit").join(some, F.col("rid") == F.col("rep"), "left_semi")
    return seen.where("not hit").unionByName(first).select(F.col("rid").alias("rep"), "hash", "bands")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, text) for the hashes of ``wanted``; texts of other rows are not shuffled, and copies are merged before they are."""
    hits = with_hit(rows, "hash", key_bitmap(wanted, "hash"), "hit").where("hit").drop("hit").dropDuplicates(["hash"])
    return hits.join(wanted, "hash").select("rep", "text")


def deduplicate_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, one of each class, all columns kept. Rows of classes of one are never shuffled."""
    groups = near_groups(df, id_col, text_col)
    key, hit = free_name(df, "_key"), free_name(df, "_hit")
    at = lambda i, h: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("")), F.hex(h))
    dropped = materialise(groups.where("not kept").select(at(F.col(id_col), F.col("text_hash")).alias(key)).distinct(), "near-dropped")
    stay = groups.where("kept").select(at(F.col(id_col), F.col("text_hash")).alias(key)).distinct().join(dropped, key, "left_semi")
    gone = materialise(dropped.join(stay, key, "left_anti"), "near-dropped")
    keyed = df.withColumn(key, at(df[id_col], F.unhex(F.md5(text_of(df, text_col)))))
    marked = with_hit(keyed, key, key_bitmap(dropped, key), hit)
    alone, some = marked.where(~F.col(hit)).drop(hit, key), marked.where(F.col(hit)).drop(hit)
    # Repeated rows, of which one stays, have the same key.
    repeated = some.join(stay, key, "left_semi").dropDuplicates([key]).drop(key)
    others = some.join(gone, key, "left_anti").join(stay, key, "left_anti").drop(key)
    return alone.unionByName(repeated).unionByName(others)
