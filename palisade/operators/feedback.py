"""Scoring against labelled values, and what people's corrections and past runs say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_key(value: Column) -> Column:
    """A value as it is compared: no invisible characters, no accents, lower case, other marks as single blanks."""

    @F.pandas_udf("string")
    def plain(x):
        bare = x.str.normalize("NFKC").str.normalize("NFD")
        return bare.str.replace("[̀-ͯ]", "", regex=True)

    seen = F.regexp_replace(value, "[​-‏⁠﻿]", "")
    ascii_only = F.octet_length(seen) == F.char_length(seen)
    bare = F.when(ascii_only, seen).otherwise(plain(F.when(~ascii_only, seen)))
    return F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "))


def same_value(found: Column, gold: Column) -> Column:
    """Do two keys speak of the same thing? One holds the other, half of the gold words are found, or one's digits hold most of the other's."""
    words = lambda k: F.array_distinct(F.split(k, " "))
    digits = lambda k: F.regexp_replace(k, "[^0-9]", "")
    inside = F.contains(found, gold) | F.contains(gold, found)
    half = 2 * F.size(F.array_intersect(words(found), words(gold))) >= F.size(words(gold))
    a, b = digits(found), digits(gold)
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    number = (short >= 5) & (short >= 0.6 * long) & (F.contains(a, b) | F.contains(b, a))
    return (found != "") & (gold != "") & (inside | half | number)


def matched(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Pairs of found and gold values of a text that match: doc_id, found_type, found, gold_type, gold. Both inputs have doc_id, entity_type, value."""
    a = found.select("doc_id", F.col("entity_type").alias("found_type"), F.col("value").alias("found")).distinct().withColumn("fk", match_key(F.col("found")))
    b = gold.select(F.col("doc_id").alias("gd"), F.col("entity_type").alias("gold_type"), F.col("value").alias("gold")).distinct().withColumn("gk", match_key(F.col("gold")))
    return a.join(b, (F.col("doc_id") == F.col("gd")) & same_value(F.col("fk"), F.col("gk"))).select("doc_id", "found_type", "found", "gold_type", "gold")


def accuracy(found: DataFrame, gold: DataFrame) -> DataFrame:
    """By type: found, gold, tp, recalled, prec, recall, f1. A gold value that any type found is recalled; a found value of four characters or
    more that matches gold of another type only is no false positive of its own type, and no true one."""
    pairs = matched(found, gold)
    values = lambda df: df.select("doc_id", "entity_type", "value").distinct()
    own = pairs.where("found_type = gold_type").select("doc_id", F.col("found_type").alias("entity_type"), F.col("found").alias("value")).distinct().withColumn("own", F.lit(1))
    other = pairs.where("found_type <> gold_type AND length(found) >= 4").select("doc_id", F.col("found_type").alias("entity_type"), F.col("found").alias("value")).distinct().withColumn("other", F.lit(1))
    key = ["doc_id", "entity_type", "value"]
    f = values(found).join(own, key, "left").join(other, key, "left").groupBy("entity_type").agg(F.count(F.lit(1)).alias("found"), F.count("own").alias("tp"), F.count(F.when(F.col("own").isNull() & F.col("other").isNull(), 1)).alias("fp"))
    hit = pairs.select("doc_id", F.col("gold_type").alias("entity_type"), F.col("gold").alias("value")).distinct().withColumn("hit", F.lit(1))
    g = values(gold).join(hit, key, "left").groupBy("entity_type").agg(F.count(F.lit(1)).alias("gold"), F.count("hit").alias("recalled"))
    out = f.join(g, "entity_type", "full").na.fill(0)
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("recalled") / F.greatest("gold", F.lit(1))
    return out.select("entity_type", "found", "gold", "tp", "fp", "recalled", F.round(p, 6).alias("prec"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.greatest(p + r, F.lit(1e-12)), 6).alias("f1"))


def corrections(found: DataFrame, gold: DataFrame) -> DataFrame:
    """What a reviewer would write: gold values that nothing found, as CUSTOM rows with their type suggested, and found values that match none."""
    pairs = matched(found, gold)
    missed = gold.select("doc_id", "entity_type", "value").distinct().join(pairs.select("doc_id", F.col("gold_type").alias("entity_type"), F.col("gold").alias("value")).distinct(), ["doc_id", "entity_type", "value"], "left_anti")
    wrong = found.select("doc_id", "entity_type", "value").distinct().join(pairs.select("doc_id", F.col("found").alias("value")).distinct(), ["doc_id", "value"], "left_anti")
    return missed.select("doc_id", F.lit("CUSTOM").alias("detected"), F.col("entity_type").alias("suggested"), "value").unionByName(wrong.select("doc_id", F.col("entity_type").alias("detected"), F.lit("").alias("suggested"), "value"))


def action_items(feedback: DataFrame) -> DataFrame:
    """Corrections (text, detected, suggested) as patterns to act on: false positives seen twice, high from three times, and missed values, high
    from two; with up to five examples."""
    kind = F.when((F.col("detected") == "CUSTOM") & ~F.col("suggested").isin("", "CUSTOM"), "missed").when((F.col("detected") != "CUSTOM") & F.col("suggested").isin("", "CUSTOM"), "false positive")
    rows = feedback.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("about", F.when(F.col("kind") == "missed", F.col("suggested")).otherwise(F.col("detected")))
    out = rows.groupBy("kind", "about").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("text")), 1, 5), ", ").alias("examples"))
    high = F.when(F.col("kind") == "missed", F.col("n") >= 2).otherwise(F.col("n") >= 3)
    return out.where("kind = 'missed' OR n >= 2").withColumn("priority", F.when(high, "high").otherwise("medium"))


def session_accuracy(samples: DataFrame) -> DataFrame:
    """Kept of detected by type, with a suggestion: types of five or more of which under 0.7 were kept want a higher cut-off."""
    out = samples.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_correct"), 1)).alias("kept"))
    share = F.col("kept") / F.col("n")
    return out.withColumn("prec", F.round(share, 6)).withColumn("suggestion", F.when((F.col("n") >= 5) & (share < 0.7), "raise").otherwise("keep"))


def recommendations(best: DataFrame, current: dict[str, float], default: float = 0.65) -> DataFrame:
    """Types whose best cut-off is more than 0.02 from the one in force."""
    now = F.lit(default)
    for kind, value in current.items():
        now = F.when(F.col("entity_type") == kind, value).otherwise(now)
    return best.where("threshold IS NOT NULL").withColumn("current", now).withColumn("change", F.round(F.col("threshold") - F.col("current"), 4)).where(F.abs("change") > 0.02).select("entity_type", "current", "threshold", "change")


def run_history(runs: DataFrame, key: str, keep: int = 100) -> DataFrame:
    """Runs with their age (1 is the latest) and whether they belong in the archive. ``key`` orders runs and is one per run."""
    day = F.date_trunc("year", F.col(key))  # ages within a year are counted apart, then years are added up, so no task holds all runs
    years = runs.groupBy(day.alias("year")).agg(F.count(F.lit(1)).alias("n"))
    later = years.select("year", (F.sum("n").over(Window.orderBy(F.desc("year"))) - F.col("n")).alias("later"))
    aged = runs.withColumn("year", day).withColumn("r", F.row_number().over(Window.partitionBy("year").orderBy(F.desc(key)))).join(F.broadcast(later), "year")
    return aged.withColumn("age", F.col("r") + F.col("later")).withColumn("archived", F.col("age") > keep).drop("year", "r", "later")


def golden_sample(found: DataFrame, per_category: int = 20) -> DataFrame:
    """A balanced choice of texts: the category is the only type or the first by name, MIXED from three types on; the difficulty grows with
    matches, types and low scores; of each category, texts at even steps of the rank by difficulty are chosen."""
    by = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_type").alias("types"), F.min("entity_type").alias("first"), F.min("score").alias("low"))
    rows = by.withColumn("category", F.when(F.col("types") >= 3, "MIXED").otherwise(F.col("first"))).withColumn("difficulty", F.round(F.col("n") + 2 * F.col("types") + 10 * (1 - F.col("low")), 4))
    w = Window.partitionBy("category")
    ranked = rows.withColumn("total", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy("difficulty", "doc_id")) - 1)
    step = lambda r: F.floor(r * per_category / F.greatest("total", F.lit(per_category)))
    return ranked.where((F.col("r") == 0) | (step(F.col("r")) > step(F.col("r") - 1))).select("doc_id", "category", "difficulty")


def bio_tags(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Tokens (doc_id, s, e, value) with tags: B- where a span begins in the token, I- where one goes on, O elsewhere; of several spans the
    one that begins first counts, the longest and the first by type among equals."""
    on = (F.col("doc_id") == F.col("d")) & (F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e"))
    other = spans.select(F.col("doc_id").alias("d"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("entity_type").alias("kind")).distinct()
    best = F.min(F.when(F.col("s2").isNotNull(), F.struct("s2", (-F.col("e2")).alias("o"), "kind"))).alias("x")
    rows = tokens.select("doc_id", "s", "e", "value").join(other, on, "left").groupBy("doc_id", "s", "e", "value").agg(best)
    return rows.select("doc_id", "s", "e", F.col("value").alias("token"), F.when(F.col("x").isNull(), "O").when(F.col("x.s2") >= F.col("s"), F.concat(F.lit("B-"), "x.kind")).otherwise(F.concat(F.lit("I-"), "x.kind")).alias("tag"))


def augment(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1") -> DataFrame:
    """Texts changed as careless writing would: three in ten lose their commas, one in ten its capitals, one in ten has blanks doubled; which ones
    depends on the id and the seed alone."""
    draw = lambda what: F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{what}:{seed}"))), 1, 6), 16, 10).cast("double") / 16777216
    text = F.when(draw("marks") < 0.30, F.replace(F.col(text_col), F.lit(","), F.lit(""))).otherwise(F.col(text_col))
    text = F.when(draw("case") < 0.10, F.lower(text)).otherwise(text)
    return df.withColumn(text_col, F.when(draw("blanks") < 0.10, F.replace(text, F.lit(" "), F.lit("  "))).otherwise(text))
