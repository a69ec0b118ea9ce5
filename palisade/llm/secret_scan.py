"""Secret scanning over an incremental ledger of blobs, in built-in functions only.

A blob is a text under its SHA-256; every rule has a version of its own. A row of the ledger names a blob, the rule versions it was scanned
with, and what they found. A run scans only the pairs of blob and rule version that the ledger lacks, appends them, and joins the findings
back to every path (row) that holds the blob: a changed rule scans all blobs again, but with that rule alone.

Ledger rows are merged per blob when read, so rows written twice (a run repeated after a crash, two runs at once) change no result.
Null text is the empty blob, which has no findings. Repeated rows each get the findings of their blob. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, key_bitmap, materialise, one_per_key, text_of, with_hit


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # in the dialect that Java and RE2 share
    gate: tuple[str, ...] = ()  # the lower-cased text must hold one of these
    group: int = 0
    least: int = 0  # characters that the group must have
    base: bool = False


#: Fixed patterns. Kinds sort in this order where spans start alike.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("password", "passwd", "secret", "token", "apikey", "api_key"), 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", ("akia",), 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", (), 0, 32, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", ("aiza",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("private key-----",)),
)

_FINDING = T.StructType([T.StructField("rule", T.StringType()), T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rules", T.ArrayType(T.StringType())), T.StructField("findings", T.ArrayType(_FINDING))])


def rule_version(rule: Rule) -> str:
    import hashlib

    return hashlib.sha256(repr(rule).encode()).hexdigest()[:16]


def _none(kind: T.DataType) -> Column:
    return F.from_json(F.lit("[]"), kind)


def _found(text: Column, rule: Rule) -> Column:
    """All matches with code-point offsets: what the pattern takes out and what it leaves alternate, so their lengths add up.

    An array is copied whenever it grows, so matches gather in runs of about the square root of their number.
    """
    rx = F.lit(rule.pattern)
    whole, rest = F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, rule.pattern, -1)
    part = F.regexp_extract_all(text, rx, F.lit(rule.group)) if rule.group else whole
    cells = F.arrays_zip(F.transform(whole, F.char_length).alias("w"), F.transform(part, F.char_length).alias("g"), F.transform(rest, F.char_length).alias("r"))
    none, runs = _none(T.ArrayType(_FINDING)), _none(T.ArrayType(T.ArrayType(_FINDING)))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["r"].cast("long")
        end = start + F.coalesce(x["w"], F.lit(0)).cast("long")
        one = F.array(F.struct(F.lit(rule_version(rule)).alias("rule"), start.alias("start"), F.lit(rule.kind).alias("kind"), end.alias("end"), F.lit(rule.base).alias("base")))
        keep = x["w"].isNotNull() & (x["g"] >= rule.least)
        full = F.size(acc["run"]) >= acc["most"]
        grown = F.when(keep & full, one).when(keep, F.concat(acc["run"], one)).otherwise(acc["run"])
        done = F.when(keep & full, F.concat(acc["runs"], F.array(acc["run"]))).otherwise(acc["runs"])
        return F.struct(end.alias("at"), acc["most"].alias("most"), grown.alias("run"), done.alias("runs"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.ceil(F.sqrt(F.size(whole))).cast("int").alias("most"), none.alias("run"), runs.alias("runs"))
    spans = F.aggregate(cells, start, step, lambda acc: F.flatten(F.concat(acc["runs"], F.array(acc["run"]))))
    gate = F.lit(False)
    for word in rule.gate:
        gate = gate | F.contains(F.lower(text), F.lit(word))
    return F.when(gate if rule.gate else text.rlike(rule.pattern), spans).otherwise(none)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text) to rows of the ledger; where there is a column ``rules``, a blob is scanned with the versions it names alone."""
    every = F.array(*[F.lit(rule_version(r)) for r in rules])
    some = "rules" in blobs.columns
    cols = [_found(F.col("text"), r) for r in rules]
    if some:
        cols = [F.when(F.array_contains("rules", rule_version(r)), c).otherwise(_none(T.ArrayType(_FINDING))) for r, c in zip(rules, cols)]
    return blobs.select("blob", (F.col("rules") if some else every).alias("rules"), F.concat(*cols).alias("findings"))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``df``: id, blob, findings in order of start, then of the rules.

    ``ledger`` is the path of the ledger, by default a new one in the shared folder; new pairs are appended to it. Texts are hashed where
    they are read; of blobs that the ledger knows in full they are not moved, but for those that share a bit of a fixed bitmap with an
    unseen one. Texts of blobs that occur once in a first run are scanned where they are read. The join back is on the blob alone, has no
    aggregate above it and reads only blobs with findings, so a blob that a third of all rows share is split by the adaptive skew join.
    """
    spark = df.sparkSession
    text = text_of(df, text_col)
    rows = df.select(df[id_col].alias("id"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))
    paths = materialise(rows.select("id", "blob"), "secret-paths")
    counts = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("n"))
    current = F.array(*[F.lit(rule_version(r)) for r in rules])
    known = _read(spark, ledger)
    if known is None:
        todo = one_per_key(rows.select("blob", "text"), "blob", counts)
    else:
        done = known.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("done"))
        unseen = F.array_except(current, F.coalesce("done", F.array().cast("array<string>")))
        unseen = materialise(counts.join(done, "blob", "left").select("blob", "n", unseen.alias("rules")).where(F.size("rules") > 0), "secret-unseen")
        near = with_hit(rows.select("blob", "text"), "blob", key_bitmap(unseen, "blob"), "hit").where("hit").drop("hit")
        todo = one_per_key(near, "blob", unseen).join(unseen.select("blob", "rules"), "blob")
    ledger = ledger or fresh_path(spark, "secret-ledger")
    scan(todo, rules).write.mode("append").parquet(ledger)
    valid = F.filter(F.flatten(F.collect_set("findings")), lambda x: F.array_contains(current, x["rule"]))
    ranked = lambda x: F.struct(x["start"].alias("start"), (F.array_position(current, x["rule"]) - 1).cast("int").alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base"))
    seen = _read(spark, ledger).where(F.size("findings") > 0).groupBy("blob").agg(F.array_sort(F.transform(F.array_distinct(valid), ranked)).alias("findings"))
    found = paths.join(seen, "blob", "left")
    return found.select(F.col("id").alias(id_col), "blob", F.coalesce("findings", F.array().cast(seen.schema["findings"].dataType)).alias("findings"))


def _read(spark, path: str | None) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    if path is None:
        return None
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException:  # the first run: there is no ledger yet
        return None
