"""Recognisers that check what they find: addresses of the web by their last label, dates and times that exist, and scores that a check changes.

Candidates come from the one scan of the text; what is decided on them is built-in functions on the rows of the scan, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checksums as C
from ..functions.dialect import SPARK
from ..plans.catalog import Catalog, Family, Pattern
from .detect import detect

#: Last labels that make a host; pass others as a parameter.
LAST_LABELS = tuple(
    "ac ae ai app ar at au be bg biz blog br ca cat ch cl cloud cn co com coop cz de dev dk edu ee es eu fi fm fr gg gov gr hk hr hu id ie il im in info int io ir is it jobs jp kr li lt lu lv me mil mobi museum mx my name net ng nl no nz online org "
    "pe ph pk pl pro pt qa ro rs ru sa se sg shop si site sk so store tech th tk to tr travel tv tw ua uk us uy vn website wiki xyz za".split()
)
#: Endings that raise the score of a bare host (fixed values).
COMMON_ENDINGS = (".com", ".org", ".net", ".io", ".co", ".edu", ".gov", ".uk", ".de", ".fr", ".ca", ".au")
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
DATES = Family("natural", "DATE_TIME", "[0-9]", (), (
    Pattern("month_day_year", 0.85, rf"(?i)\b(?:{MONTHS})[.,]?[ \t]+[0-9]{{1,2}}(?:st|nd|rd|th)?[.,]?[ \t]+[0-9]{{4}}\b"),
    Pattern("day_month_year", 0.85, rf"(?i)\b[0-9]{{1,2}}(?:st|nd|rd|th)?[ \t]+(?:{MONTHS})[.,]?[ \t]+[0-9]{{4}}\b"),
    Pattern("clock", 0.80, r"\b[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:[ \t]?[AaPp][Mm])?\b"),
))
#: Where a number of a text is from, by what stands within 200 characters of it; the first region that is named wins (fixed values).
REGION_MARKS = {
    "US": ("usa", "united states", "america", "usd", "$", "california", "new york", "texas", "florida", "illinois", "ohio", "georgia", "michigan"),
    "CA": ("canada", "canadian", "cad", "ontario", "quebec", "alberta", "british columbia", "toronto", "vancouver", "montreal"),
    "GB": ("uk", "united kingdom", "england", "scotland", "wales", "gbp", "£", "london", "manchester", "birmingham", "nhs"),
    "AU": ("australia", "australian", "aud", "sydney", "melbourne", "brisbane"),
    "DE": ("germany", "german", "deutschland", "eur", "€", "berlin", "munich"),
    "FR": ("france", "french", "paris", "lyon", "marseille"),
    "IN": ("india", "indian", "inr", "₹", "mumbai", "delhi", "bangalore"),
    "BR": ("brazil", "brazilian", "brl", "r$", "são paulo", "rio de janeiro"),
    "MX": ("mexico", "mexican", "mxn", "mexico city"),
    "JP": ("japan", "japanese", "jpy", "¥", "tokyo", "osaka"),
}
#: Country code, and what the numbering plan lets a number without code and trunk prefix look like.
PLANS = {
    "US": ("1", "^[2-9][0-9]{2}[2-9][0-9]{6}$"), "CA": ("1", "^[2-9][0-9]{2}[2-9][0-9]{6}$"), "GB": ("44", "^(?:[1-3][0-9]{8,9}|[5789][0-9]{9})$"), "AU": ("61", "^[2-478][0-9]{8}$"), "DE": ("49", "^[1-9][0-9]{6,10}$"),
    "FR": ("33", "^[1-9][0-9]{8}$"), "IN": ("91", "^[1-9][0-9]{9}$"), "BR": ("55", "^[1-9][1-9](?:9[0-9]{8}|[2-5][0-9]{7})$"), "MX": ("52", "^[1-9][0-9]{9}$"), "JP": ("81", "^[1-9][0-9]{8,9}$"),
}
#: Spellings that look like a telephone number even where the plan says no.
PHONE_SHAPES = (r"^\+[0-9]{1,3}[ \-.(]", r"^\([0-9]{2,4}\) *[0-9]", r"^[0-9]{3,4}[\-.][0-9]{3,4}[\-.][0-9]{4}", r"^00[0-9]{2,4}[\-. ]", r"^0[0-9]{3,4}[ \-][0-9]{4,6}", r"^0[0-9]{2,4}\.[0-9]{3,4}\.[0-9]{3,4}")


def web_family(labels: tuple[str, ...] = LAST_LABELS) -> Family:
    """Hosts that end in one of ``labels``, with what stands before and after; mail addresses are taken whole, to be left out."""
    last = "|".join(sorted(labels, key=lambda x: (-len(x), x)))
    return Family("web", "URL", r"[A-Za-z0-9]\.[A-Za-z]", (), (Pattern("web", 0.80, rf"(?i)\b(?:[a-z][a-z0-9+]{{1,9}}://|mailto:)?(?:[a-z0-9._%+-]+@)?(?:[a-z0-9][a-z0-9-]*\.)+(?:{last})\b(?::[0-9]{{1,5}})?(?:/[^ \t\r\n<>\"'()]*)?"),))


def find_urls(df: DataFrame, labels: tuple[str, ...] = LAST_LABELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, s, e, value, score): 0.95 with a scheme, 0.92 from ``www.``, 0.88 with a path, 0.85 with a common ending, else 0.80. Mail
    addresses and matches of under four characters are left out. Null and empty texts have none; rows that share an id keep their own."""
    found = detect(df, catalog=Catalog((web_family(labels),)), id_col=id_col, text_col=text_col)
    return found.where(is_web(F.col("value"))).select("doc_id", "s", "e", "value", web_score(F.col("value")).alias("score"))


def is_web(v: Column) -> Column:
    return (F.length(v) >= 4) & ~(F.contains(v, F.lit("@")) & ~F.lower(v).rlike("^(?:http|ftp|mailto)"))


def web_score(v: Column) -> Column:
    low, common = F.lower(v), F.lit(False)
    for x in COMMON_ENDINGS:
        common = common | low.endswith(x)
    return F.when(low.rlike("^(?:https?|ftp)://"), 0.95).when(low.startswith("www."), 0.92).when(v.contains("/"), 0.88).when(common, 0.85).otherwise(0.80)


def find_dates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, s, e, value, score, parsed): dates in words that exist, as yyyy-mm-dd, and times of day, as hh:mm:ss."""
    found = detect(df, catalog=Catalog((DATES,)), id_col=id_col, text_col=text_col)
    return found.select("doc_id", "s", "e", "value", "score", date_read(F.col("value"), F.col("pattern")).alias("parsed")).where(F.col("parsed").isNotNull())


def date_read(v: Column, pattern: Column) -> Column:
    """The day or time that a candidate of ``DATES`` names; null where there is none."""
    month = (F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.regexp_extract(v, "(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)", 1))) + 2) / 3
    day, year = F.regexp_extract(v, "(?:^|[^0-9])([0-9]{1,2})(?:[^0-9]|$)", 1), F.right(v, F.lit(4))
    date = F.date_format(F.try_to_timestamp(F.concat(year, F.lpad(month.cast("int").cast("string"), 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyyMMdd")), "yyyy-MM-dd")
    h, m, s, half = (F.regexp_extract(v, r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?:[ \t]?([AaPp])[Mm])?$", i) for i in (1, 2, 3, 4))
    hour = F.when(h != "", h.cast("int"))
    h24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(F.lower(half) == "p", 12).otherwise(0))
    known = h24.between(0, 23) & (m < "60") & ((s == "") | (s < "60")) & (h != "")
    time = F.when(known, F.concat_ws(":", F.lpad(h24.cast("string"), 2, "0"), m, F.when(s == "", "00").otherwise(s)))
    return F.when(pattern == "clock", time).otherwise(date)


def proven(found: DataFrame) -> DataFrame:
    """Rows of a scan without candidates of ``web_family`` and ``DATES`` that are none; those of the web with their score. Others stay as they are."""
    family, v = F.col("family"), F.col("value")
    is_one = F.when(family == "web", is_web(v)).when(family == "natural", date_read(v, F.col("pattern")).isNotNull()).otherwise(True)
    return found.where(is_one).withColumn("score", F.when(family == "web", web_score(v)).otherwise(F.col("score")))


def region_of(around: Column) -> Column:
    """The region that the words around a number name; the United States where they name none."""
    low, out = F.lower(around), F.lit("US")
    for region, marks in reversed(REGION_MARKS.items()):
        named = F.lit(False)
        for mark in marks:
            named = named | F.contains(low, F.lit(mark))
        out = F.when(named, region).otherwise(out)
    return out


def _plan(region: Column, value: Column) -> Column:
    """valid: the number keeps to the plan of its region, or, with a plus, of the country it names; possible: 7 to 15 digits with a plus, or
    as many as a trunk prefix would leave; else invalid."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    abroad = F.ltrim(value).startswith("+")
    fits = F.lit(False)
    for name, (code, shape) in PLANS.items():
        rest = F.regexp_replace(digits, f"^{code}", "")
        home = F.regexp_replace(digits, "^0", "") if code != "1" else F.regexp_replace(digits, "^1", "")
        fits = fits | (abroad & digits.startswith(code) & rest.rlike(shape)) | (~abroad & (region == name) & home.rlike(shape))
    return F.when(fits, "valid").when(abroad & F.length(digits).between(7, 15), "possible").otherwise("invalid")


def check_phones(found: DataFrame, only: Column | None = None) -> DataFrame:
    """``found`` with region, verdict and a changed score: valid +0.15 to 0.98 at most, possible +0.08 to 0.90 at most, invalid x0.90 where it is
    spelled like a telephone number, else x0.75. Values of under seven digits keep their score, and so do rows that ``only``, a condition, leaves out."""
    value, score = F.col("value"), F.col("score")
    shaped = F.lit(False)
    for rx in PHONE_SHAPES:
        shaped = shaped | F.trim(value).rlike(rx)
    only = F.lit(True) if only is None else only
    some = only & (F.length(F.regexp_replace(value, "[^0-9]", "")) >= 7)
    out = found.withColumn("region", F.when(only, region_of(F.concat("before", "value", "after"))))
    out = out.withColumn("verdict", F.when(some, _plan(F.col("region"), value)).otherwise("unknown"))
    verdict = F.col("verdict")
    new = F.when(verdict == "valid", F.least(F.lit(0.98), score + 0.15)).when(verdict == "possible", F.least(F.lit(0.90), score + 0.08)).when(verdict == "invalid", score * F.when(shaped, 0.90).otherwise(0.75)).otherwise(score)
    return out.withColumn("score", F.when(only, F.round(new, 4)).otherwise(score))


#: Countries whose check an identity number is held against, whatever its text says (fixed values).
ID_COUNTRIES = ("US", "GB", "DE", "BR", "IT", "ES", "PL", "SE", "NL", "BE")


def check_ids(found: DataFrame, only: Column | None = None) -> DataFrame:
    """``found`` with verdict and a changed score: a number of eight digits or more that passes the check of one of ten countries gains 0.15, to
    0.98 at most; one that passes the general check alone gains 0.08, to 0.95 at most. Rows that ``only`` leaves out keep their score."""
    only = F.lit(True) if only is None else only
    flat = found.withColumn("_flat", F.regexp_replace(F.upper("value"), "[ \\t.-]", ""))
    many = F.length(F.regexp_replace("value", "[^0-9]", "")) >= 8
    holds = F.lit(False)
    for country in ID_COUNTRIES:
        holds = holds | F.expr(C.national_id_of(SPARK, "_flat", country))
    verdict = F.when(only & many & holds, "valid").when(only & many & F.expr(C.luhn(SPARK, "_flat")), "possible").otherwise("unknown")
    score = F.when(F.col("verdict") == "valid", F.least(F.lit(0.98), F.col("score") + 0.15)).when(F.col("verdict") == "possible", F.least(F.lit(0.95), F.col("score") + 0.08)).otherwise(F.col("score"))
    return flat.withColumn("verdict", verdict).withColumn("score", F.when(only, F.round(score, 4)).otherwise(F.col("score"))).drop("_flat")


def rescored(found: DataFrame) -> DataFrame:
    """The checks of telephone and identity numbers, each on the rows of its type."""
    kind = F.col("entity_type")
    return check_ids(check_phones(found, kind == "PHONE_NUMBER").drop("region", "verdict"), kind == "NATIONAL_ID").drop("verdict")


def drop_negative(found: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of ``found`` whose value, without case and outer blanks, is no word of ``words`` (entity_type, word) for its type.

    Words of the type COMMON count for all types but PERSON, those of LOCATION for ADDRESS too. ``words`` is a dictionary, and what is
    broadcast of it is decided by its size when the query runs. Null values stay.
    """
    many = words.select(F.col("entity_type").alias("_kind"), F.lower(F.trim("word")).alias("_word")).dropDuplicates()
    kind, common = F.col("entity_type"), F.col("_kind") == "COMMON"
    meant = (F.col("_kind") == kind) | (common & (kind != "PERSON")) | ((kind == "ADDRESS") & (F.col("_kind") == "LOCATION"))
    return found.join(many, (F.lower(F.trim("value")) == F.col("_word")) & meant, "left_anti")
