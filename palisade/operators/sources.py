"""Spans that come from elsewhere than the pattern catalogue: dictionaries and encoded payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.dialect import SPARK
from ..plans import dictionaries as dic
from ..plans.catalog import Catalog, Family, Pattern
from .detect import detect


def _any(terms) -> str:
    return "(?:" + "|".join(sorted(terms, key=lambda t: (-len(t), t))) + ")"


def dictionary_families() -> tuple[Family, ...]:
    """The dictionaries as families: the longest term first, anywhere in the text. Countries are found in any case, the others as written."""
    cities = tuple(Pattern(f"city_{k}", min(0.95, round(0.70 + dic.CITY_BOOST[k], 2)), rf"\b{_any(v.split('|'))}\b") for k, v in dic.CITIES.items())
    countries = (Pattern("country_name", 0.90, rf"(?i)\b{_any(dic.COUNTRIES)}\b"), Pattern("country_code", 0.90, rf"\b{_any(dic.COUNTRY_CODES)}\b"))
    first, last = _any(dic.FIRST_NAMES), _any(dic.LAST_NAMES)
    names = (Pattern("names_full", 0.80, rf"\b{first} {last}\b"), Pattern("names_single", 0.60, rf"\b{_any(dic.FIRST_NAMES + dic.LAST_NAMES)}\b"))
    return (
        Family("gazetteer_city", "LOCATION", "[A-Z]", (), cities),
        Family("gazetteer_country", "LOCATION", "[A-Za-z]", (), countries),
        Family("gazetteer_company", "COMPANY", "[A-Z]", (), (Pattern("company_name", 0.90, rf"\b{_any(dic.COMPANIES)}\b"),)),
        Family("names", "PERSON", "[A-Z]", (), names),
    )


#: Encoded runs and how they are read; decoded text of at least so many printable characters is scanned.
ENCODED = (
    ("base64", "[A-Za-z0-9+/]{20,}={0,2}", "CASE WHEN length(value) % 4 = 0 THEN try_validate_utf8(try_to_binary(value, 'base64')) END", 5),
    ("url", "(?:%[0-9A-Fa-f]{2}){3,}", "try_url_decode(value)", 3),
    ("hex", "(?:[0-9a-fA-F]{2}){8,}", "CASE WHEN length(value) % 2 = 0 THEN try_validate_utf8(unhex(value)) END", 5),
)


def encoded_spans(corpus: DataFrame, catalog: Catalog) -> DataFrame:
    """What is found in decoded payloads, from a score of 0.5 on and at 0.9 of it. The offsets are those of the payload in the text, the value
    is what was decoded."""
    runs = Family("encoded", "ENCODED", "[A-Za-z0-9+/]{16}|%[0-9A-Fa-f]{2}", (), tuple(Pattern(n, 1.0, rx) for n, rx, _, _ in ENCODED))
    decoded = "CASE pattern " + " ".join(f"WHEN '{n}' THEN CASE WHEN length({x}) >= {least} THEN {x} END" for n, _, x, least in ENCODED) + " END"
    payloads = detect(corpus, catalog=Catalog((runs,))).selectExpr("named_struct('doc_id', doc_id, 's', s, 'e', e, 'encoding', pattern) AS doc_id", f"{decoded} AS text").where("text is not null").where(SPARK.matches("text", "^[ -~]+$"))
    return detect(payloads, catalog=catalog).where("score >= 0.5").selectExpr("doc_id.doc_id AS doc_id", "family", "entity_type", "concat('encoded_', doc_id.encoding) AS pattern", "round(0.9D * score, 4) AS score", "doc_id.s AS s", "doc_id.e AS e", "value", "before", "after")
