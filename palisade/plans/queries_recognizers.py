"""Queries of the recognisers that check what they find; their SQL is written by hand, apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import checksums as C
from ..functions.dialect import DUCK
from ..operators import recognizers as K
from ..operators.detect import detect
from .fixtures import corpus, corpus_sql
from .queries_spans import _one, detections_sql

#: Rows beside the documents.
ROWS = (
    "see https://example.com/a?b=1, www.example.org, example.io and docs.example.co.uk:8080/x (or shop.example.xyz) but not file.txt or jane@example.com; mailto:jane@example.com ftp://ftp.example.net",
    "Jul 13, 2009 and 13th July 2009, Feb 30, 2011, 29 February 2012, Sept. 1st 2020; at 14:30, 2:45 PM, 12:05 am, 25:10, 13:00 pm, 23:59:59 and 9:75",
    "Our London office: 020 7946 0958 or +44 20 7946 0958.", "California: (415) 555-2671, 115-555-0143 and +1 212 555 0143", "Berlin +49 30 901820, Paris 01 42 68 53 00, mobile +999 1234567",
    "SSN: 219-09-9999, 000-12-3456, 000-12-3457, CPF: 529.982.247-25, 529.982.247-24, PESEL 44051401359, BSN 111222333",
)
ID_FAMILIES = ("ssn", "national_id")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).unionByName(spark.createDataFrame([(-2001 - i, x) for i, x in enumerate(ROWS)], "doc_id long, text string"))


def url_recognize(spark, sf_dir):
    return K.find_urls(_rows(spark, sf_dir))


def date_recognize(spark, sf_dir):
    return K.find_dates(_rows(spark, sf_dir))


def phone_check(spark, sf_dir):
    return K.check_phones(detect(_rows(spark, sf_dir), ("phone",))).select("doc_id", "pattern", "s", "e", "region", "verdict", "score")


def id_check(spark, sf_dir):
    return K.check_ids(detect(_rows(spark, sf_dir), ID_FAMILIES)).select("doc_id", "entity_type", "pattern", "s", "e", "value", "verdict", "score")


#: A few words for the query; a dictionary is a parameter of the operator.
WORDS = (("COMMON", "click"), ("COMMON", "signup"), ("COMMON", "purchase"), ("PERSON", "building"), ("PERSON", "machinery"), ("LOCATION", "household"), ("COMPANY", "automobile"))


def negative_words(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    found = customers.selectExpr("c_custkey AS id", "CASE c_custkey % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'LOCATION' WHEN 2 THEN 'ADDRESS' ELSE 'COMPANY' END AS entity_type", "concat(' ', c_mktsegment) AS value")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS id", "CASE event_id % 2 WHEN 0 THEN 'PERSON' ELSE 'COMPANY' END AS entity_type", "event_type AS value")
    return K.drop_negative(found.unionByName(events), spark.createDataFrame(list(WORDS), "entity_type string, word string"))


QUERIES = {f.__name__: f for f in (url_recognize, date_recognize, phone_check, id_check, negative_words)}

_VALUES = ", ".join("({}, '{}')".format(-2001 - i, x.replace("'", "''")) for i, x in enumerate(ROWS))
_SOURCE = f"{corpus_sql()} UNION ALL SELECT cast(doc_id as bigint), text FROM (VALUES {_VALUES}) AS r(doc_id, text)"
_CORPUS = f"corpus AS MATERIALIZED ({_SOURCE})"
_WEB = K.web_family()
_REGION = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(w, '{m}')" for m in marks) + f" THEN '{region}'" for region, marks in K.REGION_MARKS.items()) + " ELSE 'US' END"
_FITS = " OR ".join(
    f"(abroad AND starts_with(dg, '{code}') AND regexp_matches(substring(dg, {len(code) + 1}), '{shape}')) OR (NOT abroad AND region = '{name}' AND regexp_matches(CASE WHEN starts_with(dg, '{'1' if code == '1' else '0'}') THEN substring(dg, 2) ELSE dg END, '{shape}'))"
    for name, (code, shape) in K.PLANS.items()
)
_SHAPED = " OR ".join(f"regexp_matches(trim(value), '{rx}')" for rx in K.PHONE_SHAPES)
_HOLDS = " OR ".join(C.national_id_of(DUCK, "f", country) for country in K.ID_COUNTRIES)
_MEANT = " OR ".join(f"(v = '{w}' AND entity_type IN ({', '.join(repr(x) for x in (('LOCATION', 'ADDRESS', 'COMPANY') if k == 'COMMON' else ('LOCATION', 'ADDRESS') if k == 'LOCATION' else (k,)))}))" for k, w in WORDS)
SQL = {
    "negative_words": f"""SELECT id, entity_type, value FROM (SELECT *, lower(trim(value)) AS v FROM (
SELECT c_custkey AS id, ['PERSON', 'LOCATION', 'ADDRESS', 'COMPANY'][c_custkey % 4 + 1] AS entity_type, ' ' || c_mktsegment AS value FROM customer
UNION ALL SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'PERSON' ELSE 'COMPANY' END, event_type FROM events)) WHERE NOT ({_MEANT})""",
    "url_recognize": f"""WITH {_CORPUS} SELECT doc_id, s, e, value, CASE WHEN v LIKE 'http://%' OR v LIKE 'https://%' OR v LIKE 'ftp://%' THEN 0.95 WHEN v LIKE 'www.%' THEN 0.92 WHEN contains(v, '/') THEN 0.88 WHEN {' OR '.join(f"ends_with(v, '{x}')" for x in K.COMMON_ENDINGS)} THEN 0.85 ELSE 0.80 END::double AS score
FROM (SELECT *, lower(value) AS v FROM ({_one(DUCK, _WEB, 'web', 0.8, _WEB.patterns[0].regex)})) WHERE length(value) >= 4 AND (NOT contains(v, '@') OR v LIKE 'http%' OR v LIKE 'ftp%' OR v LIKE 'mailto%')""",
    "date_recognize": f"""WITH {_CORPUS}, c AS ({' UNION ALL '.join(_one(DUCK, K.DATES, p.name, p.score, p.regex) for p in K.DATES.patterns)}),
t AS (SELECT *, regexp_extract(value, '[0-9]+') AS a, lower(substring(regexp_extract(value, '(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)'), 1, 3)) AS mon, string_split(regexp_extract(value, '^[0-9:]+'), ':') AS p, lower(right(value, 2)) AS half FROM c),
u AS (SELECT *, CASE WHEN half IN ('am', 'pm') THEN CASE WHEN cast(p[1] as int) BETWEEN 1 AND 12 THEN cast(p[1] as int) % 12 + CASE half WHEN 'pm' THEN 12 ELSE 0 END END ELSE try_cast(p[1] as int) END AS h FROM t WHERE pattern = 'clock')
SELECT doc_id, s, e, value, score, strftime(d, '%Y-%m-%d') AS parsed FROM (SELECT *, try_strptime(concat(a, ' ', mon, ' ', right(value, 4)), '%d %b %Y') AS d FROM t WHERE pattern <> 'clock') WHERE d IS NOT NULL
UNION ALL SELECT doc_id, s, e, value, score, concat(lpad(cast(h as varchar), 2, '0'), ':', p[2], ':', coalesce(p[3], '00')) FROM u WHERE h < 24 AND cast(p[2] as int) < 60 AND coalesce(cast(p[3] as int), 0) < 60""",
    "phone_check": f"""SELECT doc_id, pattern, s, e, region, verdict, round(CASE verdict WHEN 'valid' THEN least(0.98, score + 0.15) WHEN 'possible' THEN least(0.90, score + 0.08) WHEN 'invalid' THEN score * CASE WHEN {_SHAPED} THEN 0.9 ELSE 0.75 END ELSE score END, 4) AS score
FROM (SELECT *, CASE WHEN length(dg) < 7 THEN 'unknown' WHEN {_FITS} THEN 'valid' WHEN abroad AND length(dg) <= 15 THEN 'possible' ELSE 'invalid' END AS verdict FROM (
SELECT *, {_REGION} AS region, regexp_replace(value, '[^0-9]', '', 'g') AS dg, starts_with(ltrim(value), '+') AS abroad FROM (SELECT *, lower(concat(before, value, after)) AS w FROM ({detections_sql(('phone',), _SOURCE)}))))""",
    "id_check": f"""SELECT doc_id, entity_type, pattern, s, e, value, verdict, round(CASE verdict WHEN 'valid' THEN least(0.98, score + 0.15) WHEN 'possible' THEN least(0.95, score + 0.08) ELSE score END, 4) AS score
FROM (SELECT *, CASE WHEN n < 8 THEN 'unknown' WHEN {_HOLDS} THEN 'valid' WHEN {C.luhn(DUCK, 'f')} THEN 'possible' ELSE 'unknown' END AS verdict FROM (
SELECT *, regexp_replace(upper(value), '[ \\t.-]', '', 'g') AS f, length(regexp_replace(value, '[^0-9]', '', 'g')) AS n FROM ({detections_sql(ID_FAMILIES, _SOURCE)})))""",
}
