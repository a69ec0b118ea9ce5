"""Text normalisation, encoded payloads, labelled fields and token features, as SQL expressions and DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dialect import Spark

#: Invisible characters and dashes (fixed values).
INVISIBLE = "[​-‏⁠﻿]"
DASHES = "[‐-―]"


def normalized(d: Spark, x: str) -> str:
    """Invisible characters go, dashes become "-", runs of blanks other than line ends become one. (NFKC comes before, where needed.)"""
    blanks = "[ \t 　]{2,}|[\t 　]" if d.name == "spark" else "[ \t 　]+"  # Spark leaves single blanks where they are
    return d.replace(d.replace(d.replace(x, INVISIBLE, ""), DASHES, "-"), blanks, " ")


#: A character that NFKC may change, reorder or join with one before, told by a few ranges of letters and marks that it leaves alone (fixed values).
UNSTABLE = r"(?=[^\x00-\x7f])[^\x00-\x9f\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0400-\u0482\u2012-\u2016\u2018-\u201f\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fff\uac00-\ud7a3]"


def normalize(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with its text in NFKC and normalised. Only texts with a character that NFKC may change leave the JVM."""
    from .dialect import SPARK

    @F.pandas_udf("string")
    def nfkc(x):
        return x.str.normalize("NFKC")

    text = F.col(text_col)
    stable = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(UNSTABLE)
    composed = df.withColumn(text_col, F.coalesce(nfkc(F.when(~stable, text)), text))
    return composed.withColumn(text_col, F.expr(normalized(SPARK, f"`{text_col}`")))


def decode_scan(d: Spark, source: str = "corpus") -> str:
    """Base64, percent and hexadecimal runs that decode to printable UTF-8: (doc_id, encoding, payload, decoded)."""
    if d.name == "spark":
        b64 = "CASE WHEN length(p) % 4 = 0 THEN try_validate_utf8(try_to_binary(p, 'base64')) END"
        hexa = "CASE WHEN length(p) % 2 = 0 THEN try_validate_utf8(unhex(p)) END"
        url = "try_url_decode(p)"
    else:
        b64 = "CASE WHEN length(p) % 4 = 0 THEN TRY(decode(from_base64(p))) END"
        hexa = "CASE WHEN length(p) % 2 = 0 THEN TRY(decode(unhex(p))) END"
        url = "TRY(url_decode(p))"
    kinds = (("base64", "[A-Za-z0-9+/]{20,}={0,2}", b64, 5), ("url", "(?:%[0-9A-Fa-f]{2}){3,}", url, 3), ("hex", "(?:[0-9a-fA-F]{2}){8,}", hexa, 5))
    parts = [f"SELECT doc_id, '{k}' AS encoding, p AS payload, {dec} AS decoded, {least} AS least FROM (SELECT doc_id, {d.explode(d.extract_all('text', rx))} AS p FROM {source} WHERE {d.matches('text', rx)}) {k}" for k, rx, dec, least in kinds]
    return f"SELECT doc_id, encoding, payload, decoded FROM ({' UNION ALL '.join(parts)}) t WHERE decoded IS NOT NULL AND length(decoded) >= least AND {d.matches('decoded', '^[ -~]+$')}"


#: Labelled fields: rule, type, score, pattern with the value in group 1 (fixed values).
FIELDS = (
    ("xml name tag", "PERSON", 0.85, "(?i)<(?:first|last|full)?_?name>([^<]{2,60})</"),
    ("xml id tag", "NATIONAL_ID", 0.85, "(?i)<(?:ssn|national_?id|tax_?id)>([^<]{4,30})</"),
    ("xml document tag", "NATIONAL_ID", 0.80, "(?i)<(?:id_?card|passport|licen[cs]e)>([^<]{4,30})</"),
    ("xml address tag", "LOCATION", 0.85, "(?i)<(?:street|address|city|zip|postcode)>([^<]{2,80})</"),
    ("xml phone tag", "PHONE_NUMBER", 0.90, "(?i)<(?:phone|tel|telephone|mobile)>([^<]{7,25})</"),
    ("json name key", "PERSON", 0.80, '(?i)"(?:first_?|last_?|full_?)?name" ?: ?"([^"]{2,60})"'),
    ("json id key", "NATIONAL_ID", 0.85, '(?i)"(?:ssn|id_?number|national_?id)" ?: ?"([^"]{4,30})"'),
    ("json address key", "LOCATION", 0.80, '(?i)"(?:address|street|city)" ?: ?"([^"]{2,80})"'),
    ("json phone key", "PHONE_NUMBER", 0.88, '(?i)"(?:phone|telephone|mobile)" ?: ?"([^"]{7,25})"'),
    ("template", "PERSON", 0.75, r"(?:\{\{|<<) ?([A-Z][a-z]+(?: [A-Z][a-z]+){1,2}) ?(?:\}\}|>>)"),
    ("label name", "PERSON", 0.80, "(?:[Nn]ame|NAME): ?([A-Z][a-z]+(?: [A-Z][a-z]+){0,2})"),
    ("card holder", "PERSON", 0.85, "(?i:card|account) ?holder: ?([A-Z][a-z]+(?: [A-Z][a-z]+){1,2})"),
    ("dear", "PERSON", 0.90, "Dear ([A-Z][a-z]+(?: [A-Z][a-z]+)?),"),
    ("member", "PERSON", 0.75, "(?:team member|participant|attendee)s?:? ([A-Z][a-z]+(?: [A-Z][a-z]+){1,2})"),
    ("bold", "PERSON", 0.70, r"\*\*([A-Z][a-z]+(?: [A-Z][a-z]+){1,2})\*\*"),
    ("label city", "LOCATION", 0.80, "City: ?([A-Z][a-z]+(?: [A-Z][a-z]+)?)"),
)
STOP_VALUES = ("none", "n/a", "unknown", "null", "test", "example", "user", "admin", "company", "address", "date")


def labeled_fields(d: Spark, source: str = "corpus") -> str:
    """(doc_id, rule, entity_type, score, value) of every labelled field whose value is not a stop value or a lone capital word of form text."""
    parts = []
    for rule, kind, score, rx in FIELDS:
        parts.append(f"SELECT doc_id, '{rule}' AS rule, '{kind}' AS entity_type, cast({score} as double) AS score, {d.explode(d.extract_all('text', rx, 1))} AS value FROM {source} WHERE {d.matches('text', rx)}")
    stop = ", ".join(f"'{x}'" for x in STOP_VALUES)
    shape = f"NOT (entity_type = 'PERSON' AND {d.matches('value', '(?:ing|tion|ment|ness)$')}) AND (entity_type <> 'PHONE_NUMBER' OR length({d.replace('value', '[^0-9]', '')}) >= 7)"
    return f"SELECT doc_id, rule, entity_type, score, trim(value) AS value FROM ({' UNION ALL '.join(parts)}) t WHERE NOT lower(trim(value)) IN ({stop}) AND {shape}"


def token_features(d: Spark, source: str = "corpus") -> str:
    """Shape features of every blank-separated token, with its neighbours': the input of a token classifier."""
    toks = d.keep(d.split("text", "[ \t\n]+"), "w", "w <> ''")
    if d.name == "spark":  # neighbours are taken from the array, so no token is shuffled
        cells = f"transform({toks}, w -> w)"
        near = "transform(ts, (w, i) -> named_struct('pos', i, 'token', w, 'before', coalesce(get(ts, i - 1), ''), 'after', coalesce(get(ts, i + 1), '')))"
        rows = f"SELECT doc_id, x.pos, x.token, x.before, x.after FROM (SELECT doc_id, explode({near}) AS x FROM (SELECT doc_id, {cells} AS ts FROM {source}) p) q"
        before, after = "before", "after"
    else:
        before, after = (f"coalesce({w}(token) OVER (PARTITION BY doc_id ORDER BY pos), '')" for w in ("lag", "lead"))
        rows = f"SELECT doc_id, unnest(range(0, len(ts))) AS pos, unnest(ts) AS token FROM (SELECT doc_id, {toks} AS ts FROM {source}) p"
    count = lambda cls: f"length({d.replace('token', f'[^{cls}]', '')})"
    shape = d.replace(d.replace(d.replace("token", "[A-Z]+", "X"), "[a-z]+", "x"), "[0-9]+", "d")
    return (
        f"SELECT doc_id, cast(pos as bigint) AS pos, token, cast(length(token) as bigint) AS n_chars, cast({count('A-Z')} as bigint) AS n_upper, cast({count('0-9')} as bigint) AS n_digit, cast({count('AEIOUaeiou')} as bigint) AS n_vowel, {shape} AS shape, "
        f"{d.matches('token', '^[A-Z][a-z]+$')} AS is_title, {d.matches('token', '^[A-Z]{2,}$')} AS is_caps, {d.matches('token', '@')} AS has_at, {before} AS before, {after} AS after FROM ({rows}) r"
    )
