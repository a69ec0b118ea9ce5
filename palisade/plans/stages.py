"""The passes over detections, as SQL over a relation ``det`` that both engines read.

``det`` has a row per match (doc_id, family, entity_type, pattern, score, s, e, value, before, after); ``corpus`` has (doc_id, text).
Each function takes a dialect and returns a query; ``operators.passes`` applies them to DataFrames. Columns of ``carried`` are handed on; with
``kept`` among them a pass drops no row, but says in that column which ones it keeps.
"""

from __future__ import annotations

from ..functions import checksums as C
from ..functions.dialect import Spark, quoted
from .catalog import DEFAULT_THRESHOLD, DENYLIST, FAMILIES, HIGH_RISK, LABELS, LOCALE_BOOSTS, MEDIUM_RISK, ROLLUP, THRESHOLDS

KEY = "doc_id, entity_type, pattern, s, e, value"


def _in(xs) -> str:
    return "(" + ", ".join(quoted(x) for x in xs) + ")"


def _more(carried: tuple[str, ...]) -> str:
    return "".join(f", {c}" for c in carried if c != "kept")


def _all(carried) -> str:
    return "".join(f", {c}" for c in carried)


def _only(columns: str, source: str, keep: str, carried: tuple[str, ...]) -> str:
    """Rows of ``source`` that ``keep`` holds for, or all of them with the condition."""
    if "kept" in carried:
        return f"SELECT {columns}{_more(carried)}, kept AND ({keep}) AS kept FROM {source}"
    return f"SELECT {columns}{_more(carried)} FROM {source} WHERE {keep}"


def _words(d: Spark, x: str) -> str:
    return d.keep(d.split(f"lower({x})", "[^a-z0-9]+"), "w", "w <> ''")


def window(d: Spark, before: int = 10, after: int = 5) -> str:
    """The lower-cased words around a match, each between blanks."""
    return f"concat(' ', {d.join(d.last_n(_words(d, 'before'), before), ' ')}, ' ', {d.join(d.first_n(_words(d, 'after'), after), ' ')}, ' ')"


def context_boost(d: Spark, carried: tuple[str, ...] = ()) -> str:
    """A context word within ten words before or five after adds 0.35, to 0.4 at least and 1 at most."""
    cases = " ".join(f"WHEN '{f.name}' THEN {d.matches('w', ' (?:' + '|'.join(c.lower() for c in f.context) + ') ')}" for f in FAMILIES if f.context)
    hit = f"(CASE family {cases} ELSE false END)"
    return f"SELECT {KEY}, family, before, after, score AS base_score, {hit} AS in_context, round(CASE WHEN {hit} THEN least(cast(1 as double), greatest(score + 0.35, cast(0.4 as double))) ELSE score END, 4) AS score{_all(carried)} FROM (SELECT *, {window(d)} AS w FROM det) t"


def denylist(d: Spark, carried: tuple[str, ...] = ()) -> str:
    return _only(f"{KEY}, family, before, after, score", "det", f"NOT (lower(trim({d.replace('value', '^[: ]+|[: ]+$', '')})) IN {_in(DENYLIST)})", carried)


def threshold(d: Spark, carried: tuple[str, ...] = ()) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in THRESHOLDS.items())
    keep = f"score >= cast(CASE entity_type {cases} ELSE {DEFAULT_THRESHOLD} END as double)"
    return f"SELECT * EXCEPT (kept), kept AND {keep} AS kept FROM det" if "kept" in carried else f"SELECT * FROM det WHERE {keep}"


def locale_of(d: Spark, text: str = "text") -> str:
    """The first locale that the script and marker words of a text suggest."""
    if d.name == "spark":
        return _locale_of(text)
    head = f"substring({text}, 1, 5000)"
    count = lambda cls: f"length({d.replace(head, f'[^{cls}]', '')})"
    script = (lambda java, re2: java) if d.name == "spark" else (lambda java, re2: re2)
    cyr, arab, cjk = script("\\p{IsCyrillic}", "\\p{Cyrillic}"), script("\\p{IsArabic}", "\\p{Arabic}"), script("\\p{IsHan}", "\\p{Han}")
    has = lambda w, x=f"lower({text})": f"{x} LIKE '%{w}%'"
    latin = f"{count('A-Za-zÀ-ÿ')} > 100"
    return (
        f"(CASE WHEN {has('の', text)} OR {has('は', text)} OR {has('を', text)} THEN 'ja-JP' WHEN {count(cjk)} > 50 AND {has('的', text)} THEN 'zh-CN' WHEN {d.matches(text, '[가-힣]')} THEN 'ko-KR' "
        f"WHEN {count(cyr)} > 50 AND ({has('і')} OR {has('є')}) THEN 'uk-UA' WHEN {count(cyr)} > 50 THEN 'ru-RU' WHEN {count(arab)} > 50 THEN 'ar-SA' "
        f"WHEN {latin} AND ({has('ß', text)} OR {has('straße')} OR {has('und')}) THEN 'de-DE' WHEN {latin} AND ({has('être')} OR {has('avoir')} OR {has(chr(99) + chr(39) * 2 + 'est')}) THEN 'fr-FR' "
        f"WHEN {latin} AND ({has('está')} OR {has('ñ', text)}) THEN 'es-ES' WHEN {latin} AND ({has('ção')} OR {has('não')}) THEN CASE WHEN {has('você')} THEN 'pt-BR' ELSE 'pt-PT' END "
        f"WHEN {latin} AND {has('è', text)} AND {has('che')} THEN 'it-IT' WHEN {latin} AND {has('ij')} AND ({has('het')} OR {has('van')}) THEN 'nl-NL' "
        f"WHEN {latin} AND ({has('colour')} OR {has('honour')} OR {has('£', text)}) THEN 'en-GB' ELSE 'en-US' END)"
    )


def _locale_of(text: str) -> str:
    """``locale_of`` for Spark: the text is lower-cased once, letters are counted up to the limit only, and ASCII texts skip the other scripts."""
    han, cyrillic, arabic = "\\p{IsHan}", "\\p{IsCyrillic}", "\\p{IsArabic}"
    many = lambda cls, n: f"regexp_like(t.head, r'^(?:[^{cls}]*+[{cls}]){{{n}}}')"
    any_of = lambda *ws, x="t.low": "(" + " OR ".join(f"contains({x}, '{w}')" for w in ws) + ")"
    wide = lambda *ws, x="t.low": f"(t.wide AND {any_of(*ws, x=x)})"
    cases = (
        f"WHEN {wide('の', 'は', 'を', x='t.text')} THEN 'ja-JP' WHEN t.wide AND {any_of('的', x='t.text')} AND {many(han, 51)} THEN 'zh-CN' WHEN t.wide AND regexp_like(t.text, '[가-힣]') THEN 'ko-KR' "
        f"WHEN t.wide AND {many(cyrillic, 51)} THEN CASE WHEN {any_of('і', 'є')} THEN 'uk-UA' ELSE 'ru-RU' END WHEN t.wide AND {many(arabic, 51)} THEN 'ar-SA' WHEN NOT {many('A-Za-zÀ-ÿ', 101)} THEN 'en-US' "
        f"WHEN {any_of('und')} OR {wide('ß', x='t.text')} OR {wide('straße')} THEN 'de-DE' WHEN {any_of('avoir', 'c' + chr(39) * 2 + 'est')} OR {wide('être')} THEN 'fr-FR' WHEN {wide('está')} OR {wide('ñ', x='t.text')} THEN 'es-ES' "
        f"WHEN {wide('ção', 'não')} THEN CASE WHEN {any_of('você')} THEN 'pt-BR' ELSE 'pt-PT' END WHEN {wide('è', x='t.text')} AND {any_of('che')} THEN 'it-IT' WHEN {any_of('ij')} AND {any_of('het', 'van')} THEN 'nl-NL' "
        f"WHEN {any_of('colour', 'honour')} OR {wide('£', x='t.text')} THEN 'en-GB' ELSE 'en-US'"
    )
    known = f"named_struct('text', {text}, 'low', lower({text}), 'head', substring({text}, 1, 5000), 'wide', octet_length({text}) > char_length({text}))"
    return f"element_at(transform(array({known}), t -> CASE {cases} END), 1)"


def locale_detect(d: Spark) -> str:
    return f"SELECT doc_id, {locale_of(d)} AS locale FROM corpus"


def _with_locale(d: Spark, carried: tuple[str, ...]) -> str:
    return "det" if "locale" in carried else f"det JOIN (SELECT doc_id AS at, {locale_of(d)} AS locale FROM corpus) l ON det.doc_id = l.at"


def geo_of(d: Spark, text: str = "text") -> str:
    """Which side of the Atlantic a text speaks of."""
    if d.name == "spark":
        held = lambda places: " OR ".join(f"contains(low, '{x}')" for x in places.split("|"))
        return f"element_at(transform(array(lower({text})), low -> CASE WHEN {held(UK_PLACES)} THEN 'UK' WHEN {held(NA_PLACES)} THEN 'NA' ELSE 'unknown' END), 1)"
    return f"CASE WHEN {d.matches(f'lower({text})', UK_PLACES)} THEN 'UK' WHEN {d.matches(f'lower({text})', NA_PLACES.replace('.', '[.]'))} THEN 'NA' ELSE 'unknown' END"


def locale_boost(d: Spark, carried: tuple[str, ...] = ()) -> str:
    """Patterns that belong to the text's locale gain, mapped ones that do not lose 0.05, unmapped ones stay."""
    gain = " ".join(f"WHEN pattern = '{p}' THEN CASE WHEN locale IN {_in(ls)} THEN {b} ELSE -0.05 END" for p, (ls, b) in LOCALE_BOOSTS.items())
    return f"SELECT {KEY}, family, before, after, locale, round(least(cast(1 as double), score + cast(CASE {gain} ELSE 0 END as double)), 4) AS score{_all(c for c in carried if c != 'locale')} FROM {_with_locale(d, carried)}"


NA_PLACES = "canada|united states|u.s.|ontario|toronto|california|texas|new york|florida"
UK_PLACES = "united kingdom|england|scotland|wales|london|manchester|national health"


def nhs_phone_conflict(d: Spark, carried: tuple[str, ...] = ()) -> str:
    """NHS-shaped numbers become phone numbers by area code, phone words, phone marks or North American places; UK places veto that.

    Area codes follow the numbering plan's rule: 2-9, 0-8, any digit, and not N11.
    """
    digits = C.digits(d, "value")
    area = f"substring(CASE WHEN length({digits}) = 11 AND {digits} LIKE '1%' THEN substring({digits}, 2) ELSE {digits} END, 1, 3)"
    code = f"({d.matches(area, '^[2-9][0-8][0-9]$')} AND right({area}, 2) <> '11')"
    near = f"lower(concat(right(before, 50), ' ', after))"  # noqa: F541
    phone = d.matches(near, "phone|tel|mobile|cell|fax|call|contact")
    marks = "(length(value) - length(replace(value, '-', '')) >= 2 OR length(value) - length(replace(value, '.', '')) >= 2 OR value LIKE '%(%')"
    boost = f"greatest(CASE WHEN {code} THEN 0.15 ELSE 0 END, CASE WHEN {phone} THEN 0.10 ELSE 0 END, CASE WHEN {marks} OR geo = 'NA' THEN 0.05 ELSE 0 END)"
    turn = f"(entity_type = 'UK_NHS' AND geo <> 'UK' AND ({code} OR {phone} OR {marks} OR geo = 'NA'))"
    source = "det" if "geo" in carried else f"det JOIN (SELECT doc_id AS at, {geo_of(d)} AS geo FROM corpus) g ON det.doc_id = g.at"
    return (
        f"SELECT doc_id, CASE WHEN turn THEN 'PHONE_NUMBER' ELSE entity_type END AS entity_type, pattern, s, e, value, family, before, after, round(CASE WHEN turn THEN least(cast(0.95 as double), score + cast(boost as double)) ELSE score END, 4) AS score{_all(c for c in carried if c != 'geo')} "
        f"FROM (SELECT *, {turn} AS turn, {boost} AS boost FROM {source}) t"
    )


def filters(d: Spark) -> dict[str, list[tuple[str, str]]]:
    """Reasons to drop a match, by entity type and in order: (rule, condition)."""
    v, near = "value", "lower(concat(right(before, 60), ' | ', substring(after, 1, 50)))"
    n_digits = f"length({C.digits(d, v)})"
    letters = f"length({d.replace(v, '[^A-Za-z]', '')})"
    alnum = f"length({d.replace(v, '[^A-Za-z0-9]', '')})"
    vowels = f"length({d.replace(v, '[^AEIOUYaeiouy]', '')})"
    m = lambda rx, x=v: d.matches(x, rx)
    html = ("html", m("<[a-z/]|&[a-z]+;"))
    garbage = [("mostly marks", f"{alnum} * 2 < length({v})"), ("no vowels", f"{letters} >= 4 AND {vowels} * 12 < {letters}"), ("four alike", m("(?i)a{4}|e{4}|i{4}|o{4}|x{4}|[.]{4}|-{4}|_{4}"))]
    labels = ("label", m("(?i)^(?:name|address|city|state|zip|country|phone|email|company|street|suite|unit|date|number)s?:?$"))
    return {
        "CREDENTIAL": [("unlabelled and plain", f"score < 0.95 AND {m('(?i)password|passwd|pwd|secret|token|key|pin|bearer|passphrase')} = false AND ({C.entropy(d, v)} < 4.0 OR length({v}) < 12)"), ("placeholder", m("(?i)(?:changeme|example|placeholder|your_)"))],
        "USERNAME": [("short", f"length({v}) < 3"), ("blank", f"{v} LIKE '% %'"), ("protocol", m("^(?:http|x|utf|content)[-.]")), ("hyphenated words", m("^[a-z]+-[a-z]+$"))],
        "COMPANY": [html, *garbage, ("phone word", m("(?i)[0-9]{3}-[0-9]{4}")), ("short", f"length({v}) <= 3 AND score < 0.85"), ("department", m("(?i)^(?:sales|marketing|human resources|support) ")), ("navigation", m("(?i)(?:click|menu|next|previous|home page)"))],
        "LOCATION": [html, *garbage, labels, ("handle", m("(?i)via |@")), ("salutation", m("(?i)^(?:dear|hi|hello) ")), ("digits only", f"{m('^[0-9 -]+$')} AND {m('^[0-9]{5}(?:-[0-9]{4})?$')} = false"), ("direction", m("(?i)^(?:north|south|east|west)$")), ("low", "score < 0.50"), ("issue number", m("^#[0-9]{5,}$"))],
        "PERSON": [html, labels, ("short", f"length({v}) < 3"), ("digit", m("[0-9]")), ("half letters", f"{letters} * 2 < length({v})"), ("pipe", f"{v} LIKE '%|%'"), ("low", "score < 0.50"), ("street word", m("(?i) (?:street|avenue|road|drive|lane|apt|suite)$")), ("institution", m("(?i)(?:university|hospital|bank|school|department)")), ("heading", m("(?i)^(?:table|figure|chapter|section) ")), ("company suffix", m("(?i) (?:inc|llc|ltd|corp|gmbh)[.]?$"))],
        "NATIONAL_ID": [("uuid", m("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-")), ("address", m("^[0-9]{1,3}(?:[.][0-9]{1,3}){3}$")), ("card", f"{n_digits} = 16"), ("few bare digits", f"{m('^[0-9]+$')} AND {n_digits} < 9"), ("no id word", f"{m('^[0-9]+$')} AND score < 0.80 AND {m('id|ssn|social|national|identity|passport|tax|number', near)} = false"), ("country code", m("[+][0-9]{1,3}[ -]?$", "right(before, 15)"))],
        "DATE_TIME": [html, ("fragment", f"length({v}) < 4"), ("duration", m("(?i) (?:days|weeks|months|years)$")), ("digits only", f"{m('^[0-9]+$')} AND {m('^(?:19|20)[0-9]{2}$')} = false"), ("fiscal", m("(?i)fiscal|quarter")), ("low", "score < 0.75"), ("pipe", f"{v} LIKE '%|%'")],
        "BANK_NUMBER": [("length", f"{n_digits} < 8 OR {n_digits} > 17"), ("card", f"{n_digits} >= 15"), ("low", "score < 0.6")],
        "PASSPORT": [("words", f"{letters} > 5"), ("low", "score < 0.7"), ("no passport word", f"score < 0.85 AND {m('passport|travel|document', near)} = false")],
        "DRIVERS_LICENSE": [("short", f"length({v}) < 6"), ("low", "score < 0.7")],
        "URL": [("bare host", m("^[a-z]+[.][a-z]{2,4}$", f"lower({v})")), ("at sign", f"{v} LIKE '%@%'"), ("double dot", f"{v} LIKE '%..%'"), ("no host", m("^https?://[^.]+$")), ("tail", m("[.]$"))],
        "CREDIT_CARD": [("device", f"{n_digits} = 15 AND {m('^(?:35|86|49|01|45|36|87|46)')}"), ("part of more digits", f"{m('[0-9]$', 'before')} OR {m('^[0-9]', 'after')}")],
        "MEDICAL": [("name", f"score < 0.6 AND {m('^[A-Z][a-z]+[ ]+[A-Z][a-z]+$')}"), ("address", m("^[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}$")), ("state and code", m("^[A-Z]{2} [0-9]{5}$")), ("abbreviation", m("^[A-Z]{1,3}$"))],
        "PHONE_NUMBER": [html, ("sixteen digits", f"{n_digits} = 16"), ("address", m("^[0-9]{1,3}(?:[.][0-9]{1,3}){3}$")), ("date", m("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), ("coordinates", m("^-?[0-9]{1,3}[.][0-9]{4,}$")), ("id word before", m("ssn|social security|passport|license|licence|nhs", "lower(right(before, 30))")), ("weak and alone", f"{m('^[0-9]+$')} AND {m('phone|tel|mobile|cell|fax|call|contact', near)} = false")],
        "IP_ADDRESS": [("version", m("(?i)(?:version|release|build|v) ?$", "right(before, 30)")), ("longer number", f"{m('[0-9][.]$', 'before')} OR {m('^[.][0-9]', 'after')}"), ("all alike", m("^(?:0[.]0[.]0[.]0|1[.]1[.]1[.]1|255[.]255[.]255[.]255)$"))],
        "GENDER": [("other", m("(?i)^other$")), ("compound", m("^-", "after"))],
        "FINANCIAL": [("address", f"{v} LIKE '%@%' OR {v} LIKE '%http%'"), ("pipe", f"{v} LIKE '%|%'"), ("word", f"{m('^[A-Z]{8}$')} AND {m('swift|bic|bank', near)} = false"), ("bare negative", m("^[(][0-9]+[)]$"))],
        "ID": [("short", f"length({v}) < 6"), ("one kind", f"score < 0.90 AND ({letters} = 0 OR {n_digits} = 0)")],
        "COORDINATES": [("fragment", m("^[0-9][.][0-9]$"))],
        "EMAIL_ADDRESS": [("in a path", f"{m('://[^ ]*$', 'before')} AND {m('(?i)mailto:', 'before')} = false")],
    }


def _verdict(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {quoted(r)}" for r, c in rules) + " ELSE 'keep' END"


def filter_type(d: Spark, entity: str) -> str:
    """Every match of one type with the rule that drops it, or 'keep'."""
    return f"SELECT {KEY}, score, {_verdict(filters(d)[entity])} AS verdict FROM det WHERE entity_type = '{entity}'"


def filter_all(d: Spark, carried: tuple[str, ...] = ()) -> str:
    """Matches that no rule of their type drops."""
    cases = " ".join(f"WHEN '{k}' THEN {_verdict(v)}" for k, v in filters(d).items())
    return _only(f"{KEY}, family, before, after, score", "det", f"(CASE entity_type {cases} ELSE 'keep' END) = 'keep'", carried)


def person_inside(d: Spark, carried: tuple[str, ...] = ()) -> str:
    """Persons that lie inside a company, or inside a location of at least their score, go.

    Spark gathers a text's companies and locations beside each match (one shuffle by text); the check engine joins them.
    """
    kept = "p.doc_id, p.entity_type, p.pattern, p.s, p.e, p.value, p.family, p.before, p.after, p.score"
    if d.name == "spark":
        alive = "kept AND " if "kept" in carried else ""
        near = f"collect_list(CASE WHEN {alive}entity_type IN ('COMPANY', 'LOCATION') THEN named_struct('s', s, 'e', e, 'score', score, 'company', entity_type = 'COMPANY') END) OVER (PARTITION BY doc_id)"
        keep = "NOT (p.entity_type = 'PERSON' AND exists(p.near, o -> p.s >= o.s AND p.e <= o.e AND (o.company OR o.score >= p.score)))"
        source = f"(SELECT *, {near} AS near FROM det) p"
        return f"SELECT * EXCEPT (near, kept), kept AND {keep} AS kept FROM {source}" if alive else f"SELECT * EXCEPT (near) FROM {source} WHERE {keep}"
    return f"SELECT {kept} FROM det p ANTI JOIN (SELECT doc_id, s, e, score, entity_type FROM det WHERE entity_type IN ('COMPANY', 'LOCATION')) o ON p.doc_id = o.doc_id AND p.entity_type = 'PERSON' AND p.s >= o.s AND p.e <= o.e AND (o.entity_type = 'COMPANY' OR o.score >= p.score)"


def validated(d: Spark, carried: tuple[str, ...] = ()) -> str:
    """Check digits and number plans raise or lower the score; invalid matches under 0.3 go."""
    digits = C.digits(d, "value")
    compact = f"upper({d.replace('value', '[^A-Za-z0-9]', '')})"
    phone = "(length(_digits) BETWEEN 7 AND 15)"
    country = "right(locale, 2)"
    valid = f"CASE WHEN entity_type = 'IBAN_CODE' THEN {C.iban(d, '_compact')} WHEN entity_type = 'PHONE_NUMBER' THEN {phone} WHEN entity_type = 'CREDIT_CARD' THEN {C.card_valid(d, '_digits')} WHEN entity_type = 'NATIONAL_ID' THEN {C.national_id(d, '_compact', country)} WHEN pattern = 'swift_bic_code' THEN {C.bic(d, '_compact')} ELSE true END"
    delta = "CASE WHEN entity_type IN ('IBAN_CODE', 'CREDIT_CARD') THEN CASE WHEN valid THEN 0.15 ELSE -0.3 END WHEN entity_type = 'PHONE_NUMBER' THEN CASE WHEN valid THEN 0.1 ELSE -0.15 END WHEN entity_type = 'NATIONAL_ID' THEN CASE WHEN valid THEN 0.15 ELSE -0.2 END WHEN pattern = 'swift_bic_code' THEN CASE WHEN valid THEN 0.1 ELSE -0.2 END ELSE 0 END"
    scored = f"SELECT {KEY}, family, before, after, valid, round(least(cast(1 as double), greatest(cast(0 as double), score + cast({delta} as double))), 4) AS score{_all(carried)} FROM (SELECT *, {valid} AS valid FROM (SELECT *, {compact} AS _compact, {digits} AS _digits FROM {_with_locale(d, carried)}) s) t"
    return _only(f"{KEY}, family, before, after, valid, score", f"({scored}) u", "valid OR score >= 0.3", carried)


#: Values that are never personal data by themselves (fixed values).
FORM_LABELS = "name|address|city|state|zip|country|phone|email|company|organization|employer|business|street|apt|suite|unit|floor|building|po box|postal code|first name|last name|full name|date of birth|dob|ssn|tax id|account number|id number|billing address|shipping address|n/a|none|unknown|tbd|pending".split("|")
STREET_TYPES = "street|st|avenue|ave|road|rd|drive|dr|boulevard|blvd|lane|ln|way|court|ct|place|pl|highway|hwy|parkway".split("|")
CORPORATE = "inc|llc|ltd|corp|co|plc|corporation|incorporated|limited|company|gmbh|ag|sa|nv|bv|pty".split("|")
PLACEHOLDERS = "xxx|xxxx|0000|1234|test|sample|demo".split("|")


def heuristic_verify(d: Spark, carried: tuple[str, ...] = ()) -> str:
    """Uncertain places, companies and ids (0.40 to 0.65): labels and placeholders go, telling parts raise the score."""
    low, checked = "lower(trim(value))", "entity_type IN ('ADDRESS', 'COMPANY', 'LOCATION', 'ID', 'ORGANIZATION') AND score BETWEEN 0.40 AND 0.65"
    word = lambda ws: d.matches(f"concat(' ', {low}, ' ')", " (?:" + "|".join(ws) + ")[.,]? ")
    gain = f"CASE WHEN NOT ({checked}) THEN 0 WHEN entity_type IN ('COMPANY', 'ORGANIZATION') AND {word(CORPORATE)} THEN 0.15 WHEN entity_type = 'ADDRESS' AND {word(STREET_TYPES)} AND {d.matches('value', '[0-9]')} THEN 0.10 WHEN entity_type = 'LOCATION' AND value LIKE '%,%' THEN 0.10 ELSE 0 END"
    return _only(f"{KEY}, family, before, after, round(least(cast(1 as double), score + cast({gain} as double)), 4) AS score", "det", f"NOT ({checked} AND ({low} IN {_in(FORM_LABELS)} OR (entity_type = 'ID' AND {low} IN {_in(PLACEHOLDERS)})))", carried)


def risk(entity: str = "entity_type") -> str:
    return f"CASE WHEN {entity} IN {_in(HIGH_RISK)} THEN 'high' WHEN {entity} IN {_in(MEDIUM_RISK)} THEN 'medium' ELSE 'low' END"


def rollup_type(entity: str = "entity_type") -> str:
    return f"CASE {entity} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLLUP.items()) + f" ELSE {entity} END"


def label(entity: str = "entity_type") -> str:
    return f"CASE {entity} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " ELSE '[REDACTED]' END"


def islands(d: Spark) -> str:
    """Overlapping matches of a text, whatever their type, as one island."""
    return """SELECT doc_id, island, min(s) AS s, max(e) AS e, count(*) AS matches, max(score) AS best FROM (
SELECT *, cast(sum(new) OVER (PARTITION BY doc_id ORDER BY s, e, pattern ROWS UNBOUNDED PRECEDING) AS bigint) AS island FROM (
SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY doc_id ORDER BY s, e, pattern ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM det) a) b GROUP BY doc_id, island"""


def redact_text(d: Spark) -> str:
    """Texts with every island replaced by the label of its best match (the first by start, end and type among equals), for the check engine;
    ``operators.detect.redact`` does it in the scan."""
    best = f"""SELECT doc_id, s, e, {label()} AS label FROM (
SELECT i.doc_id, i.s, i.e, det.entity_type, row_number() OVER (PARTITION BY i.doc_id, i.s ORDER BY det.score DESC, det.s, det.e DESC, det.entity_type) AS r
FROM ({islands(d)}) i JOIN det ON det.doc_id = i.doc_id AND det.s >= i.s AND det.e <= i.e) t WHERE r = 1"""
    piece = "concat(substring(text, cast(prev as int) + 1, cast(s - prev as int)), label)"
    cut = f"SELECT b.doc_id, s, e, label, coalesce(lag(e) OVER (PARTITION BY b.doc_id ORDER BY s), 0) AS prev FROM ({best}) b"
    return f"SELECT doc_id, count(*) AS redactions, concat(string_agg(piece, '' ORDER BY s), substring(any_value(text), cast(max(e) as int) + 1)) AS redacted FROM (SELECT c.doc_id, s, e, text, {piece} AS piece FROM ({cut}) c JOIN corpus ON c.doc_id = corpus.doc_id) p GROUP BY doc_id"
