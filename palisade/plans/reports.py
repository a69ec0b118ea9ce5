"""Dictionaries, votes, column profiles, page layout, evaluation and summaries, as SQL for both engines."""

from __future__ import annotations

from ..functions.dialect import Spark
from . import dictionaries as dic
from .stages import label, risk, rollup_type


def gazetteer(d: Spark, kind: str) -> str:
    """Runs of one to four capitalised words that are, whole, a term of the dictionary; the dictionary is a small dimension table."""
    runs = d.explode(d.extract_all("text", "[A-Z][a-z]+(?: [A-Z][a-z]+){0,3}"))
    return f"SELECT doc_id, phrase, dict.entity_type, dict.kind, dict.score FROM (SELECT doc_id, {runs} AS phrase FROM corpus) r JOIN {dic.values((kind,))} ON lower(phrase) = dict.term"


def names_lookup(d: Spark) -> str:
    """Capitalised words that are first or last names; both in a row is a full name."""
    pairs = d.explode(d.extract_all("text", "[A-Z][a-z]+(?: [A-Z][a-z]+)?"))
    f, last = dic.values(("first_name",)).replace("dict(", "fn("), dic.values(("last_name",)).replace("dict(", "ln(")
    return f"""SELECT doc_id, phrase, CASE WHEN fn.term IS NOT NULL AND ln.term IS NOT NULL AND phrase LIKE '% %' THEN cast(0.80 as double) ELSE cast(0.60 as double) END AS score FROM (SELECT doc_id, phrase, split_part(lower(phrase), ' ', 1) AS a, split_part(lower(phrase), ' ', 2) AS b FROM (SELECT doc_id, {pairs} AS phrase FROM corpus) r) t
LEFT JOIN {f} ON t.a = fn.term LEFT JOIN {last} ON (CASE WHEN t.b = '' THEN t.a ELSE t.b END) = ln.term WHERE fn.term IS NOT NULL OR ln.term IS NOT NULL"""


#: Weights of the engines that vote on persons (fixed values).
WEIGHTS = {"title": 0.95, "labelled": 0.90, "pattern": 0.70, "names": 0.85}


def person_vote(d: Spark) -> str:
    """Overlapping person matches of several engines become one, with a weighted score by tier."""
    source = "CASE WHEN pattern LIKE 'title%' THEN 'title' WHEN pattern IN ('labeled_name', 'role') THEN 'labelled' ELSE 'pattern' END"
    weight = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " END"
    return f"""WITH src AS (SELECT *, {source} AS source FROM det),
flagged AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY doc_id ORDER BY s, e, pattern ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM src),
grouped AS (SELECT *, cast(sum(new) OVER (PARTITION BY doc_id ORDER BY s, e, pattern ROWS UNBOUNDED PRECEDING) AS bigint) AS island FROM flagged),
best AS (SELECT doc_id, island, source, max(score) AS score, min(s) AS s, max(e) AS e FROM grouped GROUP BY doc_id, island, source),
voted AS (SELECT doc_id, island, min(s) AS s, max(e) AS e, count(*) AS engines, max(score) AS top, sum(score * cast({weight} as double)) / sum(cast({weight} as double)) AS combined FROM best GROUP BY doc_id, island)
SELECT doc_id, s, e, engines, round(CASE WHEN engines >= 2 AND combined >= 0.50 THEN least(0.88, combined + least(0.08, 0.03 * (engines - 1))) WHEN engines = 1 AND top >= 0.55 THEN top ELSE 0 END, 4) AS score FROM voted WHERE (engines >= 2 AND combined >= 0.50) OR (engines = 1 AND top >= 0.55)"""


#: Tables whose columns are profiled: table, columns.
PROFILED = {"customer": ("c_custkey", "c_name", "c_mktsegment"), "supplier": ("s_suppkey", "s_name"), "orders": ("o_orderkey", "o_orderdate", "o_orderpriority"), "part": ("p_name", "p_brand", "p_type"), "nation": ("n_name",)}
PER_COLUMN = 20


def column_cells(d: Spark) -> str:
    """Every column's values as text, one row each: (tab, col, cell)."""
    return " UNION ALL ".join(f"SELECT '{t}' AS tab, '{c}' AS col, {d.text(c)} AS cell FROM {t} WHERE {c} IS NOT NULL" for t, cs in PROFILED.items() for c in cs)


def column_sample(d: Spark) -> str:
    """Twenty distinct values of each column, chosen by their hash, so that every run and engine picks the same."""
    joined = "array_join(transform(array_sort(collect_list(struct(r, cell))), x -> x.cell), ' | ')" if d.name == "spark" else "string_agg(cell, ' | ' ORDER BY r)"
    return f"SELECT tab, col, count(*) AS sample_size, {joined} AS sample FROM (SELECT tab, col, cell, row_number() OVER (PARTITION BY tab, col ORDER BY md5(concat(col, cell)), cell) AS r FROM (SELECT DISTINCT tab, col, cell FROM ({column_cells(d)}) c) u) t WHERE r <= {PER_COLUMN} GROUP BY tab, col"


def mask_columns(d: Spark) -> str:
    """Customers with their names and balances masked; nulls stay null."""
    return f"SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN {label(chr(39) + 'PERSON' + chr(39))} END AS c_name, CASE WHEN c_acctbal IS NOT NULL THEN {label(chr(39) + 'FINANCIAL' + chr(39))} END AS c_acctbal, c_mktsegment, c_nationkey FROM customer"


def blocks(d: Spark) -> str:
    """A page of text blocks for every document: each line is cut at " | " into blocks, placed by its line and its place in the line."""
    if d.name == "spark":
        lines = "SELECT doc_id, ln, line FROM (SELECT doc_id, posexplode(split(text, '\\n', -1)) AS (ln, line) FROM documents WHERE text IS NOT NULL) a".replace("'\\n'", "r'\\n'")
        cells = "SELECT doc_id, ln, k, trim(cell) AS text FROM (SELECT doc_id, ln, posexplode(split(line, r' [|] ', -1)) AS (k, cell) FROM lines) b"
    else:
        lines = "SELECT doc_id, unnest(range(0, len(ls))) AS ln, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL) a"
        cells = "SELECT doc_id, ln, unnest(range(0, len(cs))) AS k, trim(unnest(cs)) AS text FROM (SELECT doc_id, ln, string_split_regex(line, ' [|] ') AS cs FROM lines) b"
    return f"lines AS ({lines}), cells AS ({cells}), blocks AS (SELECT doc_id, cast(ln as bigint) * 1000000000 + k AS block, cast(ln as bigint) AS ln, text, cast(10 + 120 * k as double) AS x1, cast(10 + 120 * k + least(110, 6 * length(text)) as double) AS x2, cast(14 * ln as double) AS y1, cast(14 * ln + 12 as double) AS y2 FROM cells WHERE text <> '')"


def merge_blocks(d: Spark) -> str:
    """Neighbouring blocks of a line (centres within 20, a gap of 0 to 50) become one region."""
    joined = "array_join(transform(array_sort(collect_list(struct(block, text))), x -> x.text), ' ')" if d.name == "spark" else "string_agg(text, ' ' ORDER BY block)"
    over = "OVER (PARTITION BY doc_id ORDER BY y1, x1, block)"
    return f"""WITH {blocks(d)}, near AS (SELECT *, CASE WHEN abs((y1 + y2) / 2 - lag((y1 + y2) / 2) {over}) <= 20 AND x1 - lag(x2) {over} BETWEEN 0 AND 50 THEN 0 ELSE 1 END AS new FROM blocks),
isl AS (SELECT *, cast(sum(new) {over.replace(')', ' ROWS UNBOUNDED PRECEDING)')} AS bigint) AS region FROM near)
SELECT doc_id, region, count(*) AS n_blocks, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, md5({joined}) AS text_md5 FROM isl GROUP BY doc_id, region"""


def table_rows(d: Spark) -> str:
    """Rows of at least two blocks within 20 of the row's first, in pages of four blocks or more with two such rows."""
    return f"WITH {blocks(d)}, r AS (SELECT doc_id, ln, count(*) AS n, min(y1) AS y1, max(y2) AS y2 FROM blocks GROUP BY doc_id, ln HAVING count(*) >= 2), t AS (SELECT doc_id FROM r GROUP BY doc_id HAVING count(*) >= 2 AND sum(n) >= 4) SELECT r.doc_id, r.ln, r.n AS n_cells, r.y1, r.y2 FROM r JOIN t ON r.doc_id = t.doc_id"


def table_columns(d: Spark) -> str:
    """Columns: the centres of blocks of a page's first five table rows, clustered where neighbours are at most 50 apart."""
    return f"""WITH {blocks(d)}, r AS (SELECT doc_id, ln, dense_rank() OVER (PARTITION BY doc_id ORDER BY ln) AS k FROM blocks GROUP BY doc_id, ln HAVING count(*) >= 2),
c AS (SELECT b.doc_id, (b.x1 + b.x2) / 2 AS x FROM blocks b JOIN r ON b.doc_id = r.doc_id AND b.ln = r.ln WHERE r.k <= 5),
g AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id ORDER BY x) <= 50 THEN 0 ELSE 1 END AS new FROM c),
i AS (SELECT *, cast(sum(new) OVER (PARTITION BY doc_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS bigint) AS col FROM g)
SELECT doc_id, col, count(*) AS n, round(avg(x), 3) AS x_center FROM i GROUP BY doc_id, col"""


#: Header words and the types of their columns (fixed values; exact match first, then as part of the header, in this order).
HEADERS = (
    ("full name", "PERSON"), ("first name", "PERSON"), ("last name", "PERSON"), ("name", "PERSON"), ("email address", "EMAIL_ADDRESS"), ("email", "EMAIL_ADDRESS"), ("phone", "PHONE_NUMBER"), ("mobile", "PHONE_NUMBER"), ("fax", "PHONE_NUMBER"),
    ("social security", "SSN"), ("ssn", "SSN"), ("passport", "PASSPORT"), ("driver", "DRIVERS_LICENSE"), ("nhs", "UK_NHS"), ("credit card", "CREDIT_CARD"), ("card number", "CREDIT_CARD"), ("account number", "BANK_NUMBER"), ("iban", "IBAN_CODE"), ("amount", "FINANCIAL"),
    ("price", "FINANCIAL"), ("ip address", "IP_ADDRESS"), ("mac address", "DEVICE_ID"), ("address", "LOCATION"), ("city", "LOCATION"), ("zip", "LOCATION"), ("country", "LOCATION"), ("latitude", "COORDINATES"), ("diagnosis", "MEDICAL"), ("vin", "VEHICLE_ID"), ("date of birth", "DATE_TIME"),
    ("date", "DATE_TIME"), ("company", "COMPANY"), ("gender", "GENDER"), ("website", "URL"),
)
HEADER_CASES = ("Name", "The Full Name", "E-mail", "Email Address:", "Phone No.", "SSN #", "Passport Number", "IBAN", "Billing address", "City", "DOB", "Date of Birth", "Quantity", "Company Name", "VIN", "")


def header_type(d: Spark, x: str) -> str:
    clean = f"trim({d.replace(d.replace(f'lower({x})', '^(?:the|a|an) ', ''), '[ ]*(?:number|no[.]?|#|:)[ ]*$', '')})"
    return f"(CASE {' '.join(f'WHEN {clean} = {chr(39)}{h}{chr(39)} THEN {chr(39)}{t}{chr(39)}' for h, t in HEADERS)} {' '.join(f'WHEN {clean} LIKE {chr(39)}%{h}%{chr(39)} THEN {chr(39)}{t}{chr(39)}' for h, t in HEADERS)} END)"


def header_context(d: Spark) -> str:
    return f"SELECT x AS header, coalesce({header_type(d, 'x')}, 'none') AS entity_type FROM (VALUES {', '.join(f'({chr(39)}{h}{chr(39)})' for h in HEADER_CASES)}) AS t(x)"


def spatial_zone(d: Spark) -> str:
    """Detections in the top or bottom twentieth of a page lose 0.40, half of that for types at home in letterheads."""
    return f"""WITH {blocks(d)}, page AS (SELECT doc_id, max(y2) AS height FROM blocks GROUP BY doc_id),
hit AS (SELECT doc_id, block, y1, y2, CASE WHEN {d.matches('text', '@')} THEN 'EMAIL_ADDRESS' ELSE 'NATIONAL_ID' END AS entity_type, cast(0.9 as double) AS score FROM blocks WHERE {d.matches('text', '[0-9]{5}|@')})
SELECT hit.doc_id, block, entity_type, round(score - CASE WHEN (y1 + y2) / 2 / height < 0.05 OR (y1 + y2) / 2 / height > 0.95 THEN CASE WHEN entity_type = 'EMAIL_ADDRESS' THEN 0.20 ELSE 0.40 END ELSE 0 END, 4) AS score FROM hit JOIN page ON hit.doc_id = page.doc_id"""


def horizontal_anchor(d: Spark) -> str:
    """Blocks just right of a label block (ending in a colon) on the same line are near a label."""
    return f"WITH {blocks(d)} SELECT v.doc_id, v.block, l.block AS label FROM blocks v JOIN blocks l ON v.doc_id = l.doc_id AND v.ln = l.ln AND l.text LIKE '%:' AND v.x1 - l.x2 BETWEEN 0 AND 50 AND v.block <> l.block"


SAMPLES = "(SELECT event_type AS entity_type, user_id % 3 AS model, cast(event_id % 100 as double) / 100 AS confidence, (event_id * 7919) % 100 < event_id % 100 AS is_correct FROM events)"


def threshold_sweep(d: Spark) -> str:
    """Precision, recall and F1 of every cut-off from 0.05 to 0.95, by type: counts by confidence, then running sums."""
    grid = ", ".join(f"({k})" for k in range(5, 100, 5))
    return f"""SELECT entity_type, cast(cut as double) / 100 AS threshold, tp, fp, fn, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall FROM (
SELECT entity_type, cut, cast(sum(CASE WHEN hundredth >= cut AND is_correct THEN n ELSE 0 END) as double) AS tp, cast(sum(CASE WHEN hundredth >= cut AND NOT is_correct THEN n ELSE 0 END) as double) AS fp, cast(sum(CASE WHEN hundredth < cut AND is_correct THEN n ELSE 0 END) as double) AS fn
FROM (SELECT entity_type, cast(round(confidence * 100) as int) AS hundredth, is_correct, count(*) AS n FROM {SAMPLES} s GROUP BY 1, 2, 3) c CROSS JOIN (VALUES {grid}) AS g(cut) GROUP BY entity_type, cut) t""".replace("precision,", "prec,").replace("AS precision", "AS prec")


LEAST_SAMPLES = 10
#: Cut-offs in force, by type, where they are not the default.
CURRENT = {"view": 0.55, "click": 0.65, "purchase": 0.75}


def optimal_threshold(d: Spark) -> str:
    """The lowest cut-off of each type of ten samples or more whose running precision is 0.90 or more, walking down by confidence; types that
    never reach it have none. Equal confidences are walked together."""
    return f"""SELECT entity_type, min(CASE WHEN tp >= 0.90 * total THEN confidence END) AS threshold, max(total) AS samples FROM (SELECT entity_type, confidence, sum(ok) OVER w AS tp, cast(sum(n) OVER w as bigint) AS total FROM (SELECT entity_type, confidence, count(CASE WHEN is_correct THEN 1 END) AS ok, count(*) AS n FROM {SAMPLES} s GROUP BY entity_type, confidence) c WINDOW w AS (PARTITION BY entity_type ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING)) r GROUP BY entity_type HAVING max(total) >= {LEAST_SAMPLES}"""


def ivw_weights(d: Spark) -> str:
    """Inverse-variance weights of the models, scaled to 0.7 to 1."""
    return f"""WITH m AS (SELECT model, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS p, sum(CASE WHEN is_correct AND confidence >= 0.5 THEN 1.0 ELSE 0.0 END) / sum(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS r FROM {SAMPLES} s GROUP BY model),
w AS (SELECT model, 1 / ((1 - p) * (1 - r) + 0.000001) AS w FROM m), n AS (SELECT model, w / sum(w) OVER () AS w FROM w)
SELECT model, round(cast(CASE WHEN max(w) OVER () > min(w) OVER () THEN 0.7 + 0.3 * (w - min(w) OVER ()) / (max(w) OVER () - min(w) OVER ()) ELSE 0.85 END as double), 4) AS weight FROM n"""


def auto_adjust(d: Spark) -> str:
    """Cut-offs in force, moved by the rate of false positives: up by a fifth of a rate over 0.3, down by 0.05 under 0.1 if over 0.6, and kept
    between 0.3 and 0.95."""
    now = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CURRENT.items()) + " ELSE 0.65 END"
    return f"SELECT entity_type, round(fp_rate, 6) AS fp_rate, now AS before, round(cast(least(0.95, greatest(0.3, now + CASE WHEN fp_rate > 0.3 THEN 0.2 * fp_rate WHEN fp_rate < 0.1 AND now > 0.6 THEN -0.05 ELSE 0 END)) as double), 4) AS threshold FROM (SELECT entity_type, cast({now} as double) AS now, cast(avg(cast(CASE WHEN is_correct THEN 0 ELSE 1 END as double)) as double) AS fp_rate FROM {SAMPLES} s GROUP BY entity_type) t"


#: Corrections by people: text, detected type, suggested types (sorted, comma-joined) (invented).
FEEDBACK = (("Jane Roe", "PERSON", "PERSON"), ("Jane Roe", "PERSON", "PERSON"), ("Menu", "PERSON", ""), ("Total Due", "COMPANY", "CUSTOM"), ("12 High St", "CUSTOM", "LOCATION"), ("blob", "CUSTOM", ""), ("Paris", "PERSON", "LOCATION"), ("Acme", "COMPANY", "COMPANY"), ("Menu", "PERSON", ""))


def feedback_categories(d: Spark) -> str:
    rows = ", ".join(f"({i}, '{t}', '{k}', '{s}')" for i, (t, k, s) in enumerate(FEEDBACK))
    inside = "concat(',', suggested, ',') LIKE concat('%,', detected, ',%')"
    return f"""SELECT category, detected, count(*) AS n FROM (SELECT detected, CASE WHEN row_number() OVER (PARTITION BY txt, detected, suggested ORDER BY id) > 1 THEN 'duplicate' WHEN detected = 'CUSTOM' AND suggested NOT IN ('', 'CUSTOM') THEN 'missed' WHEN detected = 'CUSTOM' THEN 'unclassified' WHEN suggested IN ('', 'CUSTOM') THEN 'false positive' WHEN {inside} THEN 'confirmed' ELSE 'misclassified' END AS category FROM (VALUES {rows}) AS f(id, txt, detected, suggested)) t GROUP BY category, detected"""


def dataset_quality(d: Spark) -> str:
    """By source: documents, labelled shares, and texts with masked or corrupted values."""
    bad = d.matches("text", r"\*{3,}|#{3,}|[xX]{4,}|N/A")
    return f"SELECT source, count(*) AS docs, count(CASE WHEN quality = 1 THEN 1 END) AS good, count(CASE WHEN toxic = 1 THEN 1 END) AS toxic, count(CASE WHEN {bad} THEN 1 END) AS corrupted FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id GROUP BY source"


def sourced(d: Spark) -> str:
    """Detections with their source, which the scan carries; the check engine joins it."""
    return "det" if d.name == "spark" else "(SELECT det.*, x.source FROM det JOIN (SELECT doc_id AS at, source FROM documents) x ON det.doc_id = x.at)"


def pii_by_source(d: Spark) -> str:
    """Matches by source and type, with the risk tier and a masked example."""
    masked = f"min(concat(substring(value, 1, 2), '***'))"  # noqa: F541
    return f"SELECT source, entity_type, {risk()} AS risk, count(*) AS n, count(DISTINCT doc_id) AS docs, {masked} AS example FROM {sourced(d)} GROUP BY source, entity_type"


def pii_rollup(d: Spark) -> str:
    return f"SELECT coalesce(source, 'all') AS source, coalesce(kind, 'all') AS kind, count(*) AS n FROM (SELECT source, {rollup_type()} AS kind FROM {sourced(d)}) t GROUP BY ROLLUP (source, kind)"


def pii_topk_docs(d: Spark) -> str:
    """The five documents of each source with the most matches."""
    return f"SELECT source, doc_id, n, r FROM (SELECT source, doc_id, n, cast(row_number() OVER (PARTITION BY source ORDER BY n DESC, doc_id) as bigint) AS r FROM (SELECT source, doc_id, count(*) AS n FROM {sourced(d)} GROUP BY source, doc_id) c) t WHERE r <= 5"


def conversation_pii(d: Spark) -> str:
    """Turns of each role that hold an address, a number of seven digits or more, or a salutation."""
    return f"SELECT role, count(*) AS turns, count(CASE WHEN {d.matches('text', '@[a-z]')} THEN 1 END) AS emails, count(CASE WHEN {d.matches('text', '[0-9]{7}')} THEN 1 END) AS numbers, count(CASE WHEN {d.matches('text', '^(?:Dear|Hello|Hi) [A-Z]')} THEN 1 END) AS salutations FROM conversations GROUP BY role"


def event_windows(d: Spark) -> str:
    """Events of each type by hour of event time."""
    return "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2"
