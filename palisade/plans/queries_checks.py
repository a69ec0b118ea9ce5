"""Queries of check digits and number shapes, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import checksums as C
from ..functions.dialect import DUCK, SPARK, Spark

#: Published specimen numbers and altered ones (fixed values).
SPECIMENS = {
    "iban": ["GB82WEST12345698765432", "DE89370400440532013000", "FR1420041010050500013M02606", "NL91ABNA0417164300", "GB82WEST12345698765431", "XX82WEST12345698765432", "ES9121000418450200051332", "short", ""],
    "bic": ["DEUTDEFF", "DEUTDEFF500", "NEDSZAJJXXX", "CUSTOMER", "deutdeff", "DEUTXXFF", ""],
    "verhoeff": ["2363", "2364", "123451", "123450", "12a", ""],
    "mod11": ["0306406152", "030640615X", "080442957X", "0804429570", "1", ""],
    "za": ["8001015009087", "8001015009088", "8013015009087", "123", ""],
    "text": ["aaaa", "abab", "correct horse battery", "Zx9!kQ2#vT", "é", ""],
}
#: Identity numbers and whether they hold, as published or altered in one character: known answers, which the check SQL states as they are.
NATIONAL = (
    ("US", "219099999", True), ("US", "666123456", False), ("CA", "046454286", True), ("CA", "046454287", False), ("ZA", "8001015009087", True), ("GB", "AB123456C", True), ("GB", "QQ123456C", False), ("BR", "52998224725", True), ("BR", "52998224724", False),
    ("NL", "111222333", True), ("NL", "111222334", False), ("PL", "44051401359", True), ("PL", "44051401358", False), ("ES", "12345678Z", True), ("ES", "12345678A", False), ("IN", "234123412346", True), ("IN", "234123412345", False), ("XX", "123456", True), ("XX", "12", False),
    ("DE", "36574261809", True), ("DE", "36574261890", False), ("DE", "36554266806", False), ("FR", "295109912611193", True), ("FR", "295109912611199", False), ("IT", "RCCMNL83S18D969H", True), ("IT", "RCCMNL83S18D969A", False), ("IT", "00743110157", True), ("IT", "00743110158", False),
    ("BE", "85073003328", True), ("BE", "17073003384", True), ("BE", "85073003329", False), ("AT", "1237010180", True), ("AT", "2237010180", False), ("SE", "8803200016", True), ("SE", "8803200018", False), ("SE", "198803200016", True), ("DK", "2110625629", True), ("DK", "5110625629", False),
    ("NO", "15108695088", True), ("NO", "15108695077", False), ("FI", "131052308T", True), ("FI", "131052-308T", True), ("FI", "131052308U", False), ("CH", "7569217076985", True), ("CH", "7569217076984", False), ("PT", "501964843", True), ("PT", "501964842", False),
    ("IE", "6433435F", True), ("IE", "6433435E", False), ("IE", "6433435FT", True), ("AR", "20055361682", True), ("AR", "20267565392", False), ("CL", "125319092", True), ("CL", "125319093", False), ("MX", "BOXW310820HNERXN09", True), ("MX", "BOXW310820HNERXN08", False),
    ("CO", "2131234321", True), ("CO", "2131234325", False), ("AU", "123456782", True), ("AU", "999999999", False), ("CN", "360426199101010071", True), ("CN", "360426199101010072", False), ("JP", "5835678256246", True), ("JP", "2835678256246", False),
    ("KR", "9710139019902", True), ("KR", "9710139019903", False), ("SG", "S1234567D", True), ("SG", "S1234567A", False), ("MY", "770305021234", True), ("MY", "771305021234", False), ("ID", "013000666091000", True), ("ID", "013000667091000", False),
    ("IL", "39337423", True), ("IL", "39337424", False), ("TR", "17291716060", True), ("TR", "17291716050", False),
)


def _values(xs: list[str], col: str = "x") -> str:
    return "(VALUES " + ", ".join(f"('{x}')" for x in xs) + f") AS t({col})"


def _numbers(d: Spark) -> str:
    """Digit strings from the orders and customers tables, 13 to 16 digits long, and every card-like number of the documents."""
    cards = d.extract_all("coalesce(text, '')", "[0-9]{13,19}")
    pad = "lpad(cast({} as {}), {}, '0')"
    kind = "string" if d.name == "spark" else "varchar"
    explode = "explode" if d.name == "spark" else "unnest"
    return f"""SELECT 'order' AS origin, {pad.format('o_orderkey', kind, 13)} AS x FROM orders
    UNION ALL SELECT 'customer', {pad.format('c_custkey', kind, 16)} FROM customer
    UNION ALL SELECT 'document', x FROM (SELECT {explode}({cards}) AS x FROM documents)"""


def sql_of(d: Spark) -> dict[str, str]:
    n = _numbers(d)
    return {
        "luhn": f"SELECT origin, x AS number, {C.luhn(d, 'x')} AS valid FROM ({n})",
        "card_issuer": f"SELECT coalesce({C.card_issuer(d, 'x')}, 'none') AS issuer, {C.card_valid(d, 'x')} AS valid, count(*) AS n FROM ({n}) GROUP BY 1, 2",
        "verhoeff": f"SELECT x AS number, {C.verhoeff(d, 'x')} AS valid FROM (SELECT x FROM ({n}) UNION ALL SELECT x FROM {_values(SPECIMENS['verhoeff'])})",
        "mod11": f"SELECT x AS number, {C.mod11(d, 'x')} AS valid FROM (SELECT x FROM ({n}) UNION ALL SELECT x FROM {_values(SPECIMENS['mod11'])})",
        "iban_mod97": f"SELECT x AS iban, coalesce({C.mod97(d, 'x')}, -1) AS remainder, {C.iban(d, 'x')} AS valid FROM (SELECT concat('GB', right(x, 2), 'WEST', left(x, 14)) AS x FROM ({n}) WHERE length(x) >= 14 UNION ALL SELECT x FROM {_values(SPECIMENS['iban'])})",
        "za_id": f"SELECT x AS number, {C.za_id(d, 'x')} AS valid, CASE WHEN {C.za_id(d, 'x')} THEN {C.za_birth_date(d, 'x', 2026)} END AS born FROM (SELECT x FROM ({n}) UNION ALL SELECT x FROM {_values(SPECIMENS['za'])})",
        "bic": f"SELECT x AS bic, {C.bic(d, 'x')} AS valid FROM {_values(SPECIMENS['bic'])}",
        "entropy": f"SELECT x AS value, {C.entropy(d, 'x')} AS bits FROM (SELECT x FROM ({n}) UNION ALL SELECT x FROM {_values(SPECIMENS['text'])})",
        "national_id_check": "SELECT country, x AS number, {} AS valid FROM (VALUES {}) AS t(country, x)".format(C.national_id(d, "x", "country"), ", ".join(f"('{c}', '{x}')" for c, x, _ in NATIONAL)),
    }


def _run(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .views import with_views

        return with_views(spark, sf_dir, sql_of(SPARK)[name])

    query.__name__ = name
    return query


QUERIES = {name: _run(name) for name in sql_of(SPARK)}
SQL = sql_of(DUCK) | {"national_id_check": "SELECT country, number, valid FROM (VALUES {}) AS t(country, number, valid)".format(", ".join(f"('{c}', '{x}', {str(v).lower()})" for c, x, v in NATIONAL))}
