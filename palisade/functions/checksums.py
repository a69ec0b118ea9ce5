"""Check digits and number shapes as SQL expressions; every function takes a dialect and a string expression."""

from __future__ import annotations

from . import national_ids
from .dialect import Spark

#: The dihedral group D5 and the permutations of its check-digit scheme (fixed values).
VERHOEFF_D = [[(j + i) % 5 if i < 5 and j < 5 else (i + j) % 5 + 5 if i < 5 else (i - j) % 5 + 5 if j < 5 else (i - j) % 5 for j in range(10)] for i in range(10)]
VERHOEFF_P1 = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]


def _permutations() -> list[list[int]]:
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([rows[-1][VERHOEFF_P1[i]] for i in range(10)])
    return rows


#: IBAN lengths by country (fixed values).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21,
    "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


def digits(d: Spark, x: str) -> str:
    """Only the ASCII digits of a string."""
    return d.replace(x, "[^0-9]", "")


def _digit(x: str, i: str) -> str:
    return f"cast(substring({x}, cast({i} as int), 1) as int)"


def luhn(d: Spark, x: str) -> str:
    """Every second digit from the right is doubled and its digits summed; the total ends in 0. False for anything but digits."""
    v = f"({_digit(x, 'i')} * (1 + (length({x}) - i) % 2))"
    total = d.itotal(d.map(d.seq("1", f"length({x})"), "i", f"{v} - 9 * (CASE WHEN {v} > 9 THEN 1 ELSE 0 END)"))
    return f"(CASE WHEN {d.matches(x, '^[0-9]+$')} THEN {total} % 10 = 0 ELSE false END)"


def mod97(d: Spark, x: str) -> str:
    """The first four characters go to the end, letters become 10 to 35, the remainder by 97; null for other characters."""
    moved = f"concat(substring({x}, 5), substring({x}, 1, 4))"
    value = f"(CASE WHEN {d.code(f'substring({moved}, cast(i as int), 1)')} >= 65 THEN {d.code(f'substring({moved}, cast(i as int), 1)')} - 55 ELSE {d.code(f'substring({moved}, cast(i as int), 1)')} - 48 END)"
    return f"(CASE WHEN {d.matches(x, '^[A-Z0-9]{5,}$')} THEN {d.fold(d.map(d.seq('1', f'length({x})'), 'i', value), 0, 'a', 'v', '(CASE WHEN v > 9 THEN a * 100 + v ELSE a * 10 + v END) % 97')} END)"


def iban(d: Spark, x: str) -> str:
    """Country, length of that country, and remainder 1."""
    length = "CASE substring({0}, 1, 2) {1} END".format(x, " ".join(f"WHEN '{k}' THEN {v}" for k, v in IBAN_LENGTHS.items()))
    return f"coalesce({d.matches(x, '^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$')} AND length({x}) = {length} AND {mod97(d, x)} = 1, false)"


def verhoeff(d: Spark, x: str) -> str:
    """The digits from the right run through the dihedral tables and end at 0."""
    flat_d = d.array(*[v for row in VERHOEFF_D for v in row])
    flat_p = d.array(*[v for row in _permutations() for v in row])
    step = d.map(d.seq("0", f"length({x}) - 1"), "i", d.at(flat_p, f"(i % 8) * 10 + {_digit(x, f'length({x}) - i')} + 1"))
    return f"(CASE WHEN {d.matches(x, '^[0-9]+$')} THEN {d.fold(step, 0, 'a', 'v', d.at(flat_d, 'a * 10 + v + 1'))} = 0 ELSE false END)"


def mod11(d: Spark, x: str) -> str:
    """Weights n to 2 over all but the last character, which is 11 less the remainder (X is 10, 11 counts as 0)."""
    n = f"(length({x}) - 1)"
    total = d.itotal(d.map(d.seq("1", n), "i", f"{_digit(x, 'i')} * ({n} + 2 - i)"))
    last = f"(CASE WHEN right({x}, 1) = 'X' THEN 10 ELSE cast(right({x}, 1) as int) END)"
    return f"(CASE WHEN {d.matches(x, '^[0-9]+[0-9X]$')} THEN (11 - {total} % 11) % 11 = {last} ELSE false END)"


def za_id(d: Spark, x: str) -> str:
    """South African identity numbers: 13 digits, a possible month and day, citizenship 0 or 1, Luhn."""
    return f"(CASE WHEN {d.matches(x, '^[0-9]{13}$')} THEN cast(substring({x}, 3, 2) as int) BETWEEN 1 AND 12 AND cast(substring({x}, 5, 2) as int) BETWEEN 1 AND 31 AND substring({x}, 11, 1) IN ('0', '1') AND {luhn(d, x)} ELSE false END)"


def za_birth_date(d: Spark, x: str, as_of_year: int) -> str:
    """The birth date in a South African identity number, as text; two-digit years after ``as_of_year`` are of the last century."""
    year = f"cast(substring({x}, 1, 2) as int)"
    return f"concat(cast(CASE WHEN {year} <= {as_of_year % 100} THEN {as_of_year // 100 * 100} + {year} ELSE {as_of_year // 100 * 100 - 100} + {year} END as string), '-', substring({x}, 3, 2), '-', substring({x}, 5, 2))"


#: ISO countries that issue most BICs (fixed values).
BIC_COUNTRIES = "AD AE AR AT AU BE BG BR CA CH CL CN CO CY CZ DE DK EE EG ES FI FR GB GR HK HR HU ID IE IL IN IS IT JP KR KW LI LT LU LV MC MT MX MY NL NO NZ PE PH PL PT QA RO RS RU SA SE SG SI SK TH TR TW UA US UY VN ZA".split()


def bic(d: Spark, x: str) -> str:
    """Four letters, a country, two letters or digits, and three more or none."""
    return f"({d.matches(x, '^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?$')} AND substring({x}, 5, 2) IN ({', '.join(repr(c) for c in BIC_COUNTRIES)}))"


def card_issuer(d: Spark, x: str) -> str:
    """The issuer by prefix and length; null where none fits."""
    rules = (
        ("visa", "^4([0-9]{12}|[0-9]{15}|[0-9]{18})$"), ("mastercard", "^(5[1-5][0-9]{14}|2(22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12})$"), ("amex", "^3[47][0-9]{13}$"),
        ("diners", "^3(0[0-5]|[68][0-9])[0-9]{11}$"), ("jcb", "^35(2[89]|[3-8][0-9])[0-9]{12}$"), ("discover", "^6(011|5[0-9]{2}|4[4-9][0-9])[0-9]{12}$"), ("unionpay", "^62([0-9]{14}|[0-9]{17})$"), ("maestro", "^(5[06-9]|6[0-9])[0-9]{10,17}$"),
    )
    return "CASE " + " ".join(f"WHEN {d.matches(x, rx)} THEN '{name}'" for name, rx in rules) + " END"


def card_valid(d: Spark, x: str) -> str:
    return f"(length({x}) BETWEEN 13 AND 19 AND {luhn(d, x)})"


def national_ids_of(d: Spark, x: str) -> dict[str, str]:
    """The published check of each country's identity number."""

    def weighted(weights: list[int]) -> str:
        return "(" + " + ".join(f"{w} * {_digit(x, str(i + 1))}" for i, w in enumerate(weights)) + ")"

    is_digits = lambda n: d.matches(x, f"^[0-9]{{{n}}}$")
    cpf1, cpf2 = weighted(list(range(10, 1, -1))), weighted(list(range(11, 1, -1)))
    rules = {
        "CA": f"CASE WHEN {is_digits(9)} THEN {luhn(d, x)} ELSE false END",
        "ZA": za_id(d, x),
        "IN": f"CASE WHEN {is_digits(12)} THEN {verhoeff(d, x)} ELSE false END",
        "GB": d.matches(x, "^[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{6}[A-D]$"),
        "US": f"({d.matches(x, '^[0-9]{9}$')} AND substring({x}, 1, 3) NOT IN ('000', '666') AND substring({x}, 1, 1) <> '9' AND substring({x}, 4, 2) <> '00' AND substring({x}, 6, 4) <> '0000')",
        "BR": f"CASE WHEN {is_digits(11)} THEN (({cpf1} * 10) % 11) % 10 = {_digit(x, '10')} AND (({cpf2} * 10) % 11) % 10 = {_digit(x, '11')} ELSE false END",
        "NL": f"CASE WHEN {is_digits(9)} THEN ({weighted([9, 8, 7, 6, 5, 4, 3, 2])} - {_digit(x, '9')}) % 11 = 0 ELSE false END",
        "PL": f"CASE WHEN {is_digits(11)} THEN {weighted([1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1])} % 10 = 0 ELSE false END",
        "ES": f"CASE WHEN {d.matches(x, '^[0-9]{8}[A-Z]$')} THEN substring('TRWAGMYFPDXBNJZSQVHLCKE', 1 + cast(substring({x}, 1, 8) as int) % 23, 1) = right({x}, 1) ELSE false END",
    }
    return rules | national_ids.rules(d, x)


def national_id_of(d: Spark, x: str, country: str) -> str:
    return f"coalesce({national_ids_of(d, x)[country]}, false)"


def national_id(d: Spark, x: str, country: str) -> str:
    """The check of the country that an expression names; for others, six characters or more."""
    return f"(CASE {country} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in national_ids_of(d, x).items()) + f" ELSE length({x}) >= 6 END)"


def entropy(d: Spark, x: str) -> str:
    """Shannon entropy of the characters, in bits, rounded to six places."""
    chars = d.map(d.seq("1", f"length({x})"), "i", f"substring({x}, cast(i as int), 1)")
    distinct = f"array_distinct({chars})" if d.name == "spark" else f"list_distinct({chars})"
    share = f"((length({x}) - length(replace({x}, c, ''))) * 1.0 / length({x}))"
    share = f"cast({share} as double)"
    return f"(CASE WHEN length({x}) > 0 THEN abs(round({d.total(d.map(distinct, 'c', f'-{share} * log2({share})'))}, 6)) ELSE cast(0 as double) END)"
