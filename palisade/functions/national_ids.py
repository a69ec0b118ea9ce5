"""Identity and tax numbers of more countries: the check that each issuer publishes, as SQL over a number without blanks, points and dashes."""

from __future__ import annotations

from .dialect import Spark

#: Values of the characters at odd places of an Italian tax code, for 0 to 9 and for A to Z (fixed values).
ITALIAN_DIGITS = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21)
ITALIAN_LETTERS = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)
#: Weights of the Colombian number, from the right (fixed values).
COLOMBIAN = (3, 7, 13, 17, 19, 23, 29, 37, 41, 43, 47, 53, 59, 67, 71)
#: First two digits of Argentine numbers (fixed values).
ARGENTINE = ("20", "23", "24", "27", "30", "33", "34", "50", "51", "55")


def rules(d: Spark, x: str) -> dict[str, str]:
    """Country to a boolean expression over ``x``; anything of another shape is false."""
    from .checksums import luhn

    def char(i: int, of: str = x) -> str:
        return f"substring({of}, {i}, 1)"

    def digit(i: int, of: str = x) -> str:
        return f"try_cast({char(i, of)} as int)"

    def weighed(weights, of: str = x, start: int = 1) -> str:
        return "(" + " + ".join(f"{w} * {digit(i, of)}" for i, w in enumerate(weights, start) if w) + ")"

    def number(a: int, n: int, of: str = x) -> str:
        return f"try_cast(substring({of}, {a}, {n}) as bigint)"

    def when(shape: str, test: str) -> str:
        return f"(CASE WHEN {d.matches(x, shape)} THEN {test} ELSE false END)"

    def among(letters: str, place: str) -> str:
        return f"substring('{letters}', cast({place} as int) + 1, 1)"

    def rank(letters: str, c: str) -> str:
        return f"(strpos('{letters}', {c}) - 1)" if d.name == "duck" else f"(instr('{letters}', {c}) - 1)"

    def day_of(year: str, month: str, day: str) -> str:
        """Is there such a day? Two-digit years count as of this century."""
        last = f"CASE WHEN {month} = 2 AND {year} % 4 = 0 THEN 29 WHEN {month} = 2 THEN 28 WHEN {month} IN (4, 6, 9, 11) THEN 30 ELSE 31 END"
        return f"({month} BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND {last})"

    def padded(n: int) -> str:
        return f"lpad({x}, {n}, '0')"

    ten = f"substring({x}, 1, 10)"
    often = [f"(length({ten}) - length(replace({ten}, '{k}', '')))" for k in range(10)]
    one_repeats = "(" + " + ".join(f"CASE WHEN {n} > 1 THEN 1 ELSE 0 END" for n in often) + ") = 1 AND " + " AND ".join(f"{n} <= 3" for n in often)
    sums = d.fold(d.map(d.seq("1", "10"), "i", f"try_cast(substring({x}, cast(i as int), 1) as int)"), 10, "a", "v", "2 * (CASE WHEN (a + v) % 10 = 0 THEN 10 ELSE (a + v) % 10 END) % 11")
    chars = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    odd = "[" + ", ".join(map(str, ITALIAN_DIGITS + ITALIAN_LETTERS)) + "]" if d.name == "duck" else "array(" + ", ".join(map(str, ITALIAN_DIGITS + ITALIAN_LETTERS)) + ")"
    italian = " + ".join(d.at(odd, f"{rank(chars, char(i))} + 1") if i % 2 else f"(CASE WHEN {rank(chars, char(i))} > 9 THEN {rank(chars, char(i))} - 10 ELSE {rank(chars, char(i))} END)" for i in range(1, 16))
    french = f"replace(replace(substring({x}, 1, 13), '2A', '19'), '2B', '18')"
    irish = weighed(range(8, 1, -1)) + f" + (CASE WHEN {char(9)} IN ('A', 'B', 'H') THEN 9 * (ascii({char(9)}) - 64) ELSE 0 END)"
    norse1, norse2 = weighed((3, 7, 6, 1, 8, 9, 4, 5, 2)), weighed((5, 4, 3, 2, 7, 6, 5, 4, 3, 2))
    mexican = " + ".join(f"{19 - i} * {rank('0123456789ABCDEFGHIJKLMN&OPQRSTUVWXYZ', char(i))}" for i in range(1, 18))
    nit = " + ".join(f"{w} * {digit(15 - i, padded(16))}" for i, w in enumerate(COLOMBIAN))
    rut = weighed((3, 2, 7, 6, 5, 4, 3, 2), padded(9))
    finnish = f"try_cast(concat(substring({x}, 1, 6), substring({x}, length({x}) - 3, 3)) as bigint)"
    singapore = f"(({weighed((2, 7, 6, 5, 4, 3, 2), x, 2)} + CASE {char(1)} WHEN 'T' THEN 4 WHEN 'G' THEN 4 WHEN 'M' THEN 3 ELSE 0 END) % 11)"
    turkish = "(" + " + ".join(digit(i) for i in range(1, 11)) + ")"
    return {
        "DE": when("^[1-9][0-9]{10}$", f"{one_repeats} AND (11 - {sums}) % 10 = {digit(11)}"),
        "FR": when("^[0-9]{5}([0-9]{2}|2[AB])[0-9]{8}$", f"97 - try_cast({french} as bigint) % 97 = {number(14, 2)}"),
        "IT": f"({when('^[A-Z]{6}[0-9LMNP-V]{2}[ABCDEHLMPRST][0-9LMNP-V]{2}[A-Z][0-9LMNP-V]{3}[A-Z]$', f'({italian}) % 26 = ascii({char(16)}) - 65')} OR {when('^[0-9]{11}$', luhn(d, x))})",
        "BE": when("^[0-9]{11}$", f"(97 - {number(1, 9)} % 97 = {number(10, 2)} OR 97 - (2000000000 + {number(1, 9)}) % 97 = {number(10, 2)})"),
        "AT": when("^[1-9][0-9]{9}$", f"{weighed((3, 7, 9, 0, 5, 8, 4, 2, 1, 6))} % 11 = {digit(4)}"),
        "SE": when("^([0-9]{2})?[0-9]{10}$", f"{luhn(d, f'right({x}, 10)')} AND {day_of(f'try_cast(substring({x}, length({x}) - 9, 2) as int)', f'try_cast(substring({x}, length({x}) - 7, 2) as int)', f'try_cast(substring({x}, length({x}) - 5, 2) as int)')}"),
        "DK": when("^[0-9]{10}$", day_of(number(5, 2), number(3, 2), number(1, 2))),
        "NO": when("^[0-9]{11}$", f"(11 - {norse1} % 11) % 11 = {digit(10)} AND (11 - {norse2} % 11) % 11 = {digit(11)}"),
        "FI": when("^[0-9]{6}[+A-FU-Y-]?[0-9]{3}[0-9A-Y]$", f"{among('0123456789ABCDEFHJKLMNPRSTUVWXY', f'{finnish} % 31')} = right({x}, 1) AND {day_of(number(5, 2), number(3, 2), number(1, 2))}"),
        "CH": when("^756[0-9]{10}$", f"{weighed((1, 3) * 6 + (1,))} % 10 = 0"),
        "PT": when("^[1-9][0-9]{8}$", f"(11 - {weighed(range(9, 1, -1))} % 11) % 11 % 10 = {digit(9)}"),
        "IE": when("^[0-9]{7}[A-W][ABHWTX]?$", f"{among('WABCDEFGHIJKLMNOPQRSTUV', f'({irish}) % 23')} = {char(8)}"),
        "AR": when("^[0-9]{11}$", f"substring({x}, 1, 2) IN ({', '.join(repr(p) for p in ARGENTINE)}) AND {among('012345678990', f'11 - {weighed((5, 4, 3, 2, 7, 6, 5, 4, 3, 2))} % 11')} = {char(11)}"),
        "CL": when("^[0-9]{7,8}[0-9K]$", f"{among('0123456789K', f'(11 - {rut} % 11) % 11')} = right({x}, 1)"),
        "MX": when("^[A-Z]{4}[0-9]{6}[HM][A-Z]{5}[0-9A-Z][0-9]$", f"(10 - ({mexican}) % 10) % 10 = {digit(18)}"),
        "CO": when("^[0-9]{8,16}$", f"{among('01987654321', f'({nit}) % 11')} = right({x}, 1)"),
        "AU": when("^[0-9]{8,9}$", f"{weighed((1, 4, 3, 7, 5, 8, 6, 9, 10), f'rpad({x}, 9, {chr(39)}0{chr(39)})')} % 11 = 0"),
        "CN": when("^[0-9]{17}[0-9X]$", f"{among('10X98765432', f'{weighed((7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2))} % 11')} = {char(18)} AND {day_of(number(7, 4), number(11, 2), number(13, 2))}"),
        "JP": when("^[1-9][0-9]{12}$", f"9 - {weighed((2, 1) * 6, x, 2)} % 9 = {digit(1)}"),
        "KR": when("^[0-9]{13}$", f"(11 - {weighed((2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5))} % 11) % 10 = {digit(13)} AND {day_of(number(1, 2), number(3, 2), number(5, 2))}"),
        "SG": when("^[FGMST][0-9]{7}[A-Z]$", f"(CASE WHEN {char(1)} IN ('S', 'T') THEN {among('JZIHGFEDCBA', singapore)} WHEN {char(1)} = 'M' THEN {among('XWUTRQPNJLK', singapore)} ELSE {among('XWUTRQPNMLK', singapore)} END) = {char(9)}"),
        "MY": when("^[0-9]{12}$", f"{day_of(number(1, 2), number(3, 2), number(5, 2))} AND {number(7, 2)} BETWEEN 1 AND 98 AND {number(7, 2)} NOT IN (17, 18, 19, 20, 69, 70, 73, 80, 81, 94, 95, 96, 97)"),
        "ID": when("^[0-9]{15}$", luhn(d, f"substring({x}, 1, 9)")),
        "IL": when("^[0-9]{1,9}$", luhn(d, padded(9))),
        "TR": when("^[1-9][0-9]{10}$", f"(7 * ({' + '.join(digit(i) for i in range(1, 10, 2))}) + 9 * ({' + '.join(digit(i) for i in range(2, 9, 2))})) % 10 = {digit(10)} AND {turkish} % 10 = {digit(11)}"),
    }
