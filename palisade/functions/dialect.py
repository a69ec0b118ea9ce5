"""Expressions written once for Spark SQL and for the DuckDB that checks results.

Both engines see the same formula; only the spelling of lists, lambdas and a few names differs.
"""

from __future__ import annotations


class Spark:
    name = "spark"

    def seq(self, a: str, b: str) -> str:
        return f"(CASE WHEN ({b}) >= ({a}) THEN sequence(cast({a} as int), cast({b} as int)) ELSE array() END)"

    def array(self, *xs) -> str:
        return f"array({', '.join(map(str, xs))})"

    def map(self, xs: str, v: str, body: str) -> str:
        return f"transform({xs}, {v} -> {body})"

    def keep(self, xs: str, v: str, body: str) -> str:
        return f"filter({xs}, {v} -> {body})"

    def total(self, xs: str) -> str:
        return f"aggregate({xs}, 0D, (_a, _x) -> _a + cast(_x as double))"

    def itotal(self, xs: str) -> str:
        return f"aggregate({xs}, 0L, (_a, _x) -> _a + cast(_x as bigint))"

    def fold(self, xs: str, init: int, a: str, x: str, body: str) -> str:
        return f"aggregate({xs}, cast({init} as bigint), ({a}, {x}) -> cast({body} as bigint))"

    def at(self, xs: str, i: str) -> str:
        return f"element_at({xs}, cast({i} as int))"

    def size(self, xs: str) -> str:
        return f"size({xs})"

    def matches(self, x: str, rx: str) -> str:
        return f"regexp_like({x}, r'{self._raw(rx)}')"

    def _raw(self, rx: str) -> str:
        return rx.replace("'", "\\x27")

    def replace(self, x: str, rx: str, to: str) -> str:
        return f"regexp_replace({x}, r'{self._raw(rx)}', '{to}')"

    def extract_all(self, x: str, rx: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, r'{self._raw(rx)}', {group})"

    def extract(self, x: str, rx: str, group: int = 0) -> str:
        return f"regexp_extract({x}, r'{self._raw(rx)}', {group})"

    def split(self, x: str, rx: str) -> str:
        return f"split({x}, r'{self._raw(rx)}', -1)"

    def code(self, c: str) -> str:
        return f"ascii({c})"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def last_n(self, xs: str, n: int) -> str:
        return f"slice({xs}, greatest(size({xs}) - {n - 1}, 1), {n})"

    def first_n(self, xs: str, n: int) -> str:
        return f"slice({xs}, 1, {n})"

    def join(self, xs: str, by: str) -> str:
        return f"array_join({xs}, '{by}')"

    def explode(self, xs: str) -> str:
        return f"explode({xs})"

    def text(self, x: str) -> str:
        return f"cast({x} as string)"


class Duck(Spark):
    name = "duck"

    def seq(self, a, b):
        return f"range(cast({a} as bigint), cast({b} as bigint) + 1)"

    def array(self, *xs):
        return f"[{', '.join(map(str, xs))}]"

    def map(self, xs, v, body):
        return f"list_transform({xs}, lambda {v}: {body})"

    def keep(self, xs, v, body):
        return f"list_filter({xs}, lambda {v}: {body})"

    def total(self, xs):
        return f"coalesce(list_sum(list_transform({xs}, lambda _x: cast(_x as double))), 0.0)"

    def itotal(self, xs):
        return f"cast(coalesce(list_sum({xs}), 0) as bigint)"

    def fold(self, xs, init, a, x, body):
        return f"list_reduce(list_prepend(cast({init} as bigint), list_transform({xs}, lambda _y: cast(_y as bigint))), lambda {a}, {x}: cast({body} as bigint))"

    def at(self, xs, i):
        return f"list_extract({xs}, {i})"

    def size(self, xs):
        return f"len({xs})"

    def matches(self, x, rx):
        return f"regexp_matches({x}, '{rx.replace(chr(39), chr(39) * 2)}')"

    def replace(self, x, rx, to):
        return f"regexp_replace({x}, '{rx.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"

    def extract_all(self, x, rx, group=0):
        return f"regexp_extract_all({x}, '{rx.replace(chr(39), chr(39) * 2)}', {group})"

    def extract(self, x, rx, group=0):
        return f"regexp_extract({x}, '{rx.replace(chr(39), chr(39) * 2)}', {group})"

    def split(self, x, rx):
        return f"string_split_regex({x}, '{rx.replace(chr(39), chr(39) * 2)}')"

    def idiv(self, a, b):
        return f"(({a}) // ({b}))"

    def last_n(self, xs, n):
        return f"list_slice({xs}, greatest(len({xs}) - {n - 1}, 1), len({xs}))"

    def first_n(self, xs, n):
        return f"list_slice({xs}, 1, {n})"

    def join(self, xs, by):
        return f"coalesce(array_to_string({xs}, '{by}'), '')"

    def explode(self, xs):
        return f"unnest({xs})"

    def text(self, x):
        return f"cast({x} as varchar)"


SPARK, DUCK = Spark(), Duck()


def quoted(x: str) -> str:
    """A string literal that both engines read alike (no backslashes)."""
    return "'" + x.replace("'", "''") + "'"
