"""Small differences between Spark SQL and DuckDB, so that an expression is stated once."""

from __future__ import annotations


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class Spark:
    name = "spark"

    @staticmethod
    def text(s: str) -> str:
        return "r" + ("'" + s + "'" if "'" not in s else '"' + s + '"')

    def rlike(self, x: str, pattern: str) -> str:
        from .text import LINEAR

        return f"rlike({x}, {self.text(LINEAR.get(pattern, pattern))})"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.text('(' + pattern + ')')}, 0)"

    def substitute(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)})"

    def map(self, xs: str, var: str, body: str) -> str:
        return f"transform({xs}, {var} -> {body})"

    def keep(self, xs: str, var: str, condition: str) -> str:
        return f"filter({xs}, {var} -> {condition})"

    def size(self, xs: str) -> str:
        return f"cast(size({xs}) as bigint)"

    def join(self, xs: str, by: str) -> str:
        return f"array_join({xs}, {self.text(by)})"

    def array(self, items: list[str]) -> str:
        return f"array({', '.join(items)})"

    def has(self, xs: str, x: str) -> str:
        return f"array_contains({xs}, {x})"

    def meets(self, a: str, b: str) -> str:
        return f"arrays_overlap({a}, {b})"

    def distinct_sorted(self, xs: str) -> str:
        return f"array_sort(array_distinct({xs}))"

    def half_even(self, x: str) -> str:
        return f"bround({x}, 0)"

    def at(self, xs: str, i: int) -> str:
        return f"{xs}[{i - 1}]"


class Duck(Spark):
    name = "duckdb"

    @staticmethod
    def text(s: str) -> str:
        return quoted(s)

    def rlike(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.text(pattern)})"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)})"

    def substitute(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)}, 'g')"

    def map(self, xs: str, var: str, body: str) -> str:
        return f"list_transform({xs}, lambda {var}: {body})"

    def keep(self, xs: str, var: str, condition: str) -> str:
        return f"list_filter({xs}, lambda {var}: {condition})"

    def size(self, xs: str) -> str:
        return f"len({xs})"

    def join(self, xs: str, by: str) -> str:
        return f"array_to_string({xs}, {self.text(by)})"

    def array(self, items: list[str]) -> str:
        return f"[{', '.join(items)}]"

    def has(self, xs: str, x: str) -> str:
        return f"list_contains({xs}, {x})"

    def meets(self, a: str, b: str) -> str:
        return f"list_has_any({a}, {b})"

    def distinct_sorted(self, xs: str) -> str:
        return f"list_sort(list_distinct({xs}))"

    def half_even(self, x: str) -> str:
        return f"round_even(({x})::double, 0)"

    def at(self, xs: str, i: int) -> str:
        return f"{xs}[{i}]"


SPARK, DUCK = Spark(), Duck()
