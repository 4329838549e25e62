"""Format-preserving pseudonyms for personal data (operator 9).

Only SQL functions. A text is cut at everything that looks like a mail
address, a date, or a card, account, social security, telephone or network
number. What passes its validation (Luhn, mod 97, ranges, the calendar) is
replaced by a keyed permutation of itself within its format, an alternating
Feistel network: equal values get equal pseudonyms in all documents, card and
account numbers keep valid check digits, dates stay dates, addresses stay
addresses. What fails its validation stays as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the key of the permutations is read from, and what stands in for it in tests. Whoever knows the key can undo them.
KEY_CONF, KEY = "spark.querylens.pii.key", "querylens"
ROUNDS = 8

#: What each kind looks like. The first kind that fits at a place has it. A domain has up to 127 labels of up to 63
#: characters; repeated groups are bounded, as Java's matcher recurses on them.
LOOKS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}+\.){1,127}[A-Za-z]{2,}+",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])(?!\.[0-9])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z])(?!\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
KINDS = tuple(LOOKS)
#: Dates from 1900-01-01: 73,049 days to 2099-12-31, which is 17 x 4,297, so a permutation of pairs is one of days.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Masks:
    """SQL expressions of a hit, named by the lambda variable h."""

    def __init__(self, key: str):
        self.key = key

    def noise(self, kind: str, i: str, half: str) -> str:
        return f"cast(conv(substr(sha2(concat({_quoted(self.key + ':' + kind + ':')}, {i}, ':', {half}), 256), 1, 15), 16, 10) as bigint)"

    def permuted(self, kind: str, left: str, right: str, a: str, b: str) -> str:
        """The pair (l, r) of Z_a x Z_b after the network, as a struct."""
        step = f"if(i % 2 = 0, named_struct('l', pmod(s.l + {self.noise(kind, 'i', 's.r')}, {a}), 'r', s.r), named_struct('l', s.l, 'r', pmod(s.r + {self.noise(kind, 'i', 's.l')}, {b})))"
        return f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> {step})"

    @staticmethod
    def let(value: str, name: str, body: str) -> str:
        """body with name bound to value, evaluated once."""
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    def digits(self, kind: str, d: str) -> str:
        """A string of up to 36 digits, permuted among those of its length."""
        n, half = f"length({d})", f"cast(length({d}) / 2 as int)"
        a, b = f"cast(rpad('1', {half} + 1, '0') as bigint)", f"cast(rpad('1', {n} - {half} + 1, '0') as bigint)"
        left, right = f"if({half} = 0, '0', substr({d}, 1, {half}))", f"substr({d}, {half} + 1)"
        joined = f"concat(lpad(cast(p.l as string), {half}, '0'), lpad(cast(p.r as string), {n} - {half}, '0'))"
        return self.let(self.permuted(kind, left, right, a, b), "p", joined)

    @staticmethod
    def only_digits(h: str) -> str:
        return f"regexp_replace({h}, '[^0-9]', '')"

    @staticmethod
    def refilled(h: str, d: str) -> str:
        """h with its digits replaced in order by those of d."""
        return f"array_join(transform(split({h}, ''), (c, j) -> if(c rlike '[0-9]', substr({d}, length(regexp_replace(substr({h}, 1, j + 1), '[^0-9]', '')), 1), c)), '')"

    @staticmethod
    def luhn_sum(d: str) -> str:
        """Of digits that the check digit follows."""
        return f"aggregate(transform(split(reverse({d}), ''), (c, j) -> if(j % 2 = 0, if(int(c) > 4, int(c) * 2 - 9, int(c) * 2), int(c))), 0, (s, x) -> s + x)"

    def card(self, h: str) -> str:
        d = self.only_digits(h)
        valid = f"pmod({self.luhn_sum(f'substr(d, 1, length(d) - 1)')} + int(right(d, 1)), 10) = 0 and d rlike '[1-9]'"
        new = self.let(self.digits("card", "substr(d, 1, length(d) - 1)"), "q", f"concat(q, pmod(10 - {self.luhn_sum('q')} % 10, 10))")
        return self.let(d, "d", f"if({valid}, {self.let(new, 'w', self.refilled(h, 'w'))}, {h})")

    def phone(self, h: str) -> str:
        return self.let(self.only_digits(h), "d", f"if(length(d) between 7 and 15, {self.let(self.digits('phone', 'd'), 'w', self.refilled(h, 'w'))}, {h})")

    def ssn(self, h: str) -> str:
        """Areas 001-899 without 666, groups 01-99, serials 0001-9999."""
        area, group, serial = (f"int(substr({h}, {at}, {n}))" for at, n in ((1, 3), (5, 2), (8, 4)))
        valid = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
        left = f"({area} - if({area} > 666, 2, 1)) * 99 + {group} - 1"
        area2 = "cast(p.l div 99 as int) + if(p.l div 99 >= 665, 2, 1)"
        shown = f"concat(lpad({area2}, 3, '0'), '-', lpad(pmod(p.l, 99) + 1, 2, '0'), '-', lpad(p.r + 1, 4, '0'))"
        return f"if({valid}, {self.let(self.permuted('ssn', left, f'{serial} - 1', '88902', '9999'), 'p', shown)}, {h})"

    def ip(self, h: str) -> str:
        o = f"transform(split({h}, '[.]'), x -> int(x))"
        shown = "concat_ws('.', p.l div 256, p.l % 256, p.r div 256, p.r % 256)"
        new = self.let(self.permuted("ip", "o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536"), "p", shown)
        return self.let(o, "o", f"if(forall(o, x -> x <= 255), {new}, {h})")

    def date(self, h: str) -> str:
        """Written with the year first, by dots with the day first, by strokes with the month first if that is a date."""
        f = f"case when {h} rlike '^[0-9]{{4}}-' then 'yyyy-MM-dd' when {h} rlike '^[0-9]{{4}}/' then 'yyyy/MM/dd' when {h} like '%.%' then 'dd.MM.yyyy' when try_to_timestamp({h}, 'MM/dd/yyyy') is not null then 'MM/dd/yyyy' else 'dd/MM/yyyy' end"
        n = f"datediff(cast(try_to_timestamp({h}, f) as date), date'{FIRST_DAY}')"
        a, b = DAYS
        new = self.let(self.permuted("date", f"n div {b}", f"n % {b}", str(a), str(b)), "p", f"date_format(date_add(date'{FIRST_DAY}', cast(p.l * {b} + p.r as int)), f)")
        return self.let(f, "f", self.let(n, "n", f"if(n between 0 and {a * b - 1}, {new}, {h})"))

    def iban(self, h: str) -> str:
        def mod97(s: str) -> str:
            return f"aggregate(split({s}, ''), 0, (m, c) -> if(c rlike '[0-9]', pmod(m * 10 + ascii(c) - 48, 97), pmod(m * 100 + ascii(c) - 55, 97)))"

        b = "substr(d, 5)"
        bban = self.let(self.only_digits(b), "e", f"if(e = '', {b}, {self.let(self.digits('iban', 'e'), 'w', self.refilled(b, 'w'))})")
        check = f"lpad(98 - {mod97(chr(39) + chr(39) + ' || q || substr(d, 1, 2) || ' + chr(39) + '00' + chr(39))}, 2, '0')"
        new = self.let(bban, "q", f"concat(substr(d, 1, 2), {check}, q)")
        valid = f"length(d) between 15 and 34 and {mod97('substr(d, 5) || substr(d, 1, 4)')} = 1"
        spaced = f"array_join(transform(split({h}, ''), (c, j) -> if(c = ' ', ' ', substr(z, length(replace(substr({h}, 1, j + 1), ' ', '')), 1))), '')"
        return self.let(f"replace({h}, ' ', '')", "d", f"if({valid}, {self.let(new, 'z', spaced)}, {h})")

    def email(self, h: str) -> str:
        """The part before the @: letters among letters, digits among digits, other signs as they are."""

        def shifted(half: str, other: str) -> str:
            k = f"sha2(concat({_quoted(self.key + ':email:')}, i, ':', {other}), 512)"
            by = "cast(conv(substr(k, 1 + 4 * (j % 32), 4), 16, 10) as int)"
            move = " ".join(f"when c between '{lo}' and '{hi}' then chr({ord(lo)} + pmod(ascii(c) - {ord(lo)} + {by}, {ord(hi) - ord(lo) + 1}))" for lo, hi in ("az", "AZ", "09"))
            return self.let(k, "k", f"array_join(transform(split({half}, ''), (c, j) -> case {move} else c end), '')")

        local, half = "u", "cast(length(u) / 2 as int)"
        step = f"if(i % 2 = 0, named_struct('l', {shifted('s.l', 's.r')}, 'r', s.r), named_struct('l', s.l, 'r', {shifted('s.r', 's.l')}))"
        net = f"aggregate(sequence(1, {ROUNDS}), named_struct('l', substr({local}, 1, {half}), 'r', substr({local}, {half} + 1)), (s, i) -> {step})"
        return self.let(f"substring_index({h}, '@', 1)", "u", self.let(net, "p", f"concat(p.l, p.r, '@', substring_index({h}, '@', -1))"))

    def any(self, h: str) -> str:
        return "case " + " ".join(f"when {h} rlike {_quoted('^(?:' + LOOKS[k] + ')$')} then {getattr(self, k)(h)}" for k in KINDS) + f" else {h} end"


def kind_of(h: str) -> str:
    return "case " + " ".join(f"when {h} rlike {_quoted('^(?:' + LOOKS[k] + ')$')} then '{k}'" for k in KINDS) + " end"


def pseudonymised(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text with pseudonyms, n_<kind> replaced of each kind, n_pii.

    The whole text is read; a null text stays null, with no finding. Null and
    repeated ids pass through; extra columns are not read; an empty table gives
    an empty result. No row is moved: there is no exchange in the plan. The key
    is the session's spark.querylens.pii.key unless one is given.
    """
    key = key or docs.sparkSession.conf.get(KEY_CONF, KEY)
    pattern = _quoted("(" + "|".join(f"(?:{p})" for p in LOOKS.values()) + ")")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # most texts hold none of the signs that every kind needs
    hits = F.expr(f"if(text rlike '[0-9@]', regexp_extract_all(text, {pattern}, 0), array())")
    rows = rows.withColumn("hits", hits)
    masked = F.expr(f"transform(hits, h -> named_struct('kind', {kind_of('h')}, 'was', h, 'now', {Masks(key).any('h')}))")
    rows = rows.withColumn("found", F.when(F.size("hits") > 0, masked))
    text = F.expr(f"if(found is null, text, concat(array_join(transform(slice(parts, 1, size(found)), (p, i) -> concat(p, found[i].now)), ''), element_at(parts, -1)))")
    rows = rows.withColumn("parts", F.expr(f"if(found is null, null, split(text, {pattern}, -1))"))
    counts = [F.expr(f"coalesce(size(filter(found, x -> x.kind = '{k}' and x.was <> x.now)), 0)").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", text.alias("text"), *counts, F.expr("coalesce(size(filter(found, x -> x.was <> x.now)), 0)").alias("n_pii"))


def without_pii(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with pseudonyms in text and its length in n_chars; other columns as they are."""
    pattern = pseudonymised(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"), key)
    return pattern.select(*((F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"doc_id.`{c}`")).alias(c) for c in docs.columns))
