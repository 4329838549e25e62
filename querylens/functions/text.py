"""Text functions as SQL expressions: normal forms, tokens, skeletons, cues, buckets.

Each takes the name of a column or an expression and a dialect. Character
classes are written out, since ``\\w``, ``\\s`` and ``\\b`` mean different sets
of characters in different engines.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .dialect import SPARK, Spark

#: Unicode white space as str.split() sees it; word characters; characters that may begin a name.
BLANK = "\\s\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD, INITIAL = r"\p{L}\p{N}_", r"\p{L}\p{Nl}\p{No}_"
#: ASCII spellings of operators and what they are normalised to, in order.
OPERATORS = (("<->", "↔"), ("->", "→"), ("<=", "≤"), (">=", "≥"), ("!=", "≠"))
#: Function words that a skeleton keeps.
FUNCTION_WORDS = (
    "a an the of in on for to from with without by at as is are was be been "
    "that which who whose what when where how why if then than and or but not "
    "no nor so such this these those there it its any every each all some "
    "does do can could should would will we you my our me iff"
).split()
#: Patterns of tokens and of names.
TOKEN = rf"\?[A-Za-z][{WORD}']*|[{INITIAL}][{WORD}'.₀-₉]*[{WORD}'₀-₉]|[{INITIAL}]|\p{{Nd}}+(?:\.\p{{Nd}}+)?|[^{WORD}{BLANK}]"
IDENTIFIER = rf"\p{{L}}[{WORD}']*(?:[._][{WORD}']+)+|[a-z]+[A-Z][{WORD}']*|[A-Z][a-z]+[A-Z][{WORD}']*"
NAME = rf"[A-Za-z][{WORD}']*(?:[._][{WORD}']+)+"
ONLY_NAME = rf"^[{BLANK}]*(?:{NAME})[{BLANK}]*$"
#: Fixed value: a command of LaTeX.
LATEX = r"\\[A-Za-z]+"


def _between(words: str) -> str:
    """The words, not inside a longer word."""
    return rf"(?:^|[^{WORD}])(?:{words})(?:$|[^{WORD}])"


#: Signs of a proof state, of a question, of symbols.
PROOF = rf"(?s)⊢|(?:^|[^{WORD}])(?:theorem|lemma|example)(?:[^{WORD}].*?)?:|:=[{BLANK}]*by(?:$|[^{WORD}])"
QUESTION = "(?i)" + _between("how|why|what|which|where|is there|does|can i") + r"|\?"
SYMBOLS = "[∀∃→↔≤≥∈∑∏=<>⊆]"
#: What Spark looks for instead: the same texts match, but no group is repeated, on which Java's matcher would
#: recurse, and no run of characters is gone through twice. A name is looked for from the first letter of a run;
#: a whole text is a name if its first group is there and no dot in it lacks what a dot needs after it.
_NAME_BEGINS = rf"[{WORD}']*[._][{WORD}']"
_WHOLE = rf"(?![\s\S]*\.(?![{WORD}']))"
LINEAR = {
    NAME: rf"(?<![{WORD}'])[{WORD}'&&[^A-Za-z]]*+[A-Za-z]{_NAME_BEGINS}",
    ONLY_NAME: rf"^[{BLANK}]*+(?=[A-Za-z]{_NAME_BEGINS}){_WHOLE}[A-Za-z][{WORD}'.]*+[{BLANK}]*+$",
    f"^(?:{IDENTIFIER})$": rf"^(?:(?=\p{{L}}{_NAME_BEGINS}){_WHOLE}\p{{L}}[{WORD}'.]*+|[a-z]++[A-Z][{WORD}']*+|[A-Z][a-z]++[A-Z][{WORD}']*+)\z",
    PROOF: rf"(?s)⊢|\A(?>.*?(?<![{WORD}])(?:theorem|lemma|example)(?![{WORD}])).*?:|:=[{BLANK}]*+by(?![{WORD}])",
}
#: Unvalidated cues of an intent and of a domain.
INTENTS = {
    "proof_support": "(?i)⊢|" + _between("prove|proof|proving|rewrite|simp|goal"),
    "usage_or_example": "(?i)" + _between("how to use|example|syntax|tactic"),
    "explanation": "(?i)" + _between("explain|why|meaning|definition of"),
    "discovery": "(?i)" + _between("find|search|is there|looking for|lemma for"),
    "enumeration": "(?i)" + _between("list all|all lemmas|all theorems|enumerate"),
}
DOMAINS = {
    "algebra": "group ring field module ideal polynomial algebra homomorphism",
    "analysis": "continuous continuity derivative integral limit convergence norm",
    "topology": "topology topological compact hausdorff neighborhood",
    "number_theory": "prime coprime divisibility divisor congruence modular",
    "combinatorics": "finset graph cardinality permutation combinatorics",
    "probability_measure": "probability random expectation measure measurable",
    "order_logic_sets": "order monotone lattice subset set union intersection logic",
    "linear_algebra": "matrix vector determinant eigenvalue linear",
    "category_theory": "category functor naturaltransformation morphism adjunction",
    "programming": "list array string parser monad io recursion recursive",
}


@pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(x: Column) -> Column:
    """Unicode normal form C; ASCII text never leaves the JVM."""
    return F.when(x.rlike(r"^\p{ASCII}*+$"), x).otherwise(_nfc(x))


@pandas_udf(StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


def casefold(x: Column) -> Column:
    """Unicode case folding; ASCII text never leaves the JVM."""
    return F.when(x.rlike(r"^\p{ASCII}*+$"), F.lower(x)).otherwise(_casefold(x))


def collapsed(x: str, d: Spark = SPARK) -> str:
    """Runs of white space as one blank, none at the ends."""
    return f"trim({d.substitute(x, f'[{BLANK}]+', ' ')})"


def normalized(x: str, d: Spark = SPARK, operators: bool = True) -> str:
    """Of text in form C: operators in Unicode (the log's normal form), then blanks collapsed."""
    if operators:
        for ascii_, sign in OPERATORS:
            x = f"replace({x}, {d.text(ascii_)}, {d.text(sign)})"
    return collapsed(x, d)


def once(value: str, body, d: Spark = SPARK, var: str = "v") -> str:
    """body of a value that is worked out once, though body names it several times."""
    return d.at(d.map(d.array([value]), var, body(var)), 1)


def words(x: str, d: Spark = SPARK) -> str:
    """Number of words between white space."""
    if d is SPARK:
        return f"cast(regexp_count({x}, {d.text(f'[^{BLANK}]++')}) as bigint)"
    return d.size(d.matches(x, f"[^{BLANK}]+"))


def tokens(x: str, d: Spark = SPARK) -> str:
    return d.matches(x, TOKEN)


def kind(t: str, d: Spark = SPARK) -> str:
    """What a token is: HOLE, NUM, itself (a symbol or function word), ID or W."""
    stop = d.array([d.text(w) for w in FUNCTION_WORDS])
    bare = d.substitute(t, r"^\.+|\.+$", "")
    return (
        f"case when {t} = '_' or {t} like '?%' then 'HOLE' when {d.rlike(t, '^[\\p{Nd}²³¹⁰-⁹₀-₉]')} then 'NUM' "
        f"when not {d.rlike(t, '^[\\p{L}_]')} then {t} when {d.rlike(bare, '^(?:' + IDENTIFIER + ')$')} then 'ID' "
        f"when length({t}) > 1 and {d.has(stop, f'lower({t})')} then lower({t}) else 'W' end"
    )


def kinds(x: str, d: Spark = SPARK) -> str:
    return d.map(tokens(x, d), "t", kind("t", d))


def skeleton(kinds_: str, d: Spark = SPARK) -> str:
    return d.join(kinds_, " ")


def _share(part: str, whole: str) -> str:
    return f"case when {whole} > 0 then cast({part} as double) / {whole} else cast(0 as double) end"


def measures(x: str, kinds_: str, d: Spark = SPARK) -> dict[str, str]:
    """The six surface measures of a text whose token kinds are given."""
    word_kinds = d.keep(kinds_, "k", d.rlike("k", r"^\p{L}"))
    n = d.size(word_kinds)
    seen = f"cast(length({d.substitute(x, f'[{BLANK}]+', '')}) as bigint)"
    signs = f"cast(length({d.substitute(x, f'[{BLANK}{WORD}.{chr(39)}]+', '')}) as bigint)"
    return {
        "n_chars": f"cast(length({x}) as bigint)",
        "n_words": n,
        "identifier_share": _share(d.size(d.keep(word_kinds, "k", "k = 'ID'")), n),
        "function_word_share": _share(d.size(d.keep(word_kinds, "k", "k = lower(k)")), n),
        "symbol_share": _share(signs, seen),
        "latex_commands": d.size(d.matches(x, LATEX)),
    }


def marks(x: str, d: Spark = SPARK) -> dict[str, str]:
    """Signs of a text that several dimensions ask for."""
    return {"is_proof": d.rlike(x, PROOF), "is_name": d.rlike(x, ONLY_NAME), "has_latex": d.rlike(x, LATEX), "has_name": d.rlike(x, NAME)}


def surface(x: str, d: Spark = SPARK, known: dict[str, str] | None = None) -> str:
    """The surface form; the first that applies. known: columns that hold marks() already."""
    m = known or marks(x, d)
    return (
        f"case when not {d.rlike(x, f'[^{BLANK}]')} then 'empty' when {m['is_proof']} then 'proof_state_or_statement' "
        f"when {m['is_name']} then 'identifier_only' when {m['has_latex']} then 'latex_present' "
        f"when {d.rlike(x, QUESTION)} then 'question_like' when {m['has_name']} then 'mixed_identifier_text' "
        f"when {d.rlike(x, SYMBOLS)} then 'symbolic_expression' else 'other_text' end"
    )


def _one_of(flags: dict[str, str], several: str, d: Spark) -> str:
    """The label whose flag alone is set; each flag is worked out once."""
    labels = d.array([f"case when {f} then '{label}' end" for label, f in flags.items()])
    hits = d.keep(labels, "l", "l is not null")
    return d.at(d.map(d.array([hits]), "h", f"case when {d.size('h')} > 1 then '{several}' when {d.size('h')} = 1 then {d.at('h', 1)} else 'unknown' end"), 1)


def intent_cue(x: str, d: Spark = SPARK, known: dict[str, str] | None = None) -> str:
    m = known or marks(x, d)
    rest = _one_of({k: d.rlike(x, p) for k, p in INTENTS.items()}, "multiple_cues", d)
    return f"case when {m['is_name']} then 'known_item_candidate' else {rest} end"


def _vocabulary() -> str:
    """A pattern of the words of all vocabularies, by their first letters."""
    by: dict[str, set[str]] = {}
    for v in DOMAINS.values():
        for w in v.split():
            by.setdefault(w[0], set()).add(w[1:])
    return "|".join(f"{c}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for c, rest in sorted(by.items()))


def domain_tokens(x: str, d: Spark = SPARK) -> str:
    """The words of all vocabularies that a text holds."""
    if d is SPARK:  # only these words are taken out of a text, not all of them
        return f"regexp_extract_all(lower({x}), r'(?<![a-z])(?:{_vocabulary()})(?![a-z])', 0)"
    every = ", ".join(d.text(w) for v in DOMAINS.values() for w in v.split())
    return d.keep(d.matches(f"lower({x})", "[a-z]+"), "t", f"t in ({every})")


def domain_cue(tokens_: str, d: Spark = SPARK) -> str:
    """Of a list of tokens, which is worked out once."""
    vocabularies = {k: d.meets("w", d.array([d.text(v) for v in vocabulary.split()])) for k, vocabulary in DOMAINS.items()}
    return d.at(d.map(d.array([tokens_]), "w", _one_of(vocabularies, "multiple_domains", d)), 1)


def bucket(n: str, bounds: tuple[int, ...]) -> str:
    """Labels of counts: 0, 1-2, ..., 129+."""
    low, whens = 0, []
    for high in bounds:
        whens.append(f"when {n} <= {high} then '{low if low == high else f'{low}-{high}'}'")
        low = high + 1
    return f"case {' '.join(whens)} else '{low}+' end"


def length_class(n: str) -> str:
    return f"case when {n} <= 2 then '0-2' when {n} <= 8 then '3-8' when {n} <= 16 then '9-16' else '17+' end"


def binned(n: str, edges: tuple[int, ...], labels: tuple[str, ...]) -> str:
    """Right-closed bins; null for a value outside of all."""
    return "case " + " ".join(f"when {n} > {a} and {n} <= {b} then '{x}'" for a, b, x in zip(edges[:-1], edges[1:], labels, strict=True)) + " end"


#: The ordered bins of query length (words) and of repeats, right-closed.
LENGTH_BINS = ((0, 2, 4, 8, 16, 10_000), ("1–2", "3–4", "5–8", "9–16", "17+"))
REPEAT_BINS = ((0, 1, 2, 5, 20, 100, 10**9), ("1", "2", "3–5", "6–20", "21–100", "100+"))


def profile_dimensions(x: str, packages: str, d: Spark = SPARK, known: dict[str, str] | None = None) -> dict[str, str]:
    """The thirteen dimensions that a row's text and package filter have."""
    m = known or marks(x, d)
    seen = f"length({d.substitute(x, f'[{BLANK}]+', '')})"
    signs = f"length({d.substitute(x, f'[{BLANK}{WORD}.{chr(39)}]+', '')})"
    percent = once(seen, lambda n: f"case when {n} > 0 then {d.half_even(f'cast(100 * {signs} as double) / {n}')} else 0 end", d, "u")
    yes = "case when {} then 'yes' else 'no' end".format
    return {
        "surface": surface(x, d, m),
        "intent_cue": intent_cue(x, d, m),
        "domain_cue": domain_cue(domain_tokens(x, d), d),
        "words": once(words(x, d), lambda n: bucket(n, (0, 2, 4, 8, 16, 32, 64, 128)), d),
        "characters": bucket(f"length({x})", (0, 32, 64, 128, 256, 512, 1024)),
        "symbol_percent": once(percent, lambda n: bucket(n, (0, 10, 25, 50, 75, 100)), d),
        "filtered": yes(f"{d.size(packages)} > 0"),
        "filter_count": bucket(d.size(d.distinct_sorted(packages)), (0, 1, 3)),
        "multiline": yes(d.rlike(x, "\\n")),
        "non_ascii": yes(d.rlike(x, "[^\\x00-\\x7F]")),
        "latex": yes(m["has_latex"]),
        "proof_marker": yes(m["is_proof"]),
        "identifier_present": yes(m["has_name"]),
    }


#: The names of the thirteen dimensions.
DIMENSIONS = tuple(profile_dimensions("x", "p"))


def with_dimensions(rows: DataFrame, x: str, packages: str) -> DataFrame:
    """rows with the thirteen dimensions; what several of them ask of the text is worked out once."""
    rows = rows.withColumns({f"_{n}": F.expr(e) for n, e in marks(x).items()})
    known = {n: f"_{n}" for n in marks(x)}
    return rows.withColumns({n: F.expr(e) for n, e in profile_dimensions(x, packages, SPARK, known).items()}).drop(*known.values())
