import pytest
from pyspark.sql import functions as F

from querylens.functions import numbers, text
from querylens.operators.groups import with_normal_form


def one(spark, value, *exprs):
    return tuple(spark.createDataFrame([(value,)], "x string").select(*(F.expr(e).alias(f"c{i}") for i, e in enumerate(exprs))).first())


@pytest.mark.parametrize(
    ("given", "log", "export"),
    [("a -> b", "a → b", "a -> b"), ("x<->y", "x↔y", "x<->y"), ("a <= b >= c != d", "a ≤ b ≥ c ≠ d", "a <= b >= c != d"), ("  a \t b\n", "a b", "a b"), ("x <- y", "x <- y", "x <- y"), ("é", "é", "é"), ("ℝ₁", "ℝ₁", "ℝ₁"), ("", "", "")],
)
def test_normal_forms(spark, given, log, export):
    df = spark.createDataFrame([(given,)], "query string")
    assert with_normal_form(df).first()["normalized"] == log
    assert with_normal_form(df, operators=False).first()["normalized"] == export


@pytest.mark.parametrize(
    ("given", "skeleton"),
    [("Nat.add_comm", "ID"), ("sum of a matrix", "W of W W"), ("?x + _ = 12", "HOLE + HOLE = NUM"), ("mulComm or MulComm", "ID or ID"), ("f (2.5)", "W ( NUM )"), ("?", "HOLE"), ("", ""), ("x' ₁", "W NUM")],
)
def test_skeleton(spark, given, skeleton):
    assert one(spark, given, text.skeleton(text.kinds("x"))) == (skeleton,)


def test_measures(spark):
    kinds = text.kinds("x")
    got = one(spark, r"Nat.add_comm is the \sum rule", *text.measures("x", kinds).values())
    assert got[0] == 29 and got[1] == 5 and got[5] == 1
    assert got[2] == pytest.approx(1 / 5) and got[3] == pytest.approx(2 / 5) and got[4] == pytest.approx(1 / 25)
    assert one(spark, "", *text.measures("x", kinds).values()) == (0, 0, 0.0, 0.0, 0.0, 0)


@pytest.mark.parametrize(
    ("given", "form"),
    [(" ", "empty"), ("⊢ p", "proof_state_or_statement"), ("theorem foo : x", "proof_state_or_statement"), ("Nat.add", "identifier_only"), (r"\frac a", "latex_present"), ("how so", "question_like"), ("use Nat.add here", "mixed_identifier_text"), ("a ≤ b", "symbolic_expression"), ("plain words", "other_text"), ("showcase", "other_text")],
)
def test_surface(spark, given, form):
    assert one(spark, given, text.surface("x")) == (form,)


def test_cues(spark):
    assert one(spark, "Nat.succ_le", text.intent_cue("x")) == ("known_item_candidate",)
    assert one(spark, "find a proof", text.intent_cue("x")) == ("multiple_cues",)
    assert one(spark, "why so", text.intent_cue("x")) == ("explanation",)
    assert one(spark, "nothing", text.intent_cue("x")) == ("unknown",)
    assert one(spark, "Prime ideal", text.domain_cue(text.domain_tokens("x"))) == ("multiple_domains",)
    assert one(spark, "a ring", text.domain_cue(text.domain_tokens("x"))) == ("algebra",)


def test_numbers(spark):
    got = spark.createDataFrame([(n,) for n in (0, 4, 5, 14, 15)], "n long").select(F.expr(numbers.rounded("n")), F.expr(numbers.rounded("n", 1)), F.expr(numbers.safe("n"))).collect()
    assert [tuple(r) for r in got] == [(0, 0, None), (0, 4, None), (10, 5, None), (10, 14, 10), (20, 15, 20)]
    assert one(spark, "x", text.bucket("0", (0, 2, 4)), text.bucket("3", (0, 2, 4)), text.bucket("5", (0, 2, 4))) == ("0", "3-4", "5+")
    assert one(spark, "x", text.binned("0", *text.LENGTH_BINS), text.binned("2", *text.LENGTH_BINS), text.binned("17", *text.LENGTH_BINS)) == (None, "1–2", "17+")


def test_linear_patterns_match_what_the_fixed_ones_match(spark):
    """Spark's patterns without repeated groups against the fixed ones in DuckDB, on random texts of telling characters."""
    import random

    import duckdb
    import pandas as pd

    from querylens.functions.dialect import DUCK

    rng = random.Random(3)
    bits = ["a", "b", "B", "1", "_", ".", "'", " ", "\n", "é", "²", "theorem", "lemma", ":", ":=", " by", "⊢", "x.y", "⅓"]
    rows = pd.DataFrame({"x": sorted({"".join(rng.choices(bits, k=rng.randrange(9))) for _ in range(6000)})})
    exprs = {"only": text.ONLY_NAME, "name": text.NAME, "ident": f"^(?:{text.IDENTIFIER})$", "proof": text.PROOF}
    got = spark.createDataFrame(rows).select("x", *(F.expr(text.SPARK.rlike("x", p)).alias(n) for n, p in exprs.items())).toPandas().sort_values("x", ignore_index=True)
    want = duckdb.sql("select x, " + ", ".join(f"{DUCK.rlike('x', p)} as {n}" for n, p in exprs.items()) + " from rows").df().sort_values("x", ignore_index=True)
    for n in exprs:
        differ = rows.x[(got[n] != want[n]).to_numpy()].tolist() if got.x.equals(want.x) else ["order"]
        assert not differ, (n, differ[:5])
        assert 0 < got[n].sum() < len(got)


LONG = {n: (part * (1_000_000 // len(part)))[:1_000_000] for n, part in {"dots": "a.", "digits": "1.", "underscores": "_a", "blanks": " ", "one_word": "a", "keywords": "theorem ", "words": "ring and "}.items()}


@pytest.mark.parametrize("name", LONG)
def test_a_megabyte_of_anything_passes(spark, name):
    df = spark.createDataFrame([(LONG[name], ["p"])], "x string, p array<string>")
    row = text.with_dimensions(df, "x", "p").first()
    assert row["surface"] == {"dots": "mixed_identifier_text", "digits": "other_text", "underscores": "mixed_identifier_text", "blanks": "empty"}.get(name, "other_text")
    kinds = df.select(F.expr(text.kinds("x")).alias("k"), "x").select(F.size("k").alias("n"), *(F.expr(e).alias(c) for c, e in text.measures("x", "k").items())).first()
    assert kinds["n"] >= 0 and kinds["n_chars"] == len(LONG[name])
