"""Table functions called from SQL against the functions behind them; surfaces to their fixed point."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lodecraft.functions import answers, tables, text

TEXTS = [r"\boxed{1} and \boxed{\frac{1}{2}}", "$x$ then $$y$$ and $z$", "no group", "", None, r"\boxed{a{b}", "{1, {2, 3}, (4, 5)}", "(1, 2)", "{1, 2", "7/2", "{}", "{3, 3.0, 6/2}"]


@pytest.fixture(scope="module")
def rows(spark):
    tables.register_all(spark)
    return spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")


def test_groups(spark, rows):
    for kind, marker in (("boxed", None), ("display", "$$"), ("inline", "$")):
        found = spark.sql("SELECT k, place, value FROM {rows}, LATERAL answer_groups(t, :kind)", args={"kind": kind}, rows=rows).collect()
        want = [(k, i, v) for k, t in enumerate(TEXTS) if t is not None for i, v in enumerate(answers.boxed(t) if kind == "boxed" else answers.dollar_groups(t, marker))]
        assert sorted(tuple(r) for r in found) == sorted(want)


def test_items(spark, rows):
    found = spark.sql("SELECT k, path, depth, kind, value, error FROM {rows}, LATERAL answer_items(t) ORDER BY k, path", rows=rows).collect()
    of = {(r.k, r.path): r for r in found}
    assert [of[6, p].value for p in ("", "0", "1", "1.0", "1.1", "2", "2.0", "2.1")] == [answers.form(answers.collection(TEXTS[6])), "1", answers.form(answers.collection("{2, 3}")), "2", "3", "(4, 5)", "4", "5"]
    assert (of[9, ""].kind, of[9, ""].value, of[10, ""].value) == ("number", "7/2", "{}") and (10, "0") not in of
    assert of[11, ""].value == "{3}" and [of[11, str(k)].value for k in range(3)] == ["3"] * 3
    assert of[8, ""].error and of[2, ""].error and of[8, ""].value is None
    assert not [r for r in found if r.k == 4]


def test_first_accepted_streams_over_a_task(spark):
    rng = random.Random(1)
    data = [(f"t{rng.randrange(7)}", p, rng.random() < 0.4) for p in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(data, "task_id string, place long, accepted boolean").repartition(5)
    tables.register_all(spark)
    found = {r.place: r.outcome for r in spark.sql("SELECT * FROM first_accepted(TABLE({df}))", df=df).collect()}
    seen, want = set(), {}
    for t, p, ok in sorted(data, key=lambda r: r[1]):
        want[p] = "rejected" if not ok else "duplicate_task" if t in seen else "accepted"
        seen |= {t} if ok else set()
    assert found == want


def test_arguments_are_checked_when_a_query_is_analysed(spark, rows):
    for sql in ("SELECT * FROM answer_groups('x', 'other')", "SELECT * FROM answer_groups(1, 'boxed')", "SELECT * FROM answer_items(array(1))", "SELECT * FROM first_accepted(TABLE(SELECT 1 AS a))"):
        with pytest.raises(AnalysisException):
            spark.sql(sql).schema  # noqa: B018


def test_names_are_taken_once(spark):
    own = tables.TableFunctions(spark)
    own.register("my_items", tables.AnswerItems)
    own.register_text_function("shout", lambda x: x.upper() if x != "bad" else 1 / 0)
    for name in ("my_items", "MY_ITEMS", "shout", "upper", "no name", "1x"):
        with pytest.raises(ValueError, match="name|already"):
            own.register(name, tables.AnswerItems)
    with pytest.raises(ValueError, match="new function"):
        own.register_text_function("shout", str)
    found = spark.sql("SELECT shout(x) AS y FROM VALUES ('a'), ('bad'), (NULL) v(x)").collect()
    assert [r.y for r in found] == ["A", "error: division by zero", None]
    assert spark.sql("SELECT count(*) AS n FROM my_items('(1, 2)')").first().n == 3


def test_surfaces_to_the_fixed_point(spark):
    rng = random.Random(3)
    data = ["", "$", "$$", "$ $", r"\(x\)"]
    for _ in range(200):
        x = rng.choice(["x", "", "a b", r"\dfrac12", "−3", r"\(", "$"])
        for _ in range(rng.randint(0, 12)):
            left, right = rng.choice([("$$", "$$"), (r"\[", r"\]"), (r"\(", r"\)"), ("$", "$")])
            x = f"{left}{rng.choice(['', ' '])}{x}{right}"
        data.append(x)
    df = spark.createDataFrame([(k, x) for k, x in enumerate(data)], "k int, x string")
    found = {r.k: r.s for r in df.select("k", text.normalize_surface(text.canonical_text(F.col("x"))).alias("s")).collect()}
    assert {k: found[k] for k in found} == {k: answers.surface(x) for k, x in enumerate(data)}
