"""Verifiers, rewards, tools and models that users plug in; guards; functions with limits."""

import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodecraft.functions.bounded import Bounded, comparator
from lodecraft.functions.dispatch import Rewards, Verifiers, add_python_tool, standard
from lodecraft.functions.tools import Registry
from lodecraft.operators import generation, guards

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see this module


def _slow(a, b):
    if a == "wait":
        time.sleep(60)
    if a == "spin":
        while True:
            pass
    if a == "die":
        import os

        os._exit(3)
    if a == "raise":
        raise ValueError
    if a == "fill":
        return "correct" if bytearray(1 << 40) else ""
    return "correct" if a == b else "incorrect"


def test_bounded_starts_again_after_a_limit():
    bounded = Bounded(_slow, wall=0.5)
    assert bounded("x", "x") == ("ok", "correct")
    child = bounded.child.pid
    assert bounded("x", "y") == ("ok", "incorrect") and bounded.child.pid == child
    assert bounded("wait", "") == ("timeout", None) == bounded("spin", "")
    assert bounded("x", "x") == ("ok", "correct") and bounded.child.pid != child
    assert bounded("raise", "") == ("internal_error", "ValueError") and bounded("fill", "") == ("internal_error", "MemoryError")
    assert bounded("die", "")[0] == "internal_error" and bounded("x", "x") == ("ok", "correct")
    bounded.close()


def test_comparator(spark):
    df = spark.createDataFrame([("x", "x"), ("wait", "x"), ("raise", "x"), ("y", "x"), (None, "x"), ("x", None)], "p string, r string").coalesce(1)
    run = comparator(_slow, wall=0.5)
    assert [r[0] for r in df.select(run("p", "r")).collect()] == ["correct", "timeout", "internal_error", "incorrect", "invalid_prediction", "invalid_reference"]


def test_each_row_goes_to_the_verifier_of_its_type(spark):
    rows = [("3", "3", "integer"), ("1/2", "0.5", "rational"), ("{1,2}", "{2,1}", "set"), ("(1,2)", "(2,1)", "tuple"), ("x+1", "1+x", "expression"), ("1", "1", "shape"), ("1", "1", None), (None, "1", "integer")]
    df = spark.createDataFrame(rows, "p string, r string, k string").coalesce(1)
    got = [r[0] for r in df.select(standard().verdict(F.col("p"), F.col("r"), F.col("k"))).collect()]
    assert got == ["correct", "correct", "correct", "incorrect", "correct", "invalid_reference", "invalid_reference", "invalid_prediction"]
    own = Verifiers()
    own.register("length")(lambda p, r: F.when(F.length(p) == F.length(r), "correct").otherwise("incorrect"))
    assert df.select(own.verdict(F.col("p"), F.col("r"), F.lit("length")).alias("v")).first().v == "correct"
    with pytest.raises(ValueError):
        own.register("length")(lambda p, r: p)


def test_rewards(spark):
    rewards = Rewards()
    rewards.register("short")(lambda c: 1.0 / F.length(c["text"]))
    rewards.register("right")(lambda c: c["ok"].cast("double"))
    df = spark.sql("select 'abcd' t, true k").select(rewards.composite({"short": 2, "right": 0.5}, {"text": F.col("t"), "ok": F.col("k")}).alias("r"))
    assert tuple(df.first().r) == (1.0, 0.5, 0.5)
    for wrong in (lambda: rewards.composite({"no": 1}, {}), lambda: rewards.register("short")(len)):
        with pytest.raises(ValueError):
            wrong()


def test_lookup_fails_on_unknown_keys(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    assert sorted(r.v for r in guards.lookup(rows, table, ["k"]).collect()) == [1, 1, 2]
    for bad in ("c", None):
        with pytest.raises(Exception, match="unknown k"):
            guards.lookup(rows.union(spark.createDataFrame([(bad,)], "k string")), table, ["k"]).collect()


def test_latest_metrics_decide(spark):
    schema = "step int, loss double, reward double, verifier_error_rate double, invalid_action_rate double"
    rows = [(3, float("nan"), 0.1, 0.03, None), (1, 1.0, float("nan"), 0.9, 0.9), (2, 1.0, 0.0, 0.0, 0.3)]
    m = spark.createDataFrame(rows, schema)
    reasons = lambda df: guards.unhealthy(df, ["step"]).first().reasons
    assert reasons(m) == ["NaN loss", "verifier_error_rate=0.03 exceeds 0.02"]
    assert reasons(m.where("step < 3")) == ["invalid_action_rate=0.3 exceeds 0.25"]
    assert reasons(m.limit(0)) == ["no metrics recorded"]
    assert guards.last_row(m, ["step"]).first().step == 3


class Scripted:
    """Answers by problem: tool once then final, final at once, nonsense for ever, or an error."""

    def __call__(self, conversations):
        return [self.turn(c) for c in conversations]

    def turn(self, c):
        problem, said = c[1][1], sum(r == "assistant" for r, _ in c)
        if problem == "broken":
            raise RuntimeError("gone")
        if problem == "noise":
            return "noise", 1
        if problem == "tool" and not said:
            return '<tool_call>{"name": "double", "arguments": {"x": "21"}}</tool_call>', 3
        answer = c[-1][1] if problem == "tool" else "7"
        return '<final>{"answer": "%s"}</final>' % answer, 2


def test_episodes_and_verified_answers(spark):
    tasks = spark.createDataFrame([(k, k) for k in ("tool", "right", "wrong", "noise", "broken")], "task_id string, problem string")
    registry = Registry()
    add_python_tool(registry, "double", lambda x: str(2 * int(x)), F.get_json_object("arguments", "$.x"))
    run = lambda **more: generation.run_episodes(tasks, Scripted(), registry, "solve", 3, 1, batch=1, **more)
    episodes = run()
    got = {r.task_id: (r.reason, r.final_answer, r.steps, r.tool_calls, r.invalid_actions, r.generated_tokens, len(r.messages)) for r in episodes.collect()}
    assert got == {
        "tool": ("final", "42", 2, 1, 0, 5, 5), "right": ("final", "7", 1, 0, 0, 2, 3), "wrong": ("final", "7", 1, 0, 0, 2, 3),
        "noise": ("max_steps", None, 3, 0, 3, 3, 7), "broken": ("model_error", None, 0, 0, 0, 0, 2),
    }
    labels = spark.createDataFrame([("tool", "42", "integer"), ("right", "7", "integer"), ("wrong", "8", "integer"), ("noise", "1", "integer")], "task_id string, reference_value string, answer_type string")
    assert {r.task_id for r in generation.verified_only(episodes, labels, standard()).collect()} == {"tool", "right"}
    assert {r.reason for r in run(cancelled=lambda: True).collect()} == {"cancelled"}


def test_a_failed_call_marks_its_rows_only(spark):
    prompts = spark.createDataFrame([(i, [("system", "s"), ("user", "broken" if i == 2 else "right")]) for i in range(4)], f"id int, messages {generation.MESSAGES}").coalesce(1)
    got = {r.id: (r.generated_tokens, r.error) for r in generation.generate(prompts, Scripted(), "id", batch=1).collect()}
    assert got == {i: (0, "RuntimeError: gone") if i == 2 else (2, None) for i in range(4)}
