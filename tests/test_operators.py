import numpy as np
import pytest
from pyspark.sql import functions as F

from lodecraft.functions import rewards, text
from lodecraft.operators import evaluation, graph, sft
from lodecraft.operators.numbering import number_rows
from lodecraft.sources import readers, tasks


def test_reward_example(spark):
    df = spark.range(1).select(rewards.reward(rewards.PRESETS["r2"], F.lit(True), F.lit(2), F.lit(5.0), F.lit(0), F.lit(0), F.lit(4), F.lit(10.0), F.lit(0)).alias("r"))
    r = df.first().r
    assert (r.total, r.tool_cost, r.python_cost) == (0.875, 0.075, 0.05)


def test_group_advantages(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 1.0), (2, 0.1), (2, 0.1), (2, 0.1)], "g int, r double")
    found = {(x.g, x.r): (round(x.advantage, 4), x.effective) for x in rewards.group_advantages(rows, "g", "r").collect()}
    assert found == {(1, 0.0): (-1.0, True), (1, 1.0): (1.0, True), (2, 0.1): (0.0, False)}
    with pytest.raises(Exception, match="not finite"):
        rewards.group_advantages(spark.createDataFrame([(1, float("nan"))], "g int, r double"), "g", "r").collect()


@pytest.mark.parametrize(("up", "down", "p"), [(22, 3, 0.000156522), (49, 42, 0.529602095), (1, 1, 1.0), (0, 0, 1.0), (5, 0, 0.0625)])
def test_mcnemar(spark, up, down, p):
    assert spark.range(1).select(evaluation.mcnemar(F.lit(up), F.lit(down)).alias("p")).first().p == p


def test_bootstrap_of_one_up_and_one_down(spark):
    pairs = spark.createDataFrame([(1, True, False), (2, False, True)], "task_id int, base boolean, sft boolean")
    r = evaluation.bootstrap(pairs, resamples=400).first()
    assert (r.n, r.delta, r.low, r.high) == (2, 0.0, -1.0, 1.0)


def test_bootstrap_interval_is_that_of_other_draws(spark):
    import numpy as np

    up, down, n = 130, 70, 800
    pairs = spark.range(n).selectExpr("id AS task_id", f"id >= {up} AND id < {up + down} AS base", f"id < {up} AS sft")
    r = evaluation.bootstrap(pairs, resamples=4000).first()
    draws = np.random.default_rng(1).multinomial(n, [up / n, down / n, 1 - (up + down) / n], 4000)
    low, high = np.quantile((draws[:, 0] - draws[:, 1]) / n, [0.025, 0.975])
    assert (r.n, r.delta) == (n, 0.075) and abs(r.low - low) < 0.003 and abs(r.high - high) < 0.003
    assert evaluation.bootstrap(pairs.limit(0)).collect() == []


def test_hot_keys_are_split(spark):
    from lodecraft.operators.skew import hot_limit, join_counted

    left = spark.range(3000).selectExpr("CASE WHEN id < 2000 THEN 7 ELSE id END AS k", "id AS v").unionAll(spark.sql("SELECT CAST(NULL AS LONG), 1L"))
    right = left.where("k % 2 = 1").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    limit = hot_limit(3000, spark)
    for how in ("inner", "left"):
        got = join_counted(left, right, ["k"], F.col("v"), "n", limit, how)
        want = left.join(right, ["k"], how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns
    assert hot_limit(100, spark) is None


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (1, 1)], "a long, b long")
    assert {r.id: r.root for r in graph.components(links).collect()} == {5: 1, 4: 1, 3: 1, 9: 8}
    assert graph.components(links.limit(0)).collect() == []


def test_numbering(spark):
    df = spark.createDataFrame([(x % 3, x * 7 % 50) for x in range(50)], "g int, x int")
    rows = number_rows(df, F.floor(F.col("x") / 10), [F.col("x")], "r", ["g"]).collect()
    for g in range(3):
        own = sorted((r.x, r.r) for r in rows if r.g == g)
        assert [r for _, r in own] == list(range(1, len(own) + 1))


def test_padding_never_cuts(spark):
    df = spark.createDataFrame([([1, 2],)], "x array<int>")
    assert df.select(sft.pad_right(F.col("x"), F.lit(4), 9).alias("p")).first().p == [1, 2, 9, 9]
    with pytest.raises(Exception, match="longer"):
        df.select(sft.pad_right(F.col("x"), F.lit(1))).collect()


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"problem": "p", "n": 1}\n\n{"problem": null, "n": 2}\n')
    rows, revision = readers.load(spark, "jsonl", {"path": str(tmp_path / "a.jsonl"), "schema": "problem string, n int", "order": "n"}, sample=1)
    assert rows.collect()[0].problem == "p" and revision == "local"
    with pytest.raises(ValueError, match="unknown loader"):
        readers.load(spark, "nothing", {})
    with pytest.raises(ValueError, match="missing columns"):
        readers.require_columns(rows, ["problem", "other"])
    m = spark.createDataFrame([([("user", "a"), ("user", "b"), ("assistant", "c")],), ([("system", "s")],), ([],)], "m array<struct<role:string,content:string>>")
    assert [r.x for r in m.select(readers.last_user_message(F.col("m")).alias("x")).collect()] == ["b", "s", None]


def test_task_table_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("d:1", "p", "d", "h", "7")], "task_id string, problem string, dataset string, source_hash string, answer string")
    tasks.write_tasks(tasks.flatten(rows), str(tmp_path / "t"))
    back = tasks.read_tasks(spark, str(tmp_path / "t"))
    assert tuple(back.columns) == tasks.COLUMNS and back.first().reference_value == "7"
    with pytest.raises(Exception, match="(?i)exist"):
        tasks.write_tasks(tasks.flatten(rows), str(tmp_path / "t"))


def test_near_pairs_equal_brute_force(spark):
    import random

    from lodecraft.operators import corpus

    rng = random.Random(4)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 90))) for _ in range(12)]
    texts = [*(list(rng.choice(base)) for _ in range(90)), list("ab"), list("ab"), [], list("🙂🙂🙂🙂🙂🙂x")]
    for t in texts[:90]:
        for _ in range(rng.choice((0, 0, 1, 3))):
            t[rng.randrange(len(t))] = rng.choice("abcdeé")
    data = {i: "".join(t) for i, t in enumerate(texts)}
    sets = {i: {t[k : k + 5] for k in range(max(1, len(t) - 4))} for i, t in data.items()}
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in data for b in data if a < b and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b])}
    got = corpus.near_pairs(spark.createDataFrame(list(data.items()), "id long, canonical string")).collect()
    assert len(want) > 50 and len(got) == len(want) and {tuple(r) for r in got} == want


def test_similar_sets_share_a_part_and_parts_are_few():
    from lodecraft.operators import corpus

    rng, edges, sent, shingles = np.random.default_rng(3), corpus._edges(0.9), 0, 0
    for size in [*range(1, 60), *(int(x) for x in np.geomspace(60, 9000, 60))]:
        one = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        most = int(size * 2 * 0.1 / 1.9 + 1e-9)  # differences of sets of about one size
        for shape in ("less", "more", "both", "first"):
            gone = 0 if shape == "more" else size // 10 if shape in ("less", "first") else most // 2
            new = size // 9 if shape == "more" else most // 2 if shape == "both" else 0
            kept = one[gone:] if shape == "first" else np.delete(one, rng.choice(size, gone, replace=False))
            other = np.unique(np.append(kept, rng.integers(0, 1 << 64, new, dtype=np.uint64)))
            common = len(np.intersect1d(one, other))
            if common >= 0.9 * (len(one) + len(other) - common) - 1e-9:
                assert set(corpus.part_digests(one, 0.9, edges).tolist()) & set(corpus.part_digests(other, 0.9, edges).tolist()), (size, shape)
                assert corpus._apart(corpus._sketch(one), corpus._sketch(other)) <= len(one) + len(other) - 2 * common
        if size > 500:
            sent, shingles = sent + len(corpus.part_digests(one, 0.9, edges)), shingles + size
    assert sent < 0.2 * shingles


def test_near_pairs_meet_in_few_rows(spark, monkeypatch):
    """Texts without near ones send packed digests and meet in next to none; the index of rarest shingles had a row for each sixth shingle."""
    import random

    from lodecraft.operators import corpus

    rng, rows = random.Random(5), {}
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(300)]
    texts[1] = texts[0] + " end"
    kept = corpus.materialise

    def counted(df, name):
        out = kept(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(corpus, "materialise", counted)
    got = corpus.near_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, canonical string")).collect()
    assert [(r.a, r.b) for r in got] == [(0, 1)] and sum(rows.values()) < 10 * len(texts)


def test_ids(spark):
    df = spark.createDataFrame([("ds", "a b")], "d string, c string").select(text.task_id(F.col("d"), F.col("c")).alias("i"), text.shingles(F.lit("abcdefg")).alias("s"), text.shingles(F.lit("ab")).alias("t"))
    r = df.first()
    assert r.i.startswith("ds:") and len(r.i) == 23 and sorted(r.s) == ["abcde", "bcdef", "cdefg"] and r.t == ["ab"]
