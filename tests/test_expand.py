import pytest
from pyspark.sql import functions as F

from gradeframe.functions.identity import with_uuid
from gradeframe.operators import expand, render
from gradeframe.plans.ordered import dense_order, positions, read_order
from gradeframe.schemas import as_problems


def problems(spark, n=40):
    rows = [(i, f"q{i}", [f"{c}{i}" for c in "wxyz"[: 2 + i % 3]], i % 2) for i in range(n)]
    df = spark.createDataFrame(rows, "ord long, problem string, choices array<string>, answer_idx int")
    return with_uuid(as_problems(df))


def test_copies_are_permutations_that_keep_the_gold_slot(spark):
    copies = expand.augmented_copies(problems(spark), n=4, keeps=2, seed=7)
    for r in copies.collect():
        assert sorted(r.permutation) == list(range(len(r.choices)))
    kept = F.get("permutation", F.col("answer_idx")) == F.col("answer_idx")
    per = copies.groupBy("parent_uuid").agg(F.count_if(kept).alias("k"), F.count("*").alias("n"))
    assert all(r.k >= 2 and r.n == 4 for r in per.collect())


def test_copies_do_not_depend_on_partitioning(spark):
    def draw(n, seed=1):
        rows = expand.augmented_copies(problems(spark).repartition(n), seed=seed).collect()
        return sorted((r.parent_uuid, r.uuid, tuple(r.permutation)) for r in rows)

    assert draw(1) == draw(7)
    assert draw(1) != draw(1, seed=2)
    with pytest.raises(ValueError):
        expand.augmented_copies(problems(spark), n=1, keeps=2)


def test_all_permutations_occur(spark):
    ids = spark.range(3000).select(expand.permutation(F.col("id"), F.lit(3), 1).alias("p"))
    counts = ids.groupBy("p").count().collect()
    assert len(counts) == 6 and all(400 < r["count"] < 600 for r in counts)


def test_augmented_rows_follow_their_parents_settings(spark):
    rows = problems(spark, 3).withColumn("choice_key_type", F.lit("numbers"))
    out = expand.augment(rows, n=2, keeps=1)
    kinds = {(r.parent_uuid is None, r.choice_key_type) for r in out.collect()}
    assert kinds == {(True, "numbers"), (False, "letters")}
    assert out.count() == 9


def test_gold_line_of_a_permuted_row(spark):
    row = [("q", ["a", "b", "c"], 0, [1, 2, 0])]
    df = as_problems(
        spark.createDataFrame(row, "problem string, choices array<string>, answer_idx int, permutation array<int>")
    )
    r = df.select(render.choices_text().alias("c"), render.gold_text().alias("g")).first()
    assert r.c == "A. b\nB. c\nC. a\n"
    assert r.g == "B. a\n"  # keyed by permutation[answer], not by the shown position


def test_templates_are_checked(spark):
    with pytest.raises(ValueError):
        render.question_text("nothing")
    with pytest.raises(ValueError):
        render.choices_text("test_1")  # a question template without a choice template


def test_number_keys_and_null_problem(spark):
    df = as_problems(spark.createDataFrame([(None, ["a", "b"], 1)], "problem string, choices array<string>, answer_idx int"))
    df = df.withColumn("choice_key_type", F.lit("numbers"))
    r = df.select(render.question_text("default").alias("q"), render.gold_text("brace").alias("g")).first()
    assert r.q == "### Question: None\n\n### Choices: 1. a\n2. b\n\n\n### Answer:"
    assert r.g == "(2) b\n"


def test_unrolled_choices(spark):
    rows = expand.unroll_cloze(problems(spark, 2), unconditional=True).collect()
    assert len(rows) == 2 * (2 + 3)
    bare = [r for r in rows if r.unconditional]
    assert all(r.problem is None and r.prompt == "Answer:" for r in bare)
    # without an id the bare rows of different problems may share a uuid; the parent tells them apart
    assert len({(r.uuid, r.parent_uuid) for r in rows}) == len(rows)


def test_max_instances(spark):
    assert expand.max_instances(problems(spark), -1).count() == 40
    assert expand.max_instances(problems(spark), 0).count() == 40
    assert [r.ord for r in expand.max_instances(problems(spark), 3).collect()] == [0, 1, 2]
    assert expand.first_n(problems(spark), 0).count() == 0


def test_dense_order(spark):
    keys = [7 * i - 50 for i in range(500)]
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "k long").repartition(6)
    for blocks in (None, 2, 300):
        got = {r.k: r.ord for r in dense_order(df, "k", blocks=blocks).collect()}
        assert got == {k: i for i, k in enumerate(keys)}


def test_read_order_is_dense(spark):
    df = spark.range(0, 1000, 1, 7)
    got = read_order(df).collect()
    assert [r.ord for r in sorted(got, key=lambda r: r.id)] == list(range(1000))


def test_positions_with_a_hot_key(spark, small_blocks):
    rows = [("hot", i) for i in range(300)] + [("b", i) for i in range(2)] + [(None, 5)]
    df = spark.createDataFrame(rows, "k string, t int").repartition(5)
    from gradeframe.plans.ordered import int_block

    got = positions(df, ["k"], ["t"], int_block(F.col("t")), "pos").collect()
    assert {(r.k, r.t): r.pos for r in got} == {
        **{("hot", i): i for i in range(300)}, ("b", 0): 0, ("b", 1): 1, (None, 5): 0
    }


def test_range_blocks_follow_the_data(spark):
    """A key with a third of all rows, all within one hour, is spread over tasks like the others."""
    from gradeframe.plans.ordered import BLOCK, calendar_seconds, with_range_block

    start = F.lit("2024-03-31 00:00:00").cast("timestamp_ntz")
    crowded = F.col("id") < 4000
    within = F.when(crowded, F.col("id") * 0.9).otherwise(F.col("id") * 3600.0)
    df = spark.range(0, 12_000, 1, 5).select(
        F.when(crowded, F.lit("hot")).otherwise(F.concat(F.lit("u"), (F.col("id") % 50).cast("string"))).alias("k"),
        (start + F.make_dt_interval(secs=within)).alias("ts"),
        "id",
    )
    df = with_range_block(df, calendar_seconds(F.col("ts")), 200)
    got = positions(df, ["k"], ["ts", "id"], F.col(BLOCK), "pos").collect()
    lists = {}
    for r in sorted(got, key=lambda r: r.id):
        lists.setdefault(r.k, []).append(r.pos)
    assert len(lists) == 51 and all(x == list(range(len(x))) for x in lists.values())
    tasks = df.repartition(8, "k", BLOCK).groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(r["count"] for r in tasks)
    assert len(sizes) == 8 and sizes[-1] <= 3 * sizes[4]
    ties = with_range_block(df.withColumn("ts", F.lit(None).cast("timestamp_ntz")), calendar_seconds(F.col("ts")))
    none = positions(ties, ["k"], ["id"], F.col(BLOCK), "pos")
    assert none.where("k = 'hot'").agg(F.max("pos")).first()[0] == 3999


def test_range_blocks_are_found_by_halving(spark):
    """No bound is looked at one by one: a row's work does not grow with the number of blocks."""
    from gradeframe.plans.ordered import BLOCK, with_bound_block, with_range_block

    bounds = [-2.0, 0.0, 0.5, 3.0, 9.0]
    values = [None, float("-inf"), -2.0, -1.0, 0.0, 0.25, 0.5, 2.0, 3.0, 8.0, 9.0, 10.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    cuts = F.array(*map(F.lit, bounds))
    got = {str(r.v): r[BLOCK] for r in with_bound_block(df.withColumn("c", cuts), "v", "c", 6).collect()}
    assert got.pop("None") == 0 and got.pop("nan") == 5
    assert got == {str(v): sum(b < v for b in bounds) for v in values[1:-1]}
    none = with_bound_block(df.withColumn("c", F.lit(None).cast("array<double>")), "v", "c", 6)
    assert {r[BLOCK] for r in none.collect()} == {0}
    plan = with_range_block(spark.range(1000), F.col("id"), 200)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
