"""Orders against every subset of small permutations, and the matrix of rules and damage on small tables."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from docquarry.operators import mutations as M
from docquarry.operators import ordering as O
from docquarry.operators import validation as V


def longest(values):
    """Indexes of the longest increasing run, the earliest of several, by trying all."""
    for size in range(len(values), 0, -1):
        for kept in combinations(range(len(values)), size):
            if all(values[a] < values[b] for a, b in zip(kept, kept[1:])):
                return list(kept)
    return []


def test_fewest_rows_are_out_of_place(spark):
    rng, rows, expected = random.Random(3), [], set()
    for g in range(120):
        values = rng.sample(range(100), rng.randint(0, 9))
        if g % 3 == 0:
            values.sort()
        assert [i for i, k in enumerate(O.in_place(values)) if k] == longest(values)
        rows += [(g, str(i), i, v) for i, v in enumerate(values)]
        expected |= {(g, str(i)) for i in range(len(values)) if i not in longest(values)}
    pairs = spark.createDataFrame(rows, "g int, id string, position int, place int").repartition(3)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("2", batch):  # parts that go over several batches, and many parts in one
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found = [tuple(r) for r in O.out_of_place(pairs, "g", "id", "position", "place").collect()]
        assert len(found) == len(expected) and set(found) == expected
    assert O.out_of_place(pairs.limit(0), "g", "id", "position", "place").collect() == []


def test_long_list(spark):
    n = 20_000
    pairs = spark.range(n).select(F.lit("one").alias("g"), F.col("id"), F.col("id").alias("position"), F.when(F.col("id") % 1000 == 7, F.col("id") + 400).otherwise(F.col("id")).alias("place"))
    assert sorted(r.id for r in O.out_of_place(pairs, "g", "id", "position", "place").collect()) == [i for i in range(n) if i % 1000 == 7]


def test_order_faults(spark):
    listed = spark.createDataFrame([("p", "a", 1), ("p", "c", 2), ("p", "b", 3), ("p", "x", 4), ("p", "a", 9), ("q", "a", 1), (None, "a", 1), ("q", None, 2)], "g string, id string, position int")
    document = spark.createDataFrame([("p", "a", 10), ("p", "b", 20), ("p", "c", 30), ("p", "a", 99), ("r", "a", 1), ("q", None, 5)], "g string, id string, place int")
    assert sorted(map(tuple, O.order_faults(listed, document, "g").collect())) == [("p", "a", "repeated"), ("p", "b", "out-of-place"), ("p", "x", "missing-target"), ("q", "a", "missing-target")]


def test_contents(spark):
    html = '<div data-toc><a href="#b">b</a><a href="#a">a</a><a href="/x">x</a></div><h2 id="a">a</h2><a href="#b">b</a><h2 id="b">b</h2>'
    pages = spark.createDataFrame([(1, html), (2, '<h2 id="a">a</h2><a href="#a">a</a>'), (3, None), (4, '<p data-toc><a>x</a></p>')], "page int, html string")
    found = O.contents_faults(pages, "page", "data-toc")
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, "a", "out-of-place"), (2, None, "no-contents"), (3, None, "no-contents"), (4, None, "no-contents")]


def test_matrix_of_damage(spark):
    rows = spark.createDataFrame([("a", ["x"], 1), ("b", ["x", "y"], 2), (None, None, 3), ("", [], 4)], "id string, of array<string>, v int")
    known = spark.createDataFrame([("x",), ("y",)], "id string")
    tables = {"rows": M.Table(rows, ("id", "of")), "known": M.Table(known, ("id",))}
    mutations = [M.Mutation("twice", "rows", F.col("v") == 2, copies=2), M.Mutation("gone", "known", F.col("id") == "y", copies=0), M.Mutation("large", "rows", F.col("v") < 3, {"v": F.col("v") + 10}), M.Mutation("null-hits-none", "rows", F.col("id") > "z", copies=0)]
    rules = {
        "duplicates": lambda t: V.duplicates(t["rows"].where("v < 3"), "id"),
        "unknown": lambda t: V.unknown(t["rows"], "of", t["known"], "id"),
        "values": lambda t: t["rows"].where("v > 5").select("id", F.lit("large").alias("fault")),
    }
    matrix = M.corruption_matrix(tables, mutations, rules)
    assert sorted(map(tuple, matrix.collect())) == [("gone", "unknown", "unknown", 1), ("large", "values", "large", 2), ("twice", "duplicates", "duplicates", 1)]
    got = {r.mutation: (r.caught, r.rules) for r in M.mutation_verdicts(matrix, mutations).collect()}
    assert got == {"": (False, ""), "twice": (True, "duplicates:duplicates"), "gone": (True, "unknown:unknown"), "large": (True, "values:large"), "null-hits-none": (False, "")}
    plain = M.mutated("rows", tables["rows"], mutations).where(~F.coalesce(F.contains("id", F.lit(M.MARK)), F.lit(False)) & F.col("id").isNotNull() & (F.col("id") != ""))
    assert sorted((r.id, r.of, r.v) for r in plain.collect()) == [("a", ["x"], 1), ("b", ["x", "y"], 2)]


def test_faults_of_undamaged_tables_catch_nothing(spark):
    rows = spark.createDataFrame([("a", 9), ("b", 1)], "id string, v int")
    mutations = [M.Mutation("harmless", "rows", F.lit(True), {"v": F.col("v") + 1}), M.Mutation("worse", "rows", F.col("v") == 1, {"v": F.lit(8)}), M.Mutation("better", "rows", F.lit(True), {"v": F.lit(0)})]
    matrix = M.corruption_matrix({"rows": M.Table(rows, ("id",))}, mutations, {"large": lambda t: t["rows"].where("v > 5").select("id")})
    got = {r.mutation: (r.caught, r.rules) for r in M.mutation_verdicts(matrix, mutations).collect()}
    assert got == {"": (False, "large:large"), "harmless": (False, ""), "worse": (True, "large:large"), "better": (True, "large:large")}


def test_copies_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS", 400, raising=False)
    rows = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.array(F.lit("x")).alias("of"), F.col("id").alias("v")).coalesce(1)
    mutations = [M.Mutation("twice", "rows", F.col("v") % 10 == 0, copies=2), M.Mutation("gone", "rows", F.col("v") % 4 == 0, copies=0), M.Mutation("elsewhere", "others", F.lit(True), copies=0)]
    copies = M.mutated("rows", M.Table(rows, ("id", "of")), mutations)
    assert copies.count() == 4000 + 100 - 250 and copies.distinct().count() == 4000 - 250
    assert max(r[0] for r in copies.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()) < 1200
    few = M.mutated("rows", M.Table(rows.limit(50), ("id", "of")), mutations)
    assert few.count() >= 200 - 50 and "REPARTITION" not in few._jdf.queryExecution().executedPlan().toString()
