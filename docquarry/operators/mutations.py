"""Rules tried on tables that were damaged on purpose: which rule finds which damage, in one job.

Every table is held once as it is and once for each mutation. The copies can't meet in a rule's joins and groups, since the
columns by which rules join and group begin with the mutation's name there. So a rule runs once over all copies.

Copies are many times the table, and what reads a small file is one task: a table is dealt to more tasks before it is multiplied.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between a mutation's name and a value.
MARK = "\x1f"
#: Copied rows of one task, about: rules may sort them where they are made.
ROWS = 1 << 19


class Mutation(NamedTuple):
    """Damage to the rows of ``table`` for which ``where`` holds: columns get other values, or the rows go or come twice."""

    name: str
    table: str
    where: Column
    changes: dict[str, Column] = {}
    copies: int = 1


class Table(NamedTuple):
    """Rows, and the columns (strings or arrays of strings) by which rules join and group them."""

    rows: DataFrame
    keys: tuple[str, ...]


def mutated(name: str, table: Table, mutations: list[Mutation]) -> DataFrame:
    """The table's copies, told apart by their keys; null and empty keys stay so. No copy is shuffled, but the rows are where they are many."""
    rows, kind = table.rows, {f.name: f.dataType.typeName() for f in table.rows.schema}
    tasks = -(-rows.count() * (len(mutations) + 1) // ROWS)
    if tasks > 1:
        rows = rows.repartition(tasks, *table.keys)
    out = rows.withColumn("_mutation", F.explode(F.array(*[F.lit(m.name) for m in (Mutation("", "", F.lit(False)), *mutations)])))
    own = [m for m in mutations if m.table == name]
    hit = {m.name: (F.col("_mutation") == m.name) & F.coalesce(m.where, F.lit(False)) for m in own}
    times = reduce(lambda n, m: F.when(hit[m.name], m.copies).otherwise(n), (m for m in own if m.copies != 1), F.lit(1))
    columns = {c: reduce(lambda v, m: F.when(hit[m.name], m.changes[c]).otherwise(v), (m for m in own if c in m.changes), F.col(c)) for c in rows.columns}
    out = out.select("_mutation", times.alias("_times"), *[v.alias(c) for c, v in columns.items()])
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_times"))))

    def tag(value: Column) -> Column:
        return F.when((value == "") | (F.col("_mutation") == ""), value).otherwise(F.concat("_mutation", F.lit(MARK), value))

    tagged = {c: F.transform(c, tag) if kind[c] == "array" else tag(F.col(c)) for c in table.keys}
    return out.select(*[tagged.get(c, F.col(c)).alias(c) for c in rows.columns])


def corruption_matrix(tables: dict[str, Table], mutations: list[Mutation], rules: dict[str, Callable[[dict[str, DataFrame]], DataFrame]]) -> DataFrame:
    """mutation ('' for the tables as they are), rule, fault and n, the number of faults.

    A rule gets all tables and returns rows whose first column is one of the keys; a column ``fault`` is named where it has one.
    """
    copies = {name: mutated(name, table, mutations) for name, table in tables.items()}
    parts = []
    for name, rule in rules.items():
        found = rule(copies)
        fault = F.col("fault") if "fault" in found.columns else F.lit(name)
        key = F.col(found.columns[0])
        mutation = F.when(F.contains(key, F.lit(MARK)), F.substring_index(key, MARK, 1)).otherwise("")
        parts.append(found.select(mutation.alias("mutation"), F.lit(name).alias("rule"), fault.alias("fault")))
    return reduce(DataFrame.unionByName, parts).groupBy("mutation", "rule", "fault").agg(F.count("*").alias("n"))


def mutation_verdicts(matrix: DataFrame, mutations: list[Mutation]) -> DataFrame:
    """mutation, caught and the rules (rule:fault) whose number of faults isn't that of the undamaged tables.

    A clean table may have faults of its own: a mutation is caught by what changes. The mutation '' is caught by none, so
    there ``rules`` are those that find faults in the tables as they are.
    """
    names = matrix.sparkSession.createDataFrame([(m.name,) for m in (Mutation("", "", F.lit(False)), *mutations)], "mutation string")
    clean = matrix.where("mutation = ''").select("rule", "fault", F.col("n").alias("_n"))
    asked = F.broadcast(names).crossJoin(matrix.select("rule", "fault").distinct())  # both bounded: names and kinds of faults
    met = asked.join(matrix, ["mutation", "rule", "fault"], "left").join(clean, ["rule", "fault"], "left")
    differs = ~F.coalesce("n", F.lit(0)).eqNullSafe(F.when(F.col("mutation") == "", 0).otherwise(F.coalesce("_n", F.lit(0))))
    fired = met.where(differs).groupBy("mutation").agg(F.sort_array(F.collect_set(F.concat_ws(":", "rule", "fault"))).alias("rules"))
    rules = F.coalesce("rules", F.array().cast("array<string>"))
    return names.join(fired, "mutation", "left").select("mutation", ((F.size(rules) > 0) & (F.col("mutation") != "")).alias("caught"), F.array_join(rules, " ").alias("rules"))
