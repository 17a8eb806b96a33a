"""Tiered lookups inside a scope: the first tier that fits gives the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .numbering import numbered_rows


# Fixed value: digits that a query must have to be taken for a number.
LEAST_DIGITS = 4


def letter_score(query: Column, canonical: Column, number: Column, title: Column, header: Column, program: Column) -> Column:
    """Letters: number (of four digits or more), title, program, header, body."""
    forms = {
        "q": X.lookup_form(query), "d": X.digits(query), "c": X.digits(canonical), "n": X.digits(number), "t": X.lookup_form(title),
        "p": X.lookup_form(program), "h": X.lookup_form(header), "b": X.lookup_form(F.concat_ws(" ", title, header, program)),
    }

    def tiers(x: Column) -> Column:
        numeric = F.length(x["d"]) >= LEAST_DIGITS
        return (
            F.when(x["q"] == "", 0)
            .when(numeric & (x["d"] == x["c"]), 100000)
            .when(numeric & (x["d"] == x["n"]), 90000)
            .when(x["t"] == x["q"], 80000)
            .when(F.contains(x["t"], x["q"]), 70000)
            .when(F.contains(x["p"], x["q"]), 50000)
            .when(F.contains(x["h"], x["q"]), 40000)
            .when(F.contains(x["b"], x["q"]), 30000)
            .otherwise(0)
        )

    return X.bound(forms, tiers)


def question_score(query: Column, question: Column, answer: Column) -> Column:
    """Questions: the question, then question and answer."""
    forms = {"q": X.lookup_form(query), "t": X.lookup_form(question), "b": X.lookup_form(F.concat_ws(" ", question, answer))}
    return X.bound(forms, lambda x: F.when(x["q"] == "", 0).when(F.contains(x["t"], x["q"]), 60000).when(F.contains(x["b"], x["q"]), 40000).otherwise(0))


def update_score(query: Column, title: Column, number: Column, programs: Column, sections: Column, body: Column) -> Column:
    """Updates: number, title, programs, sections, body, then all of at least two words (parted by white space, repeats included) in the body."""
    words = F.filter(F.transform(F.split(F.coalesce(query, F.lit("")), f"[{X.SPACE}]+"), X.lookup_form), lambda t: t != "")
    forms = {
        "q": X.lookup_form(query), "n": X.number_query(query), "o": X.official_number(number), "t": X.lookup_form(title), "p": X.lookup_form(programs),
        "s": X.lookup_form(sections), "b": X.lookup_form(body), "w": words,
    }

    def tiers(x: Column) -> Column:
        return (
            F.when(x["q"] == "", 0)
            .when(x["q"].rlike("^[0-9]+$") & (F.length(x["q"]) < 6), 0)
            .when((x["n"] != "") & (x["n"] == x["o"]), 100000)
            .when(x["t"] == x["q"], 90000)
            .when(F.contains(x["t"], x["q"]), 80000)
            .when(F.contains(x["p"], x["q"]), 70000)
            .when(F.contains(x["s"], x["q"]), 65000)
            .when(F.contains(x["b"], x["q"]), 50000)
            .when((F.size(x["w"]) >= 2) & F.forall(x["w"], lambda t: F.contains(x["b"], t)), F.lit(30000) + F.size(x["w"]))
            .otherwise(0)
        )

    return X.bound(forms, tiers)


def scored_rows(rows: DataFrame, query: Column, score: Column) -> DataFrame:
    """Rows with a score above 0, worked out once for each; all rows for the empty query, none for one of punctuation alone."""
    kept = F.filter(F.array(score.cast("long")), lambda s: (F.coalesce(query, F.lit("")) == "") | (s > 0))
    return rows.withColumn("score", F.explode(kept))


def looked_up(rows: DataFrame, query: Column, score: Column, *ties: Column) -> DataFrame:
    """``scored_rows``, ranked by score and ``ties``: by range partitions and their totals."""
    keys = {f"_tie{i}": t for i, t in enumerate(ties)}
    found = scored_rows(rows, query, score).withColumns({"_worse": -F.col("score"), **keys})
    return numbered_rows(found, "_worse", *keys, name="rank").drop("_worse", *keys)


def update_order() -> list[Column]:
    """The order of found updates: score, then date (none last), then id, then place."""
    return [F.desc("score"), F.desc(F.coalesce("event_date", F.lit(""))), F.col("id"), F.col("ord")]


def filter_group(rows: DataFrame, group: str = "", column: str = "group_id") -> DataFrame:
    """Rows of one group; all for an empty choice."""
    return rows.where(F.col(column) == group) if group else rows


def ranked_in_groups(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def filter_updates(rows: DataFrame, program: str = "", kind: str = "", year: str = "", relation: str = "") -> DataFrame:
    """Filters of the updates list; empty ones don't filter."""
    out = rows
    if program:
        out = out.where(F.array_contains("loan_ids", program))
    if kind:
        out = out.where(F.col("source_type") == kind)
    if year:
        out = out.where(F.substring("event_date", 1, 4) == year)
    if relation:
        out = out.where(F.array_contains("loan_ids", relation) | F.array_contains("section_ids", relation))
    return out


def filter_options(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).where(F.col(column).isNotNull()).distinct()
