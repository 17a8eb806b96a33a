"""Search from saved records: postings of three-letter grams give the candidates, the usual scoring verifies them.

An index is a published folder (see ``sources.versions``) with three tables:

* ``records``: the prepared records with the digest of what they were made from, in folders by a hash of ord (``slice``);
* ``postings``: (gram, block, ords), the records of each gram, in folders by a hash of the gram and sorted by it, with at
  most as many ords in a row as a block of records has;
* ``grams``: (gram, n), the number of records of each gram.

A term can only stand in a record that has all of its grams, so the rarest grams of each term of a query (and of its
number) name all records that could have evidence. Those are fetched by equality of ord and scored; no record meets a query
without cause. A query keeps the scan where it must: with a term under three characters, or where its rarest grams are in
more than ``SCAN_SHARE`` of the records. Both ways give the same rows.

What is known of the queries (terms, grams, candidates) is held in the plan up to 20,000 rows and then also names the
folders that are read; larger query tables are written to the shared folder and joined.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import unicode as U
from ..sources import versions
from ..sources.shared import settled, written
from . import search as S

#: Raised whenever the rules of preparation change: an index of other rules is refused.
RULES = 1
SCAN_SHARE, GRAMS_PER_TERM = 0.2, 3
#: Records of a block of postings and of a slice; the most folders of records and of grams.
BLOCK, SLICE, MOST_FOLDERS = 65_536, 1000, 1000
#: Characters of the records whose grams a worker sorts at a time.
CHUNK = 1_000_000
_SHIFT = 21  # bits of a code point


def _gram_rows(rows: DataFrame) -> DataFrame:
    """(block, gram, ords) of rows (ord, block, texts): the distinct records of each gram in a run of records with CHUNK
    characters, so what is shuffled are lists, not pairs. A gram doesn't reach from one text into the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy()
            texts, at, size = batch.column(2).values, 0, 0
            for i in range(batch.num_rows):
                size += sum(len(t.as_py() or "") for t in texts[int(ends[i]) : int(ends[i + 1])])
                if size >= CHUNK or i + 1 == batch.num_rows:
                    yield grouped(batch.slice(at, i + 1 - at))
                    at, size = i + 1, 0

    def grouped(rows: pa.RecordBatch) -> pa.RecordBatch:
        codes, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, texts in enumerate(rows.column(2).to_pylist()):
            found = []
            for t in texts:
                c = np.frombuffer((t or "").encode("utf-32-le"), "<u4").astype(np.int64)
                found.append(c[:-2] << (2 * _SHIFT) | c[1:-1] << _SHIFT | c[2:])
            codes.append(np.unique(np.concatenate(found)))
            place.append(np.full(len(codes[-1]), i))
        gram, row = np.concatenate(codes), np.concatenate(place)
        block = rows.column(1).to_numpy()[row]
        order = np.lexsort((gram, block))
        gram, row, block = gram[order], row[order], block[order]
        first = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])][: len(gram)])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(gram)], pa.int32()), rows.column(0).take(pa.array(row)))
        return pa.RecordBatch.from_arrays([pa.array(block[first], pa.int32()), pa.array(gram[first]), lists], names=["block", "gram", "ords"])

    ord_type = rows.schema["ord"].dataType
    return rows.mapInArrow(run, T.StructType([T.StructField("block", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("ords", T.ArrayType(ord_type))]))


def _term_grams(term: Column) -> Column:
    """The same for one short text, in the JVM."""
    code = lambda i: F.ascii(F.substring(term, i, F.lit(1))).cast("long")
    each = F.transform(F.sequence(F.lit(1), F.length(term) - 2), lambda i: F.shiftleft(code(i), 2 * _SHIFT).bitwiseOR(F.shiftleft(code(i + 1), _SHIFT)).bitwiseOR(code(i + 2)))
    return F.when(F.length(term) >= 3, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))


def _part(gram: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(parts)).cast("int")


def _digest(records: DataFrame) -> Column:
    """256 bits of all columns of a record, by their names."""
    return F.sha2(F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"}), 256)


_POSTINGS = "gram long, block int, ords array<{}>, part int"


class Index:
    """A version of an index, open for reading."""

    def __init__(self, spark: SparkSession, number: int, folder: str):
        self.spark, self.number, self.folder = spark, number, folder
        meta = spark.read.parquet(f"{folder}/meta").first()
        self.n_records, self.slices, self.blocks, self.parts, self.rules = meta["records"], meta["slices"], meta["blocks"], meta["parts"], meta["rules"]
        if self.rules != RULES:
            raise ValueError(f"the index was prepared by rules {self.rules}, these are {RULES}: build it anew")
        kinds = T.StructType.fromJson(json.loads(meta["columns"]))
        self.records = spark.read.schema(kinds).parquet(f"{folder}/records")
        self.postings = spark.read.schema(_POSTINGS.format(kinds["ord"].dataType.simpleString())).parquet(f"{folder}/postings")
        self.grams = spark.read.schema("gram long, n long, part int").parquet(f"{folder}/grams")


def _some_postings(prepared: DataFrame, blocks: int, parts: int) -> DataFrame:
    """part, gram, block, ords of prepared records; a gram and block may have more than one row."""
    fields = F.array(*[f"f_{f}" for f in S.FIELDS])
    each = prepared.select("ord", F.pmod(F.xxhash64("ord"), F.lit(blocks)).cast("int").alias("block"), fields.alias("texts"))
    return _gram_rows(each).select(_part("gram", parts).alias("part"), "gram", "block", "ords")


def _by_part(some: DataFrame) -> GroupedData:
    """Grouped for the postings' rows, dealt by part, so that they are shuffled once and lie as they are written."""
    return some.repartition("part").groupBy("part", "gram", "block")


def _postings(prepared: DataFrame, blocks: int, parts: int) -> DataFrame:
    return _by_part(_some_postings(prepared, blocks, parts)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ords")))).alias("ords"))


def _write_postings(postings: DataFrame, folder: str) -> None:
    """``postings`` come dealt by part (see ``_by_part``)."""
    postings.select("gram", "block", "ords", "part").sortWithinPartitions("part", "gram", "block").write.partitionBy("part").parquet(f"{folder}/postings")
    spark = postings.sparkSession
    counts = spark.read.schema(postings.select("gram", "block", "ords", "part").schema).parquet(f"{folder}/postings").groupBy("part", "gram").agg(F.sum(F.size("ords")).alias("n"))
    counts.repartition("part").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{folder}/grams")


def _write(folder: str, prepared: DataFrame, postings: DataFrame | None, slices: int, blocks: int, parts: int) -> None:
    spark = prepared.sparkSession
    keyed = prepared.withColumn("slice", F.pmod(F.xxhash64("ord"), F.lit(slices)).cast("int"))
    # dealt by hash: ranges would prepare all records twice, once for their sample
    keyed.repartition("slice").sortWithinPartitions("slice", "ord").write.partitionBy("slice").parquet(f"{folder}/records")
    kept = spark.read.schema(keyed.schema).parquet(f"{folder}/records")
    _write_postings(_postings(kept, blocks, parts) if postings is None else postings, folder)
    meta = kept.agg(F.count("*").alias("records"), F.lit(slices).alias("slices"), F.lit(blocks).alias("blocks"), F.lit(parts).alias("parts"), F.lit(RULES).alias("rules"), F.lit(keyed.schema.json()).alias("columns"))
    meta.write.parquet(f"{folder}/meta")


def _prepared(records: DataFrame, nfkc) -> DataFrame:
    whole = F.coalesce("ord", F.raise_error(F.lit("a record without ord can't be indexed")).cast(records.schema["ord"].dataType))
    return S.prepare_records(records.withColumn("_digest", _digest(records)).withColumn("ord", whole), nfkc)


def build(records: DataFrame, target: str, nfkc=U.nfkc) -> Index:
    """Index all ``records`` anew and publish that as the next version. Records without ord are an error."""
    spark = records.sparkSession
    number, _ = versions.current(spark, target)
    n = records.count()
    slices, blocks = max(1, min(MOST_FOLDERS, n // SLICE)), max(1, -(-n // BLOCK))
    parts = 4 * slices
    versions.publish(spark, target, lambda folder: _write(folder, _prepared(records, nfkc), None, slices, blocks, parts), number)
    return opened(spark, target)


def opened(spark: SparkSession, target: str) -> Index:
    number, folder = versions.current(spark, target)
    if folder is None:
        raise ValueError(f"{target}: there is no index")
    return Index(spark, number, folder)


def changes(index: Index, records: DataFrame) -> DataFrame:
    """Rows (ord, change): what is new, changed or deleted against the index, by digests. An ord counts once."""
    now = records.select("ord", _digest(records).alias("d")).groupBy("ord").agg(F.sort_array(F.collect_list("d")).alias("now"))
    then = index.records.groupBy("ord").agg(F.sort_array(F.collect_list("_digest")).alias("then"))
    both = now.join(then, "ord", "full")
    kind = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "changed")
    return both.select("ord", kind.alias("change")).where("change IS NOT NULL")


def refresh(index: Index, target: str, records: DataFrame, nfkc=U.nfkc) -> Index:
    """The index of ``records`` as the next version: only new and changed records are prepared and cut into grams.

    Others are copied as they stand; ords that changed or went leave the postings, block by block. Equal to a new build
    but for the numbers of slices and blocks, which stay. Raises ``versions.Outrun`` if another version came between.
    """
    spark = index.spark
    found = changes(index, records)
    if not {f.name for f in records.schema} <= {f.name for f in index.records.schema}:
        raise ValueError("the records have columns that the index lacks: build it anew")
    found = written(found, "changes")
    fresh = _prepared(records.join(found.where("change <> 'deleted'").select("ord"), "ord", "left_semi"), nfkc)
    stays = index.records.drop("slice").join(found.select("ord"), "ord", "left_anti")
    fresh = written(fresh, "fresh")
    # the grams of the records that changed or went, as they were, tell which postings hold them
    went = index.records.join(found.where("change <> 'new'").select("ord"), "ord", "left_semi")
    kinds = {"kept": index.postings.select("part", "gram", "block", "ords"), "gone": _some_postings(went, index.blocks, index.parts), "fresh": _some_postings(fresh, index.blocks, index.parts)}
    every = reduce(DataFrame.union, [rows.withColumn("kind", F.lit(kind)) for kind, rows in kinds.items()])
    of = {kind: F.flatten(F.collect_list(F.when(F.col("kind") == kind, F.col("ords")))) for kind in kinds}
    merged = _by_part(every).agg(F.array_sort(F.array_distinct(F.concat(F.array_except(of["kept"], of["gone"]), of["fresh"]))).alias("ords")).where(F.size("ords") > 0)
    versions.publish(spark, target, lambda folder: _write(folder, stays.unionByName(fresh.select(stays.columns)), merged, index.slices, index.blocks, index.parts), index.number)
    return opened(spark, target)


class _Plan:
    """How each query of a table is answered: its candidates, or the scan."""

    def __init__(self, index: Index, asked: DataFrame):
        spark = index.spark
        self.asked, rows = settled(asked.where("ok AND NOT empty").select("query_id", "normalized", "terms", "related"), "asked")
        self.nothing = rows == []
        if self.nothing:
            return
        number = F.upper(F.regexp_replace("normalized", f"[{X.SPACE}]", ""))
        terms = self.asked.select("query_id", F.explode(F.array_distinct(F.concat("terms", "related", F.array(number)))).alias("term"))
        needs = terms.select("query_id", "term", F.explode_outer(_term_grams(F.col("term"))).alias("gram")).withColumn("part", _part("gram", index.parts))
        needs, rows = settled(needs, "needs")
        counts = index.grams
        if rows is not None:
            counts = counts.where(F.col("part").isin(sorted({r["part"] for r in rows if r["part"] is not None})))
        counted = needs.join(counts, ["part", "gram"], "left").withColumn("n", F.when(F.col("gram").isNull(), index.n_records).otherwise(F.coalesce("n", F.lit(0))))
        each = Window.partitionBy("query_id", "term")
        counted = counted.withColumn("least", F.min("n").over(each)).withColumn("place", F.row_number().over(each.orderBy("n", "gram")))
        # a gram is worth reading if it isn't much more common than the rarest one
        counted = counted.where((F.col("place") <= GRAMS_PER_TERM) & ((F.col("place") == 1) | (F.col("n") <= 8 * F.col("least"))))
        counted, rows = settled(counted.select("query_id", "term", "part", "gram", "n", "least", "place"), "picked")
        costs = counted.where("place = 1").groupBy("query_id").agg(F.sum("least").alias("cost"), F.count_if(F.col("gram").isNull()).alias("short"))
        ways = costs.select("query_id", ((F.col("short") > 0) | (F.col("cost") > SCAN_SHARE * index.n_records)).alias("scanned"))
        self.ways, way_rows = settled(ways, "ways")
        self.any_scan = way_rows is None or any(r["scanned"] for r in way_rows)
        self.any_gram = way_rows is None or not all(r["scanned"] for r in way_rows)
        picked = counted.join(self.ways.where("NOT scanned"), "query_id", "left_semi").where("least > 0")
        picked = picked.withColumn("k", F.count("*").over(Window.partitionBy("query_id", "term")))
        postings = index.postings
        if rows is not None:
            taken = {r["query_id"] for r in way_rows or () if not r["scanned"]} if way_rows is not None else None
            used = [r for r in rows if r["gram"] is not None and r["least"] > 0 and (taken is None or r["query_id"] in taken)]
            postings = postings.where(F.col("part").isin(sorted({r["part"] for r in used})) & F.col("gram").isin(sorted({r["gram"] for r in used})))
        met = postings.join(picked.select("query_id", "term", "gram", "k"), "gram").select("query_id", "term", "k", F.explode("ords").alias("ord"))
        whole = met.groupBy("query_id", "term", "ord").agg(F.count("*").alias("c"), F.first("k").alias("k")).where("c = k")
        found = whole.select("query_id", "ord").distinct().withColumn("slice", F.pmod(F.xxhash64("ord"), F.lit(index.slices)).cast("int"))
        self.candidates, self.candidate_rows = settled(found, "candidates") if self.any_gram else (found.where(F.lit(False)), [])
        self.spark = spark


def _pairs(index: Index, plan: _Plan, type_filter, scopes) -> tuple[DataFrame | None, DataFrame | None]:
    """(records with their query's columns, by candidates; records to scan with the queries that need it)."""
    by_gram = None
    if plan.any_gram:
        base = index.records
        if plan.candidate_rows is not None:
            base = base.where(F.col("slice").isin(sorted({r["slice"] for r in plan.candidate_rows})))
        by_gram = S.filtered(base, type_filter, scopes).join(plan.candidates, ["slice", "ord"]).join(plan.asked, "query_id")
    scanned = plan.asked.join(plan.ways.where("scanned"), "query_id", "left_semi") if plan.any_scan else None
    return by_gram, scanned


def search(
    index: Index,
    query: str | DataFrame,
    concepts: DataFrame | None = None,
    intents: DataFrame | None = None,
    type_filter: str | None = None,
    scopes: str | list[str] | None = None,
    proximity: bool = True,
    spread: bool = True,
    nfkc=U.nfkc,
) -> DataFrame:
    """As ``operators.search.search`` over the indexed records. Refused and empty queries read no record."""
    scored = scored_rows(index, query, concepts, intents, type_filter, scopes, proximity, nfkc)
    return S.diversify(scored) if spread else S.ranked(scored)


def scored_rows(index: Index, query, concepts=None, intents=None, type_filter=None, scopes=None, proximity=True, nfkc=U.nfkc) -> DataFrame:
    """A row for each query and record with evidence, as ``operators.search.score_records`` gives them."""
    queries = S.query_table(index.records, query) if isinstance(query, str) else query
    plan = _Plan(index, S.expand_queries(S.validate_queries(queries, nfkc), concepts, nfkc))
    if plan.nothing:
        rows = index.records.where(F.lit(False)).join(plan.asked)
        return S.score_pairs(rows, plan.asked, intents, proximity, nfkc).drop("slice")
    by_gram, scanned = _pairs(index, plan, type_filter, scopes)
    if scanned is None:
        return S.score_pairs(by_gram, plan.asked, intents, proximity, nfkc).drop("slice")
    pairs = S.filtered(index.records, type_filter, scopes).join(F.broadcast(scanned))
    if by_gram is not None:
        pairs = pairs.unionByName(by_gram)
    # a number that isn't known before the union is made keeps the long conditions of the scoring above it
    pairs = pairs.withColumn("_pair", F.monotonically_increasing_id())
    return S.score_pairs(pairs, plan.asked, intents, proximity, nfkc).where("_pair >= 0").drop("_pair", "slice")


def read_shares(index: Index, query: str | DataFrame, concepts: DataFrame | None = None, nfkc=U.nfkc) -> DataFrame:
    """query_id, scanned, read (records that are scored) and thousandths of all records, for each query that runs."""
    queries = S.query_table(index.records, query) if isinstance(query, str) else query
    plan = _Plan(index, S.expand_queries(S.validate_queries(queries, nfkc), concepts, nfkc))
    if plan.nothing:
        return plan.asked.select("query_id", F.lit(False).alias("scanned"), F.lit(0).cast("long").alias("read"), F.lit(0).cast("long").alias("thousandths"))
    counted = plan.ways.join(plan.candidates.groupBy("query_id").agg(F.count("*").alias("c")), "query_id", "left")
    read = F.when(F.col("scanned"), F.lit(index.n_records)).otherwise(F.coalesce("c", F.lit(0))).cast("long")
    return counted.select("query_id", "scanned", read.alias("read"), F.floor(1000 * read / max(1, index.n_records)).cast("long").alias("thousandths"))
