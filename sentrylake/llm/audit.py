"""How filters of a corpus overlap, by contracting a table of counts.

Each part of the corpus has one count for each way of passing or failing five filters, a tensor of 2x2x2x2x2.
What a filter removes at a step of an order is a contraction: each axis is met with a vector that selects the
documents that pass, those that fail, or all.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm.common import WORD
from sentrylake.session import staged

PASS, FAIL, ALL = np.array([[1, 0], [0, 1], [1, 1]], dtype=np.int64)
FILTERS = "ABCDE"


def failures(text: Column) -> list[Column]:
    """The failure conditions A to D of a text that is not null."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [F.size(words) < 50, 100 * F.size(F.array_distinct(words)) < 65 * F.size(words), 100 * capitals.cast("bigint") > 5 * F.length(text).cast("bigint"), text.rlike("[#$%&*|]")]


def cells(df: DataFrame, id_col: str, text: str, part: str, labels: DataFrame, label_id: str, good: str, toxic: str) -> DataFrame:
    """(part, code, n, good, toxic): counts of the documents of a part for each code of 0 to 31; its highest bit
    says that the document fails filter A, its lowest that it fails E.

    The first of equal texts needs no join: rank 1 in a group passes E, and Spark applies that limit before the
    shuffle, so a group with a third of all rows sends a few rows a task; what fails is all less what passes. Rows of one id are counted
    before they meet their label, and rows without an id never look for one."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bits = [F.when(f, 1 << 4 - i).otherwise(0) for i, f in enumerate(failures(F.col("body")))]
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), body.alias("body"))
    rows = staged(rows.select("id", "part", sum(bits[1:], bits[0]).alias("code"), F.unhex(F.sha2("body", 256)).alias("digest")))
    first = rows.withColumn("_rank", F.rank().over(Window.partitionBy("digest").orderBy(F.asc_nulls_last("id")))).where("_rank = 1")
    marks = labels.select(F.col(f"`{label_id}`").alias("id"), (F.col(f"`{good}`") == 1).alias("g"), (F.col(f"`{toxic}`") == 1).alias("t")).where("id IS NOT NULL")
    marks = staged(marks.groupBy("id").agg(F.coalesce(F.bool_or("g"), F.lit(False)).cast("int").alias("g"), F.coalesce(F.bool_or("t"), F.lit(False)).cast("int").alias("t")))

    def counted(some: DataFrame, new_bit: int) -> DataFrame:
        n = some.where("id IS NOT NULL").groupBy("id", "part", "code").agg(F.count(F.lit(1)).alias("n"))
        known = n.join(marks, "id", "left").select("part", "code", "n", (F.col("n") * F.coalesce("g", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("t", F.lit(0))).alias("toxic"))
        zero = F.lit(0).cast("bigint")
        alone = some.where("id IS NULL").select("part", "code", F.lit(1).cast("bigint").alias("n"), zero.alias("good"), zero.alias("toxic"))
        both = known.unionByName(alone)
        return both.groupBy("part", "code").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]).withColumn("bit", F.lit(new_bit))

    passing = staged(counted(first, 0))
    signed = counted(rows, 1).unionByName(passing).unionByName(passing.select("part", "code", *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")], F.lit(1).alias("bit")))
    return signed.groupBy("part", (F.col("code") + F.col("bit")).alias("code")).agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def contracted(counts: np.ndarray) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part.
    counts: 3x2x2x2x2x2, for all, good and toxic documents, with 1 for failing."""
    seen: dict[tuple[int, ...], np.ndarray] = {}

    def select(*axes: int) -> np.ndarray:
        """axes: 0 passes, 1 fails, 2 all, for each filter."""
        if axes not in seen:
            seen[axes] = np.einsum("zabcde,a,b,c,d,e->z", counts, *[(PASS, FAIL, ALL)[x] for x in axes])
        return seen[axes]

    out = []
    for order in permutations(range(5)):
        axes = [2] * 5
        for step, f in enumerate(order, 1):
            axes[f] = 1
            removed, failing = select(*axes), select(*(1 if i == f else 2 for i in range(5)))
            unique = select(*(1 if i == f else 0 for i in range(5)))
            axes[f] = 0
            out.append(["".join(FILTERS[i] for i in order), step, select(*axes)[0], removed[0], failing[0] - removed[0], unique[0], removed[1], removed[2]])
    total = dict.fromkeys(FILTERS, 0)
    for row in out:
        total[row[0][row[1] - 1]] += row[3]
    return [(*row, total[row[0][row[1] - 1]]) for row in out]


MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(df: DataFrame, id_col: str, text: str, part: str, labels: DataFrame, label_id: str, good: str, toxic: str) -> DataFrame:
    """For each part, order of the five filters and step: part, filter_order, step and MEASURES.

    Filters: A fewer than 50 words, B less than 65 % of the words distinct, C more than 5 % of the code points in A-Z, D any of
    #$%&*|, E the text of a smaller id once more. Null and empty texts are the same text; a null part is the
    empty one. A null id comes after all others and has no label; rows with one id and text don't make each other fail E, and
    each counts. A document is good or toxic if any label of its id says so. An empty table gives no rows. Other columns may
    have any name.

    Documents are counted before parts meet: a part is one row of at most 96 numbers, and parts are spread over the tasks."""
    counts = cells(df, id_col, text, part, labels, label_id, good, toxic)
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("code", "n", "good", "toxic")).alias("cells"))  # at most 32 a part

    def run(batches):
        for batch in batches:
            out = []
            for name, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = np.zeros((3, 32), dtype=np.int64)
                for c in found:
                    table[:, c["code"]] = c["n"], c["good"], c["toxic"]
                out.extend((name, *row) for row in contracted(table.reshape(3, 2, 2, 2, 2, 2)))
            if out:
                part_, order, step, *numbers = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(part_, pa.string()), pa.array(order, pa.string()), pa.array(step, pa.int32()), *[pa.array([int(x) for x in c], pa.int64()) for c in numbers]],
                                                 ["part", "filter_order", "step", *MEASURES])

    return rows.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{m} bigint" for m in MEASURES))
