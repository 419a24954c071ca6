"""Ranked lexical search by hashed max-sketches.

A document's sketch has a fixed number of coordinates. Each of its terms is hashed to one, which keeps the largest
impact of the terms there. For a query term that coordinate is at least the impact of the term, so one product of
sketches and query weights bounds the scores of many documents under all queries. Documents are then scored
exactly in descending order of their bounds, until no bound reaches the last score that would still rank.
"""

from __future__ import annotations

import math
import zlib
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrylake.llm.common import bounded, utf8
from sentrylake.session import staged

#: The bytes of a term in UTF-8 are digits, letters (A-Z lower-cased here) and all that is not ASCII; others part terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Documents whose sketches are multiplied at a time, and bytes of text whose term counts are held at a time.
BATCH_ROWS, BATCH_BYTES = 256, 1 << 22


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: int, m: int) -> int:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def norm(n: int, n_docs: int, total: int) -> int:
    return 75 + 25 * n * n_docs // total


def _blocks(items: DataFrame, max_terms: int) -> Iterator[list]:
    """The queries, as (item, Counter of its terms), in blocks of max_terms different terms or one query."""
    block, size = [], 0
    for row in items.toLocalIterator():
        found = Counter(terms((row[1] or "").encode()))
        if block and size + len(found) > max_terms:
            yield block
            block, size = [], 0
        if found:
            block.append((row[0], found))
            size += len(found)
    if block:
        yield block


def _statistics(rows: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms with repeats, and the documents that hold each term of the vocabulary. Each
    task counts on its own and sends one number for each term it has met."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        names, counts, n_docs, total = known.keys(), np.zeros(len(known), dtype=np.int64), 0, 0
        for batch in batches:
            for text in utf8(batch, "text"):
                found = terms(text)
                n_docs += bool(found)
                total += len(found)
                counts[[known[t] for t in names & set(found)]] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], at])), pa.array(np.concatenate([[n_docs, total], counts[at]]))], ["term", "n"])

    out = np.zeros(len(vocabulary) + 2, dtype=np.int64)
    for row in rows.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["term"]] = row["n"]
    return int(out[-2]), int(out[-1]), out[:-2]


class Best:
    """The k highest scores of one query, then the smallest ids (null last)."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def add(self, score: int, doc) -> None:
        insort(self.rows, (-score, doc is None, doc if doc is not None else 0, doc), key=lambda r: r[:3])
        del self.rows[self.k:]

    @property
    def least(self) -> int:
        """The score that a document must reach to rank still."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1


class Searcher:
    """Folds documents into sketches and keeps the best of each query."""

    def __init__(self, queries: list[dict[bytes, int]], n_docs: int, total: int, k: int, width: int):
        self.queries, self.n_docs, self.total, self.width = queries, n_docs, total, width
        self.best = [Best(k) for _ in queries]
        self.weights = np.zeros((width, len(queries)))
        for q, found in enumerate(queries):
            for term, w in found.items():
                self.weights[zlib.crc32(term) % width, q] += w
        self.least = np.ones(len(queries))
        self.scored = 0  # exact scores worked out, for tests and figures

    def add(self, docs: list[tuple]) -> None:
        """docs: (id, Counter of its terms)."""
        sketches, crc = np.zeros((len(docs), self.width)), zlib.crc32
        norms = []
        for row, (_, counts) in zip(sketches, docs):
            m = norm(counts.total(), self.n_docs, self.total)
            norms.append(m)
            at = np.fromiter(map(crc, counts), np.int64, len(counts)) % self.width
            tf = np.fromiter(counts.values(), np.int64, len(counts))
            np.maximum.at(row, at, 1_000_000_000 * tf // (1000 * tf + 12 * m))
        # Sums of whole numbers are exact up to 2 ** 53; beyond, rounding moves a bound by far less than this share.
        bounds = (sketches @ self.weights) * (1 + 1e-9)
        for q in np.flatnonzero((bounds >= self.least).any(axis=0)):
            column, found, best = bounds[:, q], self.queries[q], self.best[q]
            for d in np.argsort(-column, kind="stable"):
                if column[d] < best.least:
                    break
                doc, counts = docs[d]
                m, score = norms[d], 0
                for term in found.keys() & counts.keys():
                    score += found[term] * impact(counts[term], m)
                self.scored += 1
                if score >= best.least:
                    best.add(score, doc)
            self.least[q] = best.least


def _searched(rows: DataFrame, block: list, n_docs: int, total: int, k: int, width: int) -> DataFrame:
    """(item, id, score): the k best of each task and query. block: (item, {term: weight with repeats})."""
    shared = rows.sparkSession.sparkContext.broadcast([q for _, q in block])
    numbers = [i for i, _ in block]
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.LongType())])

    def run(batches):
        searcher, id_type, docs, size = Searcher(shared.value, n_docs, total, k, width), None, [], 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch, "text")):
                counts = Counter(terms(text))
                if not counts:
                    continue
                docs.append((doc, counts))
                size += len(text)
                if len(docs) == BATCH_ROWS or size >= BATCH_BYTES:
                    searcher.add(docs)
                    docs, size = [], 0
        if docs:
            searcher.add(docs)
        found = [(numbers[q], r[3], -r[0]) for q, best in enumerate(searcher.best) for r in best.rows]
        if found:
            item, doc, score = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, id_type), pa.array(score, pa.int64())], ["item", "id", "score"])

    return rows.mapInArrow(run, schema)


def search(df: DataFrame, id_col: str, text: str, items: DataFrame, item_id: str, item_text: str, k: int = 20, width: int = 4096, max_terms: int = 200_000) -> DataFrame:
    """item id, rank, id, score: the k highest-scoring documents of each item, equal scores by id (null last).

    Terms, weights and scores are those of op12's contract; only scores above 0 rank. Null and empty texts have no
    term and are in no count; an item without terms has no row; repeated rows rank each, and so do repeated
    items. Empty tables give no rows. Other columns may have any name.

    Items are taken in blocks of max_terms different terms (or one item), so what is broadcast and what the statistics bring
    back has that bound; each block reads the documents twice and shuffles k rows per task and item, never a text."""
    rows = bounded(df).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    spark = df.sparkSession
    # A number for each item, as ids may be null or repeated; (number, id) pairs come back by a join on it.
    named = staged(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_id}`").alias("_item_id"), F.col(f"`{item_text}`").alias("_item_text")))
    parts = []
    for block in _blocks(named.select("item", "_item_text"), max_terms):
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, found in block for t in found))}
        n_docs, total, dfs = _statistics(rows, vocabulary)
        if not total:
            break
        weighted = [(item, {t: n * weight(n_docs, int(dfs[vocabulary[t]])) for t, n in found.items()}) for item, found in block]
        parts.append(_searched(rows, weighted, n_docs, total, k, width))
    if not parts:
        parts = [spark.createDataFrame([], T.StructType([T.StructField("item", T.LongType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.LongType())]))]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.join(named.select("item", "_item_id"), "item").select(F.col("_item_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
