"""Document fingerprints by winnowing.

Every run of `gram` code points has a rolling hash; from every window of `window` neighbouring hashes the
smallest is chosen, of equal ones the rightmost. Two texts that share a run of gram + window - 1 code points
choose a common hash in it, and the positions kept say where.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.common import bounded, utf8

GRAM, WINDOW = 16, 64
_BASE = np.uint64(0x100000001B3)


def _mixed(h: np.ndarray) -> np.ndarray:
    """The upper half of a multiply and shift mix, as 32-bit hashes in 64-bit words."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(32)


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """A hash for each run of `gram` numbers. Hashes of 2m numbers come from two of m, so a run costs
    the logarithm of its length."""
    n = len(points) - gram + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    power, base, size, done = points.astype(np.uint64) + np.uint64(1), _BASE, 1, None
    have = 0
    with np.errstate(over="ignore"):
        while size <= gram:
            if gram & size:
                done = power[:n] if done is None else done * base + power[have:have + n]
                have += size
            if size * 2 > gram:
                break
            power = power[:-size] * base + power[size:]
            base, size = base * base, size * 2
        return _mixed(done)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a text, in the order of the positions (of code points). A text shorter than
    a gram is one gram, one with fewer grams than a window is one window; an empty text has none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    hashes = gram_hashes(points, min(gram, len(points)))
    # The smaller hash first, then the larger position: one number orders both.
    least = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64))
    span, window = 1, min(window, len(hashes))
    while span < window:
        step = min(span, window - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (chosen >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.uint32)


def printed(hashes: np.ndarray, positions: np.ndarray) -> str:
    """The fingerprint as text: eight hex digits of the hash and eight of the position for each choice."""
    return np.stack([hashes, positions], axis=1).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes, each sorted and without repeats; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(df: DataFrame, id_col: str, text: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """id, hashes and positions (arrays of long, in the order of the positions) of every row.

    Null text counts as empty and has empty arrays. Repeated rows and null ids are carried; an empty table gives an
    empty table; other columns may have any name."""
    rows = bounded(df).select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            got = [winnow(x.decode("utf-8", "replace"), gram, window) for x in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([g[k].astype(np.int64) for g in got], pa.list_(pa.int64())) for k in (0, 1)]], ["id", "hashes", "positions"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, hashes array<bigint>, positions array<bigint>").withColumnRenamed("id", id_col)


def with_next(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(run, guest, id, text, mark): the rows by descending id (null last, then by checksum and length), cut into
    runs that a task each can read in order. A run ends with a guest, the first row of the next run; the
    last run's guest is the first row of all, so every row's next row is in its run. Only the guests are
    copied. Runs are cut at quantiles of the id, so they are about equal; rows with one and the same id
    share a run."""
    spark = df.sparkSession
    n = min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 4096)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.crc32(F.col("text").cast("binary")) * F.lit(1 << 30) + F.length("text"))
    cuts = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n).alias("c")).first()["c"] if n > 1 else None
    cuts = sorted(set(cuts or []))
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c >= F.col("id"))) if cuts else F.lit(0)
    rows = rows.withColumn("run", F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(above))
    # One row per run: the id it begins with.
    firsts = rows.groupBy("run").agg(F.max("id").alias("id")).orderBy("run").collect()
    before = {r["run"]: firsts[i - 1]["run"] for i, r in enumerate(firsts)}
    starts = {r["id"]: before[r["run"]] for r in firsts if r["id"] is not None}
    host = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])[F.col("id")] if starts else F.lit(None).cast("int")
    last = next((before[r["run"]] for r in firsts if r["id"] is None), None)
    host = F.coalesce(host, F.when(F.col("id").isNull(), F.lit(last).cast("int")))
    own = F.array(F.struct(F.col("run").alias("run"), F.lit(False).alias("guest")))
    both = F.array(F.struct(F.col("run").alias("run"), F.lit(False).alias("guest")), F.struct(host.alias("run"), F.lit(True).alias("guest")))
    rows = rows.withColumn("place", F.explode(F.when(host.isNull(), own).otherwise(both))).select("place.run", "place.guest", "id", "text", "mark")
    return rows.repartition(max(1, min(n, len(firsts))), "run").sortWithinPartitions("run", "guest", F.desc_nulls_last("id"), "mark")


def edited_likeness(df: DataFrame, id_col: str, text: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A row's edited text is its own with the last floor(n_chars / 2) code points replaced by as many from the beginning of the
    next document by descending id (all if it has fewer); after the last comes the first. near_edited and near_next are the likeness of the row's
    fingerprint to those of the edited text and of the next document.

    Null text counts as empty, whose fingerprint is empty; two empty fingerprints have likeness 1. Ids are whole numbers;
    null ids come last, repeated ids follow each other by checksum and length of the text. An empty table gives an
    empty table. Other columns may have any name. Texts are shuffled once."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held, out = None, []
        for batch in batches:
            for own, guest, doc, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), utf8(batch, "text")):
                if held is None and guest:
                    continue
                words = raw.decode("utf-8", "replace")
                hashes, at = winnow(words, gram, window)
                shown = printed(hashes, at), np.unique(hashes)
                if held is not None:
                    _, last, before, (last_print, last_set) = held
                    cut = len(before) // 2
                    edited = before[:len(before) - cut] + words[:cut]
                    new, new_at = winnow(edited, gram, window)
                    out.append((last, len(before), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), last_print, printed(new, new_at),
                                likeness(last_set, np.unique(new)), likeness(last_set, shown[1])))
                # After the first guest the run is over; the others tie with it.
                held = None if guest else (own, doc, words, shown)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema)

    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), *[(n, pa.string()) for n in names[2:5]], *[(n, pa.float64()) for n in names[5:]]])
    rows = with_next(bounded(df), id_col, text).mapInArrow(run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return rows.withColumnRenamed("id", id_col)
