"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has its own tree over the preceding bytes. Every node of a
tree holds how often its decision went either way in the training text, estimates it by Krichevsky and
Trofimov, and mixes that estimate with those of its longer contexts. All depths are mixed, weighted by how
well they compress the training text. The result is a code length per byte.

A gram is a byte together with the bytes before it. Each gram that occurs in the texts is scored once, in the task that
holds its subtrees; the texts then add up the values of their grams.

The text that is modelled is the token sequence: words with A-Z lower-cased, single spaces between, a line
feed as the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sentrylake.llm.common import LOWER, bounded, remainder, utf8
from sentrylake.session import staged

#: Bytes of lines that are worked on at once: to count grams, and to score, where the lists of rare words and grams come on top.
COUNT_BLOCK, SCORE_BLOCK = 1 << 22, 1 << 20
#: Depth whose contexts are gathered into one task each; the shorter ones are few and are finished on the driver.
TOP = 2


def tokens(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def line(text: bytes) -> bytes:
    return b" ".join(tokens(text)) + b"\n"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8, brought back by the recurrence; for x > 0."""
    y = x + 8.0
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    z = 1.0 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The natural logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def gram_keys(lines: list[bytes], depth: int) -> np.ndarray:
    """A number for each byte of the lines: its context, the nearest byte first, and then the byte.
    Before a line stand zero bytes."""
    pad = b"\0" * depth
    data = np.frombuffer(pad + pad.join(lines), dtype=np.uint8).astype(np.uint64)
    n = len(data) - depth
    keys = data[depth:].copy()
    for back in range(1, depth + 1):
        keys |= data[depth - back:depth - back + n] << np.uint64(8 * (depth + 1 - back))
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    real = np.ones(n, dtype=bool)
    ends = np.cumsum(lengths) + depth * np.arange(len(lines))
    for k in range(depth):
        real[ends[:-1] + k] = False
    return keys[real]


def blocks(rows, most: int):
    """Lists of (line, *row) for rows (text, ...), in blocks of about `most` bytes; a longer line ends its block."""
    at, size = [], 0
    for row in rows:
        at.append((line(row[0]), *row))
        size += len(at[-1][0])
        if size >= most:
            yield at
            at, size = [], 0
    if at:
        yield at


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[starts], *[np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values])


def _decisions(contexts: np.ndarray, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, n0, n1) of the binary decisions: key is the context and then the bits already known after a 1."""
    keys, zeros, ones = [], [], []
    for b in range(8):
        known = (np.uint64(1) << np.uint64(b)) | (symbols >> np.uint64(8 - b))
        bit = (symbols >> np.uint64(7 - b)) & np.uint64(1)
        keys.append((contexts << np.uint64(8)) | known)
        ones.append(np.where(bit == 1, counts, 0.0))
        zeros.append(np.where(bit == 0, counts, 0.0))
    return _summed(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))


def weighted(key: np.ndarray, n0: np.ndarray, n1: np.ndarray, child_key: np.ndarray | None, child_log: np.ndarray | None):
    """(log Pw, w) of the nodes of one depth; w is the weight of a node's own estimate. child_key: the
    nodes' keys as seen from their children, child_log: the children's log Pw."""
    own = kt_log(n0, n1)
    if child_key is None:
        return own, np.ones_like(own)
    below = np.bincount(np.searchsorted(key, child_key), weights=child_log, minlength=len(key))
    return np.logaddexp(own, below) - np.log(2.0), 1.0 / (1.0 + np.exp(np.clip(below - own, -700, 700)))


def parent_key(key: np.ndarray) -> np.ndarray:
    """The same decision with the farthest byte of its context left out."""
    return ((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(255))


def subtrees(grams: np.ndarray, counts: np.ndarray, depth: int, top: int):
    """(depth, key, n0, n1, log Pw, w) for each depth from `depth` down to `top`, for grams that hold
    whole subtrees of depth `top`."""
    child_key = child_log = None
    symbols, contexts = grams & np.uint64(255), grams >> np.uint64(8)
    for d in range(depth, top - 1, -1):
        key, n0, n1 = _decisions(contexts, symbols, counts)
        log_pw, w = weighted(key, n0, n1, child_key, child_log)
        yield d, key, n0, n1, log_pw, w
        child_key, child_log = parent_key(key), log_pw
        merged, counts = _summed(((contexts >> np.uint64(8)) << np.uint64(8)) | symbols, counts)
        contexts, symbols = merged >> np.uint64(8), merged & np.uint64(255)


def climbed(levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int, grams: np.ndarray, bit: int, p: np.ndarray) -> np.ndarray:
    """The probability of one bit of each gram's last byte. levels: for each depth the sorted keys, their probabilities of a
    one and their weights. p: what the deeper levels gave, NaN where they hold no node."""
    known = (np.uint64(1) << np.uint64(bit)) | ((grams & np.uint64(255)) >> np.uint64(8 - bit))
    one = (grams >> np.uint64(7 - bit)) & np.uint64(1) == 1
    for d in sorted(levels, reverse=True):
        keys, ones, weights = levels[d]
        if not len(keys):
            continue
        wanted = ((grams >> np.uint64(8 * (depth + 1 - d))) << np.uint64(8)) | known
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        own, w = np.where(one, ones[at], 1.0 - ones[at]), weights[at]
        p = np.where(keys[at] == wanted, np.where(np.isnan(p), own, w * own + (1.0 - w) * p), p)
    return p


def byte_logs(levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int, grams: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
    """log10 of the probability of each gram's last byte after its context. below: the probabilities of its
    eight bits by the deeper levels, if levels aren't all. A bit that no level knows has probability one half."""
    out = np.zeros(len(grams))
    for bit in range(8):
        p = climbed(levels, depth, grams, bit, np.full(len(grams), np.nan) if below is None else below[:, bit])
        out += np.log10(np.where(np.isnan(p), 0.5, p))
    return out


def _arrays(batches, *names: str) -> list[np.ndarray]:
    got = [b for b in batches if b.num_rows]
    return [np.concatenate([b.column(b.schema.get_field_index(n)).to_numpy() for b in got]) if got else np.zeros(0, np.int64) for n in names]


def gram_counts(rows: DataFrame, depth: int) -> DataFrame:
    """(gram, n, seen) over the columns text and learn: how often a gram occurs in the rows to learn from, and in all."""
    def run(batches):
        for block in blocks(((t, x) for batch in batches for t, x in zip(utf8(batch, "text"), batch.column(1).to_pylist())), COUNT_BLOCK):
            for learn in (True, False):
                lines = [line for line, _, x in block if x == learn]
                if not lines:
                    continue
                grams, n = np.unique(gram_keys(lines, depth), return_counts=True)
                for at in range(0, len(grams), 1 << 16):
                    seen = pa.array(n[at:at + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array(grams[at:at + (1 << 16)].view(np.int64)), seen if learn else pa.array(np.zeros(len(seen), np.int64)), seen], ["gram", "n", "seen"])

    return rows.mapInArrow(run, "gram bigint, n bigint, seen bigint").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the column `text`; the empty word counts the ends."""
    def run(batches):
        seen: dict[bytes, int] = {b"": 0}
        for batch in batches:
            for text in utf8(batch, "text"):
                for w in tokens(text):
                    seen[w] = seen.get(w, 0) + 1
                seen[b""] += 1
            if len(seen) > 1 << 17:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                seen = {b"": 0}
        if len(seen) > 1 or seen[b""]:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


class Grams:
    """The grams of the texts with their log10 probabilities, as a table of any size. `rows` and `logs` are DataFrame steps:
    nodes hold what the depths from TOP on say, and `logs` mixes in the few shorter contexts."""

    def __init__(self, rows: DataFrame, depth: int = 5):
        """rows: text and learn, a boolean without nulls."""
        if not TOP <= depth <= 6:
            raise ValueError(f"depth must be from {TOP} to 6")
        names = ["gram", "seen", "below", "n0", "n1", "log_pw"]

        def run(batches):
            keys, counts, seen = _arrays(batches, "gram", "n", "seen")
            keys = keys.view(np.uint64)
            levels, learnt = {}, counts > 0
            if learnt.any():
                for d, key, n0, n1, log_pw, w in subtrees(keys[learnt], counts[learnt].astype(np.float64), depth, TOP):
                    levels[d] = key, (n1 + 0.5) / (n0 + n1 + 1), w
                yield from batched([pa.array(key.view(np.int64)), None, None, pa.array(n0), pa.array(n1), pa.array(log_pw)])
            for at in range(0, len(keys), 1 << 16):
                some = keys[at:at + (1 << 16)]
                bits = np.stack([climbed(levels, depth, some, b, np.full(len(some), np.nan)) for b in range(8)], axis=1).astype(np.float32)
                below = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(some), [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())
                yield from batched([pa.array(some.view(np.int64)), pa.array(seen[at:at + (1 << 16)]), below, None, None, None])

        def batched(columns):
            n = len(columns[0])
            types = [pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c for c, t in zip(columns, types)], names)

        grams = gram_counts(rows, depth).repartition(F.shiftright("gram", 8 * (depth + 1 - TOP)))
        table = staged(grams.mapInArrow(run, "gram bigint, seen bigint, below binary, n0 double, n1 double, log_pw double"))
        self.depth, self.nodes = depth, table.where(F.col("below").isNotNull()).select("gram", "seen", "below")
        self.shared = rows.sparkSession.sparkContext.broadcast(self._short(table.where(F.col("below").isNull())))

    def _short(self, top: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The levels above TOP, from the decisions after one byte: at most 256 * 255 rows."""
        upper = top.groupBy((F.shiftright("gram", 16) * 256 + F.col("gram") % 256).alias("key")).agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_pw").alias("below")).orderBy("key").toArrow()
        key, n0, n1, child_log = (upper.column(c).to_numpy() for c in ("key", "n0", "n1", "below"))
        key, n0, n1 = key.astype(np.uint64), n0.astype(np.float64), n1.astype(np.float64)
        child_key, child_log, levels = key, child_log.astype(np.float64), {}
        for at in range(TOP - 1, -1, -1):
            log_pw, weight = weighted(key, n0, n1, child_key, child_log)
            levels[at] = key, (n1 + 0.5) / (n0 + n1 + 1), weight
            child_key, child_log = parent_key(key), log_pw
            key, n0, n1 = _summed(child_key, n0, n1)
        return levels

    def logs(self, wanted) -> DataFrame:
        """(gram, log) of the grams that meet a condition on `seen`."""
        shared, depth = self.shared, self.depth

        def run(batches):
            for batch in batches:
                grams = batch.column(0).to_numpy().view(np.uint64)
                below = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, 8).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(byte_logs(shared.value, depth, grams, below))], ["gram", "log"])

        return self.nodes.where(wanted).select("gram", "below").mapInArrow(run, "gram bigint, log double")

    def least_seen(self, most: int) -> int:
        """The lowest power of two from which on no more than so many grams are seen so often."""
        sizes = {r["p"]: r["k"] for r in self.nodes.groupBy(F.floor(F.log2("seen")).alias("p")).agg(F.count(F.lit(1)).alias("k")).collect()}
        least, total = max(sizes, default=-1) + 1, 0
        while least > 0 and total + sizes.get(least - 1, 0) <= most:
            least -= 1
            total += sizes.get(least, 0)
        return 1 << least


def line_sums(lines: list[bytes], depth: int, known: np.ndarray, logs: np.ndarray):
    """For each line the sum of the logs of its grams in `known` (sorted), and a list of (gram, how often) of its others."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    grams, back = np.unique(gram_keys(lines, depth), return_inverse=True)
    at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
    there = known[at] == grams if len(known) else np.zeros(len(grams), dtype=bool)
    values = np.where(there, logs[at], 0.0) if len(known) else np.zeros(len(grams))
    sums = np.add.reduceat(values[back], np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    missed = np.flatnonzero(~there[back])
    of, gram = np.repeat(np.arange(len(lines)), lengths)[missed], grams[back[missed]]
    order = np.lexsort((gram, of))
    of, gram = of[order], gram[order]
    starts = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])])) if len(of) else np.zeros(0, np.int64)
    pairs = pa.StructArray.from_arrays([pa.array(gram[starts].view(np.int64)), pa.array(np.diff(np.append(starts, len(of))))], ["gram", "n"])
    return sums, pa.ListArray.from_arrays(pa.array(np.searchsorted(of[starts], np.arange(len(lines) + 1)).astype(np.int32)), pairs)


def score(df: DataFrame, id_col: str, text: str, held_out=None, depth: int = 5, frequent_grams: int = 1 << 21, frequent: int = 1 << 17) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, code_length.

    Rows where held_out (a boolean column; by default crc32 of the id modulo 7 is 2) is true are scored but not learnt
    from. score is the model's log10 probability of the row's token sequence, code_length the bits it
    takes per byte of it; base_score is that of a unigram model with one added to each count. Tokens are the words
    and one end.

    Null text is empty: one token, the end. A null id counts as the empty text for held_out; a null held_out is scored as
    not held out, but not learnt from. Repeated rows are learnt from and scored each. Without training rows every bit has
    probability one half. An empty table gives an empty table. Other columns may have any name.

    The model grows with the texts and is never whole in one place. Its most frequent grams, at most frequent_grams, and the `frequent`
    commonest words are broadcast and looked up in the task; a row's other grams and words meet their values in a join. The
    bounds change the speed, not the result."""
    held = remainder(id_col, 7) == 2 if held_out is None else held_out
    spark = df.sparkSession
    rows = bounded(df).select(F.col(id_col).alias("id"), F.coalesce(held, F.lit(False)).alias("held_out"), F.col(text).alias("text"), F.coalesce(~held, F.lit(False)).alias("learn"))
    words = staged(word_counts(rows.where("learn").select("text")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, log_all = total["n"], float(np.log10(total["n"] + total["v"] + 1))
    top = words.orderBy(F.desc("n"), "word").limit(frequent).toArrow()
    model = Grams(rows.select("text", "learn"), depth)
    least = model.least_seen(frequent_grams)
    common = model.logs(F.col("seen") >= least).toArrow()
    keys, logs = common.column("gram").to_numpy().view(np.uint64), common.column("log").to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], logs[order], dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist()))))

    def run(batches):
        known_grams, logs, counts = shared.value
        for block in blocks(((t, i, h) for batch in batches for t, i, h in zip(utf8(batch, "text"), batch.column(0).to_pylist(), batch.column(1).to_pylist())), SCORE_BLOCK):
            lines, texts, ids, helds = zip(*block)
            (sums, rare_grams), n_tokens, known, base, rare = line_sums(lines, depth, known_grams, logs), [], [], [], []
            for t in texts:
                own: dict[bytes, int] = {b"": 1}
                for w in tokens(t):
                    own[w] = own.get(w, 0) + 1
                found = {w: counts.get(w, 0) for w in own}
                n_tokens.append(sum(own.values()))
                known.append(sum(n for w, n in own.items() if found[w]))
                base.append(float(np.dot(list(own.values()), np.log10(np.array(list(found.values())) + 1.0))))
                rare.append([{"word": w, "n": n} for w, n in own.items() if not found[w]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(helds, pa.bool_()), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(sums),
                 pa.array([len(x) for x in lines], pa.int64()), pa.array(rare, rare_type), rare_grams],
                ["id", "held_out", "n_tokens", "known", "base", "sum", "n_bytes", "rare", "rare_grams"])

    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
    rows = rows.drop("learn")
    id_type = to_arrow_type(rows.schema["id"].dataType)
    rows = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, known bigint, base double, sum double, n_bytes bigint, "
                                "rare array<struct<word: binary, n: bigint>>, rare_grams array<struct<gram: bigint, n: bigint>>")
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()))
    met = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("k")).join(words, "word")
    met = met.select("row", F.col("k").alias("more"), (F.col("k") * F.log10(F.col("n") + 1.0)).alias("more_base"), F.lit(0.0).alias("more_sum"))
    gram = rows.select("row", F.explode("rare_grams").alias("r")).select("row", "r.gram", F.col("r.n").alias("k")).join(model.logs(F.col("seen") < least), "gram")
    met = met.unionByName(gram.select("row", F.lit(0).cast("bigint").alias("more"), F.lit(0.0).alias("more_base"), (F.col("k") * F.col("log")).alias("more_sum")))
    met = met.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("more", "more_base", "more_sum")])
    whole = F.col("sum") + F.coalesce("more_sum", F.lit(0.0))
    return rows.join(met, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), whole.alias("score"),
        (-whole / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("code_length"))
