"""Packing examples into sequences: vector bin packing by the dot-product heuristic.

A sequence has room for so many tokens, segments and loss-bearing tokens at once. A task keeps a window
of waiting examples; for the open sequence it always places the example whose needs have the largest
dot product with the room that is left, each limit scaled to 1. When nothing fits whole, the example that
scores best is cut to fill what is left.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrylake.llm.common import bounded, utf8

#: Chunks that a worker remembers the ids of (some 300 bytes each), the bytes they may have, and bytes of text that it takes at a time.
REMEMBERED, REMEMBERED_BYTES, BLOCK = 250_000, 1 << 23, 1 << 18
#: A chunk is what stands between spaces and line ends; a word before ASCII punctuation (but no apostrophe) is one of its
#: own, because no piece of the tokenizer crosses from an ASCII letter to such a mark.
_CHUNK = re.compile(rb"[A-Za-z\x80-\xff]*[A-Za-z](?=[!-&(-/:-@\[-`{-~ \n])|[^ \n]+")


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit numbers, by a tokenizer that lower-cases and whose
    pieces never cross a space or a line end.

    The ids of a chunk are remembered, in two halves: when the young half is full it becomes the old one, and what is met
    again moves to the young, so only what is rarely met is forgotten."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer
        # Spark gives a task one core; the library would start a thread for each core of the machine.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.half = Tokenizer.from_file(path), max(1, remembered // 2)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.learned = 0  # bytes of the chunks learned since the young half was empty

    def _block(self, text: bytes) -> bytes:
        # Special tokens are recognised before lower-casing, so a text that may hold one keeps its case.
        chunks = _CHUNK.findall(text if b"<|" in text else text.lower())
        young, old = self.young, self.old
        new = {c for c in chunks if c not in young}
        if new:
            if len(young) + len(new) > self.half or self.learned > REMEMBERED_BYTES // 2:
                self.old, self.young, self.learned = young, {}, 0
                young, old, new = self.young, self.old, set(chunks)
            unseen = []
            for c in new:
                if c in old:
                    young[c] = old[c]
                else:
                    unseen.append(c)
            if unseen:
                self._learn(unseen)
        return b"".join(map(young.__getitem__, chunks))

    def _learn(self, chunks: list[bytes]) -> None:
        """One text of all new chunks, as a call for each costs more than its work; where a piece starts tells its chunk."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = array("I", found.ids).tobytes()
        ends = np.searchsorted(np.fromiter((a for a, _ in found.offsets), np.int64), np.cumsum([0, *[len(x) + 1 for x in texts]])) * 4
        self.learned += sum(map(len, chunks))
        for c, a, b in zip(chunks, ends.tolist(), ends[1:].tolist()):
            self.young[c] = ids[a:b]

    def encode(self, text: bytes) -> bytes:
        if len(text) <= BLOCK:
            return self._block(text)
        parts, at = [], 0
        while at < len(text):
            end = next((m.end() for m in (_BREAK.search(text, at + BLOCK),) if m), len(text))
            parts.append(self._block(text[at:end]))
            at = end
        return b"".join(parts)


_BREAK = re.compile(rb"[ \n]")


def encoder(path: str) -> Callable[[], Callable[[bytes], bytes]]:
    """What a task calls to get the encoder of its worker process for a tokenizer file. Spark keeps a worker for
    several tasks, but brings this module anew with each; what they share hangs on the tokenizer library."""
    def own():
        import tokenizers
        kept = vars(tokenizers).setdefault("_encoders", {})
        if path not in kept:
            kept[path] = Encoder(path)
        return kept[path].encode

    return own


class Packer:
    """One task's packing. An example is (payload, tokens, loss): its last `loss` tokens bear loss.
    Pieces come out as (payload, start, length, sequence, offset)."""

    def __init__(self, limits: tuple[int, int, int], window: int):
        self.limits, self.window = np.array(limits, dtype=np.float64), window
        self.max_tokens, self.max_segments, self.max_loss = limits
        self.waiting: list[list] = []  # payload, start, tokens, loss
        self.needs = np.zeros((window, 3))
        self.sequence = 0

    def add(self, payload, tokens: int, loss: int) -> Iterator[tuple]:
        start = 0
        while tokens:
            n = self._longest(tokens, loss, self.max_tokens, self.max_loss)
            bears = max(0, n - (tokens - loss))
            if n == self.max_tokens:  # a whole sequence; so what waits is bounded by the window
                yield payload, start, n, self._own(), 0
            else:
                if len(self.waiting) == self.window:
                    yield from self._place(self.max_tokens)
                self.needs[len(self.waiting)] = n, 1, bears
                self.waiting.append([payload, start, n, bears])
            start, tokens, loss = start + n, tokens - n, loss - bears

    def finish(self) -> Iterator[tuple]:
        """What waits when the task ends; less than a sequence is cut into powers of two."""
        while self.waiting:
            total = sum(w[2] for w in self.waiting)
            yield from self._place(self.max_tokens if total >= self.max_tokens else 1 << total.bit_length() - 1)

    def _own(self) -> int:
        """The number of a sequence that is full at once; the open one takes the next."""
        self.sequence += 1
        return self.sequence - 1

    @staticmethod
    def _longest(tokens: int, loss: int, room: int, loss_room: int) -> int:
        """The longest beginning within both limits; the loss is at the end."""
        free = tokens - loss
        return min(tokens, room, free + loss_room)

    def _place(self, room: int) -> Iterator[tuple]:
        """Fill one sequence of `room` tokens from what waits."""
        limits = np.array([room, *self.limits[1:]])
        used, own = np.zeros(3), self._own()
        while self.waiting:
            n = len(self.waiting)
            needs, left = self.needs[:n], limits - used
            if left[0] < 1 or left[1] < 1:
                break
            scores = (needs / self.limits) @ (left / self.limits)
            fits = (needs <= left).all(axis=1)
            at = int(np.argmax(np.where(fits, scores, -1.0) if fits.any() else scores))
            payload, start, tokens, loss = self.waiting[at]
            take = self._longest(tokens, loss, int(left[0]), int(left[2]))
            if take < 1:
                break
            yield payload, start, take, own, int(used[0])
            rest = tokens - take
            bears = max(0, loss - rest)
            used += (take, 1, bears)
            if rest:
                self.waiting[at] = [payload, start + take, rest, loss - bears]
                self.needs[at] = rest, 1, loss - bears
            else:
                self.waiting[at] = self.waiting[-1]
                self.needs[at] = self.needs[n - 1]
                self.waiting.pop()


def release(example: list, waiting: list[list]) -> None:
    """Keep only those ids of an example (id, ids, number of the first, loss, tokens) that wait for a place."""
    first = min((start for payload, start, *_ in waiting if payload is example), default=example[4])
    example[1], example[2] = example[1][4 * (first - example[2]):], first


def packed(df: DataFrame, id_col: str, text: str, encode: Callable[[], Callable[[bytes], bytes]], end_id: int,
           max_tokens: int = 4096, max_segments: int = 256, max_loss: int = 4096, loss_from: str | None = None, window: int = 512) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit
    numbers), doc_tokens, loss_tokens, sequence_id, offset.

    A document is the ids of its text and then end_id. Its loss-bearing tokens are those from token
    number loss_from (a column; null or none: from the first) to the end. Sequences hold at most max_tokens
    tokens, max_segments pieces and max_loss loss-bearing tokens. Null and empty texts are end_id alone.
    Documents longer than a sequence are cut, never shortened. Repeated rows are packed each; null ids
    are carried; an empty table gives an empty table; other columns may have any name.

    Each task packs the rows it reads, so nothing is shuffled; the last sequence of a task is cut into
    powers of two, which need no padding. sequence_id is the task number times 2 ** 32 plus the sequence of the task."""
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits must be positive")
    rows = bounded(df).select(F.col(id_col).alias("id"), F.col(text).alias("text"), (F.col(loss_from).cast("bigint") if loss_from else F.lit(None).cast("bigint")).alias("loss_from"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *[T.StructField(n, T.LongType()) for n in (
        "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset")]])
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        to_ids, packer = encode(), Packer((max_tokens, max_segments, max_loss), window)
        base = TaskContext.get().partitionId() << 32
        out: list[tuple] = []

        def note(pieces):
            for (doc, ids, at, free, tokens), start, n, sequence, offset in pieces:
                out.append((doc, start, n, zlib.crc32(ids[4 * (start - at):4 * (start - at + n)]), tokens, max(0, start + n - max(start, free)), base + sequence, offset))

        def flush():
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], schema.names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, free, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), utf8(batch, "text")):
                ids = to_ids(text) + end
                tokens = len(ids) // 4
                free = min(max(free or 0, 0), tokens)
                example = [doc, ids, 0, free, tokens]
                note(packer.add(example, tokens, tokens - free))
                if tokens > max_tokens:
                    release(example, packer.waiting)
                if len(out) >= 8192:
                    yield flush()
        note(packer.finish())
        if out:
            yield flush()

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
