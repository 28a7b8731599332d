"""Packing examples into sequences by vector bin packing with the dot-product heuristic.

A sequence holds at most ``tokens`` tokens, ``segments`` pieces and ``loss`` loss-bearing tokens. Examples are placed
whole; only one that exceeds a limit by itself is cut: its full heads are pieces of their own, and its rest is placed
like an example. One sequence is open at a time. Of the sizes that still fit it, the one whose (tokens, one segment, loss
tokens), each over its limit, has the largest dot product with the room that is left goes in. The limits are weighed by
what all that waits demands of them, and the product is taken over the size to the power SIZE_POWER: at 0 the largest
size would go first whatever its shape, at 1 shape alone would count. When none fits, the sequence is closed and the
next one opened. A task gathers CHUNK tokens before it packs, and keeps RESERVE of them back
for later, so that there are always small examples left to fill gaps with.

Tasks pack their own rows, so nothing is shuffled and a sequence never spans tasks. A task's last sequence is cut into
sequences of powers of two, which need no padding; all others are padded to the limit. Ids of sequences are the task's
number and a count. A task that is run again packs alike if its rows come in the same order: pack what is read from
files. A task holds CHUNK tokens at a time.

Defined cases: a null text is empty and has the end token alone; loss-bearing tokens are those from the example's
``loss_from`` on (null or none named: all); repeated rows and null ids are packed like others, and ``example_id`` tells
the pieces of rows that share a doc_id apart; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tokens import tokenizer_path, word_tokenizer

#: Tokens that a task gathers before it packs them, and the share of them that it keeps back for later.
CHUNK, RESERVE = 2_000_000, 0.5
#: How far the size of an example is taken out of its dot product; what keeps sizes of zero weight apart from zero.
SIZE_POWER, TINY = 0.8, 1e-12
SEQUENCES_PER_TASK = 2**33
SCHEMA = "doc_id long, example_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long"
FIELDS = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in SCHEMA.split(", ")])


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 1024
    loss: int = 4096


class Packer:
    """Packs (example, start, length, loss_from) pieces; emits rows of pieces with sequence and offset."""

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits = limits
        self.sequence = first_sequence
        self.of = {}  # (length, loss) -> class
        self.sizes = np.empty((0, 3))
        self.waiting: list[list[tuple]] = []
        self.tokens = 0  # that wait
        self.open: list[tuple] = []
        self.full = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.room = self.full.copy()

    @staticmethod
    def loss_of(piece: tuple) -> int:
        _, start, length, loss_from = piece
        return max(0, start + length - max(start, loss_from))

    def head(self, piece: tuple) -> int:
        """The longest head of a piece that a sequence can hold."""
        _, start, length, loss_from = piece
        return int(min(length, self.limits.tokens, max(0, loss_from - start) + self.limits.loss))

    def emit(self, pieces: list[tuple]) -> list[tuple]:
        """Rows of one sequence."""
        rows, offset = [], 0
        for example, start, length, loss_from in pieces:
            rows.append((example, start, length, self.sequence, offset, self.loss_of((example, start, length, loss_from))))
            offset += length
        self.sequence += 1
        return rows

    def wait(self, piece: tuple) -> None:
        key = (piece[2], self.loss_of(piece))
        at = self.of.setdefault(key, len(self.waiting))
        if at == len(self.waiting):
            self.waiting.append([])
            if at >= len(self.sizes):
                self.sizes = np.concatenate([self.sizes, np.zeros((max(64, at), 3))])
            self.sizes[at] = (key[0], 1, key[1])
        self.waiting[at].append(piece)
        self.tokens += piece[2]

    def add(self, example: int, length: int, loss_from: int) -> list[tuple]:
        """Full sequences of an example at once; the rest of it waits."""
        rows, piece = [], (example, 0, length, loss_from)
        while (n := self.head(piece)) < piece[2]:
            if n == self.limits.tokens:
                rows += self.emit([(example, piece[1], n, loss_from)])
            else:
                self.wait((example, piece[1], n, loss_from))
            piece = (example, piece[1] + n, piece[2] - n, loss_from)
        self.wait(piece)
        return rows

    def close(self) -> list[tuple]:
        rows = self.emit(self.open) if self.open else []
        self.open, self.room = [], self.full.copy()
        return rows

    def pack(self, reserve: int = 0) -> list[tuple]:
        """Packs what waits until no more than ``reserve`` tokens do; the last sequence stays open."""
        rows = []
        held = [i for i, w in enumerate(self.waiting) if w]  # sizes that are used up go
        self.sizes, self.waiting = self.sizes[held], [self.waiting[i] for i in held]
        self.of = {(int(n), int(loss)): i for i, (n, _, loss) in enumerate(self.sizes)}
        left = np.array([len(w) for w in self.waiting], np.int64)
        demand = left @ self.sizes / self.full
        weight = (self.sizes @ (demand / self.full) + TINY) ** SIZE_POWER
        while self.tokens > reserve and left.any():
            fits = (left > 0) & (self.sizes <= self.room).all(1)
            if not fits.any():
                rows += self.close()
                continue
            if not self.open:
                demand = left @ self.sizes / self.full
                weight = (self.sizes @ (demand / self.full) + TINY) ** SIZE_POWER
            score = self.sizes @ (self.room * demand / self.full**2) / weight
            at = int(np.argmax(np.where(fits, score, -1.0)))
            piece = self.waiting[at].pop()
            left[at] -= 1
            self.tokens -= piece[2]
            self.open.append(piece)
            self.room -= self.sizes[at]
        return rows

    def tail(self) -> list[tuple]:
        """Rows of the open sequence, cut into sequences of powers of two if it isn't full."""
        pieces, self.open, self.room = self.open, [], self.full.copy()
        total = sum(p[2] for p in pieces)
        rows, at = [], 0
        for bit in range(total.bit_length() - 1, -1, -1):
            left, part = (1 << bit) * (total >> bit & 1), []
            while left:
                example, start, length, loss_from = pieces[at]
                take = min(length, left)
                part.append((example, start, take, loss_from))
                pieces[at] = (example, start + take, length - take, loss_from)
                at += take == length
                left -= take
            rows += self.emit(part) if part else []
        return rows


def _packed(path: str, limits: Limits, end_id: int, chunk: int, memory: float):
    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        packer = Packer(limits, first)
        tokenizer = word_tokenizer(path, memory)
        end = np.array([end_id], "<u4").tobytes()
        held: dict[int, tuple] = {}  # example -> doc_id, ids; of those that still have a piece to come
        count = size = 0
        rows: list[tuple] = []

        def batch(rows):
            out = []
            for example, start, length, sequence, offset, loss in rows:
                doc_id, ids = held[example]
                out.append((doc_id, first + example, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, sequence, offset, loss))
            columns = zip(*out, strict=True) if out else [()] * len(FIELDS)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FIELDS, strict=True)], schema=FIELDS)

        for table in batches:
            encoded = tokenizer.encode_all(table.column("text"), end)
            for doc_id, ids, loss_from in zip(table.column("doc_id").to_pylist(), encoded, table.column("loss_from").to_pylist(), strict=True):
                held[count] = (doc_id, ids)
                rows += packer.add(count, len(ids) // 4, loss_from or 0)
                count += 1
                size += len(ids) // 4
                if size >= chunk:
                    rows += packer.pack(int(chunk * RESERVE))
                    yield batch(rows)
                    later = {p[0] for pieces in [packer.open, *packer.waiting] for p in pieces}
                    held = {e: held[e] for e in later}
                    rows, size = [], packer.tokens
        yield batch(rows + packer.pack() + packer.tail())
        del held, packer
        tokenizer.rest()

    return run


def pack_documents(docs: DataFrame, path: str | None = None, limits: Limits = Limits(), end_id: int = 2, chunk: int = CHUNK, loss_from: str | None = None, memory: float = 1.0) -> DataFrame:
    """Pieces: doc_id, example_id (one for each row), start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset and loss_tokens.

    loss_from: the column with the first loss-bearing token of each example, if not all are. memory: share of the words that a worker
    remembers otherwise, where other work needs the room; it changes no result.
    """
    first_loss = F.col(loss_from).cast("long") if loss_from else F.lit(0).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), first_loss.alias("loss_from"))
    return rows.mapInArrow(_packed(path or tokenizer_path(), limits, end_id, chunk, memory), SCHEMA)
