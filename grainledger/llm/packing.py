"""Vector bin packing of tokenised documents into training sequences.

A piece of a document asks for three things of a sequence at once: tokens, one segment (its own attention
span), and loss-bearing tokens. A sequence is filled by the dot-product heuristic: of the waiting pieces that
fit in every dimension it takes the one whose demands point most along the room that is left. Where none fits,
a piece is cut to fill the room, since a document may be cut freely. Where segments or loss-bearing tokens run out
before the tokens, and at a task's end, a sequence is cut to a power of two, which needs no padding.

Packing is local to a task, so nothing is shuffled; documents of one task share sequences. Sequence ids hold the
task's number above and a count below, so that they are unique and a rerun of a task gives them again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from grainledger.llm.common import table
from grainledger.llm.token_ids import crc_of_ids, encoder, give_back

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
END = 1
#: Units that a worker's encoder remembers: 128 bytes or so each.
REMEMBER = 250_000
#: Texts whose units are looked up together at most, and their bytes, about: a unit that many of them have is then looked up once.
TOGETHER, BYTES = 2048, 8 << 20


class _Packer:
    def __init__(self, tokens: int, segments: int, loss: int, waiting: int):
        self.limit = np.array([tokens, segments, loss], float)
        self.tokens, self.segments, self.loss, self.most = tokens, segments, loss, waiting
        self.demand = np.zeros((waiting + 1, 3))
        self.docs: list[tuple] = []  # (doc_id, ids, start, end, from which token loss counts)
        self.first = TaskContext.get().partitionId() << 36 if TaskContext.get() else 0
        self.closed = 0
        self.rows: list[tuple] = []

    def _ask(self, doc: tuple) -> tuple[int, int, int]:
        _, _, a, b, since = doc
        return b - a, 1, max(0, b - max(a, since))

    def _place(self, doc: tuple, at: int) -> None:
        doc_id, ids, a, b, since = doc
        self.rows.append((doc_id, a, b - a, crc_of_ids(ids[a:b]), len(ids), self.first + self.closed, at, max(0, b - max(a, since))))

    def add(self, doc_id, ids: np.ndarray, since: int) -> None:
        """Whole sequences of a long document at once; its rest waits."""
        a, n = 0, len(ids)
        while n - a >= self.tokens or max(0, n - max(a, since)) > self.loss:
            b = min(a + self.tokens, max(a, since) + self.loss)
            self._place((doc_id, ids, a, b, since), 0)
            self.closed += 1
            a = b
        if a < n:
            self._wait((doc_id, ids, a, n, since))
            while len(self.docs) >= self.most:
                self._close()

    def _wait(self, doc: tuple) -> None:
        self.demand[len(self.docs)] = self._ask(doc)
        self.docs.append(doc)

    def _take(self, i: int) -> tuple:
        doc, last = self.docs[i], len(self.docs) - 1
        self.docs[i] = self.docs[last]
        self.demand[i] = self.demand[last]
        self.docs.pop()
        return doc

    def _choose(self) -> tuple[list[tuple], np.ndarray]:
        """The pieces of one sequence, and the room left."""
        room, chosen = self.limit.copy(), []
        while room[0] > 0 and room[1] > 0 and self.docs:
            demand = self.demand[: len(self.docs)]
            fits = (demand <= room).all(1)
            if fits.any():
                along = (demand / self.limit) @ (room / self.limit)
                doc = self._take(int(np.argmax(np.where(fits, along, -1.0))))
            else:
                i = int(np.argmax(demand[:, 0]))
                doc_id, ids, a, b, since = self.docs[i]
                cut = min(b, a + int(room[0]), max(a, since) + int(room[2]))
                if cut <= a:
                    break
                self.docs[i] = (doc_id, ids, cut, b, since)
                self.demand[i] = self._ask(self.docs[i])
                doc = (doc_id, ids, a, cut, since)
            chosen.append(doc)
            room -= self._ask(doc)
        return chosen, room

    def _close(self) -> None:
        """One sequence: full, or where none fits any more as long as a power of two, which needs no padding."""
        chosen, room = self._choose()
        held = self.tokens - int(room[0])
        size, at = held if held == self.tokens else 1 << (held.bit_length() - 1), 0
        for doc_id, ids, a, b, since in chosen:
            cut = min(b, a + size - at)
            if cut > a:
                self._place((doc_id, ids, a, cut, since), at)
                at += cut - a
            self._back((doc_id, ids, cut, b, since))
        self.closed += 1

    def end(self) -> None:
        while self.docs:
            self._close()

    def _back(self, doc: tuple) -> None:
        if doc[3] > doc[2]:
            if len(self.docs) >= len(self.demand):
                self.demand = np.vstack([self.demand, np.zeros_like(self.demand)])
            self._wait(doc)

    def taken(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 8
        columns = list(zip(*self.rows)) if self.rows else [()] * 8
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    tokens: int = 2048,
    segments: int = 256,
    loss: int = 2048,
    waiting: int = 512,
    id_column: str = "doc_id",
    text_column: str = "text",
    loss_from: str | None = None,
    remember: int = REMEMBER,
    together: int = TOGETHER,
) -> DataFrame:
    """One row for each piece: document, start, length, crc32 of its ids, the document's ids, sequence, offset.

    ``loss_from`` names an integer column with the number of leading tokens (a prompt's, say) that bear no
    loss; without it every token does. A null text is empty and has the end id alone; a null id is kept.
    Repeated rows are documents of their own. An empty table gives no rows. Other columns are not read. A text of
    any length is encoded whole, and is cut at the limits. ``remember`` and ``together`` trade a worker's memory for time.
    """
    chosen = [id_column, text_column] + ([loss_from] if loss_from else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer, True, remember), _Packer(tokens, segments, loss, waiting)
        end = np.array([END], encode.dtype).tobytes()
        for batch in batches:
            step = max(1, min(together, BYTES * len(batch) // max(1, batch.nbytes)))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                since = part.column(2).to_pylist() if loss_from else [0] * len(part)
                coded = encode.encode_many([text or "" for text in part.column(1).to_pylist()])
                for doc_id, code, skip in zip(part.column(0).to_pylist(), coded, since):
                    ids = np.frombuffer(code + end, encode.dtype)
                    packer.add(doc_id, ids, min(max(skip or 0, 0), len(ids)))
                yield packer.taken()
        packer.end()
        yield packer.taken()
        give_back()

    return docs.select(*chosen).mapInArrow(run, SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
