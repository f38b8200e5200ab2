"""Packing documents into training sequences: bounded-space online best-fit.

A document is its token ids and an end id.  Longer ones than a sequence are cut
into full pieces, the shorter piece first.  Pieces are dealt at random (by
hash) over tasks of about ``tokens_per_task`` tokens; each task takes its
pieces from the longest on and places each into the open bin with the least
free space that holds it.  Open bins are found through a bitset keyed by free
space: shift away what is too small, take the lowest bit.  At most
``open_bins`` are open; when a further one is needed, the fullest closes.

Only piece lengths are shuffled, not ids.  A task's memory is bounded by
``tokens_per_task``; the number of tasks follows the total of all lengths, and
what is lost by packing in tasks is at most the last bins of each.

Defined results: null and empty text are the end id alone; repeated rows are
packed each; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardprism.llm.common import Scratch
from cardprism.llm.tokens import ByteBpe


class BestFit:
    """Bounded-space best-fit.  ``bins[f]`` are the open bins with f free."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most, self.open, self.made, self.bits = capacity, open_bins, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def place(self, n: int) -> tuple[int, int]:
        """(bin, offset) of a piece of ``n`` tokens."""
        if fits := self.bits >> n:
            free = n + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if self.open >= self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            at, free = self.made, self.capacity
            self.made += 1
        if left := free - n:
            self.bins[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.capacity - free


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def cut_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                  with_ids: bool = False, folder: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) per piece."""
    kind = dict(docs.dtypes)[id_col]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        bpe = ByteBpe(folder)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.array([*bpe.ids(text), end_id], "<u4")
                for k, (start, n) in enumerate(pieces_of(len(ids), capacity)):
                    part = ids[start:start + n]
                    rows.append((doc, k, start, n, zlib.crc32(part.tobytes()), *([part.tolist()] if with_ids else [])))
            yield pd.DataFrame(rows, columns=columns)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInPandas(run, schema)


def pack(pieces: DataFrame, capacity: int = 1024, open_bins: int = 4096, tokens_per_task: int = 8_000_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    total = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, math.ceil(total / tokens_per_task))

    def run(batches):
        every = [b for b in batches if len(b)]
        if not every:
            return
        mine = pd.concat(every, ignore_index=True)
        mine = mine.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 32
        places = [fit.place(n) for n in mine["length"].tolist()]
        mine["sequence_id"] = [base + b for b, _ in places]
        mine["offset"] = [o for _, o in places]
        yield mine

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id bigint, offset bigint"
    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32"))
    return dealt.mapInPandas(run, schema)


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, open_bins: int = 4096, tokens_per_task: int = 8_000_000,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, folder: str | None = None) -> DataFrame:
    """Cut and pack: one row per piece, with its sequence and place there."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.put(cut_documents(docs, capacity, end_id, id_col, text_col, with_ids, folder), "pieces")
    return pack(pieces, capacity, open_bins, tokens_per_task)
