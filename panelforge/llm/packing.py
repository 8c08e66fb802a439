"""Packing of tokenised documents into training sequences: first-fit decreasing over a tournament tree."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.bpe import vocabulary
from panelforge.llm.bpe_blocks import blocks
from panelforge.llm.shared import id_and_text, raw_bytes, sliced


class Tournament:
    """Bins of equal capacity; each inner node holds the larger free space of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [0] * (2 * self.leaves)
        self.free[self.leaves : self.leaves + bins] = [capacity] * bins
        for i in range(self.leaves - 1, 0, -1):
            self.free[i] = max(self.free[2 * i], self.free[2 * i + 1])

    def place(self, size: int) -> int:
        """The first bin with `size` free, whose space is taken."""
        free, i = self.free, 1
        while i < self.leaves:
            i *= 2
            if free[i] < size:
                i += 1
        free[i] -= size
        placed = i - self.leaves
        i >>= 1
        while i:
            best = max(free[2 * i], free[2 * i + 1])
            if free[i] == best:
                break
            free[i] = best
            i >>= 1
        return placed


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, all between 1 and capacity; ties keep their order, bins are numbered from 0 without gaps."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.zeros(len(sizes), np.int64)
    full = int((sizes == capacity).sum())
    bins[order[:full]] = np.arange(full)
    rest = order[full:]
    if len(rest):
        tree = Tournament(len(rest), capacity)
        bins[rest] = full + np.array([tree.place(s) for s in sizes[rest].tolist()], np.int64)
    return bins


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("row", pa.int64())])


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int, end_id: int) -> DataFrame:
    """Each document's ids and the end id, cut every max_tokens: a row a piece, ids kept as their checksum only, with the document's number in its task."""
    key, sent = vocabulary(docs.sparkSession, tokenizer_path)

    def run(batches):
        encoder = blocks(key, sent.value)
        end = np.array([end_id], "<u4").tobytes()
        row = 0
        for whole in batches:
            for batch in sliced(whole):
                batch.column(1).validate(full=True)  # ill-formed UTF-8 fails here
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for doc, ids in zip(batch.column(0).to_pylist(), encoder.each(*raw_bytes(batch.column(1)))):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, max_tokens):
                        length = min(max_tokens, n - start)
                        for column, x in zip(out, (doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, row)):
                            column.append(x)
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=PIECES)

    return id_and_text(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long")


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = 1024, end_id: int = 0, documents_per_group: int = 4096, seed: int = 17) -> DataFrame:
    """Pieces with the sequence that holds them: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_to).

    Pieces are dealt into groups of about documents_per_group documents by a hash of what they are and of
    their document's number in its task; each group is packed on its own, so no task holds more than a group, whatever one doc_id
    or one repeated row holds. Groups are of pieces, not of documents, so that a very long document spreads. A sequence whose tokens are a power of two
    needs no padding; others are padded to max_tokens. Null and empty texts are one piece holding the
    end id; repeated rows are packed as often as they occur; ties go by doc_id and start; an empty table gives no rows.
    """
    groups = max(1, math.ceil(docs.count() / documents_per_group))
    dealt = token_pieces(docs, tokenizer_path, max_tokens, end_id).withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row", F.lit(seed)), F.lit(groups)).cast("long")).drop("row")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins = first_fit_decreasing(pdf["length"].to_numpy(), max_tokens)
        order = np.argsort(bins, kind="stable")
        pdf, bins = pdf.iloc[order].reset_index(drop=True), bins[order]
        length = pdf["length"].to_numpy()
        ends = np.cumsum(length)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        of = np.cumsum(np.r_[True, bins[1:] != bins[:-1]]) - 1
        total = np.add.reduceat(length, first)
        pdf["sequence_id"] = (int(pdf["pack_group"].iloc[0]) << 32) + of
        pdf["offset"] = ends - length - (ends - length)[first][of]
        pdf["sequence_tokens"] = total[of]
        pdf["padded_to"] = np.where((total & (total - 1)) == 0, total, max_tokens)[of]
        return pdf.drop(columns="pack_group")

    return dealt.groupBy("pack_group").applyInPandas(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long")
