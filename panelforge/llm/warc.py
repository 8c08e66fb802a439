"""WARC archives of captures, read back into sorted runs and merged into one globally ordered index.

Archives are rows (archive, data) of a written table: data is a standard .warc.gz, one gzip member a
record, of about ARCHIVE_BYTES. Spark's commit makes the table whole even when executors are lost.
Reading an archive gives its captures as a run sorted by URL key, time and page; range partitions of
all runs are merged by loser trees, so the index is ordered within and across partitions.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.shared import partitions, sliced, small_batches, written

ARCHIVE_BYTES = 4 << 20
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = dt.datetime(2024, 1, 1)
SPAN_SECONDS = 10 * 365 * 86400


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query, lower-cased."""
    try:
        parts = urlsplit((url or "").strip())
        host = parts.hostname or ""
    except ValueError:
        return (url or "").lower()
    port = parts.netloc.rpartition("@")[2].partition(":")[2] if ":" in parts.netloc else ""
    path = (parts.path or "/") + ("?" + parts.query if parts.query else "")
    return (",".join(reversed(host.split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + path).lower()


def capture_time(page_id: int | None) -> str:
    """The tables have no capture time: one second a page from EPOCH on, by page_id."""
    return (EPOCH + dt.timedelta(seconds=(page_id or 0) % SPAN_SECONDS)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Date: {capture_time(page_id)}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def records(data: bytes):
    """(offset, length, headers, payload, payload length) of each record of an archive; a revisit's payload is None."""
    at = 0
    while at < len(data):
        reader, parts, read = zlib.decompressobj(31), [], at
        while not reader.eof:
            if read >= len(data):
                raise ValueError("a record is cut off")
            parts.append(reader.decompress(data[read : read + 16384]))
            read += 16384
        text = b"".join(parts)
        size = min(read, len(data)) - at - len(reader.unused_data)
        head, _, rest = text.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        full = int(http.decode().rpartition("Content-Length: ")[2])
        yield at, size, fields, (payload if fields["WARC-Type"] == "response" else None), full
        at += size


def page_number(urn: str) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn != "<urn:page:>" else None


#: Stands for a null page_id in the order of captures.
LEAST = -(1 << 63)


class LoserTree:
    """k-way merge: inner nodes hold the losers of their matches, so the next row costs one comparison a level."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.at = [0] * len(runs)
        self.tree = [0] * self.k
        winners = [0] * (2 * self.k)
        winners[self.k :] = list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._first(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        """Whether run a's next row comes before run b's; a run that is used up comes last, ties go to the lower run."""
        x = self.runs[a][self.at[a]] if self.at[a] < len(self.runs[a]) else None
        y = self.runs[b][self.at[b]] if self.at[b] < len(self.runs[b]) else None
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def __iter__(self):
        if not self.runs:
            return
        while self.at[self.winner] < len(self.runs[self.winner]):
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            node = (w + self.k) // 2
            while node:
                if self._first(self.tree[node], w):
                    w, self.tree[node] = self.tree[node], w
                node //= 2
            self.winner = w


def with_references(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is the smallest page_id with the same payload, null for that page itself.

    Payloads are compared by length and SHA-1. The smallest page of each repeated payload is aggregated from a narrow
    table, and the pages join it once; a payload that very many pages share is a skewed side that adaptive execution
    splits, and where repeated payloads are few Spark broadcasts them by their measured size and no page moves.
    """
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary")).alias("payload")).withColumn("sha", F.sha1("payload")).withColumn("size", F.length("payload").cast("long"))
    first = plain.filter(F.col("size") >= least).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("last > first")
    return plain.join(first, ["sha", "size"], "left").select("page_id", "url", "payload", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def archives(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(archive, data): the .warc.gz archives of the pages, written to the shared folder."""

    def run(batches):
        task, n, members, size = TaskContext.get().partitionId(), 0, [], 0
        for whole in batches:
            for b in sliced(whole, "payload"):
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    members.append(record(*row))
                    size += len(members[-1])
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{n:06d}.warc.gz"]), pa.array([b"".join(members)], pa.binary())], names=["archive", "data"])
                        n, members, size = n + 1, [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{n:06d}.warc.gz"]), pa.array([b"".join(members)], pa.binary())], names=["archive", "data"])

    with small_batches(pages.sparkSession):
        return written(with_references(pages, least).mapInArrow(run, "archive string, data binary"), "warc")


CAPTURE = pa.schema([("run", pa.string()), ("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("archive_offset", pa.int64()), ("archive_length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
CAPTURE_DDL = "run string, url_key string, captured_at string, page_id long, archive_offset long, archive_length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def capture_runs(stored: DataFrame) -> DataFrame:
    """Every record of the archives, read back: one run an archive, sorted by URL key, time and page."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for at, size, fields, payload, full in records(data):
                    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if payload is not None and (digest(payload) != told or len(payload) != full):
                        raise ValueError(f"{name} at {at}: payload and digest differ")
                    refers = page_number(fields["WARC-Refers-To"]) if payload is None else None
                    rows.append((name, url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], page_number(fields["WARC-Record-ID"]), at, size, full, told, fields["WARC-Type"], refers))
                rows.sort(key=lambda r: (r[1], r[2], LEAST if r[3] is None else r[3], r[4]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), CAPTURE)], schema=CAPTURE)

    return stored.select("archive", "data").mapInArrow(run, CAPTURE_DDL)


#: Captures of one range of the merge on average: what a task holds, whatever the table.
RANGE_ROWS = 50_000


def merged(runs: DataFrame) -> DataFrame:
    """The runs' captures in one order of (url_key, captured_at, page_id), within and across partitions.

    There are as many ranges as their rows need; they include the page and the place of the record, so captures of one
    URL, and records of one page, spread over tasks. A run's share arrives in
    pieces that are in order; where one is not continued in order, a new run begins.
    """
    n = max(partitions(runs.sparkSession), -(-runs.count() // RANGE_ROWS))

    def merge(batches):
        parts: dict[str, list[list[tuple]]] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                own = parts.setdefault(row[0], [[]])
                key = (row[1], row[2], LEAST if row[3] is None else row[3], row[0], row[4])
                if own[-1] and own[-1][-1][0] > key:
                    own.append([])
                own[-1].append((key, row))
        rows, out = [r for own in parts.values() for r in own], []
        for _, i, j in LoserTree([[(k, i, j) for j, (k, _) in enumerate(run)] for i, run in enumerate(rows)]):
            out.append(rows[i][j][1])
            if len(out) == 4096:
                yield batch(out)
                out = []
        yield batch(out)

    def batch(rows):
        columns = [list(c) for c in zip(*rows)] or [[] for _ in CAPTURE]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CAPTURE)], schema=CAPTURE)

    return runs.repartitionByRange(n, "url_key", "captured_at", "page_id", "run", "archive_offset").mapInArrow(merge, CAPTURE_DDL)


def capture_index(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Write the pages' archives, read them back and merge their runs: one row a page, in index order.

    Null html is an empty payload, null URLs sort first; rows repeated with one page_id are records
    of their own, both responses; a null page_id is a response of its own and never referred to; empty payloads refer to
    the first empty one; an empty table gives no rows; other columns are ignored.
    """
    stored = archives(pages, least)
    with small_batches(pages.sparkSession):
        runs = written(capture_runs(stored), "runs")
    return merged(runs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", F.col("run").alias("archive"), "archive_offset", "archive_length")
