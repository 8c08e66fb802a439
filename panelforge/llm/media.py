"""AVI motion-JPEG: lossless intra frames, RIFF index parsing and shot detection.

Frames are grey lossless JPEG (process 14, 8-bit samples). The Huffman code gives a difference of s
extra bits a code word of 9 - s bits, so every sample takes 9 bits: coding and decoding are array
operations over all frames of a block. Frames of other files are decoded by their own headers (size,
Huffman table), bit by bit; what is not grey, 8-bit and lossless with the first predictor raises an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.shared import BLOCK_BYTES, id_and_text, raw_bytes, sliced

SIDE = 24
SAMPLES = SIDE * SIDE
FILL = 255
FRAMES_A_SECOND = 25
CODED = SAMPLES * 9 // 8


def _code_words() -> tuple[np.ndarray, np.ndarray]:
    """9-bit word of each difference -255..255 (at its value + 255), and the difference of each word."""
    word, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = 8 if s == 0 else 8 - s
        code = ((1 << prefix) - 1) << 1
        extra = d if d > 0 else d + (1 << s) - 1
        word[d + 255] = code << s | extra
        back[word[d + 255]] = d
    return word, back


WORDS, DIFFERENCES = _code_words()


def frame_head() -> bytes:
    """SOI, Huffman table, frame and scan headers: the same for every frame."""
    lengths = [0] * 16
    values = bytes(range(8, -1, -1))  # shorter words for more extra bits
    for length in range(1, 10):
        lengths[length - 1] = 1
    dht = b"\xff\xc4" + struct.pack(">H", 19 + len(values)) + b"\x00" + bytes(lengths) + values
    sof3 = b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, SIDE, SIDE, 1) + b"\x01\x11\x00"
    sos = b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00" + b"\x01\x00\x00"
    return b"\xff\xd8" + dht + sof3 + sos


HEAD, TAIL = frame_head(), b"\xff\xd9"


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded, stuffed scans of frames (n x 576 samples): (bytes of all, offset of each)."""
    x = samples.reshape(-1, SIDE, SIDE).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    words = WORDS[d.reshape(-1, 8) + 255].astype(np.uint64)
    # eight 9-bit words are nine bytes: the first 64 bits as one big-endian number, the last byte apart
    top = np.zeros(len(words), np.uint64)
    for k in range(7):
        top |= words[:, k] << np.uint64(55 - 9 * k)
    top |= words[:, 7] >> np.uint64(8)
    out = np.empty((len(words), 9), np.uint8)
    out[:, :8] = top.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8] = (words[:, 7] & np.uint64(255)).astype(np.uint8)
    flat = out.reshape(-1)
    marks = np.flatnonzero(flat == 255)
    stuffed = np.insert(flat, marks + 1, 0) if len(marks) else flat
    ends = np.arange(len(x) + 1) * CODED
    return stuffed, ends + np.searchsorted(marks, ends)


def decode_frames(scans: np.ndarray) -> np.ndarray:
    """Samples of concatenated scans whose stuffing is still in; n x 576."""
    flat = scans[~np.r_[False, (scans[:-1] == 255) & (scans[1:] == 0)]] if len(scans) else scans
    groups = np.ascontiguousarray(flat.reshape(-1, 9))
    top = np.ascontiguousarray(groups[:, :8]).view(">u8").reshape(-1).astype(np.uint64)
    words = np.empty((len(groups), 8), np.uint16)
    for k in range(7):
        words[:, k] = (top >> np.uint64(55 - 9 * k)) & np.uint64(511)
    words[:, 7] = ((top & np.uint64(1)) << np.uint64(8)).astype(np.uint16) | groups[:, 8]
    d = DIFFERENCES[words].reshape(-1, SIDE, SIDE)
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1) + 128
    return np.cumsum(d, axis=2, dtype=np.int16).astype(np.uint8).reshape(-1, SAMPLES)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def avi(frames: list[bytes], rate: int = FRAMES_A_SECOND) -> bytes:
    """A RIFF AVI file of MJPG frames with an idx1 index."""
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SAMPLES, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    sizes = np.array([len(f) for f in frames], np.int64)
    at = 4 + np.concatenate([[0], np.cumsum(8 + sizes + (sizes & 1))])
    body = b"".join(b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) & 1) for f in frames)
    index = np.zeros(len(frames), np.dtype([("kind", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    index["kind"], index["flags"], index["at"], index["size"] = b"00dc", 0x10, at[:-1], sizes
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"movi" + body) + _chunk(b"idx1", index.tobytes()))


def indexed_frames(media: bytes) -> tuple[list[tuple[int, int]], int]:
    """(place, size) of each video frame as the idx1 index says, and microseconds a frame."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    at, end, movi, found, step = 12, 8 + struct.unpack_from("<I", media, 4)[0], None, [], 1_000_000 // FRAMES_A_SECOND
    while at + 8 <= end:
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            step = struct.unpack_from("<I", media, at + 20)[0]
        elif kind == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif kind == b"idx1" and movi is not None:
            index = np.frombuffer(media, np.dtype([("kind", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), size // 16, at + 8)
            found = [(movi + int(x["at"]) + 8, int(x["size"])) for x in index[index["kind"] == b"00dc"]]
        at += 8 + size + (size & 1)
    return found, step


class Frame:
    """A grey lossless JPEG frame, as its own headers describe it."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        tables: dict[int, dict[tuple[int, int], int]] = {}
        at, self.height, self.width = 2, 0, 0
        while True:
            mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if mark == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = self.words(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif mark == 0xC3:
                bits, self.height, self.width, parts = struct.unpack_from(">BHHB", body)
                if (bits, parts) != (8, 1):
                    raise ValueError("only grey frames of 8 bits are read")
            elif 0xC0 <= mark <= 0xCF and mark not in (0xC8, 0xCC) or mark == 0xDD and any(body):
                raise ValueError(f"only lossless frames without restarts are read, not marker {mark:02x}")
            elif mark == 0xDA:
                if body[0] != 1 or tuple(body[3:6]) != (1, 0, 0):
                    raise ValueError("only the first predictor without point transform is read")
                self.table = tables[body[2] >> 4]
                end = data.rfind(b"\xff\xd9")
                self.scan = data[at : end if end >= at else len(data)]
                return

    @staticmethod
    def words(counts: bytes, values: bytes) -> dict[tuple[int, int], int]:
        """(length, code word) -> value of a canonical Huffman table."""
        out, code, k = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                out[length, code] = values[k]
                code, k = code + 1, k + 1
            code <<= 1
        return out

    def samples(self) -> np.ndarray:
        """Rows x columns of samples."""
        bits = np.unpackbits(np.frombuffer(self.scan.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
        d, at = np.zeros((self.height, self.width), np.int64), 0
        for i in range(d.size):
            code = length = 0
            while (length, code) not in self.table:
                code, length, at = code << 1 | bits[at], length + 1, at + 1
                if length > 16:
                    raise ValueError("no such code word")
            s, v = self.table[length, code], 0
            for b in bits[at : at + s]:
                v = v << 1 | b
            at += s
            d.flat[i] = v if s == 0 or v >> (s - 1) else v - (1 << s) + 1
        d[:, 0] = np.cumsum(d[:, 0]) + 128
        return np.cumsum(d, axis=1).astype(np.uint8)


def shot_starts(samples: np.ndarray, bins: int = 16, window: int = 8, factor: float = 3.0, floor: float = 0.25) -> np.ndarray:
    """First frames of shots: the histogram difference to the frame before exceeds `floor` and `factor` times the mean of the last `window` differences."""
    n = len(samples)
    hist = np.bincount((np.repeat(np.arange(n), samples.shape[1]) * bins + (samples.reshape(-1) >> 4)), minlength=n * bins).reshape(n, bins)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * samples.shape[1])
    total = np.concatenate([[0.0], np.cumsum(diff)])
    k = np.arange(len(diff))
    low = np.maximum(0, k - window)
    mean = (total[k] - total[low]) / np.maximum(1, k - low)
    return np.concatenate([[0], 1 + np.flatnonzero((diff > floor) & (diff > factor * mean))]).astype(np.int64)


def padded(text: np.ndarray) -> np.ndarray:
    """Payload: the bytes and FILL up to a positive multiple of a frame."""
    want = max(1, -(-len(text) // SAMPLES)) * SAMPLES
    out = np.full(want, FILL, np.uint8)
    out[: len(text)] = text
    return out


def encode_payloads(payloads: list[np.ndarray]) -> list[bytes]:
    """An AVI file of each payload; all frames are coded in one pass."""
    scans, ends = encode_frames(np.concatenate(payloads).reshape(-1, SAMPLES))
    data, at, out = scans.tobytes(), 0, []
    for p in payloads:
        n = len(p) // SAMPLES
        out.append(avi([HEAD + data[ends[i] : ends[i + 1]] + TAIL for i in range(at, at + n)]))
        at += n
    return out


def decode_media(files: list[bytes]) -> list[tuple[np.ndarray, int]]:
    """(frames x samples, microseconds a frame) of each file: the index is parsed, every intra frame decoded; frames with this module's headers all at once."""
    scans, counts, steps, other = [], [], [], {}
    for k, media in enumerate(files):
        view = memoryview(media)
        frames, step = indexed_frames(media)
        steps.append(step)
        own = [view[at : at + size] for at, size in frames]
        if all(f[: len(HEAD)] == HEAD and f[-2:] == TAIL for f in own):
            scans += [f[len(HEAD) : -2] for f in own]
            counts.append(len(frames))
        else:
            counts.append(0)
            other[k] = np.stack([Frame(bytes(f)).samples().reshape(-1) for f in own])
    samples = np.split(decode_frames(np.frombuffer(b"".join(scans), np.uint8)), np.cumsum(counts)[:-1])
    return [(other.get(k, x), step) for k, (x, step) in enumerate(zip(samples, steps))]


def clips(samples: np.ndarray, step: int) -> list[tuple[int, int, int, int]]:
    """(first frame, frames, start, end in microseconds) of each shot."""
    starts = shot_starts(samples)
    ends = np.append(starts[1:], len(samples))
    return [(int(a), int(b - a), int(a) * step, int(b) * step) for a, b in zip(starts, ends)]


CLIP = pa.struct([(c, pa.int64()) for c in ("first_frame", "frames", "start_us", "end_us")])
CLIP_DDL = "array<struct<first_frame: long, frames: long, start_us: long, end_us: long>>"


def clip_lists(found: list[list[tuple[int, int, int, int]]]) -> pa.Array:
    rows = [c for own in found for c in own]
    columns = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 4)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(CLIP)))


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the media column itself, one AVI file per text. Null and empty texts are one frame of FILL; long texts are blocks of their own; repeated rows repeat; an empty table stays empty; other columns are ignored."""

    def run(batches):
        for whole in batches:
            for batch in sliced(whole, limit=BLOCK_BYTES):
                flat, ends = raw_bytes(batch.column(1))
                files = encode_payloads([padded(flat[a:b]) for a, b in zip(ends, ends[1:])])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decoded(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, clips) of a table (doc_id, n_bytes, media), all read back from the stored bytes.

    clips: the timed shots. feature: frames, shots, start of the shots in milliseconds (as a checksum) and mean
    sample. Null media have null values and no clips; other columns are ignored.
    """

    def run(batches):
        for whole in batches:
            for batch in sliced(whole, "media", BLOCK_BYTES):
                files = [x or b"" for x in batch.column(2).to_pylist()]
                there = [x for x in files if x]
                out: list[list] = [[] for _ in range(6)]
                shots = []
                read = iter(decode_media(there) if there else [])
                for media in files:
                    samples, step = next(read) if media else (np.zeros((0, SAMPLES), np.uint8), 0)
                    own = clips(samples, step) if media else []
                    shots.append(own)
                    payload = samples.tobytes()
                    times = zlib.crc32(",".join(str(s[2] // 1000) for s in own).encode())
                    feature = f"frames={len(samples)};shots={len(own)};times={times:08x};mean={int(samples.sum(dtype=np.int64)) // max(1, samples.size)}"
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                    for column, x in zip(out, row if media else [None] * 6):
                        column.append(x)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds)), clip_lists(shots)], names=names)

    held = media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), F.col("media").cast("binary").alias("media"))
    return held.mapInArrow(run, f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips {CLIP_DDL}")


def clip_rows(media: DataFrame) -> DataFrame:
    """Timed clips of a table (doc_id, media): (doc_id, clip, first_frame, frames, start_us, end_us). Null media have no clips; repeated rows repeat theirs; an empty table gives no rows."""
    found = decoded(media.select("doc_id", F.lit(None).cast("long").alias("n_bytes"), "media"))
    return found.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", F.col("clip").cast("long").alias("clip"), "c.*")


def media_features(docs: DataFrame) -> DataFrame:
    """Each text as an AVI file in a media column, and what is read back from that column: see media_table and decoded. Equal texts give equal values."""
    return decoded(media_table(docs))
