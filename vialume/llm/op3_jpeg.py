"""Media columns: texts stored in baseline JPEG files, and features read back from such files.

Storing. A payload byte is one quantised DCT coefficient of a grayscale 8x8 block (the unit in which JPEG is lossless):
byte b >= 128 is the value b, a smaller one the value b - 255, so each coefficient is of category 8 and its value bits
are the byte. Every block is a restart interval of its own. Widths are a multiple of three blocks (192 bytes); blocks
that fill the last row hold bytes 32, and a comment marker keeps the payload's length.

Reading is general for baseline files of one interleaved scan: markers are parsed, the scan is split at restart markers,
and all segments of a batch are Huffman-decoded in step with numpy. Luminance thumbnails take the DC value of each
block; the feature is the image size and an average hash of the thumbnail.

Null texts count as empty (payload of 192 spaces). A text is handled whole, at about ten bytes of memory for each of its
own. Rows are independent; repeated rows give repeated results and further
columns are ignored. Files that aren't baseline JPEG raise ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vialume.llm.text import slices, spans

UNIT = 192
#: Blocks in one column of an image at most (65,535 pixels).
MOST_ROWS = 8191
#: Blocks whose bits are held one a byte.
BLOCKS_AT_ONCE = 1 << 14
MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def _marker(code: int, body: bytes) -> bytes:
    return bytes([0xFF, code]) + (len(body) + 2).to_bytes(2, "big") + body


#: One code, the bit 0, for category 8; the same for DC differences and for AC values after no zeros.
_ONE_CODE = bytes([1] + [0] * 15 + [8])
_TABLES = _marker(0xDB, bytes([0]) + bytes([1] * 64)), _marker(0xC4, b"\x00" + _ONE_CODE + b"\x10" + _ONE_CODE), _marker(0xDD, (1).to_bytes(2, "big")), _marker(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def _header(blocks: int, columns: int, payload: int) -> bytes:
    frame = b"\x08" + (blocks // columns * 8).to_bytes(2, "big") + (columns * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00"
    return b"\xff\xd8" + _marker(0xFE, b"payload=%d" % payload) + _TABLES[0] + _marker(0xC0, frame) + _TABLES[1] + _TABLES[2] + _TABLES[3]


def encode_files(payloads: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """One file for each payload of a buffer; sizes are positive multiples of 192."""
    blocks = sizes // 64
    columns = 3 * -(-blocks // (3 * MOST_ROWS))
    all_blocks = -(-blocks // columns) * columns
    coded = payloads.reshape(-1, 64)
    if (all_blocks != blocks).any():
        ends = np.cumsum(blocks)
        coded = np.insert(coded, np.repeat(ends, all_blocks - blocks), 32, axis=0)
    n = len(coded)
    scan = np.empty((n, 74), dtype=np.uint8)
    for lo in range(0, n, BLOCKS_AT_ONCE):
        some = coded[lo : lo + BLOCKS_AT_ONCE]
        bits = np.zeros((len(some), 64, 9), dtype=np.uint8)
        bits[:, :, 1:] = np.unpackbits(some.reshape(-1, 64, 1), axis=2)
        scan[lo : lo + len(some), :72] = np.packbits(bits.reshape(-1, 576), axis=1)
    ends = np.cumsum(all_blocks)
    within = np.arange(n) - np.repeat(ends - all_blocks, all_blocks)
    scan[:, 72] = 0xFF
    scan[:, 73] = 0xD0 + within % 8
    scan[ends - 1, 73] = 0xD9
    stuffed = scan == 0xFF
    stuffed[:, 72:] = False
    at = np.flatnonzero(stuffed.ravel())
    raw = np.insert(scan.ravel(), at + 1, 0).tobytes()
    stops = ends * 74 + np.searchsorted(at, ends * 74)
    starts = np.concatenate([[0], stops[:-1]])
    return [_header(int(b), int(c), int(p)) + raw[i:j] for b, c, p, i, j in zip(all_blocks, columns, sizes, starts, stops, strict=True)]


@dataclass(frozen=True)
class Frame:
    """What a file's markers say. parts: (horizontal, vertical sampling, quantiser of DC, DC table, AC table) of each component."""

    width: int
    height: int
    parts: tuple
    interval: int
    payload: int | None
    scan: int

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = (1, 1) if len(self.parts) == 1 else (max(p[0] for p in self.parts), max(p[1] for p in self.parts))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    @property
    def order(self) -> tuple:
        """The component of each block of an MCU."""
        return (0,) if len(self.parts) == 1 else tuple(k for k, p in enumerate(self.parts) for _ in range(p[0] * p[1]))


def parse_markers(data: bytes) -> Frame:
    """The markers of a baseline file up to its scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at, quant, huff, interval, payload, frame = 2, {}, {}, 0, None, None
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("broken marker")
        code, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if code == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                k += 1 + 64 * (1 + wide)
        elif code == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                huff[body[k]] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif code == 0xC0:
            frame = body
        elif code in (0xC1, 0xC2, 0xC3) or 0xC5 <= code <= 0xCF and code != 0xCC:
            raise ValueError("not baseline")
        elif code == 0xDD:
            interval = int.from_bytes(body, "big")
        elif code == 0xFE and body.startswith(b"payload="):
            payload = int(body[8:])
        elif code == 0xDA:
            if frame is None or body[0] != frame[5]:
                raise ValueError("one interleaved scan is expected")
            tables = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            parts = tuple((frame[7 + 3 * k] >> 4, frame[7 + 3 * k] & 15, quant[frame[8 + 3 * k]], huff[tables[frame[6 + 3 * k]] >> 4], huff[16 | tables[frame[6 + 3 * k]] & 15]) for k in range(frame[5]))
            return Frame(int.from_bytes(frame[3:5], "big"), int.from_bytes(frame[1:3], "big"), parts, interval, payload, at)


_lookups: dict[bytes, np.ndarray] = {}


def lookup(table: bytes) -> np.ndarray:
    """``length << 8 | symbol`` for the next 16 bits; 0 where no code begins."""
    if table not in _lookups:
        out, code, k = np.zeros(1 << 16, dtype=np.int64), 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                lo = code << (16 - length)
                out[lo : lo + (1 << (16 - length))] = length << 8 | table[k]
                code, k = code + 1, k + 1
            code <<= 1
        _lookups[table] = out
    return _lookups[table]


class _Bits:
    """Readers of many bit strings in one buffer."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        padded = np.concatenate([data, np.full(16, 0xFF, np.uint8)])
        self.windows = np.ndarray(shape=(len(padded) - 7,), dtype=">u8", buffer=padded.data, strides=(1,))
        self.at = starts.astype(np.int64) * 8
        self.most = (len(padded) - 8) * 8

    def value(self, who, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol and the bits that follow it as a signed value (its category is the symbol's low half)."""
        at = self.at[who]
        word = self.windows[np.minimum(at, self.most) >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        got = table[(word >> np.uint64(48)).astype(np.int64)]
        length, symbol = got >> 8, got & 255
        if not length.all():
            raise ValueError("no such Huffman code")
        size = symbol & 15
        bits = ((word << length.astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - size.astype(np.uint64))).astype(np.int64)
        self.at[who] = at + length + size
        return symbol, np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


def decode_scans(frame: Frame, scans: list[bytes], mcus: list[int]) -> list[np.ndarray]:
    """Coefficients (blocks x 64, zigzag order, DC not differenced) of scans with the same tables."""
    data = np.frombuffer(b"".join(scans), dtype=np.uint8)
    ff = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ff + 1]
    marks = ff[(after >= 0xD0) & (after <= 0xD9)]
    gone = np.sort(np.concatenate([ff[after == 0] + 1, marks, marks + 1]))
    place = lambda at: at - np.searchsorted(gone, at)
    stops = np.cumsum([len(s) for s in scans])
    starts = np.concatenate([[0], stops[:-1]])
    restarts = marks[data[marks + 1] != 0xD9]
    begin = np.sort(np.concatenate([place(starts), place(restarts + 2)]))
    size, of = [], []
    for k, m in enumerate(mcus):
        step = frame.interval or m
        size += [step] * (m // step) + ([m % step] if m % step else [])
        of.append(len(size))
    if len(size) != len(begin):
        raise ValueError("restart markers don't fit the image")
    size, order = np.array(size), frame.order
    most, per = int(size.max()), len(order)
    out = np.zeros((len(size), most * per, 64), dtype=np.int16)
    bits = _Bits(np.delete(data, gone), begin)
    last = np.zeros((len(size), len(frame.parts)), dtype=np.int64)
    for m in range(most):
        who = np.flatnonzero(size > m)
        for b, part in enumerate(order):
            _, diff = bits.value(who, lookup(frame.parts[part][3]))
            last[who, part] += diff
            out[who, m * per + b, 0] = last[who, part]
            table, k, live = lookup(frame.parts[part][4]), np.ones(len(who), dtype=np.int64), who
            while len(live):
                symbol, value = bits.value(live, table)
                k = k + (symbol >> 4)
                some = (symbol & 15) > 0
                if (k > 63).any() and (k[some] > 63).any():
                    raise ValueError("too many coefficients")
                if some.all():
                    out[live, m * per + b, k] = value
                else:
                    out[live[some], m * per + b, k[some]] = value[some]
                k = k + 1
                k[symbol == 0] = 64
                if k.max() > 63:
                    more = k < 64
                    live, k = live[more], k[more]
    flat = out.reshape(-1, 64)[np.repeat(np.arange(len(size)) * most * per, size * per) + np.concatenate([np.arange(s * per) for s in size.tolist()])] if most > 1 else out.reshape(-1, 64)
    ends = np.cumsum(np.array(mcus) * per)
    return np.split(flat, ends[:-1])


def thumbnail(frame: Frame, coefficients: np.ndarray) -> np.ndarray:
    """The luminance thumbnail: one pixel for each block, from its DC value."""
    across, down = frame.mcus
    h, v = (1, 1) if len(frame.parts) == 1 else frame.parts[0][:2]
    own = np.array([k for k, p in enumerate(frame.order) if p == 0])
    dc = coefficients[:, 0].reshape(down, across, -1)[:, :, own].astype(np.int64).reshape(down, across, v, h)
    pixels = dc.transpose(0, 2, 1, 3).reshape(down * v, across * h) * frame.parts[0][2]
    pixels = pixels[: -(-frame.height // 8), : -(-frame.width // 8)]
    return np.clip((pixels + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def average_hash(pixels: np.ndarray) -> int:
    """64 bits: whether each cell of an 8x8 grid is brighter than the mean of the cells."""
    rows, cols = pixels.shape
    sums = np.zeros((rows + 1, cols + 1), dtype=np.int64)
    sums[1:, 1:] = pixels.cumsum(0, dtype=np.int64).cumsum(1)
    y, x = np.arange(8) * rows // 8, np.arange(8) * cols // 8
    y1, x1 = np.maximum(np.arange(1, 9) * rows // 8, y + 1), np.maximum(np.arange(1, 9) * cols // 8, x + 1)
    cells = (sums[np.ix_(y1, x1)] - sums[np.ix_(y, x1)] - sums[np.ix_(y1, x)] + sums[np.ix_(y, x)]) / np.outer(y1 - y, x1 - x)
    return int.from_bytes(np.packbits(cells > cells.mean()).tobytes(), "big")


def read_files(files: list[bytes]) -> list[tuple[Frame, np.ndarray]]:
    """Frame and coefficients of each file; files with the same tables are decoded together."""
    alike = defaultdict(list)
    frames = [parse_markers(f) for f in files]
    for k, f in enumerate(frames):
        alike[f.parts, f.interval].append(k)
    out: list = [None] * len(files)
    for who in alike.values():
        found = decode_scans(frames[who[0]], [files[k][frames[k].scan :] for k in who], [frames[k].mcus[0] * frames[k].mcus[1] for k in who])
        for k, c in zip(who, found, strict=True):
            out[k] = frames[k], c
    return out


def payload_of(frame: Frame, coefficients: np.ndarray) -> bytes:
    """The bytes that encode_files stored."""
    v = coefficients.ravel()[: frame.payload]
    return np.where(v > 0, v, v + 255).astype(np.uint8).tobytes()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in spans(batch):
            n = np.diff(offsets)
            sizes = np.maximum(-(-n // UNIT), 1) * UNIT
            payloads = np.full(int(sizes.sum()), 32, dtype=np.uint8)
            payloads[np.arange(len(data)) + np.repeat(np.cumsum(sizes) - sizes - offsets[:-1], n)] = data
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64())[lo:hi], pa.array(n, pa.int64()), pa.array(encode_files(payloads, sizes), pa.binary())], ["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = batch.column("media").to_pylist()
        ends = np.concatenate([[0], np.cumsum([len(f) for f in files])])
        for lo, hi in slices(ends):
            rows = []
            for f, (frame, coefficients) in zip(files[lo:hi], read_files(files[lo:hi]), strict=True):
                payload = payload_of(frame, coefficients)
                small = thumbnail(frame, coefficients)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(f), hashlib.sha256(f).hexdigest(), f"{frame.width}x{frame.height}:{average_hash(small):016x}", frame.width, frame.height))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("n_bytes")[lo:hi], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [c.split()[0] for c in FEATURE_SCHEMA.split(", ")])


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a baseline JPEG file."""
    return docs.select("doc_id", "text").mapInArrow(_store, MEDIA_SCHEMA)


def media_features(media: DataFrame) -> DataFrame:
    """Payload digests, file digests, image size and thumbnail hash, all from the stored files."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, FEATURE_SCHEMA)
