"""Baseline JPEG: marker parsing, Huffman decoding, DC-only luminance thumbnails.

The decoder reads any baseline (SOF0) stream of one scan.  Restart intervals are decoded in
lockstep, one lane each, so a batch of files costs a fixed number of numpy steps; streams
with few restart markers are decoded by a plain loop instead.

The encoder stores payload bytes as quantized coefficients, 64 to a block: the DC
coefficient is the first byte minus 128, an AC coefficient is a byte plus 1 (so none is 0).
Every block is a restart interval, and code lengths are chosen so that code and extra bits
of a coefficient take 11 bits together.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, short_batches

BITS = 11
#: Code length by symbol, chosen as BITS minus the number of extra bits.
DC_LENGTHS = {size: BITS - size for size in range(9)}
AC_LENGTHS = {size: BITS - size for size in range(10)} | {0xF0: 12}
#: Lanes from which on lockstep decoding beats the plain loop.
LANES = 24


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length): codes in order of length, then symbol."""
    out, code, last = {}, 0, 0
    for length, symbol in sorted((n, s) for s, n in lengths.items()):
        code <<= length - last
        out[symbol] = code, length
        code, last = code + 1, length
    return out


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    counts = [sum(n == i for n in lengths.values()) for i in range(1, 17)]
    symbols = bytes(s for _, s in sorted((n, s) for s, n in lengths.items()))
    return struct.pack(">BBHB", 0xFF, 0xC4, 19 + len(symbols), kind) + bytes(counts) + symbols


@lru_cache(maxsize=1)
def _words() -> tuple[np.ndarray, np.ndarray, bytes]:
    """The 11-bit words of each byte as DC and as AC coefficient, and a block that holds nothing."""
    dc, ac = canonical(DC_LENGTHS), canonical(AC_LENGTHS)

    def word(codes: dict[int, tuple[int, int]], value: int) -> int:
        size = abs(value).bit_length()
        return codes[size][0] << size | (value if value >= 0 else value + (1 << size) - 1)

    empty = dc[0][0] << 13 | ac[0][0] << 2 | 3
    return np.array([word(dc, b - 128) for b in range(256)], np.uint64), np.array([word(ac, b + 1) for b in range(256)], np.uint64), empty.to_bytes(3, "big")


@lru_cache(maxsize=1)
def _tables() -> bytes:
    return struct.pack(">BBHB", 0xFF, 0xDB, 67, 0) + bytes([8] + [1] * 63) + _dht(0x00, DC_LENGTHS) + _dht(0x10, AC_LENGTHS) + struct.pack(">BBHH", 0xFF, 0xDD, 4, 1)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """One grey JPEG per payload; a payload's length is a positive multiple of 64."""
    dc, ac, empty = _words()
    assert 0xFF not in empty
    counts = np.array([len(p) // 64 for p in payloads])
    blocks = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 64)
    word = ac[blocks]
    word[:, 0] = dc[blocks[:, 0]]
    w = word.reshape(-1, 8).T
    u = np.uint64
    high = w[0] << u(53) | w[1] << u(42) | w[2] << u(31) | w[3] << u(20) | w[4] << u(9) | w[5] >> u(2)
    low = (w[5] & u(3)) << u(22) | w[6] << u(11) | w[7]
    packed = np.empty((len(high), 11), np.uint8)
    packed[:, :8] = high.astype(">u8").view(np.uint8).reshape(-1, 8)
    packed[:, 8:] = low.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]
    coded = np.empty((len(blocks), 8 * BITS + 2), np.uint8)
    coded[:, :-2] = packed.reshape(-1, 8 * BITS)
    first = np.cumsum(counts) - counts
    coded[:, -2] = 0xFF
    coded[:, -1] = 0xD0 + (np.arange(len(blocks)) - np.repeat(first, counts)) % 8
    step = 1 + (coded == 0xFF)
    step[:, -2] = 1
    place = np.cumsum(step.ravel())
    at = np.concatenate([[0], place[coded.shape[1] - 1 :: coded.shape[1]]])
    stuffed = np.zeros(at[-1], np.uint8)
    stuffed[place - step.ravel()] = coded.ravel()
    out = []
    for k, payload in enumerate(payloads):
        n = int(counts[k])
        wide = int(np.ceil(np.sqrt(n)))
        high_ = -(-n // wide)
        note = b"payload %d" % len(payload)
        head = b"\xff\xd8" + struct.pack(">BBH", 0xFF, 0xE0, 16) + b"JFIF\0\1\1\0\0\1\0\1\0\0" + struct.pack(">BBH", 0xFF, 0xFE, 2 + len(note)) + note
        frame = struct.pack(">BBHBHHBBBB", 0xFF, 0xC0, 11, 8, 8 * high_, 8 * wide, 1, 1, 0x11, 0)
        scan = struct.pack(">BBHBBBBBB", 0xFF, 0xDA, 8, 1, 1, 0, 0, 63, 0)
        body = stuffed[at[first[k]] : at[first[k] + n] - 2].tobytes()
        rest = b"".join(bytes([0xFF, 0xD0 + (i - 1) % 8]) + empty for i in range(n, wide * high_))
        out.append(head + _tables() + frame + scan + body + rest + b"\xff\xd9")
    return out


@dataclass
class Image:
    width: int = 0
    height: int = 0
    #: (component id, horizontal and vertical sampling, quantization table)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)
    quant: dict[int, tuple[int, ...]] = field(default_factory=dict)
    codes: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    interval: int = 0
    note: bytes = b""
    #: Of the scan: (component's index, DC table, AC table), and where its data begin.
    scan: list[tuple[int, int, int]] = field(default_factory=list)
    data: int = 0

    @property
    def blocks(self) -> list[int]:
        """The component of each block of an MCU."""
        if len(self.scan) == 1:
            return [0]
        return [i for i, (part, _, _) in enumerate(self.scan) for _ in range(self.parts[part][1] * self.parts[part][2])]

    @property
    def grid(self) -> tuple[int, int]:
        """MCUs down and across."""
        across, down = (1, 1) if len(self.scan) == 1 else (max(p[1] for p in self.parts), max(p[2] for p in self.parts))
        return -(-self.height // (8 * down)), -(-self.width // (8 * across))

    @property
    def kind(self) -> tuple:
        """Images of one kind can be decoded together."""
        return tuple(self.blocks), tuple((self.codes[d], self.codes[16 + a]) for _, d, a in self.scan)


def parse(data: bytes) -> Image:
    """Read the markers up to the scan; ValueError for what isn't a baseline JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    image, at = Image(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 1 + 64 * (1 + wide)
                image.quant[body[0] & 15] = struct.unpack(">64H" if wide else ">64B", body[1:n])
                body = body[n:]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                image.codes[body[0]] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif mark == 0xC0:
            image.height, image.width, n = struct.unpack(">xHHB", body[:6])
            image.parts = [(c, hv >> 4, hv & 15, q) for c, hv, q in zip(*[iter(body[6 : 6 + 3 * n])] * 3, strict=True)]
        elif mark == 0xDD:
            image.interval = int.from_bytes(body, "big")
        elif mark == 0xFE:
            image.note = body
        elif mark == 0xDA:
            at_part = {p[0]: i for i, p in enumerate(image.parts)}
            image.scan = [(at_part[c], t >> 4, t & 15) for c, t in zip(*[iter(body[1 : 1 + 2 * body[0]])] * 2, strict=True)]
            image.data = at
            if not image.width or not image.height:
                raise ValueError("no frame")
            return image
        elif 0xC1 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("not baseline")
    raise ValueError("no scan")


@lru_cache(maxsize=64)
def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length << 8 | symbol; 0 where no code begins."""
    table, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
            code += 1
        at, code = at + n, code << 1
    return table


def _extend(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return value - np.where((value << 1) >> size == 0, (1 << size) - 1, 0)


def segments(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entropy-coded data without stuffing: the bytes, each segment's start, and its scan's number."""
    data = np.frombuffer(b"".join(scans) + b"\0", np.uint8)
    mark = np.flatnonzero(data[:-1] == 0xFF)
    after = data[mark + 1]
    drop = np.zeros(len(data), bool)
    drop[mark[after == 0] + 1] = True
    restart = mark[(after >= 0xD0) & (after <= 0xD7)]
    drop[restart] = drop[restart + 1] = True
    left = np.cumsum(~drop) - ~drop
    begin = np.cumsum([0, *map(len, scans)])[:-1]
    start = np.sort(np.concatenate([begin, restart + 2]))
    return data[~drop], left[np.minimum(start, len(data) - 1)], np.searchsorted(begin, start, side="right") - 1


def _end_of_scan(data: bytes, at: int) -> int:
    """Where the next marker that is neither stuffing nor a restart lies (normally EOI, at the end)."""
    if data[-2:] == b"\xff\xd9":
        view = np.frombuffer(data, np.uint8, offset=at)
        mark = np.flatnonzero(view[:-1] == 0xFF)
        after = view[mark + 1]
        stop = mark[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
        return at + int(stop[0])
    raise ValueError("cut off")


def _lockstep(data: np.ndarray, start: np.ndarray, mcus: np.ndarray, image: Image) -> np.ndarray:
    """Coefficients [lane, MCU of the lane, block, 64], undone prediction included."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
    window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    last = len(window) - 1
    bit = start * 8
    out = np.zeros((len(start), int(mcus.max()), len(image.blocks), 64), np.int32)
    before = np.zeros((len(start), len(image.scan)), np.int64)
    tables = [(lookup(*image.codes[d]), lookup(*image.codes[16 + a])) for _, d, a in image.scan]

    def symbol(table: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = table[window[np.minimum(at >> 3, last)] >> (16 - (at & 7)) & 0xFFFF]
        return found & 0xFF, at + (found >> 8)

    def extra(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return window[np.minimum(at >> 3, last)] >> (32 - (at & 7) - size) & ((1 << size) - 1)

    for mcu in range(out.shape[1]):
        lanes = np.flatnonzero(mcus > mcu)
        for k, part in enumerate(image.blocks):
            dc, ac = tables[part]
            at = bit[lanes]
            size, at = symbol(dc, at)
            before[lanes, part] += _extend(extra(at, size), size)
            out[lanes, mcu, k, 0] = before[lanes, part]
            at = at + size
            live, place = np.arange(len(lanes)), np.ones(len(lanes), np.int64)
            own = out[:, mcu, k]
            while len(live):
                whole = len(live) == len(lanes)
                here, now = (at, place) if whole else (at[live], place[live])
                sign, here = symbol(ac, here)
                size, run = sign & 15, sign >> 4
                value = _extend(extra(here, size), size)
                now = now + run
                end = sign == 0
                good = (size > 0) & (now < 64)
                if good.all():
                    own[lanes if whole else lanes[live], now] = value
                else:
                    own[(lanes if whole else lanes[live])[good], now[good]] = value[good]
                here, now = here + size, np.where(end, 64, now + 1)
                if whole:
                    at, place = here, now
                else:
                    at[live], place[live] = here, now
                on = now < 64
                if not on.all():
                    live = live[on]
            bit[lanes] = at
    return out


def _plain(data: np.ndarray, start: int, mcus: int, image: Image) -> np.ndarray:
    """The same for one lane, symbol by symbol."""
    raw = data.tobytes() + bytes(8)
    out = np.zeros((mcus, len(image.blocks), 64), np.int32)
    before, bit = [0] * len(image.scan), int(start) * 8
    tables = [(lookup(*image.codes[d]), lookup(*image.codes[16 + a])) for _, d, a in image.scan]

    def peek(at: int, n: int) -> int:
        return int.from_bytes(raw[at >> 3 : (at >> 3) + 5], "big") >> (40 - (at & 7) - n) & ((1 << n) - 1)

    def value(at: int, size: int) -> int:
        v = peek(at, size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    for mcu in range(mcus):
        for k, part in enumerate(image.blocks):
            dc, ac = tables[part]
            found = int(dc[peek(bit, 16)])
            bit += found >> 8
            before[part] += value(bit, found & 0xFF)
            out[mcu, k, 0] = before[part]
            bit += found & 0xFF
            place = 1
            while place < 64:
                found = int(ac[peek(bit, 16)])
                bit += found >> 8
                size = found & 15
                if not found & 0xFF:
                    break
                place += found >> 4 & 15
                if size and place < 64:
                    out[mcu, k, place] = value(bit, size)
                bit += size
                place += 1
            if bit > 8 * len(raw):
                raise ValueError("cut off")
    return out


def decode(files: list[bytes]) -> list[tuple[Image, np.ndarray]]:
    """(image, coefficients [MCU, block, 64 in zigzag order]) of each file."""
    images = [parse(f) for f in files]
    groups = defaultdict(list)
    for i, image in enumerate(images):
        groups[image.kind].append(i)
    out: list[tuple[Image, np.ndarray]] = [None] * len(files)  # type: ignore[list-item]
    for members in groups.values():
        data, start, of = segments([files[i][images[i].data : _end_of_scan(files[i], images[i].data)] for i in members])
        first = np.searchsorted(of, np.arange(len(members) + 1))
        mcus = np.zeros(len(start), np.int64)
        for k, i in enumerate(members):
            total, rest = images[i].grid[0] * images[i].grid[1], images[i].interval
            n = first[k + 1] - first[k]
            mcus[first[k] : first[k + 1]] = np.clip(total - np.arange(n) * rest, 0, rest) if rest else np.where(np.arange(n) == 0, total, 0)
        if len(start) >= LANES and mcus.max() <= 64:
            found = _lockstep(data, start, mcus, images[members[0]])
            for k, i in enumerate(members):
                own = found[first[k] : first[k + 1]]
                out[i] = images[i], own.reshape(-1, *own.shape[2:])[np.arange(own.shape[1])[None].repeat(len(own), 0).ravel() < mcus[first[k] : first[k + 1]].repeat(own.shape[1])]
        else:
            for k, i in enumerate(members):
                out[i] = images[i], np.concatenate([_plain(data, start[j], int(mcus[j]), images[i]) for j in range(first[k], first[k + 1])])
    return out


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """Luminance from the DC coefficients alone: one pixel for each 8 x 8 block of the first component."""
    down, across = image.grid
    part = image.parts[image.scan[0][0]]
    wide, high = (1, 1) if len(image.scan) == 1 else part[1:3]
    dc = coefficients[: down * across, : wide * high, 0].reshape(down, across, high, wide).transpose(0, 2, 1, 3).reshape(down * high, across * wide)
    pixels = np.clip((dc * image.quant[part[3]][0] + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return pixels[: -(-image.height // 8), : -(-image.width // 8)]


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 mean of the thumbnail are above their mean."""
    sums = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    sums[1:, 1:] = pixels.cumsum(0, dtype=np.int64).cumsum(1)
    edge = [np.arange(8) * n // 8 for n in pixels.shape]
    stop = [np.maximum((np.arange(8) + 1) * n // 8, e + 1) for n, e in zip(pixels.shape, edge, strict=True)]
    (a, b), (c, d) = (edge[0][:, None], stop[0][:, None]), (edge[1][None], stop[1][None])
    cell = (sums[b, d] - sums[a, d] - sums[b, c] + sums[a, c]) / ((b - a) * (d - c))
    return f"{int.from_bytes(np.packbits(cell > cell.mean()).tobytes(), 'big'):016x}"


def read_payload(image: Image, coefficients: np.ndarray) -> bytes:
    """The bytes that encode_payloads stored."""
    size = int(image.note.split()[1])
    flat = coefficients.reshape(-1, 64)[: size // 64]
    out = (flat - 1).astype(np.uint8)
    out[:, 0] = flat[:, 0] + 128
    return out.tobytes()


def image_features(df: DataFrame, id_col: str, image_col: str) -> DataFrame:
    """Dimensions, thumbnail and thumbnail hash of a binary column of JPEG files.

    Returns doc_id, width, height, thumb_hash, thumbnail (rows of grey bytes), error.  A null,
    empty, damaged or non-baseline file gives nulls and says why in error; rows are never lost.
    """
    short_batches(df.sparkSession)

    def one(data: bytes | None) -> tuple:
        try:
            image, found = decode([data or b""])[0]
            pixels = thumbnail(image, found)
            return image.width, image.height, thumbnail_hash(pixels), pixels.tobytes(), None
        except (ValueError, IndexError, KeyError, struct.error) as error:
            return None, None, None, None, str(error) or type(error).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string())
        for batch in batches:
            rows = [one(x) for x in batch["image"].to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "width", "height", "thumb_hash", "thumbnail", "error"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(image_col).alias("image"))
    return rows.mapInArrow(run, "doc_id long, width int, height int, thumb_hash string, thumbnail binary, error string")


#: Bytes of payload that are coded and decoded at a time; bounds a task's memory.
AT_ONCE = 1 << 20


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Store each whole text in a JPEG, read it back and compute features from the stored bytes.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature ("width x height:thumbnail hash"), width, height and, unless
    with_media is false, media (the file).  Null and empty texts store one block of zeros;
    equal texts give equal values; every row gives one row; an empty table gives none.
    """
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode() for t in batch["text"].to_pylist()]
            rows, at = [], 0
            while at < len(raw):
                end, size = at, 0
                while end < len(raw) and (end == at or size + len(raw[end]) <= AT_ONCE):
                    size, end = size + len(raw[end]) + 64, end + 1
                media = encode_payloads([t + bytes(-len(t) % 64 if t else 64) for t in raw[at:end]])
                for text, file, (image, found) in zip(raw[at:end], media, decode(media), strict=True):
                    payload = read_payload(image, found)
                    feature = f"{image.width}x{image.height}:{thumbnail_hash(thumbnail(image, found))}"
                    rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature, image.width, image.height, file if with_media else None))
                at = end
            kinds = (*[pa.int64()] * 2, pa.string(), *[pa.int64()] * 2, *[pa.string()] * 2, *[pa.int32()] * 2, pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *NAMES, "media"])

    out = id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, media binary")
    return out if with_media else out.drop("media")


NAMES = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
