"""Progressive JPEG media columns.

``store`` keeps each document's bytes losslessly as the quantised DCT coefficients
of a three-component progressive JPEG (4:2:0): 64 payload bytes are the 64
coefficients of one block. ``load`` reads a stored JPEG back: it accumulates the
scans, by spectral selection and successive approximation, into coefficient
arrays, returns the payload that the coefficients hold, applies the inverse
transform in numpy, upsamples chroma and gives the full-resolution RGB tensor.
``read_jpeg`` takes other progressive Huffman-coded JPEGs of 8-bit samples as well.

The writer's Huffman codes have the length that makes each code and its extra bits
span a constant width, and no coefficient is zero, so such scans are read at a
constant stride with numpy; scans of any other kind are read symbol by symbol.

Null texts are empty; an empty text is one block of zero bytes. Equal texts give
equal media bytes.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, portions, raw_texts

#: Coefficient order of the format, as row-major positions in a block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Media bytes that a task reads at a time, unless one document has more.
PORTION = 1 << 20
_MADE = ("payload", "height", "width", "feature", "rgb")
SAMPLING = ((2, 2), (1, 1), (1, 1))
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_COMMENT = b"payload:"


def _basis() -> np.ndarray:
    """64 x 64: coefficients in zigzag order times this are the samples of a block."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.where(k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


BASIS = _basis()


class Huffman:
    """A code given as the format gives it: how many codes of each length, and the symbols in order."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.counts, self.symbols = bytes(counts), bytes(symbols)
        self.codes: dict[tuple[int, int], int] = {}
        code = at = 0
        for length, n in enumerate(self.counts, 1):
            for _ in range(n):
                self.codes[length, code] = self.symbols[at]
                code, at = code + 1, at + 1
            code <<= 1

    def segment(self, place: int) -> bytes:
        return bytes([place]) + self.counts + self.symbols

    @lru_cache(maxsize=8)  # noqa: B019
    def strides(self) -> tuple[int, np.ndarray] | None:
        """The width that every code and its extra bits have in common, and the value of each such bit string."""
        widths = {length + symbol % 16 for (length, _), symbol in self.codes.items()}
        if len(widths) != 1 or any(s > 15 for s in self.symbols):
            return None
        width = widths.pop()
        values = np.full(1 << width, np.iinfo(np.int32).min, np.int32)
        for (length, code), size in self.codes.items():
            extra = np.arange(1 << size)
            values[(code << size) + extra] = np.where(extra >> max(size - 1, 0), extra, extra - (1 << size) + 1) if size else 0
        return width, values


def _ladder(sizes: range, width: int) -> Huffman:
    """Codes for the sizes whose length and extra bits sum to ``width``."""
    counts = [0] * 16
    for s in sizes:
        counts[width - s - 1] += 1
    return Huffman(bytes(counts), bytes(sorted(sizes, reverse=True)))


DC_CODE, AC_CODE = _ladder(range(9), 9), _ladder(range(1, 8), 8)
REFINE_CODE = Huffman(bytes([1] + [0] * 15), b"\0")


def _inverse(code: Huffman) -> tuple[int, np.ndarray]:
    """For each value from -256 its bit string."""
    width, values = code.strides()
    out = np.zeros(513, np.uint16)
    seen = np.flatnonzero(values > np.iinfo(np.int32).min)
    out[values[seen] + 256] = seen
    return width, out


@lru_cache(maxsize=4096)
def _geometry(mcus: int) -> tuple[int, int, list[np.ndarray], np.ndarray]:
    """Columns and rows of MCUs, and the interleaved order of blocks (index into all components' blocks)."""
    across = int(np.ceil(np.sqrt(mcus)))
    down = -(-mcus // across)
    return across, down, *_orders(across, down, SAMPLING)


@lru_cache(maxsize=256)
def _orders(across: int, down: int, sampling: tuple) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Each component's blocks across and down, and the order in which an interleaved scan visits all blocks."""
    grids, parts, base = [], [], 0
    for h, v in sampling:
        own = base + np.arange(across * h * down * v).reshape(down, v, across, h)
        parts.append(own.transpose(0, 2, 1, 3).reshape(across * down, v * h))
        grids.append((across * h, down * v))
        base += own.size
    return grids, np.concatenate(parts, axis=1).ravel()


def _pack(bits: np.ndarray) -> bytes:
    """Bits as bytes, the rest of the last one filled with ones, 0xFF marked as data."""
    short = -bits.size % 8
    if short:
        bits = np.concatenate([bits.ravel(), np.ones(short, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(components: list[int], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(components), *(x for c in components for x in (c + 1, 0x00)), first, last, high << 4 | low])
    return _segment(0xDA, head) + data


_VALUE = np.where(np.arange(256) >= 128, np.arange(256) - 126, np.arange(256) - 129).astype(np.int16)
_DC_WIDTH, _DC_BITS = _inverse(DC_CODE)
_AC_BYTE = _inverse(AC_CODE)[1].astype(np.uint8)
#: The first scan's byte for each payload byte, and the bit that refines it.
_FIRST = _AC_BYTE[np.sign(_VALUE) * (np.abs(_VALUE) >> 1) + 256]
_REFINE = (np.abs(_VALUE) & 1).astype(np.uint8)
_TABLES = _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC4, DC_CODE.segment(0x00))


def write_jpeg(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload, of a positive multiple of 64 bytes."""
    blocks = len(payload) // 64
    across, down, grids, order = _geometry(-(-blocks // 6))
    data = np.zeros((len(order), 64), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    ends = np.cumsum([w * h for w, h in grids])
    spans = [slice(e - w * h, e) for (w, h), e in zip(grids, ends, strict=True)]
    dc = _VALUE[data[:, 0]].astype(np.int32)
    steps = np.empty(len(order), np.int32)
    for s, (h, v) in zip(spans, SAMPLING, strict=True):  # differences follow the order in which the scan visits a component
        visit = order.reshape(-1, 6)
        own = visit[(visit >= s.start) & (visit < s.stop)]
        steps[own] = np.diff(dc[own] >> 1, prepend=0)
    bits = (_DC_BITS[steps[order] + 256][:, None] >> np.arange(_DC_WIDTH - 1, -1, -1)) & 1
    first, refine = _FIRST[data], _REFINE[data]
    refine[:, 0] = 0  # the code that ends a block's band, before the block's correction bits
    out = [b"\xff\xd8", _segment(0xFE, _COMMENT + struct.pack(">Q", len(payload))), _TABLES]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_scan([0, 1, 2], 0, 0, 0, 1, _pack(bits.astype(np.uint8))))
    out.append(_segment(0xC4, AC_CODE.segment(0x10)))
    for c, s in enumerate(spans):
        for low, high in ((1, 5), (6, 63)) if c == 0 else ((1, 63),):
            out.append(_scan([c], low, high, 0, 1, first[s, low : high + 1].tobytes()))
    out.append(_segment(0xC4, REFINE_CODE.segment(0x10)))
    for c, s in enumerate(spans):
        out.append(_scan([c], 1, 63, 1, 0, _pack(refine[s])))
    out += [_scan([0, 1, 2], 0, 0, 1, 0, _pack((dc[order] & 1).astype(np.uint8))), b"\xff\xd9"]
    return b"".join(out)


class _Bits:
    """The bits of a scan's data, one restart interval at a time."""

    def __init__(self, data: bytes):
        self.parts = [p.replace(b"\xff\0", b"\xff") for p in re.split(rb"\xff[\xd0-\xd7]", data)]
        self.restart()

    def restart(self) -> None:
        self.data, self.at = (self.parts.pop(0) if self.parts else b""), 0

    def bit(self) -> int:
        byte = self.at >> 3
        value = self.data[byte] >> (7 - (self.at & 7)) & 1 if byte < len(self.data) else 1
        self.at += 1
        return value

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.bit()
        return value

    def symbol(self, code: Huffman) -> int:
        value = 0
        for length in range(1, 17):
            value = value << 1 | self.bit()
            if (length, value) in code.codes:
                return code.codes[length, value]
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _read_dc(c: np.ndarray, order: np.ndarray, owner: np.ndarray, codes: list[Huffman], data: bytes, high: int, low: int, interval: int, per_mcu: int) -> None:
    if high:
        if not interval:
            got = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8))[: len(order)]
            c[order, 0] |= got.astype(np.int32) << low
            return
        bits = _Bits(data)
        for i, block in enumerate(order):
            if i and i % (interval * per_mcu) == 0:
                bits.restart()
            c[block, 0] |= bits.bit() << low
        return
    same = codes[0].strides() if not interval and all(x is codes[0] for x in codes) else None
    if same:
        width, values = same
        got = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8))[: len(order) * width].reshape(-1, width)
        steps = values[got @ (1 << np.arange(width - 1, -1, -1))]
        for k in range(int(owner.max()) + 1):
            mine = order[owner == k]
            c[mine, 0] = np.cumsum(steps[owner == k]) << low
        return
    bits, last = _Bits(data), [0] * len(codes)
    for i, (block, k) in enumerate(zip(order.tolist(), owner.tolist(), strict=True)):
        if interval and i and i % (interval * per_mcu) == 0:
            bits.restart()
            last = [0] * len(codes)
        last[k] += bits.signed(bits.symbol(codes[k]))
        c[block, 0] = last[k] << low


def _read_ac(c: np.ndarray, code: Huffman, data: bytes, first: int, last: int, high: int, low: int, interval: int) -> None:
    """One component's band; ``c`` holds its blocks in the order of the scan."""
    n, span = len(c), last - first + 1
    if not interval and not high and (same := code.strides()) and 0 not in code.symbols:
        width, values = same
        raw = np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8)
        words = raw[: n * span] if width == 8 else np.unpackbits(raw)[: n * span * width].reshape(-1, width) @ (1 << np.arange(width - 1, -1, -1))
        c[:, first : last + 1] = (values[words] << low).reshape(n, span)
        return
    if high and not interval and code.symbols == b"\0" and len(code.codes) == 1 and (c[:, first : last + 1] != 0).all():
        got = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8))[: n * (span + 1)].reshape(n, span + 1)[:, 1:]
        band = c[:, first : last + 1]
        band += np.where(band > 0, 1, -1) * (got.astype(np.int32) << low)
        return
    bits, run = _Bits(data), 0
    for i, block in enumerate(c):
        if interval and i and i % interval == 0:
            bits.restart()
            run = 0
        at = first
        while at <= last and not run:
            r, s = divmod(bits.symbol(code), 16)
            if not s and r < 15:
                run = (1 << r) + bits.take(r)
                break
            if not high:
                at += r
                if s:
                    block[at] = bits.signed(s) << low
                at += 1
                continue
            new = (1 if bits.bit() else -1) << low if s else 0
            while at <= last:  # passes r zeros; those not zero take a correction bit each
                if block[at]:
                    if bits.bit():
                        block[at] += (1 << low) * np.sign(block[at])
                elif r == 0:
                    block[at] = new
                    at += 1
                    break
                else:
                    r -= 1
                at += 1
        if run:
            if high:
                for k in range(at, last + 1):
                    if block[k] and bits.bit():
                        block[k] += (1 << low) * np.sign(block[k])
            run -= 1


class Picture:
    """Coefficients of each component's blocks in zigzag order, with what it takes to show them."""

    def __init__(self):
        self.width = self.height = 0
        self.sampling: list[tuple[int, int]] = []
        self.quant: list[np.ndarray] = []
        self.grids: list[tuple[int, int]] = []
        self.coefficients = np.zeros((0, 64), np.int32)
        self.payload_bytes: int | None = None

    def parts(self) -> list[np.ndarray]:
        ends = np.cumsum([w * h for w, h in self.grids])
        return np.split(self.coefficients, ends[:-1])

    def rgb(self) -> np.ndarray:
        """The full-resolution tensor: height x width x 3, unsigned bytes."""
        most = max(h for h, _ in self.sampling), max(v for _, v in self.sampling)
        planes = []
        for own, (w, h), q, (sh, sv) in zip(self.parts(), self.grids, self.quant, self.sampling, strict=True):
            samples = (own * q).astype(np.float32) @ BASIS
            plane = samples.reshape(h, w, 8, 8).transpose(0, 2, 1, 3).reshape(h * 8, w * 8)
            if (sh, sv) != most:
                plane = plane.repeat(most[1] // sv, axis=0).repeat(most[0] // sh, axis=1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            planes *= 3
            out = np.stack([planes[0] + 128] * 3, axis=-1)
        else:
            y, cb, cr = planes
            y = np.clip(y + 128, 0, 255)
            cb, cr = np.clip(cb, -128, 127), np.clip(cr, -128, 127)
            out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
        return np.clip(np.rint(out), 0, 255).astype(np.uint8)


@lru_cache(maxsize=64)
def _huffman(counts: bytes, symbols: bytes) -> Huffman:
    return Huffman(counts, symbols)


def read_jpeg(data: bytes) -> Picture:
    """Accumulates the scans of a progressive JPEG."""
    out, at, tables, quant, interval = Picture(), 2, {}, {}, 0
    ids: list[int] = []
    wants: list[int] = []
    order = np.zeros(0, int)
    bases: list[int] = []
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE and body.startswith(_COMMENT):
            (out.payload_bytes,) = struct.unpack(">Q", body[len(_COMMENT) :])
        elif marker == 0xDB:
            while body:
                wide, place = divmod(body[0], 16)
                n = 128 if wide else 64
                quant[place] = np.frombuffer(body[1 : n + 1], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[n + 1 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xC2:
            precision, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("samples of 8 bits are expected")
            ids = [body[6 + 3 * k] for k in range(n)]
            out.sampling = [divmod(body[7 + 3 * k], 16) for k in range(n)]
            wants = [body[8 + 3 * k] for k in range(n)]
            across = -(-out.width // (8 * max(h for h, _ in out.sampling)))
            down = -(-out.height // (8 * max(v for _, v in out.sampling)))
            out.grids, order = _orders(across, down, tuple(out.sampling))
            bases = [0, *np.cumsum([w * h for w, h in out.grids]).tolist()]
            out.coefficients = np.zeros((bases[-1], 64), np.int32)
            mcu = across * down
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("a progressive JPEG with Huffman codes is expected")
        elif marker == 0xDA:
            n = body[0]
            chosen = [ids.index(body[1 + 2 * k]) for k in range(n)]
            places = [body[2 + 2 * k] for k in range(n)]
            first, last, (high, low) = body[1 + 2 * n], body[2 + 2 * n], divmod(body[3 + 2 * n], 16)
            end = m.start() if (m := _MARKER.search(data, at)) else len(data)
            scan, at = data[at:end], end
            c = out.coefficients
            if first == 0:
                if n == 1:
                    seen, kind, per = _alone(out, chosen[0], bases), None, 1
                    kind = np.zeros(len(seen), int)
                else:
                    owners = np.searchsorted(bases, order, side="right") - 1
                    pick = np.isin(owners, chosen) if n < len(ids) else slice(None)
                    seen, kind = order[pick], owners[pick]
                    kind = np.searchsorted(chosen, kind) if n < len(ids) else kind
                    per = len(seen) // mcu
                _read_dc(c, seen, kind, [tables.get(p >> 4, REFINE_CODE) for p in places], scan, high, low, interval, per)
            else:
                k = chosen[0]
                seen = _alone(out, k, bases)
                whole = len(seen) == bases[k + 1] - bases[k]
                band = c[bases[k] : bases[k + 1]] if whole else c[seen]
                _read_ac(band, tables[0x10 | places[0] & 15], scan, first, last, high, low, interval)
                if not whole:
                    c[seen] = band
    out.quant = [quant[w] for w in wants]
    return out


def _alone(p: Picture, k: int, bases: list[int]) -> np.ndarray:
    """The blocks that a scan of one component has: those the picture covers, without the rest of its last MCUs."""
    (w, _), (h, v) = p.grids[k], p.sampling[k]
    most = max(x for x, _ in p.sampling), max(x for _, x in p.sampling)
    across, down = -(-(-(-p.width * h // most[0])) // 8), -(-(-(-p.height * v // most[1])) // 8)
    return (bases[k] + np.arange(down)[:, None] * w + np.arange(across)).ravel()


_BYTE = np.zeros(513, np.uint8)
_BYTE[_VALUE + 256] = np.arange(256)


def payload_of(picture: Picture) -> bytes:
    """The payload that ``write_jpeg`` stored."""
    return _BYTE[picture.coefficients + 256].tobytes()[: picture.payload_bytes]


def pad(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 if text else 64)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as a progressive JPEG, ready to be written as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 256, "text"):
            texts = raw_texts(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_jpeg(pad(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def load(stored: DataFrame, tensors: bool = True) -> DataFrame:
    """``stored`` with payload, height, width, feature (size, mean of R, G and B, checksum of the tensor) and, if asked for, the tensor rgb.

    rgb has height x width x 3 unsigned bytes, row by row. Columns of these names that ``stored`` has are replaced. Rows are taken
    in portions whose media fit into ``PORTION`` bytes, so a task holds few tensors at a time.
    """
    stored = stored.drop(*_MADE)
    extra = "payload binary, height int, width int, feature string" + ", rgb binary" * tensors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 64, "media", PORTION):
            got: dict[str, list] = {"payload": [], "height": [], "width": [], "feature": [], "rgb": []}
            for media in batch.column(batch.schema.get_field_index("media")).to_pylist():
                picture = read_jpeg(media)
                rgb = picture.rgb()
                got["payload"].append(payload_of(picture))
                got["height"].append(picture.height)
                got["width"].append(picture.width)
                means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (picture.height * picture.width)
                tensor = rgb.tobytes()
                got["feature"].append(f"{picture.width}x{picture.height}:" + ",".join(f"{m:.3f}" for m in means) + f":{zlib.crc32(tensor):08x}")
                if tensors:
                    got["rgb"].append(tensor)
            kinds = {"payload": pa.binary(), "height": pa.int32(), "width": pa.int32(), "feature": pa.string()} | ({"rgb": pa.binary()} if tensors else {})
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[k], t) for k, t in kinds.items())], names=[*batch.schema.names, *kinds])

    return stored.mapInArrow(run, f"{ddl(stored)}, {extra}")


def op8_progressive_jpeg(spark, sf_dir) -> DataFrame:
    out = load(store(spark.read.parquet(f"{sf_dir}/documents.parquet")), tensors=False)
    return out.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
