"""Media columns as progressive JPEG: texts stored in coefficients, and images read back as RGB tensors.

The format's unit is the quantised coefficient. A payload byte b is the coefficient of size 8 whose
extra bits are b, so every byte value has one and none is zero. The file is an ordinary 4:2:0
progressive JPEG: a first scan of the DC values without their lowest bit, first scans of two spectral
bands for each component, and a refinement scan for each of them with the lowest bits. As the code
lengths are chosen so that a code and its extra bits always fill the same number of bits, numpy packs
and unpacks whole scans; scans of other files are read code by code, through a table of 16-bit beginnings, to
the same coefficients.

Reading accumulates all scans into coefficient arrays. The payload is taken from them; the picture is
their inverse transform, with chroma upsampled to full resolution and turned into RGB. The query's rows carry it
as a tensor column (height, width and samples), and the picture's feature is taken from that column.

Cases: null text is empty and is a payload of padding only; rows with equal ids each get a row; an empty
table gives an empty table; columns other than the key and the text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, rows_of, settled, texts_of

UNIT = 576
BANDS = ((1, 31), (32, 63))
MOST_MCUS = 4095  # 16-pixel rows that a JPEG can hold


def zigzag() -> np.ndarray:
    """Raster position of each coefficient in zigzag order: along the anti-diagonals, turning at the edges."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = zigzag()
#: DC differences of -255..255 take 9 bits each: a size c has a code of 9 - c bits.
DC_LENGTHS = {c: 9 - c for c in range(9)}
#: AC: one bit for a coefficient of size 7, five for each end-of-band run.
AC_LENGTHS = {0x07: 1} | {r << 4: 5 for r in range(15)}


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), codes counted up in order of length."""
    codes, code, before = {}, 0, 0
    for symbol, length in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= length - before
        codes[symbol] = (code, length)
        code, before = code + 1, length
    return codes


def table_segment(kind: int, slot: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    body = bytes([kind << 4 | slot]) + bytes(sum(x == n for x in lengths.values()) for n in range(1, 17)) + bytes(order)
    return segment(0xC4, body)


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def dc_words() -> tuple[np.ndarray, np.ndarray]:
    """The 9-bit word of each difference (from -255 on), and the difference of each word."""
    codes, words, back = canonical(DC_LENGTHS), np.zeros(511, np.uint16), np.zeros(512, np.int32)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        words[d + 255] = codes[size][0] << size | (d if d > 0 else d + (1 << size) - 1)
        back[words[d + 255]] = d
    return words, back


WORDS, DIFFERENCES = dc_words()
AC_CODES = canonical(AC_LENGTHS)
NINE = np.arange(8, -1, -1, dtype=np.uint16)
HEAD = b"\xff\xd8" + segment(0xDB, b"\x00" + b"\x01" * 64)
TABLES = table_segment(0, 0, DC_LENGTHS) + table_segment(1, 0, AC_LENGTHS)


def scan_segment(components: bytes, first: int, last: int, high: int, low: int) -> bytes:
    return segment(0xDA, bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([first, last, high << 4 | low]))


def to_bytes(bits: np.ndarray) -> bytes:
    """Bits as entropy-coded data: ones fill the last byte, a zero byte follows each 255."""
    if rest := -len(bits) % 8:
        bits = np.append(bits, np.ones(rest, np.uint8))
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def runs(blocks: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Spans of blocks for end-of-band runs, and the bits that announce them."""
    for at in range(0, blocks, 32767):
        n = min(32767, blocks - at)
        r = n.bit_length() - 1
        code, length = AC_CODES[r << 4]
        yield at, n, np.array([int(b) for b in f"{code:0{length}b}" + (f"{n - (1 << r):0{r}b}" if r else "")], np.uint8)


def store_payload(payload: bytes) -> bytes:
    """A progressive JPEG that holds the payload, of a multiple of 64 bytes, in its coefficients."""
    mcus = -(-len(payload) // 384)
    across = -(-mcus // MOST_MCUS)
    down = -(-mcus // across)
    mcus = across * down
    raw = np.full((6 * mcus, 64), 255, np.uint8)
    raw.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    parts = [raw[: 4 * mcus], raw[4 * mcus : 5 * mcus], raw[5 * mcus :]]
    value = raw[:, 0].astype(np.int32) - 255 * (raw[:, 0] < 128)
    luma = value[: 4 * mcus].reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(-1)
    dc = [luma, value[4 * mcus : 5 * mcus], value[5 * mcus :]]
    words = [WORDS[np.diff(x >> 1, prepend=0) + 255] for x in dc]
    mixed = np.concatenate([words[0].reshape(mcus, 4), words[1][:, None], words[2][:, None]], axis=1).reshape(-1)
    lowest = np.concatenate([dc[0].reshape(mcus, 4), dc[1][:, None], dc[2][:, None]], axis=1).reshape(-1) & 1
    out = [HEAD, segment(0xFE, len(payload).to_bytes(8, "big"))]
    out.append(
        segment(
            0xC2,
            b"\x08" + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + b"\x03" + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00",
        )
    )
    out += [TABLES, scan_segment(b"\x01\x02\x03", 0, 0, 0, 1), to_bytes((mixed[:, None] >> NINE & 1).astype(np.uint8).reshape(-1))]
    for c, part in enumerate(parts, 1):
        for first, last in BANDS:
            out += [scan_segment(bytes([c]), first, last, 0, 1), (part[:, first : last + 1] >> 1).tobytes()]
    out += [scan_segment(b"\x01\x02\x03", 0, 0, 1, 0), to_bytes(lowest.astype(np.uint8))]
    for c, part in enumerate(parts, 1):
        low = (part & 1) ^ (part < 128)
        for first, last in BANDS:
            bits = [x for at, n, announced in runs(len(part)) for x in (announced, low[at : at + n, first : last + 1].reshape(-1))]
            out += [scan_segment(bytes([c]), first, last, 1, 0), to_bytes(np.concatenate(bits))]
    return b"".join(out) + b"\xff\xd9"


class Bits:
    """Reads entropy-coded data; after its end come ones."""

    def __init__(self, data: bytes):
        self.data, self.at = data + b"\xff" * 8, 0

    def ahead(self) -> int:
        """The next 16 bits, which are not passed."""
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 3].ljust(3, b"\xff"), "big") >> (8 - (self.at & 7)) & 0xFFFF

    def number(self, n: int) -> int:
        value = self.ahead() >> (16 - n)
        self.at += n
        return value

    def bit(self) -> int:
        return self.number(1)

    def signed(self, n: int) -> int:
        value = self.number(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1

    def symbol(self, table: HuffmanTable) -> int:
        symbol, length = table.ahead[self.ahead()]
        if not length:
            raise ValueError("no such code")
        self.at += length
        return symbol


class HuffmanTable:
    """Symbols by their codes; `ahead` has the symbol and code length of each 16 bits, of length 0 where no code fits."""

    def __init__(self, lengths: dict[int, int]):
        self.lengths, self.ahead = lengths, [(0, 0)] * (1 << 16)
        code = before = 0
        for symbol, length in lengths.items():
            code <<= length - before
            before = length
            span = 1 << (16 - length)
            self.ahead[code * span : (code + 1) * span] = [(symbol, length)] * span
            code += 1


@lru_cache(maxsize=16)
def huffman_table(symbols: bytes, counts: bytes) -> HuffmanTable:
    """The table of symbols in order of their codes, and how many codes there are of each length."""
    sizes = [n for n, count in enumerate(counts, 1) for _ in range(count)]
    return HuffmanTable(dict(zip(symbols, sizes, strict=True)))


class Component:
    def __init__(self, across: int, down: int, quant: int):
        self.across, self.down, self.quant = across, down, quant


class ProgressiveImage:
    """The coefficient arrays of a progressive JPEG, filled scan by scan."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[int, HuffmanTable] = {}
        self.comment, self.interval = b"", 0
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while data[at + 1] != 0xD9:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDA:
                end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at).start()
                self._scan(body, data[at:end])
                at = end
            else:
                self._segment(marker, body)

    def _segment(self, marker: int, body: bytes) -> None:
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                at = 17 + sum(body[1:17])
                self.tables[body[0]] = huffman_table(body[17:at], body[1:17])
                body = body[at:]
        elif marker == 0xDD:
            self.interval = int.from_bytes(body, "big")
        elif marker == 0xFE:
            self.comment = body
        elif marker == 0xC2:
            self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            found = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            self.wide, self.high = max(x[1] for x in found), max(x[2] for x in found)
            self.mcus = -(-self.width // (8 * self.wide)), -(-self.height // (8 * self.high))
            self.parts = {c: Component(h, v, q) for c, h, v, q in found}
            self.coefficients = {c: np.zeros((self.mcus[1] * v, self.mcus[0] * h, 64), np.int16) for c, h, v, _ in found}
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("only progressive Huffman JPEG is read")

    def _order(self, ids: list[int]) -> list[tuple[int, np.ndarray]]:
        """The blocks of a scan by component, as flat numbers in scan order, and for several components by MCU."""
        out = []
        for c in ids:
            p, (down, across, _) = self.parts[c], self.coefficients[c].shape
            grid = np.arange(down * across).reshape(down, across)
            if len(ids) == 1:
                real = grid[: -(-self.height * p.down // (8 * self.high)), : -(-self.width * p.across // (8 * self.wide))]
                out.append((c, real.reshape(-1, 1)))
            else:
                out.append(
                    (c, grid.reshape(self.mcus[1], p.down, self.mcus[0], p.across).transpose(0, 2, 1, 3).reshape(-1, p.down * p.across))
                )
        return out

    def _scan(self, body: bytes, coded: bytes) -> None:
        ids = [body[i] for i in range(1, 1 + 2 * body[0], 2)]
        slots = {body[i]: body[i + 1] for i in range(1, 1 + 2 * body[0], 2)}
        first, last, high, low = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
        order = self._order(ids)
        if not self.interval and self._whole_scan(order, slots, first, last, high, low, coded):
            return
        step = self.interval or len(order[0][1])
        for k, part in enumerate(re.split(rb"\xff[\xd0-\xd7]", coded)):
            bits, before, left = Bits(part.replace(b"\xff\x00", b"\xff")), dict.fromkeys(ids, 0), 0
            for mcu in range(k * step, min((k + 1) * step, len(order[0][1]))):
                for c, blocks in order:
                    for block in blocks[mcu]:
                        cells = self.coefficients[c].reshape(-1, 64)[block]
                        if first:
                            table = self.tables[0x10 | slots[c] & 15]
                            left = self._ac_first(
                                bits, cells, table, first, last, low, left
                            ) if not high else self._ac_again(bits, cells, table, first, last, low, left)
                        elif high:
                            cells[0] |= bits.bit() << low
                        else:
                            before[c] += bits.signed(bits.symbol(self.tables[slots[c] >> 4]))
                            cells[0] = before[c] << low

    @staticmethod
    def _ac_first(bits: Bits, cells: np.ndarray, table: HuffmanTable, first: int, last: int, low: int, left: int) -> int:
        if left:
            return left - 1
        k = first
        while k <= last:
            run, size = divmod(bits.symbol(table), 16)
            if size:
                k += run
                cells[k] = bits.signed(size) * (1 << low)
            elif run < 15:
                return (1 << run) + bits.number(run) - 1
            else:
                k += 15
            k += 1
        return 0

    @staticmethod
    def _ac_again(bits: Bits, cells: np.ndarray, table: HuffmanTable, first: int, last: int, low: int, left: int) -> int:
        def correct(k: int) -> None:
            if bits.bit():
                cells[k] += (1 if cells[k] > 0 else -1) << low

        k = first
        while k <= last and not left:
            run, size = divmod(bits.symbol(table), 16)
            value = 0
            if size:
                value = (1 if bits.bit() else -1) * (1 << low)
            elif run < 15:
                left = (1 << run) + bits.number(run)
                break
            while k <= last:
                if cells[k]:
                    correct(k)
                elif run:
                    run -= 1
                else:
                    break
                k += 1
            if value and k <= last:
                cells[k] = value
            k += 1
        if left:
            for at in range(k, last + 1):
                if cells[at]:
                    correct(at)
            return left - 1
        return 0

    def _whole_scan(self, order: list, slots: dict[int, int], first: int, last: int, high: int, low: int, coded: bytes) -> bool:
        """Reads a scan at once if its codes and extra bits have one length throughout; False if they don't."""
        if first:
            c, blocks = order[0][0], order[0][1].reshape(-1)
            flat, n = self.coefficients[c].reshape(-1, 64), last - first + 1
            table = self.tables[0x10 | slots[c] & 15]
            if not high:
                if table.ahead[0] != (7, 1) or len(coded) != len(blocks) * n:
                    return False
                got = np.frombuffer(coded, np.uint8)
                if got.max(initial=0) > 127:
                    return False
                got = got.reshape(-1, n).astype(np.int16)
                flat[blocks, first : last + 1] = (got - 127 * (got < 64)) << low
                return True
            held = flat[blocks, first : last + 1]
            if not held.all():
                return False
            found = np.unpackbits(np.frombuffer(coded.replace(b"\xff\x00", b"\xff"), np.uint8))
            at = done = 0
            while done < len(blocks):
                reader = Bits(np.packbits(found[at : at + 48]).tobytes())
                run, size = divmod(reader.symbol(table), 16)
                if size or run == 15:
                    return False
                count = (1 << run) + reader.number(run)
                at += reader.at
                span = held[done : done + count]
                span += (found[at : at + span.size].reshape(span.shape).astype(np.int16) << low) * np.sign(span)
                at, done = at + span.size, done + count
            flat[blocks, first : last + 1] = held
            return True
        total = sum(x.size for _, x in order)
        width = 1 if high else 9
        if not high and any(self.tables[slots[c] >> 4].lengths != DC_LENGTHS for c, _ in order):
            return False
        found = np.unpackbits(np.frombuffer(coded.replace(b"\xff\x00", b"\xff"), np.uint8), count=total * width)
        if high:
            rows = found.reshape(len(order[0][1]), -1).astype(np.int16)
        else:
            rows = DIFFERENCES[found.reshape(-1, 9) @ (1 << NINE)].reshape(len(order[0][1]), -1)
        at = 0
        for c, blocks in order:
            own = rows[:, at : at + blocks.shape[1]].reshape(-1)
            at += blocks.shape[1]
            flat = self.coefficients[c].reshape(-1, 64)
            if high:
                flat[blocks.reshape(-1), 0] |= own << low
            else:
                flat[blocks.reshape(-1), 0] = np.cumsum(own) << low
        return True

    def payload(self) -> bytes:
        """The bytes that store_payload put into the coefficients."""
        cells = np.concatenate([x.reshape(-1) for x in self.coefficients.values()])
        return (cells + 255 * (cells < 0)).astype(np.uint8).tobytes()[: int.from_bytes(self.comment, "big")]

    def rgb(self) -> np.ndarray:
        """Height x width x 3, 8 bits: inverse transform, chroma repeated to full size, colours."""
        planes = []
        for c, p in self.parts.items():
            cells = self.coefficients[c]
            down, across, _ = cells.shape
            spatial = (cells.reshape(-1, 64) * self.quant[p.quant]).astype(np.float32) @ INVERSE
            plane = spatial.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across)
            planes.append((np.clip(np.rint(plane), -128, 127), self.high // p.down, self.wide // p.across))
        full = lambda plane, v, h: np.repeat(np.repeat(plane, v, 0), h, 1)[: self.height, : self.width] if v * h > 1 else plane[: self.height, : self.width]
        luma = full(*planes[0]) + 128
        if len(planes) == 1:
            return np.repeat(luma.astype(np.uint8)[:, :, None], 3, 2)
        (cb, v, h), (cr, _, _) = planes[1:3]
        out = np.empty((self.height, self.width, 3), np.uint8)
        for channel, offset in enumerate((1.402 * cr, -0.344136 * cb - 0.714136 * cr, 1.772 * cb)):  # fixed values of the JPEG colour transform
            out[:, :, channel] = np.clip(np.rint(luma + full(offset.astype(np.float32), v, h)), 0, 255)
        return out


def inverse_transform() -> np.ndarray:
    """Zigzag coefficients to 8x8 samples, as one 64 x 64 matrix."""
    u = np.arange(8)
    cosine = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1) / 2  # sample, frequency
    return np.einsum("yv,xu->vuyx", cosine, cosine).reshape(64, 64)[ZIGZAG].astype(np.float32)


INVERSE = inverse_transform()


def padded(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    return raw + b"\xff" * (UNIT * max(1, -(-len(raw) // UNIT)) - len(raw)), len(raw)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a JPEG file) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch):
                made = [(doc_id, *padded(text)) for doc_id, text in rows]
                ids, sizes = pa.array([x[0] for x in made], pa.int64()), pa.array([x[2] for x in made], pa.int64())
                media = pa.array([store_payload(x[1]) for x in made], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, sizes, media], names=["doc_id", "n_bytes", "media"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode_images(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """The key, height, width and `rgb binary` (height x width x 3 samples) of every JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch, 16):
                tensors = [ProgressiveImage(data).rgb() for _, data in rows]
                sizes = [pa.array([t.shape[i] for t in tensors], pa.int32()) for i in (0, 1)]
                samples = pa.array([t.tobytes() for t in tensors], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in rows], batch.schema.types[0]), *sizes, samples],
                    names=[key, "height", "width", "rgb"],
                )

    return media.select(key, column).mapInArrow(run, f"{key} {dict(media.dtypes)[key]}, height int, width int, rgb binary")


READ = {
    "doc_id": pa.int64(),
    "n_bytes": pa.int64(),
    "payload_bytes": pa.int64(),
    "payload_sha256": pa.string(),
    "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(),
    "media_sha256": pa.string(),
    "height": pa.int32(),
    "width": pa.int32(),
    "rgb": pa.binary(),
}
SQL_NAMES = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}


def read_media(media: DataFrame) -> DataFrame:
    """Reads the stored files back: digests of payload and file, and the picture's full-resolution RGB tensor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch, 64, 2_000_000):
                out: list[tuple] = []
                for doc_id, n_bytes, data in rows:
                    image = ProgressiveImage(data)
                    payload, rgb = image.payload(), image.rgb()
                    digests = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest()
                    out.append((doc_id, n_bytes, *digests, *rgb.shape[:2], rgb.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), READ.values(), strict=True)],
                    names=list(READ),
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ", ".join(f"{n} {SQL_NAMES[k]}" for n, k in READ.items()))


def read_digests(media: DataFrame) -> DataFrame:
    """read_media with the tensor's feature, its shape and checksum, in place of its samples."""
    feature = F.concat(F.col("height").cast("string"), F.lit("x"), F.col("width").cast("string"), F.lit("x3 "), F.hex(F.crc32("rgb")))
    return read_media(media).withColumn("feature", feature).drop("height", "width", "rgb")


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digests(settled(store_texts(documents(spark, sf_dir)), "media"))
