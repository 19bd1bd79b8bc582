"""GIF media columns: write byte payloads as 8-bit indexed frames, decode any GIF back to timed frames with histograms.

The decoder follows the GIF89a format: LZW code streams of growing width, global and local palettes, interlacing,
graphic-control delays, transparency and the four disposal rules. The writer stores payload bytes as palette indices of
a grey palette, 64 pixels a row and ``ROWS`` rows a frame, as dictionary streams with a clear code every ``SEGMENT``
samples.

Both ends work on all streams of a batch at once. Writing, the segments of all frames advance together, a sample each
step; a segment's dictionary is one slot for each hash of (word, sample), where a later word may displace an earlier
one, which costs a match and never changes what the stream says. Reading, a code after the first of a table stands for
an earlier place of the output and the sample after it, so lengths and then samples are found by following all
references together, twice as far in every round.

Defined results: a null text counts as empty; an empty text is one row of 64 zero samples; repeated rows give equal
media; a null id is carried through; bytes that are no GIF raise ValueError in :func:`decode` and give no frames in
:func:`frames` (its ``error`` column says why). Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import lean, table, text_chunks

WIDTH = 64
ROWS = 1024
DELAY_MS = 100
BINS = 8
#: bytes of frames or files that are worked on at once; a longer one stands alone
BATCH = 1 << 21


# ---- LZW ----------------------------------------------------------------------------------------


#: samples between clear codes: so few that a table of 4096 codes is never full
SEGMENT = 3584
_SLOTS = 1 << 23
_HASH = np.uint32(0x9E3779B1)


@lru_cache(maxsize=16)
def _ends(size: int, n: int) -> np.ndarray:
    """Bits from a clear code to the end of each of the n next codes: as wide as the next free code, 12 at most."""
    free = (1 << size) + 1 + np.arange(n)
    free[0] += 1
    return np.cumsum(np.clip(np.floor(np.log2(free)).astype(np.int64) + 1, size + 1, 12))


def _words(lanes: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The codes of segments, all of them a sample further in every step."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(lanes)
    order = sorted((i for i in range(len(lanes)) if len(lanes[i])), key=lambda i: -len(lanes[i]))
    while order:
        longest = len(lanes[order[0]])
        bits = max(4, (2 * longest - 1).bit_length())
        own, order = order[: _SLOTS >> bits], order[_SLOTS >> bits :]
        length = np.array([len(lanes[i]) for i in own])
        samples = np.zeros((longest, len(own)), np.uint32)
        for k, i in enumerate(own):
            samples[: length[k], k] = lanes[i]
        table = np.full(len(own) << bits, 0xFFFFFFFF, np.uint32)  # no word has this many bits set
        base, free, word = np.arange(len(own)) << bits, np.full(len(own), (1 << size) + 2, np.uint32), samples[0].copy()
        codes = np.full((longest, len(own)), -1, np.int16)
        alive = np.searchsorted(-length, -np.arange(longest), side="left").tolist()  # longer than t
        for t in range(1, longest):
            n = alive[t]
            codes[t - 1, n : alive[t - 1]] = word[n : alive[t - 1]]  # these end here
            now = samples[t, :n]
            key = word[:n] << np.uint32(8) | now
            slot = base[:n] + (key * _HASH >> np.uint32(32 - bits))
            found = table[slot]
            miss = np.flatnonzero(found >> np.uint32(12) != key)
            codes[t - 1, miss] = word[miss]
            table[slot[miss]] = key[miss] << np.uint32(12) | free[miss]
            free[miss] += np.uint32(1)
            word[:n] = found & np.uint32(4095)
            word[miss] = now[miss]
        codes[longest - 1, : alive[-1]] = word[: alive[-1]]
        columns = np.ascontiguousarray(codes.T)
        for k, i in enumerate(own):
            out[i] = columns[k][columns[k] >= 0].astype(np.uint32)
    return out


def lzw_encode(frames: list[np.ndarray], size: int = 8) -> list[np.ndarray]:
    """The code streams of many frames' samples, as bytes."""
    clear, stop = 1 << size, (1 << size) + 1
    cuts = [list(range(0, max(1, len(f)), SEGMENT)) for f in frames]
    words = _words([f[a : a + SEGMENT] for f, at in zip(frames, cuts, strict=True) for a in at], size)
    ends, out, k = _ends(size, SEGMENT + 2), [], 0
    codes, upto, first = [], [], []
    total = 0
    for at in cuts:
        first.append(total)
        codes.append(np.array([clear], np.uint32))
        upto.append(np.array([total + size + 1]))
        total += size + 1
        for j in range(len(at)):
            own = words[k]
            k += 1
            codes += [own, np.array([clear if j + 1 < len(at) else stop], np.uint32)]
            upto.append(total + ends[: len(own) + 1])
            total += int(ends[len(own)])
        total = -(-total // 8) * 8
    code, end = np.concatenate(codes).astype(np.uint64), np.concatenate(upto)
    # A code begins where the one before it ends, but for those at the start of a byte of their own.
    begin = np.concatenate([[0], end[:-1]])
    lengths = np.array([1 + sum(len(words[i]) + 1 for i in range(a, b)) for a, b in zip(np.cumsum([0] + [len(c) for c in cuts])[:-1], np.cumsum([len(c) for c in cuts]), strict=True)])
    begin[np.cumsum(lengths) - lengths] = first
    value, byte = code << (begin & 7).astype(np.uint64), begin >> 3
    data = np.zeros(total // 8 + 3)
    for part in range(3):  # codes never share a bit, so sums are unions
        data += np.bincount(byte + part, (value >> np.uint64(8 * part) & np.uint64(255)).astype(float), len(data))
    data = data.astype(np.uint8)
    bounds = [*first, total]
    return [data[a // 8 : b // 8] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _cut(data: np.ndarray, size: int) -> list[np.ndarray]:
    """The codes of a stream, an array for each table; checks that each refers to a code before it."""
    if not 2 <= size <= 11:
        raise ValueError("LZW code size out of range")
    clear, stop = 1 << size, (1 << size) + 1
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
    at, total, ask, out = 0, len(data) * 8, 4096, []
    while at + size + 1 <= total:
        ends = at + _ends(size, ask)[: (total - at) // (size + 1)]
        begin = np.concatenate([[at], ends[:-1]])
        begin, ends = begin[ends <= total], ends[ends <= total]
        byte = begin >> 3
        codes = ((padded[byte] | padded[byte + 1] << 8 | padded[byte + 2] << 16) >> (begin & 7)) & ((1 << (ends - begin)) - 1)
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        if not len(marks) and len(codes) == ask:
            ask *= 4
            continue
        last = int(marks[0]) if len(marks) else len(codes)
        own = codes[:last]
        if (own - stop - 1 >= np.arange(last)).any():
            raise ValueError("LZW code beyond the table")
        out.append(own)
        if not len(marks) or codes[last] == stop:
            break
        at, ask = int(ends[last]), 4096
    return out


def lzw_decode(streams: list[tuple[np.ndarray, int, int]]) -> list[np.ndarray | ValueError]:
    """The first samples of many code streams, given as bytes, code size and count of samples; missing ones are 0.

    A stream whose codes can't be read gives the error instead.
    """
    out: list[np.ndarray | ValueError] = []
    tables, clear, owner = [], [], []
    for i, (data, size, pixels) in enumerate(streams):
        try:
            found = _cut(data, size)
            out.append(np.zeros(pixels, np.uint8))
        except ValueError as e:
            found = []
            out.append(e)
        tables += found
        clear += [1 << size] * len(found)
        owner += [i] * len(found)
    if not sum(map(len, tables)):
        return out
    counts = np.array([len(t) for t in tables])
    code, base = np.concatenate(tables), np.repeat(np.array(clear), counts)
    start = np.repeat(np.cumsum(counts) - counts, counts)
    itself = np.arange(len(code))
    up = np.where(code < base, itself, start + code - base - 2)
    length, far = (up != itself).astype(np.int64), up
    while True:  # references to a literal, followed twice as far each round
        further = far[far]
        if (further == far).all():
            break
        length, far = length + length[far], further
    length += 1
    # What lies beyond the asked samples is not written out.
    of = np.repeat(np.array(owner), counts)
    before = np.cumsum(length) - length
    begin = before[np.searchsorted(of, np.arange(len(streams)))[of]]
    asked = np.array([s[2] for s in streams])
    keep = before - begin < asked[of]
    length, up, code, of = length * keep, up, code, of
    at = np.cumsum(length) - length
    source = np.repeat(at[up] - at, length) + np.arange(int(length.sum()))
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    value = np.zeros(len(source), np.uint8)
    literal = keep & (up == itself)
    value[at[literal]] = code[literal]
    value = value[source]
    bounds = np.bincount(of, length, len(streams)).astype(np.int64)
    ends = np.cumsum(bounds)
    for i, (n, end) in enumerate(zip(bounds.tolist(), ends.tolist(), strict=True)):
        if n:
            n_out = min(n, int(asked[i]))
            out[i][:n_out] = value[end - n : end - n + n_out]
    return out


# ---- files --------------------------------------------------------------------------------------


def _blocks(body: np.ndarray) -> bytes:
    full = len(body) // 255
    out = np.empty((full, 256), np.uint8)
    out[:, 0] = 255
    out[:, 1:] = body[: full * 255].reshape(full, 255)
    rest = body[full * 255 :]
    return out.tobytes() + (bytes([len(rest)]) + rest.tobytes() if len(rest) else b"") + b"\0"


_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def encode_all(payloads: list[np.ndarray], rows: int = ROWS, delay_ms: int = DELAY_MS) -> list[bytes]:
    """GIFs of many payloads' bytes as samples; their lengths are multiples of the width."""
    step = rows * WIDTH
    frames = [p[a : a + step] for p in payloads for a in range(0, len(p), step)]
    bodies: list[bytes] = []
    lo = 0
    while lo < len(frames):  # frames of some megabytes at a time, however long one payload is
        hi, held = lo, 0
        while hi < len(frames) and (hi == lo or held + len(frames[hi]) <= BATCH):
            held += len(frames[hi])
            hi += 1
        bodies += [_blocks(b) for b in lzw_encode(frames[lo:hi])]
        lo = hi
    out, k = [], 0
    for p in payloads:
        parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(len(p) // WIDTH, rows), 0xF7, 0, 0), _GREY]
        for a in range(0, len(p), step):
            height = len(p[a : a + step]) // WIDTH
            parts += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_ms // 10, 0, 0), struct.pack("<BHHHHBB", 0x2C, 0, 0, WIDTH, height, 0, 8), bodies[k]]
            k += 1
        out.append(b"".join([*parts, b"\x3b"]))
    return out


def encode(payload: np.ndarray, rows: int = ROWS, delay_ms: int = DELAY_MS) -> bytes:
    """A GIF of the payload's bytes as samples; its length is a multiple of the width."""
    return encode_all([payload], rows, delay_ms)[0]


@dataclass
class Frame:
    begin_ms: int
    delay_ms: int
    left: int
    top: int
    canvas: np.ndarray  #: height x width x RGBA as shown
    height: int
    width: int

    def shown(self) -> np.ndarray:
        """What the canvas shows in this frame's own rectangle."""
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]

    def histogram(self) -> np.ndarray:
        """Pixels by channel and bin of the whole canvas: BINS for red, then green, then blue."""
        return np.concatenate([np.bincount(self.canvas[..., c].reshape(-1) >> 5, minlength=BINS) for c in range(3)])


def _read_blocks(raw: np.ndarray, at: int) -> tuple[np.ndarray, int]:
    found = []
    while True:
        heads = raw[at::256]
        full = int(np.argmax(heads != 255)) if (heads != 255).any() else len(heads)
        full = min(full, (len(raw) - at) // 256)
        if full:
            found.append(raw[at : at + full * 256].reshape(full, 256)[:, 1:].reshape(-1))
            at += full * 256
        if at >= len(raw):
            raise ValueError("GIF data end in a block")
        n = int(raw[at])
        found.append(raw[at + 1 : at + 1 + n])
        at += 1 + n
        if n == 0:
            return np.concatenate(found), at


@dataclass
class _Image:
    """A frame as it stands in the file."""

    delay: int
    disposal: int
    hidden: int
    place: tuple[int, int, int, int]  #: left, top, width, height
    interlaced: bool
    colours: np.ndarray
    stream: tuple[np.ndarray, int, int]


def _parse(data: bytes) -> tuple[int, int, list[_Image]]:
    """Width, height and images of a GIF."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    raw = np.frombuffer(data, np.uint8)
    width, height, flags, _ = struct.unpack_from("<HHBB", data, 6)
    at, common, images = 13, None, []
    if flags & 0x80:
        n = 2 << (flags & 7)
        common = raw[at : at + 3 * n].reshape(n, 3)
        at += 3 * n
    delay, disposal, hidden = 0, 0, -1
    while at < len(raw) and raw[at] != 0x3B:
        kind = raw[at]
        if kind == 0x21:
            body, end = _read_blocks(raw, at + 2)
            if raw[at + 1] == 0xF9 and len(body) >= 4:
                disposal, delay = int(body[0]) >> 2 & 7, 10 * (int(body[1]) | int(body[2]) << 8)
                hidden = int(body[3]) if body[0] & 1 else -1
            at = end
        elif kind == 0x2C:
            left, top, w, h, f = struct.unpack_from("<HHHHB", data, at + 1)
            at, colours = at + 10, common
            if f & 0x80:
                n = 2 << (f & 7)
                colours = raw[at : at + 3 * n].reshape(n, 3)
                at += 3 * n
            if colours is None:
                raise ValueError("GIF frame without a palette")
            body, end = _read_blocks(raw, at + 1)
            images.append(_Image(delay, disposal, hidden, (left, top, w, h), bool(f & 0x40), colours, (body, int(raw[at]), w * h)))
            at, delay, disposal, hidden = end, 0, 0, -1
        else:
            raise ValueError(f"unknown GIF block {kind:#x}")
    return width, height, images


def _compose(width: int, height: int, images: list[_Image], samples: list[np.ndarray]) -> list[Frame]:
    canvas, frames, clock = np.zeros((height, width, 4), np.uint8), [], 0
    for image, index in zip(images, samples, strict=True):
        left, top, w, h = image.place
        index = index.reshape(h, w)
        if image.interlaced:
            order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
            straight = np.empty_like(index)
            straight[order] = index
            index = straight
        before = canvas.copy() if image.disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        index = index[: area.shape[0], : area.shape[1]]
        paint = image.colours[np.minimum(index, len(image.colours) - 1)]
        if image.hidden < 0:
            area[..., :3], area[..., 3] = paint, 255
        else:
            drawn = index != image.hidden
            area[..., :3][drawn], area[..., 3][drawn] = paint[drawn], 255
        frames.append(Frame(clock, image.delay, left, top, canvas.copy(), area.shape[0], area.shape[1]))
        clock += image.delay
        if image.disposal == 2:
            area[...] = 0
        elif image.disposal == 3:
            canvas = before
    return frames


def decode_all(media: list[bytes]) -> Iterator[list[Frame] | ValueError]:
    """All frames of each GIF, composed as a viewer shows them; an error for bytes that are none."""
    lo = 0
    while lo < len(media):
        parsed, hi, held = [], lo, 0
        while hi < len(media) and (hi == lo or held + len(media[hi]) <= BATCH):
            held += len(media[hi])
            try:
                parsed.append(_parse(media[hi]))
            except (ValueError, struct.error, IndexError) as e:
                parsed.append(ValueError(str(e)))
            hi += 1
        samples = iter(lzw_decode([i.stream for x in parsed if not isinstance(x, ValueError) for i in x[2]]))
        for x in parsed:
            if isinstance(x, ValueError):
                yield x
                continue
            own = [next(samples) for _ in x[2]]
            wrong = [e for e in own if isinstance(e, ValueError)]
            yield wrong[0] if wrong else _compose(*x, own)
        lo = hi


def decode(data: bytes) -> list[Frame]:
    """All frames of a GIF, composed as a viewer shows them."""
    found = next(decode_all([data]))
    if isinstance(found, ValueError):
        raise found
    return found


def payload_of(text: np.ndarray) -> np.ndarray:
    """The bytes with zeros up to a positive multiple of the width."""
    out = np.zeros(max(1, -(-len(text) // WIDTH)) * WIDTH, np.uint8)
    out[: len(text)] = text
    return out


# ---- columns ------------------------------------------------------------------------------------


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text and its GIF in ``media``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column("text")):
                media = encode_all([payload_of(data[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(offs), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, media binary")


_FRAME = "frame int, begin_ms int, delay_ms int, width int, height int, red array<int>, green array<int>, blue array<int>, samples binary"


def frames(media: DataFrame) -> DataFrame:
    """One row a frame: doc_id, timing, size, colour histograms and the red samples of its rectangle; or an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for i, found in enumerate(decode_all([m or b"" for m in batch.column("media").to_pylist()])):
                error = str(found) if isinstance(found, ValueError) else None
                found = [] if error is not None else found
                rows = []
                for k, x in enumerate(found):
                    h = x.histogram().reshape(3, -1).tolist()
                    rows.append((k, x.begin_ms, x.delay_ms, x.width, x.height, *h, x.shown()[..., 0].tobytes()))
                rows = rows or [(None,) * 9]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32()] * 5 + [pa.list_(pa.int32())] * 3 + [pa.binary()], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i].as_py()] * len(rows), ids.type), *columns, pa.array([error] * len(rows), pa.string())], ["doc_id", "frame", "begin_ms", "delay_ms", "width", "height", "red", "green", "blue", "samples", "error"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(lean(run), f"doc_id {kind}, {_FRAME}, error string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        media = batch.column("media").to_pylist()
        for raw, found in zip(media, decode_all(media), strict=True):
            if isinstance(found, ValueError):
                raise found
            back = b"".join(x.shown()[..., 0].tobytes() for x in found)
            grey = sum(x.histogram()[:BINS] for x in found)
            feature = f"frames={len(found)};ms={sum(x.delay_ms for x in found)};size={found[0].canvas.shape[1]}x{found[0].canvas.shape[0]};grey={','.join(map(str, grey.tolist()))}"
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def digests(media: DataFrame) -> DataFrame:
    """What the stored media hold once read back: sizes, hashes and the colour-histogram feature."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(lean(_digests), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(to_media(table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))))
