"""Media columns (operator 8): ISO media containers, read by their boxes and sample tables.

pack() stores a payload losslessly as 8-bit samples of 64 bytes in a container; inspect() walks the nested boxes of
any such container and decodes its sample tables and fragment runs into codec, duration and byte ranges, never the
payload; read_back() joins the bytes that those ranges name.

Null texts are empty; an empty text is one sample of 64 zero bytes; equal texts give equal values; texts of any
length are stored whole; repeated rows give repeated results, an empty table gives no rows; other columns are not read,
whatever their names; broken containers give no tracks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from riskloom.llm.common import map_arrow

UNIT = 64
RATE = 8000
#: Fixed box types that hold other boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"moof", b"traf", b"mvex", b"udta"}
#: Boxes within boxes at most.
DEEP = 64


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pack(payload: bytes, per_chunk: int = 32, sync_every: int = 16) -> bytes:
    """A container with one audio track of raw 8-bit samples, 64 bytes each; payload: a positive multiple of 64 bytes."""
    n = len(payload) // UNIT
    chunks = -(-n // per_chunk)
    rest = n - (chunks - 1) * per_chunk
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    to_chunk = [(1, per_chunk, 1)] if rest == per_chunk else [(1, per_chunk, 1), (chunks, rest, 1)] if chunks > 1 else [(1, rest, 1)]
    keys = range(1, n + 1, sync_every)
    head = box(b"ftyp", b"isom", struct.pack(">I", 0), b"isom", b"mp42")
    entry = box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))

    def moov(at: int) -> bytes:
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, UNIT)),
            full(b"stss", struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)),
            full(b"stsc", struct.pack(">I", len(to_chunk)), *(struct.pack(">III", *c) for c in to_chunk)),
            full(b"stsz", struct.pack(">II", UNIT, n)),
            full(b"stco", struct.pack(">I", chunks), struct.pack(f">{chunks}I", *range(at, at + chunks * per_chunk * UNIT, per_chunk * UNIT))),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n * UNIT, 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n * UNIT, 0, 0, 0x100, 0), matrix, bytes(8), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n * UNIT, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    at = len(head) + len(moov(0)) + 8
    return head + moov(at) + box(b"mdat", payload)


@dataclass
class Track:
    number: int = 0
    codec: str | None = None
    handler: str | None = None
    timescale: int = 0
    duration: int = 0
    keyframes: list[int] | None = None
    sizes: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)

    def ranges(self) -> list[tuple[int, int]]:
        """(offset, length) of each sample."""
        return list(zip(self.offsets, self.sizes, strict=True))

    def keyframe_ranges(self) -> list[tuple[int, int]]:
        """Of the sync samples; without a sync table every sample is one."""
        every = self.ranges()
        return every if self.keyframes is None else [every[k - 1] for k in self.keyframes if 0 < k <= len(every)]


def walk(data: bytes | memoryview, start: int = 0, end: int | None = None):
    """(type, body start, body end) of every box, outer ones first; boxes nested deeper than DEEP are no container."""
    open_ = [(start, len(data) if end is None else end)]
    while open_:
        at, end = open_.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1 and at + 16 <= end:
            size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        stop = end if size == 0 else at + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {at} leaves its parent")
        yield kind, body, stop
        open_.append((stop, end))
        if kind in NESTED:
            if len(open_) > DEEP:
                raise ValueError(f"box {kind!r} at {at} lies too deep")
            open_.append((body, stop))


class _Runs:
    """The samples of movie fragments: run by run, sizes and flags from the run, else the fragment, else the track's defaults."""

    def __init__(self, most: int) -> None:
        """most: samples that a container of this size can say anything about."""
        self.base, self.most, self.track = 0, most, None
        self.found: list[tuple[Track, int, int, int, bool]] = []  # track, offset, size, duration, keyframe

    def start(self, numbers, at: int, tracks: list[Track], defaults: dict[int, tuple[int, ...]]) -> None:
        flags, number = numbers(at, 1)[0] & 0xFFFFFF, numbers(at + 4, 1)[0]
        self.track = next((t for t in tracks if t.number == number), None)
        if self.track is None:
            raise ValueError(f"a fragment of track {number}, which is not there")
        self.duration, self.size, self.flags = defaults.get(number, (0, 0, 0))
        at += 8
        self.offset = self.base
        if flags & 0x1:
            self.offset, at = numbers(at, 1, "Q")[0], at + 8
        at += 4 if flags & 0x2 else 0
        for bit, name in ((0x8, "duration"), (0x10, "size"), (0x20, "flags")):
            if flags & bit:
                setattr(self, name, numbers(at, 1)[0])
                at += 4
        self.next = self.offset

    def add(self, numbers, at: int) -> None:
        flags, n = numbers(at, 1)[0] & 0xFFFFFF, numbers(at + 4, 1)[0]
        if self.track is None or len(self.found) + n > self.most:
            raise ValueError("a run of no fragment, or of more samples than the container has bytes")
        at, first = at + 8, None
        if flags & 0x1:
            self.next, at = self.offset + numbers(at, 1, "i")[0], at + 4
        if flags & 0x4:
            first, at = numbers(at, 1)[0], at + 4
        for k in range(n):
            of = {0x100: self.duration, 0x200: self.size, 0x400: first if k == 0 and first is not None else self.flags, 0x800: 0}
            for bit in of:
                if flags & bit:
                    of[bit], at = numbers(at, 1)[0], at + 4
            self.found.append((self.track, self.next, of[0x200], of[0x100], not of[0x400] & 0x10000))
            self.next += of[0x200]

    def close(self) -> None:
        for track, offset, size, duration, key in self.found:
            if track.keyframes is None:
                track.keyframes = list(range(1, len(track.offsets) + 1))
            track.offsets.append(offset)
            track.sizes.append(size)
            track.duration += duration
            if key:
                track.keyframes.append(len(track.offsets))


def inspect(data: bytes) -> list[Track]:
    """The tracks of a container, from its boxes only; what breaks the format gives no tracks."""
    tracks: list[Track] = []
    chunks: list[int] = []
    to_chunk: list[tuple[int, int, int]] = []
    numbers = lambda at, n, width="I": struct.unpack_from(f">{n}{width}", data, at)
    pending: list[tuple[Track, list[int], list[tuple[int, int, int]]]] = []
    defaults: dict[int, tuple[int, ...]] = {}
    runs = _Runs(len(data))
    try:
        for kind, at, _ in walk(data):
            if kind == b"trak":
                tracks.append(Track())
                chunks, to_chunk = [], []
                pending.append((tracks[-1], chunks, to_chunk))
            elif not tracks:
                continue
            elif kind == b"mdhd":
                wide = data[at] == 1
                tracks[-1].timescale, tracks[-1].duration = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
            elif kind == b"hdlr":
                tracks[-1].handler = data[at + 8 : at + 12].decode("latin-1")
            elif kind == b"stsd":
                tracks[-1].codec = data[at + 12 : at + 16].decode("latin-1")
            elif kind == b"stss":
                tracks[-1].keyframes = list(numbers(at + 8, *numbers(at + 4, 1)))
            elif kind == b"stsc":
                n = numbers(at + 4, 1)[0]
                flat = numbers(at + 8, 3 * n)
                to_chunk += zip(flat[::3], flat[1::3], flat[2::3], strict=True)
            elif kind == b"stsz":
                size, n = numbers(at + 4, 2)
                if n * max(size, 1) > len(data):
                    raise ValueError("more samples than the container has bytes")
                tracks[-1].sizes = [size] * n if size else list(numbers(at + 12, n))
            elif kind in (b"stco", b"co64"):
                chunks += numbers(at + 8, numbers(at + 4, 1)[0], "I" if kind == b"stco" else "Q")
            elif kind == b"tkhd":
                tracks[-1].number = numbers(at + (20 if data[at] == 1 else 12), 1)[0]
            elif kind == b"trex":
                defaults[numbers(at + 4, 1)[0]] = numbers(at + 12, 3)
            elif kind == b"moof":
                runs.base = at - 8
            elif kind == b"tfhd":
                runs.start(numbers, at, tracks, defaults)
            elif kind == b"trun":
                runs.add(numbers, at)
        for track, own, deal in pending:
            if not deal:
                continue
            sample = 0
            for k, (first, per, _) in enumerate(deal):
                if first < 1:
                    raise ValueError("chunks are counted from 1")
                until = deal[k + 1][0] if k + 1 < len(deal) else len(own) + 1
                for c in range(first, until):
                    where = own[c - 1]
                    for _ in range(per):
                        track.offsets.append(where)
                        where += track.sizes[sample]
                        sample += 1
            track.sizes = track.sizes[: len(track.offsets)]
        runs.close()
    except (ValueError, struct.error, IndexError):
        return []
    return tracks


def read_back(data: bytes, track: Track) -> bytes:
    view = memoryview(data)
    return b"".join(view[at : at + n] for at, n in track.ranges())


def padded(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (codec, handler, rate,
    duration, samples, keyframes), keyframe_ranges (offset, length of every keyframe) of every row of docs."""
    names = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, keyframe_ranges array<struct<offset:bigint,length:bigint>>"

    def make():
        def one(text):
            media = pack(padded(text))
            (track,) = inspect(media)
            back = read_back(media, track)
            keys = track.keyframe_ranges()
            feature = f"codec={track.codec.strip()};handler={track.handler};rate={track.timescale};duration={track.duration};samples={len(track.sizes)};keyframes={len(keys)}"
            return len(text.encode("utf-8", "surrogatepass")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, [{"offset": at, "length": n} for at, n in keys]

        def step(rows):
            cols = list(zip(*(one(t or "") for t in rows["text"]), strict=True)) or [()] * 8
            return dict(zip(["doc_id", *(p.split()[0] for p in names.split(", ")[1:])], [rows["doc_id"], *map(list, cols)], strict=True))

        return step

    return map_arrow(docs, ["doc_id", "text"], names, make, rows=64)
