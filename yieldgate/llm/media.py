"""Media columns: ISO base media containers in a binary column.

`encode_media` stores bytes as a raw grey video track (24 x 24 8-bit samples, 576 bytes a frame); `probe_media` walks
the nested boxes of any such container, decodes the sample tables and fragments of each track and gives codec, duration
and keyframe byte ranges. Neither decodes a payload: samples are only ever copied.

Defined results: null or broken containers give nulls and an `error`, as do tables that point out of the file, claim more
than it holds or nest more than `DEEPEST` boxes; columns outside `tracks` are of the first track that has samples (of the
first where none has); a container without samples has no keyframes; a track that states no duration has that of its
samples; equal bytes give equal containers; other columns are kept out by name, so clashing ones do no harm.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, documents

FRAME = 576
GROUP = 12
TIMESCALE = 25
PAD = b"\xff"

#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
DEEPEST = 16


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
_HDLR = _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0")
_VMHD = _full(b"vmhd", bytes(8), flags=1)
_DINF = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
_ENTRY = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", 24, 24), struct.pack(">II", 0x480000, 0x480000), bytes(4), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 8, -1))
_STSD = _full(b"stsd", struct.pack(">I", 1), _ENTRY)


def _moov(n: int, at: int, wide: bool) -> bytes:
    groups = -(-n // GROUP)
    offsets = at + np.arange(groups, dtype=np.int64) * (GROUP * FRAME)
    whole, rest = divmod(n, GROUP)
    runs = ([(1, GROUP, 1)] if whole else []) + ([(whole + 1, rest, 1)] if rest else [])
    table = _box(
        b"stbl", _STSD,
        _full(b"stts", struct.pack(">III", 1, n, 1)),
        _full(b"stss", struct.pack(">I", groups), np.arange(1, n + 1, GROUP).astype(">u4").tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, n)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", groups), offsets.astype(">u8" if wide else ">u4").tobytes()),
    )
    size = struct.pack(">II", 24 << 16, 24 << 16)
    return _box(
        b"moov",
        _full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2)),
        _box(
            b"trak",
            _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), _MATRIX, size, flags=7),
            _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), _HDLR, _box(b"minf", _VMHD, _DINF, table)),
        ),
    )


def mux(data: bytes) -> bytes:
    """A container whose frames are data, filled up with bytes 255 to a positive multiple of a frame."""
    n = max(1, -(-len(data) // FRAME))
    payload = data.ljust(n * FRAME, PAD)
    wide = len(payload) >= 1 << 31
    head = len(_FTYP) + len(_moov(n, 0, wide)) + (16 if wide else 8)
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return b"".join((_FTYP, _moov(n, head, wide), mdat, payload))


def walk(media: memoryview, at: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int, int]]:
    """Path, start, start of the body and end of each box, outer ones first."""
    end = len(media) if end is None else end
    if len(path) > DEEPEST:
        raise ValueError("boxes nest too deep")
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", media, at)
        body = at + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", media, body)
            body += 8
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield (*path, kind), at, body, at + size
        if kind in NESTED:
            yield from walk(media, body, at + size, (*path, kind))
        at += size


#: Boxes of a track or of a fragment by kind: starts and ends of their bodies.
Boxes = dict[bytes, list[tuple[int, int]]]


def _ints(media: memoryview, box: tuple[int, int], skip: int, n: int, dtype: str = ">u4") -> np.ndarray:
    start, end = box
    if start + skip + n * np.dtype(dtype).itemsize > end:
        raise ValueError("a table is cut off")
    return np.frombuffer(media, dtype, n, start + skip).astype(np.int64)


def _sizes(media: memoryview, boxes: Boxes) -> np.ndarray:
    if b"stz2" in boxes:
        box = boxes[b"stz2"][0]
        field, n = _ints(media, box, 4, 2) & [255, -1]
        if field == 4:
            pairs = _ints(media, box, 12, (n + 1) // 2, ">u1")
            return np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n]
        return _ints(media, box, 12, n, {8: ">u1", 16: ">u2"}[int(field)])
    box = boxes[b"stsz"][0]
    fixed, n = _ints(media, box, 4, 2)
    if fixed * n > len(media):
        raise ValueError("samples are more than the file")
    return np.full(n, fixed) if fixed else _ints(media, box, 12, n)


def _table_samples(media: memoryview, boxes: Boxes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offset and size of each sample of the sample tables, and whether it is a keyframe."""
    sizes = _sizes(media, boxes)
    n = len(sizes)
    kind, dtype = (b"co64", ">u8") if b"co64" in boxes else (b"stco", ">u4")
    places, runs = boxes[kind][0], boxes[b"stsc"][0]
    chunk_at = _ints(media, places, 8, _ints(media, places, 4, 1)[0], dtype)
    runs = _ints(media, runs, 8, 3 * _ints(media, runs, 4, 1)[0]).reshape(-1, 3)
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunk_at) + 1))) if len(runs) else np.zeros(0, np.int64)
    if per_chunk.sum() != n or len(runs) and len(per_chunk) != len(chunk_at):
        raise ValueError("sample tables disagree")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    offsets = np.repeat(chunk_at[: len(per_chunk)], per_chunk) + before - np.repeat(before[first] if n else before, per_chunk)
    keys = np.ones(n, bool)
    if b"stss" in boxes:
        sync = _ints(media, boxes[b"stss"][0], 8, _ints(media, boxes[b"stss"][0], 4, 1)[0]) - 1
        if len(sync) and (sync.min() < 0 or sync.max() >= n):
            raise ValueError("a keyframe is no sample")
        keys[:] = False
        keys[sync] = True
    return offsets, sizes, keys


@dataclass
class _Fragment:
    """Boxes of a traf, where its moof starts, and whether it is the first in there."""

    boxes: Boxes
    moof: int
    first: bool


def _fragment_samples(media: memoryview, fragment: _Fragment, usual: dict[int, np.ndarray], data_end: int) -> tuple[int, np.ndarray, int]:
    """Track, samples (offset, size, keyframe, ticks as rows) and the end of the data of a fragment.

    usual: duration, size and flags of a track's samples where a fragment gives none; data_end: that of the one before.
    """
    box = fragment.boxes[b"tfhd"][0]
    flags, track = _ints(media, box, 0, 2)
    at, base = 8, fragment.moof if fragment.first or flags & 0x20000 else data_end
    if flags & 1:
        base, at = int(_ints(media, box, at, 1, ">u8")[0]), at + 8
    at += 4 * bool(flags & 2)
    given = usual.get(int(track), np.zeros(3, np.int64)).copy()
    for k, bit in enumerate((8, 16, 32)):
        if flags & bit:
            given[k], at = _ints(media, box, at, 1)[0], at + 4
    parts, data_end = [np.zeros((4, 0), np.int64)], base
    for run in fragment.boxes.get(b"trun", []):
        flags, n = _ints(media, run, 0, 2)
        if n > len(media):
            raise ValueError("samples are more than the file")
        at, first_flags = 8, None
        if flags & 1:
            data_end, at = base + int(_ints(media, run, at, 1, ">i4")[0]), at + 4
        if flags & 4:
            first_flags, at = _ints(media, run, at, 1)[0], at + 4
        fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        rows = _ints(media, run, at, n * len(fields)).reshape(n, len(fields))
        ticks, sizes, marks = (rows[:, fields.index(bit)] if bit in fields else np.full(n, given[k]) for k, bit in enumerate((0x100, 0x200, 0x400)))
        if n and first_flags is not None:
            marks = np.r_[first_flags, marks[1:]]
        ends = data_end + np.cumsum(sizes)
        parts.append(np.stack([ends - sizes, sizes, marks >> 16 & 1 ^ 1, ticks]))
        data_end = int(ends[-1]) if n else data_end
    return int(track), np.concatenate(parts, 1), data_end


def _described(media: bytes, view: memoryview, boxes: Boxes) -> dict:
    """What a track's own boxes say of it; duration is None where it is unknown."""
    if b"stsd" not in boxes or b"mdhd" not in boxes:
        raise ValueError("no track")
    entry = boxes[b"stsd"][0][0] + 8
    codec = media[entry + 4 : entry + 8].decode("latin-1").strip()
    at = boxes[b"mdhd"][0][0]
    wide = media[at] == 1
    timescale, ticks = struct.unpack_from(">IQ", view, at + 20) if wide else struct.unpack_from(">II", view, at + 12)
    known = 0 < ticks < ((1 << 64) - 1 if wide else (1 << 32) - 1)
    kind = track = None
    if b"hdlr" in boxes:
        at = boxes[b"hdlr"][0][0]
        kind = media[at + 8 : at + 12].decode("latin-1")
    if b"tkhd" in boxes:
        at = boxes[b"tkhd"][0][0]
        (track,) = struct.unpack_from(">I", view, at + (20 if media[at] == 1 else 12))
    width, height = struct.unpack_from(">HH", view, entry + 32) if kind in (None, "vide") else (None, None)
    return {"track": track, "kind": kind, "codec": codec, "width": width, "height": height, "timescale": timescale, "duration": ticks if known else None}


def tracks(media: bytes) -> list[dict]:
    """Every track: codec, frame size, time, and its samples by offset and size, with the indices of keyframes."""
    view = memoryview(media)
    found: list[Boxes] = []
    fragments: list[_Fragment] = []
    usual: dict[int, np.ndarray] = {}
    moof, first = 0, True
    for path, at, start, end in walk(view):
        kind = path[-1]
        if kind == b"trak":
            found.append({})
        elif kind == b"moof":
            moof, first = at, True
        elif kind == b"traf":
            fragments.append(_Fragment({}, moof, first))
            first = False
        elif kind == b"trex":
            track, _, *rest = _ints(view, (start, end), 4, 5)
            usual[int(track)] = np.array(rest)
        elif b"trak" in path:
            found[-1].setdefault(kind, []).append((start, end))
        elif b"traf" in path:
            fragments[-1].boxes.setdefault(kind, []).append((start, end))
    if not found:
        raise ValueError("no track")
    more: dict[int, list[np.ndarray]] = {}
    data_end = 0
    for fragment in fragments:
        track, samples, data_end = _fragment_samples(view, fragment, usual, data_end)
        more.setdefault(track, []).append(samples)
    out = []
    for boxes in found:
        x = _described(media, view, boxes)
        offsets, sizes, keys = _table_samples(view, boxes)
        later = np.concatenate([np.zeros((4, 0), np.int64), *more.get(x["track"], [])], 1)
        offsets, sizes, keys = np.r_[offsets, later[0]], np.r_[sizes, later[1]], np.flatnonzero(np.r_[keys, later[2] > 0])
        if len(sizes) and (offsets.min() < 0 or (offsets + sizes).max() > len(media)):
            raise ValueError("a sample leaves the file")
        if x["duration"] is None:
            times = _ints(view, boxes[b"stts"][0], 8, 2 * _ints(view, boxes[b"stts"][0], 4, 1)[0]).reshape(-1, 2) if b"stts" in boxes else np.zeros((0, 2), np.int64)
            x["duration"] = int((times[:, 0] * times[:, 1]).sum() + later[3].sum())
        out.append({**x, "offsets": offsets, "sizes": sizes, "keys": keys})
    return out


def demux(media: bytes) -> dict:
    """The first track with samples, or the first where none has, of tracks()."""
    return _leading(tracks(media))


def _leading(found: list[dict]) -> dict:
    return next((x for x in found if len(x["sizes"])), found[0])


def sample_bytes(media: bytes, offsets: np.ndarray, sizes: np.ndarray) -> bytes:
    """The samples one after another; neighbours in the file are copied at once."""
    if not len(offsets):
        return b""
    ends = offsets + sizes
    cut = np.flatnonzero(offsets[1:] != ends[:-1]) + 1
    return b"".join(media[a:b] for a, b in zip(offsets[np.r_[0, cut]], ends[np.r_[cut - 1, len(ends) - 1]], strict=True))


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text", 8 << 20):
        data = [x.encode() for x in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array(map(mux, data), pa.binary())], schema=_ENCODED)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text (null: empty) as UTF-8 in a container."""
    return documents(docs, id_col, text_col).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


_RANGES = "array<struct<offset:long,length:long>>"
_PROBED = f"doc_id long, codec string, width int, height int, timescale long, duration long, n_samples long, keyframes {_RANGES}, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, error string"
_TRACKS = f"tracks array<struct<track:long,kind:string,codec:string,width:int,height:int,timescale:long,duration:long,n_samples:long,keyframes:{_RANGES}>>"
_RANGE = pa.struct([("offset", pa.int64()), ("length", pa.int64())])
_TRACK = pa.struct([("track", pa.int64()), ("kind", pa.string()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(_RANGE))])
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()),
    ("keyframes", pa.list_(_RANGE)), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("error", pa.string()),
])


def _ranges(x: dict) -> list[dict]:
    keys = x["keys"]
    return [{"offset": a, "length": b} for a, b in zip(x["offsets"][keys].tolist(), x["sizes"][keys].tolist(), strict=True)]


def _probe_row(media: bytes | None, every: bool) -> tuple:
    """Values of _PROBED behind the id, and those of all tracks if they are wanted."""
    if media is None:
        return (None,) * 12 + ("no media", None)
    form = (len(media), hashlib.sha256(media).hexdigest())
    try:
        found = tracks(media)
        x = _leading(found)
        payload = sample_bytes(media, x["offsets"], x["sizes"])
        ranges = _ranges(x)
        each = [{**{n: t[n] for n in ("track", "kind", "codec", "width", "height", "timescale", "duration")}, "n_samples": len(t["sizes"]), "keyframes": _ranges(t)} for t in found] if every else None
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return (*(None,) * 7, *form, *(None,) * 3, str(e), None)
    return (x["codec"], x["width"], x["height"], x["timescale"], x["duration"], len(x["sizes"]), ranges, *form, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), None, each)


def _probe(batches: Iterator[pa.RecordBatch], every: bool = True) -> Iterator[pa.RecordBatch]:
    schema = _SCHEMA.append(pa.field("tracks", pa.list_(_TRACK))) if every else _SCHEMA
    for part in chunks(batches, "media", 8 << 20):
        rows = [_probe_row(x, every) for x in part.column("media").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(schema)[1:]))], schema=schema)


def probe_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each row of df: what its container says, digests of the samples read back, and all its tracks."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(_probe, f"{_PROBED}, {_TRACKS}")


def media_digest(docs: DataFrame) -> DataFrame:
    """Contract columns: each text stored as media, read back and described."""
    stored = encode_media(docs)
    # The length without fill travels beside the container, so that no join is needed to bring it back.
    probed = stored.select(F.col("doc_id"), "n_bytes", "media").mapInArrow(_probe_with_length, "n_bytes long, " + _PROBED)
    keys = F.col("keyframes")
    feature = F.concat_ws(
        ";", F.col("codec"), F.concat_ws("x", "width", "height"), F.concat_ws("/", "duration", "timescale"),
        F.concat(F.lit("samples="), F.col("n_samples")), F.concat(F.lit("keys="), F.size(keys)),
        F.concat(F.lit("ranges="), F.sha2(F.to_json(keys), 256)),
    )
    return probed.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "codec", "duration", "timescale", "n_samples", "error")


def _probe_with_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "media", 8 << 20):
        for out in _probe(iter([part]), every=False):
            yield pa.RecordBatch.from_arrays([part.column("n_bytes"), *out.columns], names=["n_bytes", *out.schema.names])
