from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest

from yieldgate.llm import media


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 6912, 6913, 100_001])
def test_round_trip(n):
    data = bytes(range(256)) * (n // 256 + 1)
    data = data[:n]
    box = media.mux(data)
    x = media.demux(box)
    back = media.sample_bytes(box, x["offsets"], x["sizes"])
    assert len(back) % 576 == 0 and len(back) >= 576 and back[:n] == data and set(back[n:]) <= {255}
    assert x["codec"] == "raw" and (x["width"], x["height"]) == (24, 24) and x["duration"] == len(back) // 576
    assert x["keys"].tolist() == list(range(0, len(back) // 576, 12))


def test_other_tables():
    """Sizes of their own, uneven chunks out of order, 64-bit offsets."""
    full, box = media._full, media._box
    import struct

    body = b"AAAABBBBBBCCDDDDDDDD"
    sizes = [4, 6, 2, 8]
    def file(at):
        stbl = box(b"stbl", media._STSD, full(b"stsz", struct.pack(">II4I", 0, 4, *sizes)), full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 1, 1)), full(b"co64", struct.pack(">I3Q", 3, at + 0, at + 10, at + 12)))
        return box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 50, 0, 0)), box(b"minf", stbl))))
    head = file(0)
    x = media.demux(file(len(head) + 8) + box(b"mdat", body))
    whole = file(len(head) + 8) + box(b"mdat", body)
    assert media.sample_bytes(whole, x["offsets"], x["sizes"]) == body
    assert x["sizes"].tolist() == sizes and x["keys"].tolist() == [0, 1, 2, 3]


def _track(number, kind, codec, ticks, *tables):
    stsd = media._full(b"stsd", struct.pack(">I", 1), media._ENTRY.replace(b"raw ", codec))
    mdia = media._box(b"mdia", media._full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, ticks, 0, 0)), media._full(b"hdlr", bytes(4), kind, bytes(12), b"x\0"), media._box(b"minf", media._box(b"stbl", stsd, *tables)))
    return media._box(b"trak", media._full(b"tkhd", struct.pack(">IIIII", 0, 0, number, 0, 0), bytes(60)), mdia)


def _tables(sizes, at, *more, wide=False):
    places = media._full(b"co64", struct.pack(">IQ", 1, at)) if wide else media._full(b"stco", struct.pack(">II", 1, at))
    return media._full(b"stsz", struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes)), media._full(b"stsc", struct.pack(">IIII", 1, 1, len(sizes), 1)), places, *more


_NONE = (media._full(b"stsz", bytes(8)), media._full(b"stsc", bytes(4)), media._full(b"stco", bytes(4)))


def test_two_tracks_keep_their_tables(spark):
    """The second has 64-bit offsets and keyframes of its own; the first has neither."""
    sync = media._full(b"stss", struct.pack(">II", 1, 2))
    def head(at):
        return media._box(b"moov", _track(1, b"soun", b"mp4a", 70, *_tables([3, 4], at)), _track(2, b"vide", b"avc1", 90, *_tables([5, 2], at + 7, sync, wide=True)))
    at = len(head(0)) + 8
    whole = head(at) + media._box(b"mdat", b"aaabbbbcccccdd")
    sound, video = media.tracks(whole)
    assert media.sample_bytes(whole, sound["offsets"], sound["sizes"]) == b"aaabbbb" and sound["keys"].tolist() == [0, 1]
    assert media.sample_bytes(whole, video["offsets"], video["sizes"]) == b"cccccdd" and video["keys"].tolist() == [1]
    row = media.probe_media(spark.createDataFrame([(1, bytearray(whole))], "doc_id long, media binary")).first()
    assert (row["codec"], row["width"], row["duration"]) == ("mp4a", None, 70)
    assert [(t["track"], t["kind"], t["codec"], t["width"], t["duration"], [tuple(k) for k in t["keyframes"]]) for t in row["tracks"]] == [
        (1, "soun", "mp4a", None, 70, [(at, 3), (at + 3, 4)]), (2, "vide", "avc1", 24, 90, [(at + 12, 2)])]


def test_fragments():
    """Runs with sizes of their own, then with the usual ones; the first sample of each is a keyframe."""
    trex = media._full(b"trex", struct.pack(">IIIII", 1, 1, 10, 6, 0x10000))
    moov = media._box(b"moov", _track(1, b"vide", b"avc1", 0, *_NONE), media._box(b"mvex", trex))
    def moof(at):
        runs = media._full(b"trun", struct.pack(">IiIIIII", 2, at, 0, 20, 3, 30, 4), flags=0x305), media._full(b"trun", struct.pack(">I", 1))
        return media._box(b"moof", media._full(b"mfhd", bytes(4)), media._box(b"traf", media._full(b"tfhd", struct.pack(">I", 1), flags=0x20000), *runs))
    one = moof(len(moof(0)) + 8) + media._box(b"mdat", b"aaabbbbcccccc")
    x = media.demux(moov + one + one)
    whole = moov + one + one
    assert media.sample_bytes(whole, x["offsets"], x["sizes"]) == b"aaabbbbcccccc" * 2
    assert x["sizes"].tolist() == [3, 4, 6] * 2 and x["keys"].tolist() == [0, 3] and x["duration"] == 2 * (20 + 30 + 10)


def test_short_sizes():
    sizes = media._full(b"stz2", struct.pack(">II", 4, 3), bytes([0x12, 0x30]))
    moov = media._box(b"moov", _track(1, b"vide", b"avc1", 5, sizes, *_tables([1, 2, 3], 0)[1:]))
    assert media.demux(moov)["sizes"].tolist() == [1, 2, 3]


_DEEP = b""
for _ in range(40):
    _DEEP = media._box(b"moov", _DEEP)
_HOSTILE = [
    _DEEP,
    media._box(b"moov", _track(1, b"vide", b"avc1", 5, media._full(b"stsz", struct.pack(">II", 1, 0xFFFFFFFF)), *_tables([1], 0)[1:])),
    media._box(b"moov", _track(1, b"vide", b"avc1", 5, *_tables([1], 0, media._full(b"stss", struct.pack(">II", 1, 0))))),
    media._box(b"moov", _track(1, b"vide", b"avc1", 5, *_NONE)) + media._box(b"moof", media._box(b"traf", media._full(b"tfhd", struct.pack(">I", 1)), media._full(b"trun", struct.pack(">I", 0xFFFFFFFF)))),
]


@pytest.mark.parametrize("bad", [*_HOSTILE, b"", b"\0\0\0\x10ftyp", media.mux(b"x")[:700], b"\0\0\0\x04moov", media.mux(b"y").replace(b"stsz", b"stsy")])
def test_broken(spark, bad):
    row = media.probe_media(spark.createDataFrame([(1, bytearray(bad))], "doc_id long, media binary")).first()
    assert row["error"] and row["codec"] is None


def test_probe_nulls(spark):
    row = media.probe_media(spark.createDataFrame([(None, None)], "doc_id long, media binary")).first()
    assert row["error"] == "no media" and row["media_bytes"] is None


def test_digest(docs, empty, rows):
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.media_digest(docs).collect()}
    for i, t in rows:
        data = (t or "").encode()
        padded = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = got[(i, len(data))]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert r["media_sha256"] == hashlib.sha256(media.mux(data)).hexdigest() and r["error"] is None
    same = [r for r in got.values() if r["doc_id"] in (0, 4)]
    assert len({(r["media_sha256"], r["feature"]) for r in same}) == 1
    assert media.media_digest(empty).count() == 0
    assert np.array(len(got)) > 10
