"""Matroska and WebM headers of crafted files."""

from __future__ import annotations

import struct

import pytest

from reelspark.sources import files
from reelspark.sources import matroska as M


def _size(n, length=None):
    length = length or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * length).to_bytes(length, "big")


def _el(name, *parts, unknown=False):
    body = b"".join(parts)
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + (b"\x01" + b"\xff" * 7 if unknown else _size(len(body))) + body


def _n(name, value):
    return _el(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _block(track, name=M.SIMPLE_BLOCK, flags=0x80, data=b"picture"):
    return _el(name, _size(track), struct.pack(">hB", 0, flags), data)


def _webm(n=10, frame_ns=40_000_000, seconds=None, codec=b"V_VP9", unknown=False, lace=False, video=True):
    head = _el(0x1A45DFA3, _el(0x4282, b"webm"))
    info = _el(M.INFO, _n(M.SCALE, 1_000_000), *([_el(M.DURATION, struct.pack(">d", seconds * 1000))] if seconds else []))
    sound = _el(M.ENTRY, _n(M.NUMBER, 1), _n(M.KIND, 2), _el(M.CODEC, b"A_OPUS"))
    picture = _el(M.ENTRY, _n(M.NUMBER, 2), _n(M.KIND, 1), _el(M.CODEC, codec), *([_n(M.FRAME_NS, frame_ns)] if frame_ns else []), _el(M.VIDEO, _n(M.WIDTH, 640), _n(M.HEIGHT, 360)))
    tracks = _el(M.TRACKS, sound, *([picture] if video else []))
    clusters = []
    for k in range(0, n, 4):
        inner = [_n(0xE7, 40 * k)]
        for i in range(k, min(n, k + 4)):
            inner += [_block(1, data=b"sound"), _block(2) if i % 2 else _el(M.BLOCK_GROUP, _block(2, M.BLOCK, 0), _n(0x9B, 40))]
        clusters.append(_el(M.CLUSTER, *inner, unknown=unknown))
    if lace:
        clusters.append(_el(M.CLUSTER, _n(0xE7, 0), _block(2, flags=0x04, data=b"\x02" + b"three")))
    return head + _el(M.SEGMENT, _el(0xEC, b"\0" * 20), info, tracks, *clusters, _el(0x1C53BB6B, b"cues"), unknown=unknown)


def test_numbers():
    assert M.number(b"\x81", 0) == (1, 1) and M.number(b"\x40\x02", 0) == (2, 2) and M.number(b"\xff", 0) == (None, 1)
    assert M.number(b"\x1a\x45\xdf\xa3", 0, True) == (0x1A45DFA3, 4)
    for broken in (b"", b"\0\1", b"\x40"):
        with pytest.raises(ValueError):
            M.number(broken, 0)
    for n in (0, 1, 126, 127, 128, 16382, 16383, 1 << 40):
        assert M.number(_size(n), 0) == (n, len(_size(n)))


@pytest.mark.parametrize("unknown", [False, True])
def test_frames_of_the_video_track_are_counted(unknown):
    fps, frames, width, height, code = M.matroska_header(_webm(11, unknown=unknown))
    assert (fps, frames, width, height, code.to_bytes(4, "little")) == (25.0, 11, 640, 360, b"VP90")
    assert M.matroska_header(_webm(11, lace=True, unknown=unknown))[1] == 14


def test_rate_by_duration_or_none():
    assert M.matroska_header(_webm(30, frame_ns=0, seconds=2.0))[0] == 15.0
    assert M.matroska_header(_webm(30, frame_ns=0))[0] == 0.0
    assert M.matroska_header(_webm(3, codec=b"V_OTHER"))[4] == 0


def test_cut_files_have_the_frames_before_the_cut():
    whole = _webm(12)
    counts = []
    for at in range(len(whole)):
        try:
            counts.append(M.matroska_header(whole[:at])[1])
        except ValueError:
            assert not counts  # only before the tracks' end
    assert counts == sorted(counts) and counts[0] == 0 and counts[-1] == 12 and len(set(counts)) == 13


def test_ingest_reads_both_kinds_of_names(spark, tmp_path):
    for name, content in (("a.mkv", _webm(50)), ("b.webm", _webm(0)), ("c.webm", _webm(video=False)), ("d.mkv", _webm()[:60]), ("e.mkv", M.MAGIC), ("f.webm", _webm(20, frame_ns=0))):
        (tmp_path / name).write_bytes(content)
    got = {r.filename: r for r in files.ingest(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    a = got["a.mkv"]
    assert (a.fps, a.total_frames, a.width, a.height, a.codec, a.duration, a.error) == (25.0, 50, 640, 360, "VP90", 2.0, None)
    assert {n: got[n].error for n in got if n != "a.mkv"} == {"b.webm": "no frames", "c.webm": "cannot be opened", "d.mkv": "cannot be opened", "e.mkv": "cannot be opened", "f.webm": "no frames"}
