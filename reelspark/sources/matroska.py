"""Headers of Matroska and WebM files: elements with variable-length ids and sizes, frames counted by a walk over clusters."""

from __future__ import annotations

import struct
from dataclasses import dataclass

MAGIC = b"\x1a\x45\xdf\xa3"

# Ids of the format's elements.
SEGMENT, INFO, TRACKS, CLUSTER, BLOCK_GROUP = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0xA0
SIMPLE_BLOCK, BLOCK = 0xA3, 0xA1
SCALE, DURATION = 0x2AD7B1, 0x4489
ENTRY, NUMBER, KIND, CODEC, FRAME_NS, VIDEO, WIDTH, HEIGHT = 0xAE, 0xD7, 0x83, 0x86, 0x23E383, 0xE0, 0xB0, 0xBA
#: Four letters of the codecs that browsers play; others give none.
CODECS = {"V_VP8": "VP80", "V_VP9": "VP90", "V_AV1": "AV01", "V_MPEG4/ISO/AVC": "H264", "V_MPEGH/ISO/HEVC": "HEVC", "V_MPEG4/ISO/ASP": "MP4V", "V_MJPEG": "MJPG", "V_THEORA": "THEO"}

#: Walked through as if their content stood in their parent: their sizes needn't be known.
_OPEN = {SEGMENT, CLUSTER, BLOCK_GROUP}


def number(content: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(value, next place) of a variable-length number; None for a size of ones only, which means unknown."""
    if at >= len(content) or not content[at]:
        raise ValueError("broken number")
    length = 9 - content[at].bit_length()
    if at + length > len(content):
        raise ValueError("cut number")
    value = int.from_bytes(content[at : at + length], "big")
    if keep_marker:
        return value, at + length
    value &= (1 << 7 * length) - 1
    return (None if value == (1 << 7 * length) - 1 else value), at + length


def children(content: bytes, at: int, end: int) -> dict[int, list[tuple[int, int]]]:
    """Where the elements between two places lie, by id."""
    out: dict[int, list[tuple[int, int]]] = {}
    while at < end:
        name, at = number(content, at, True)
        size, at = number(content, at)
        if size is None or at + size > end:
            raise ValueError("element beyond its parent")
        out.setdefault(name, []).append((at, at + size))
        at += size
    return out


def _whole(content: bytes, found: dict[int, list[tuple[int, int]]], name: int, default: int = 0) -> int:
    if name not in found:
        return default
    a, b = found[name][0]
    return int.from_bytes(content[a:b], "big")


def _real(content: bytes, found: dict[int, list[tuple[int, int]]], name: int) -> float:
    if name not in found:
        return 0.0
    a, b = found[name][0]
    return struct.unpack(">f" if b - a == 4 else ">d", content[a:b])[0] if b - a in (4, 8) else 0.0


@dataclass
class _Track:
    number: int
    width: int
    height: int
    codec: str
    frame_ns: int


def _video_track(content: bytes, at: int, end: int) -> _Track | None:
    for a, b in children(content, at, end).get(ENTRY, []):
        found = children(content, a, b)
        if _whole(content, found, KIND) != 1 or VIDEO not in found:
            continue
        inner = children(content, *found[VIDEO][0])
        codec = content[slice(*found[CODEC][0])].decode("ascii", "replace").rstrip("\0") if CODEC in found else ""
        return _Track(_whole(content, found, NUMBER), _whole(content, inner, WIDTH), _whole(content, inner, HEIGHT), codec, _whole(content, found, FRAME_NS))
    return None


def _frames_in(content: bytes, at: int, end: int, track: int) -> int:
    """Frames of ``track`` in a block: one, or as many as its lace has."""
    own, at = number(content, at)
    if own != track or at + 3 > end:
        return 0
    laced = content[at + 2] & 0x06
    return content[at + 3] + 1 if laced and at + 3 < end else 1


def matroska_header(content: bytes) -> tuple[float, int, int, int, int]:
    """(fps, frames, width, height, fourcc) of a Matroska or WebM file's first video track.

    The rate is the track's time per frame, or else the number of frames in the file's duration. A block that the file's end
    cuts off isn't a frame. Without a video track, or with broken elements before the first cluster, it is an error.
    """
    if content[:4] != MAGIC:
        raise ValueError("not a Matroska file")
    at, track, seconds, frames = 0, None, 0.0, 0
    while at < len(content):
        try:
            name, start = number(content, at, True)
            size, start = number(content, start)
        except ValueError:
            if track is None:
                raise
            break  # a cut file's end
        if name in _OPEN:
            at = start
            continue
        if size is None:
            raise ValueError("unknown size")
        end = start + size
        if end > len(content):
            if track is None:
                raise ValueError("cut before the tracks' end")
            break
        if name == INFO:
            found = children(content, start, end)
            seconds = _real(content, found, DURATION) * _whole(content, found, SCALE, 1_000_000) / 1e9
        elif name == TRACKS and track is None:
            track = _video_track(content, start, end)
            if track is None:
                raise ValueError("no video track")
        elif name in (SIMPLE_BLOCK, BLOCK) and track is not None:
            frames += _frames_in(content, start, end, track.number)
        at = end
    if track is None:
        raise ValueError("no video track")
    fps = 1e9 / track.frame_ns if track.frame_ns else frames / seconds if seconds > 0 else 0.0
    letters = CODECS.get(track.codec, "")
    return fps, frames, track.width, track.height, int.from_bytes(letters.encode(), "little")
