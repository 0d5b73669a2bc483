"""JPEG files of images: baseline, colours at full resolution, Huffman codes made for each image."""

from __future__ import annotations

import heapq
import struct
from itertools import count

import numpy as np

# The common quantisation of brightness and of colours at quality 50, row by row.
LUMA = (
    (16, 11, 10, 16, 24, 40, 51, 61), (12, 12, 14, 19, 26, 58, 60, 55), (14, 13, 16, 24, 40, 57, 69, 56), (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77), (24, 35, 55, 64, 81, 104, 113, 92), (49, 64, 78, 87, 103, 121, 120, 101), (72, 92, 95, 98, 112, 100, 103, 99),
)
CHROMA = (
    (17, 18, 24, 47, 99, 99, 99, 99), (18, 21, 26, 66, 99, 99, 99, 99), (24, 26, 56, 99, 99, 99, 99, 99), (47, 66, 99, 99, 99, 99, 99, 99),
    (99, 99, 99, 99, 99, 99, 99, 99), (99, 99, 99, 99, 99, 99, 99, 99), (99, 99, 99, 99, 99, 99, 99, 99), (99, 99, 99, 99, 99, 99, 99, 99),
)

#: Places of a block along its diagonals, to and fro.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_K = np.arange(8)
#: The discrete cosine transform of eight numbers.
DCT = np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16))
LONGEST = 16


def quantisation(table: tuple, quality: int) -> np.ndarray:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * scale + 50) // 100, 1, 255).astype(int)


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Lengths, 16 at most, of a prefix code for the symbols that occur; no code is all ones, which a reserved symbol takes."""
    order = count()
    heap = [(int(n), next(order), [s]) for s, n in enumerate(counts) if n] + [(0, -1, [len(counts)])]
    heapq.heapify(heap)
    length = {s: 0 for _, _, symbols in heap for s in symbols}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], next(order), a[2] + b[2]))
    # shorten codes that are too long, in favour of the frequent ones, until the lengths make a prefix code again
    ranked = sorted(length, key=lambda s: (length[s], -(counts[s] if s < len(counts) else 0), s))
    lengths = [min(length[s], LONGEST) for s in ranked]
    room = sum(1 << (LONGEST - n) for n in lengths) - (1 << LONGEST)
    k = len(lengths) - 1
    while room > 0:
        while lengths[k] == LONGEST:
            k -= 1
        room -= 1 << (LONGEST - lengths[k] - 1)
        lengths[k] += 1
        k = len(lengths) - 1
    lengths.sort()
    ranked.remove(len(counts))
    return dict(zip(ranked, lengths[:-1], strict=True))


def canonical(lengths: dict[int, int]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(symbols in the order of their codes, codes and lengths by symbol)."""
    symbols = list(lengths)  # short ones first
    codes, sizes, code, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in symbols:
        code <<= lengths[s] - last
        codes[s], sizes[s], last = code, lengths[s], lengths[s]
        code += 1
    return symbols, codes, sizes


def _blocks(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)


def coefficients(bgr: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """(3 n, 64) quantised coefficients along the diagonals, the three planes of a block one after another."""
    h, w = bgr.shape[:2]
    x = np.pad(bgr.astype(float), ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    b, g, r = x[..., 0], x[..., 1], x[..., 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [y - 128, (b - y) / 1.772, (r - y) / 1.402]
    out = [np.rint(DCT @ _blocks(p) @ DCT.T / t).astype(np.int64).reshape(-1, 64)[:, ZIGZAG] for p, t in zip(planes, tables, strict=True)]
    return np.stack(out, axis=1).reshape(-1, 64)


def _bits(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of bits, bits) of values: negative ones as their value less one."""
    size = np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)
    return size, np.where(v < 0, v + (1 << size) - 1, v)


def tokens(coefs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(table, symbol, bits, number of bits) in the order of the file; tables are 0 and 1 for first coefficients, 2 and 3 for the others."""
    n = len(coefs)
    first = coefs[:, 0].copy()
    first[3:] -= coefs[:-3, 0]
    size, bits = _bits(first)
    block, at = np.nonzero(coefs[:, 1:])
    at = at + 1
    before = np.where(np.r_[True, block[1:] != block[:-1]], 0, np.r_[0, at[:-1]]) if len(at) else at
    run = at - before - 1
    asize, abits = _bits(coefs[block, at])
    long = np.repeat(np.arange(len(at)), run // 16)
    end = np.flatnonzero(coefs[:, 63] == 0)
    colour = lambda k: (k % 3 > 0).astype(int)
    zero = lambda k: np.zeros(len(k), np.int64)
    place = np.concatenate([np.arange(n) * 200, block * 200 + 2 * at + 1, block[long] * 200 + 2 * at[long], end * 200 + 199])
    table = np.concatenate([colour(np.arange(n)), 2 + colour(block), 2 + colour(block[long]), 2 + colour(end)])
    symbol = np.concatenate([size, run % 16 * 16 + asize, zero(long) + 0xF0, zero(end)])
    order = np.argsort(place, kind="stable")
    return table[order], symbol[order], np.concatenate([bits, abits, zero(long), zero(end)])[order], np.concatenate([size, asize, zero(long), zero(end)])[order]


def _packed(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Numbers one after another with their lengths in bits, filled up with ones; a byte of ones is followed by zeros."""
    start = np.r_[0, np.cumsum(lengths)]
    out = np.ones(-(-start[-1] // 8) * 8, np.uint8)
    for k in range(int(lengths.max(initial=0))):
        some = lengths > k
        out[start[:-1][some] + k] = values[some] >> (lengths[some] - 1 - k) & 1
    return np.packbits(out).tobytes().replace(b"\xff", b"\xff\0")


def jpeg(bgr: np.ndarray, quality: int = 95) -> bytes:
    """A JPEG file of an image (height, width, 3)."""
    if not 1 <= quality <= 100 or not bgr.size:
        raise ValueError("quality must be from 1 to 100, the image not empty")
    tables = [quantisation(LUMA, quality), quantisation(CHROMA, quality)]
    table, symbol, bits, n_bits = tokens(coefficients(bgr, [tables[0], tables[1], tables[1]]))
    part = lambda mark, data: b"\xff" + bytes([mark]) + struct.pack(">H", len(data) + 2) + data
    out = [b"\xff\xd8", part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    out += [part(0xDB, bytes([k]) + bytes(t.reshape(64)[ZIGZAG].tolist())) for k, t in enumerate(tables)]
    out.append(part(0xC0, struct.pack(">BHHB", 8, bgr.shape[0], bgr.shape[1], 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])))
    code, size = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64)
    for k in range(4):
        own = table == k
        symbols, codes, sizes = canonical(code_lengths(np.bincount(symbol[own], minlength=256)))
        code[own], size[own] = codes[symbol[own]], sizes[symbol[own]]
        out.append(part(0xC4, bytes([(k >> 1) << 4 | k & 1]) + bytes(np.bincount(sizes[symbols], minlength=17)[1:17].tolist()) + bytes(symbols)))
    out.append(part(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])))
    pairs = lambda a, b: np.stack([a, b], axis=1).reshape(-1)
    return b"".join([*out, _packed(pairs(code, bits), pairs(size, n_bits)), b"\xff\xd9"])
