"""Zstandard files that can be read from the middle: independent frames of whole lines, and a table of them at the end.

The table is the format's usual one: a skippable frame with compressed and decompressed sizes and a footer with the number of frames.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from contextlib import nullcontext
from dataclasses import dataclass

import zstandard

#: Fixed values of the format.
SKIPPABLE, FOOTER, ENTRY = 0x184D2A5E, 0x8F92EAB1, 8
FRAME_BYTES = 64 << 10

#: (start, length) -> bytes of a file.
ReadRange = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Frame:
    index: int
    compressed_start: int
    compressed_length: int
    start: int
    length: int


def write(data: bytes | Iterator[bytes], path, frame_bytes: int = FRAME_BYTES, separator: bytes = b"\n", level: int = 3) -> list[Frame]:
    """Writes data to a path or an open file, in frames of at least frame_bytes that end at a separator (but for the last)."""
    frames: list[Frame] = []
    with open(path, "wb") if isinstance(path, str) else nullcontext(path) as out:
        held, start, at = b"", 0, 0

        def put(piece: bytes) -> None:
            nonlocal start, at
            packed = zstandard.ZstdCompressor(level=level, write_content_size=True).compress(piece)
            frames.append(Frame(len(frames), at, len(packed), start, len(piece)))
            out.write(packed)
            start, at = start + len(piece), at + len(packed)

        for piece in [data] if isinstance(data, bytes) else data:
            held += piece
            while (cut := held.find(separator, frame_bytes - 1)) >= 0:
                put(held[: cut + len(separator)])
                held = held[cut + len(separator) :]
        if held:
            put(held)
        table = b"".join(struct.pack("<II", f.compressed_length, f.length) for f in frames) + struct.pack("<IBI", len(frames), 0, FOOTER)
        out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
    return frames


def frames(read: ReadRange, size: int) -> list[Frame] | None:
    """The frames that the table lists, or None if the file has no table."""
    if size < 17:
        return None
    n, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
    entry = ENTRY + 4 * (flags >> 7)
    length = n * entry + 9
    if magic != FOOTER or size < length + 8 or struct.unpack("<II", read(size - length - 8, 8)) != (SKIPPABLE, length):
        return None
    table, out, at, start = read(size - length, n * entry), [], 0, 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, i * entry)
        out.append(Frame(i, at, packed, start, plain))
        at, start = at + packed, start + plain
    return out


def read_frame(read: ReadRange, frame: Frame) -> bytes:
    return zstandard.ZstdDecompressor().decompress(read(frame.compressed_start, frame.compressed_length), max_output_size=frame.length)


def whole(read: ReadRange, size: int, step: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed file from front to end, in pieces; for files without a table."""
    at, unpack = 0, zstandard.ZstdDecompressor().decompressobj()
    while at < size:
        piece = read(at, min(step, size - at))
        at += len(piece)
        while piece:
            if out := unpack.decompress(piece):
                yield out
            if not unpack.eof:
                break
            piece, unpack = unpack.unused_data, zstandard.ZstdDecompressor().decompressobj()


def ends_with_lines(read: ReadRange, listed: list[Frame]) -> bool:
    """Whether every frame but the last ends a line, as parallel reading needs; looks at the last of every frame, one at a time."""
    return all(read_frame(read, f).endswith(b"\n") for f in listed[:-1] if f.length)


def plan(data_size: int, read: ReadRange | None = None, listed: list[Frame] | None = None, chunk: int = 4 << 20) -> list[tuple[int, int]]:
    """(start, length) of what is read in parallel: the frames, or chunks of a plain file that end with a line."""
    if listed is not None:
        return [(f.start, f.length) for f in listed]
    out, start = [], 0
    while start < data_size:
        stop = min(data_size, start + chunk)
        if stop < data_size:
            back = stop
            while back > start and (cut := read(max(start, back - 4096), back - max(start, back - 4096)).rfind(b"\n")) < 0:
                back = max(start, back - 4096)
            stop = max(start, back - 4096) + cut + 1 if back > start else _next_line(read, stop, data_size)
        out.append((start, stop - start))
        start = stop
    return out


def _next_line(read: ReadRange, at: int, size: int) -> int:
    while at < size:
        piece = read(at, min(4096, size - at))
        if (cut := piece.find(b"\n")) >= 0:
            return at + cut + 1
        at += len(piece)
    return size
