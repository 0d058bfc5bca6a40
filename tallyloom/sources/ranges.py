"""Parts of files by byte range, from any store that pyarrow opens (local, HDFS, S3 and others)."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes read at once.
PIECE = 1 << 20


def store(uri: str):
    """The file system of ``uri`` and the path in it; a path without a scheme is local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def read_range(file, begin: int, end: int) -> bytes:
    """Bytes [begin, end) of an open file, fewer if it is shorter."""
    file.seek(begin)
    return file.read(max(end - begin, 0))


def lines_between(file, begin: int, end: int, inside: bool = False) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the lines that start in [begin, end), each without its newline.

    The last of them is read to its newline, past ``end`` if need be. ``inside``: begin
    need not be a line's start; then what belongs to the line before is passed over.
    """
    at, rest = begin, b""
    if inside:
        at = begin - 1  # a newline just before begin makes begin a start
    file.seek(at)
    skipping = inside
    while True:
        # past the end, small steps suffice to finish a line
        piece = file.read(min(PIECE, end - at - len(rest)) if at + len(rest) < end else 1 << 16)
        data = rest + piece
        cut = 0
        while (k := data.find(b"\n", cut if cut else len(rest) if not skipping and rest else 0)) >= 0:
            if skipping:
                skipping = False
            elif at + cut >= end:
                return
            else:
                yield at + cut, data[cut:k]
            cut = k + 1
            if cut == len(data):
                break
        if skipping:
            at, rest = at + len(data), b""
        else:
            at, rest = at + cut, data[cut:]
        if not piece:
            if rest and not skipping and at < end:
                yield at, rest
            return
        if not skipping and at >= end:
            return


def last_newline(file, begin: int, end: int, piece: int = 1 << 16) -> int:
    """The place after the last newline in [begin, end), or ``begin`` without one; read backwards in pieces."""
    high = end
    while high > begin:
        low = max(begin, high - piece)
        k = read_range(file, low, high).rfind(b"\n")
        if k >= 0:
            return low + k + 1
        high = low
    return begin


def next_newline(file, begin: int, end: int, piece: int = 1 << 16) -> int:
    """The place after the first newline in [begin, end), or ``begin`` without one."""
    low = begin
    while low < end:
        high = min(low + piece, end)
        k = read_range(file, low, high).find(b"\n")
        if k >= 0:
            return low + k + 1
        low = high
    return begin
