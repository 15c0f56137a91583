"""ZIP archives on any file system: stored members are found through the central directory and
read by byte range, without extraction."""

from __future__ import annotations

import struct
import time
import zipfile
from typing import NamedTuple

from talkweave.llm.common import open_fs

TRIES = 4


class Member(NamedTuple):
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


def retried(read, tries: int = TRIES):
    """read(), again after a failure, with growing pauses; the last failure goes to the caller."""
    for k in range(tries):
        try:
            return read()
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(0.05 * 4**k)


class Archive:
    """One archive, opened for range reads."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.uri = uri
        self.file = retried(lambda: fs.open_input_file(path))
        self.size = self.file.size()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def at(self, offset: int, n: int) -> bytes:
        out = retried(lambda: self.file.read_at(n, offset))
        if len(out) != n:
            raise ValueError(f"{self.uri}: {n} bytes wanted at {offset}, {len(out)} there")
        return out

    def directory(self) -> tuple[int, int, int]:
        """Entries, bytes and offset of the central directory, by ZIP64 records where they are set."""
        tail = min(self.size, 65_557)
        end = self.at(self.size - tail, tail)
        k = end.rfind(b"PK\x05\x06")
        if k < 0:
            raise ValueError(f"{self.uri}: no end of central directory")
        entries, size, offset = struct.unpack_from("<HII", end, k + 10)
        place = self.size - tail + k
        if (entries == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF) and place >= 20:
            locator = self.at(place - 20, 20)
            if locator[:4] == b"PK\x06\x07":
                record = self.at(struct.unpack_from("<Q", locator, 8)[0], 56)
                if record[:4] != b"PK\x06\x06":
                    raise ValueError(f"{self.uri}: no ZIP64 end of central directory")
                entries, size, offset = struct.unpack_from("<QQQ", record, 32)
        return entries, size, offset

    def members(self) -> list[Member]:
        entries, size, offset = self.directory()
        raw, at, out = self.at(offset, size), 0, []
        for _ in range(entries):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError(f"{self.uri}: the central directory is damaged")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            crc, packed, full, n, m, c = struct.unpack_from("<IIIHHH", raw, at + 16)
            header = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, stop = at + 46 + n, at + 46 + n + m
            while extra + 4 <= stop:
                kind, length = struct.unpack_from("<HH", raw, extra)
                if kind == 1:  # ZIP64: only the fields that did not fit above, in this order
                    more, k = raw[extra + 4 : extra + 4 + length], 0
                    values = []
                    for v in (full, packed, header):
                        if v == 0xFFFFFFFF:
                            v = struct.unpack_from("<Q", more, k)[0]
                            k += 8
                        values.append(v)
                    full, packed, header = values
                extra += 4 + length
            out.append(Member(name, method, crc, packed, full, header))
            at += 46 + n + m + c
        return out

    def begins(self, m: Member) -> int:
        """Where a stored member's bytes begin."""
        if m.method:
            raise ValueError(f"{self.uri}: {m.name} is not stored")
        head = self.at(m.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{self.uri}: no member at {m.header}")
        n, extra = struct.unpack_from("<HH", head, 26)
        return m.header + 30 + n + extra


class Writing:
    """Archives of one attempt at a task, one after the other.

    The names carry the attempt, so attempts never touch each other's archives, in whatever order
    their rows came. Which archives count is what the table of their names says, and Spark commits
    that table for one attempt of each task only.
    """

    def __init__(self, folder: str, partition: int, attempt: int):
        self.fs, self.folder = open_fs(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.stem, self.count = f"part-{partition:06d}-{attempt}", 0

    def begin(self) -> zipfile.ZipFile:
        self.name = f"{self.stem}-{self.count:05d}.zip"
        self.count += 1
        self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}")
        return zipfile.ZipFile(_Stream(self.out), "w", zipfile.ZIP_STORED, allowZip64=True)

    def finish(self, archive: zipfile.ZipFile) -> str:
        archive.close()
        self.out.close()
        return self.name


class _Stream:
    """What zipfile needs of a file that can only be appended to."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass
