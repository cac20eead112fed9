"""Files in the shared folder, written and range-read by tasks.

Paths are URIs, so the folder may be any store that pyarrow knows; the schemes
that Hadoop has for S3 are read as its own.  Credentials and endpoints are those
that pyarrow finds in the environment of driver and executors, not those of the
Spark session.  A task writes
under a name of its own attempt and hands the name out only with its rows; what a
lost task left behind is never read.
"""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub("^s3[an]://", "s3://", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Roller:
    """Appends to files of about `most` bytes below a folder; `place` gives the file and offset of what comes next.

    A file that is given a name is written under another one and moved when it is
    complete, so attempts that write the same file do not meet.
    """

    def __init__(self, folder: str, suffix: str, most: int):
        self.folder, self.suffix, self.most = folder, suffix, most
        self.uri, self.out, self.at, self._own = "", None, 0, ""

    def full(self) -> bool:
        return self.out is not None and self.at >= self.most

    def place(self, name: str = "") -> tuple[str, int, bool]:
        """File, offset, and whether the file is new; name is for a new one."""
        new = self.out is None or self.full()
        if new:
            self.close()
            self._own = f"{self.folder}/{uuid.uuid4().hex}{self.suffix}"
            self.uri = f"{self.folder}/{name}{self.suffix}" if name else self._own
            system, path = opened(self._own)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.out, self.at = system.open_output_stream(path, compression=None), 0
        return self.uri, self.at, new

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self, tail: bytes = b"") -> None:
        if self.out is not None:
            self.out.write(tail)
            self.out.close()
            self.out = None
            if self.uri != self._own:
                system, path = opened(self._own)
                to = opened(self.uri)[1]
                if system.get_file_info(to).type.name == "NotFound":
                    system.move(path, to)
                else:
                    system.delete_file(path)


class Ranges:
    """Reads byte ranges, keeping the last file open."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            self.close()
            system, path = opened(uri)
            self.file, self.uri = system.open_input_file(path), uri
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = self.uri = None
