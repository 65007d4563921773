"""Binary files in the shared folder, by URI, from inside tasks."""

from __future__ import annotations

import re

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; Hadoop writes local ones as `file:/path`."""
    local = re.match(r"(?:file:)?(/+.*)", uri)
    if local:
        return fs.LocalFileSystem(), "/" + local[1].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts) -> int:
    """Write parts of bytes to a new name, then move it into place: a task that runs twice leaves one whole file."""
    system, path = locate(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    import uuid

    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    size = 0
    with system.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    system.move(draft, path)
    return size


class RangeReader:
    """Reads ranges of a file."""

    def __init__(self, uri: str):
        system, path = locate(uri)
        self._file = system.open_input_file(path)
        self.size = self._file.size()

    def read(self, start: int, length: int) -> bytes:
        return self._file.read_at(length, start)

    def close(self) -> None:
        self._file.close()
