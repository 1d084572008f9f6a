"""Files that tasks write to and read from the shared folder, on any store that pyarrow's file systems reach."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class RollingWriter:
    """Writes files of about ``limit`` bytes below ``root``.

    Every file has a random name, so what a lost or repeated task attempt has left is never read: readers take only
    the paths that the committed attempt returned.
    """

    def __init__(self, root: str, suffix: str, limit: int):
        self.root, self.suffix, self.limit = root, suffix, limit
        self.store, self.path = _at(root)
        self.store.create_dir(self.path, recursive=True)
        self.out, self.uri, self.size = None, "", 0

    def full(self) -> bool:
        return self.out is not None and self.size >= self.limit

    def write(self, data: bytes) -> int:
        """Append and give the offset at which the data begin."""
        if self.out is None:
            name = uuid.uuid4().hex + self.suffix
            self.uri, self.size = f"{self.root}/{name}", 0
            self.out = self.store.open_output_stream(f"{self.path}/{name}", compression=None)
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> tuple[str, int]:
        uri, size = self.uri, self.size
        if self.out is not None:
            self.out.close()
        self.out = None
        return uri, size


@contextlib.contextmanager
def opened(uri: str) -> Iterator:
    store, path = _at(uri)
    with store.open_input_file(path) as f:
        yield f
