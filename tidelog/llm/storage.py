"""Files in the shared folder, read and written by executors and the driver through one interface."""

from __future__ import annotations

from typing import BinaryIO
from urllib.parse import urlparse


#: Spark's names of object stores, and those that the file library knows.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def plain_uri(uri: str) -> str:
    """A folder as the file library names it. A dbfs: folder is a mounted local one."""
    scheme, colon, rest = uri.partition(":")
    if colon and scheme == "dbfs":
        return "/dbfs/" + rest.lstrip("/")
    return SCHEMES.get(scheme, scheme) + colon + rest


class Files:
    """Binary files under a folder given as a URI or a plain path. Local paths need no extra library; the libraries'
    own settings (environment, instance roles) give access to object stores."""

    def __init__(self, uri: str) -> None:
        uri = plain_uri(uri)
        parsed = urlparse(uri)
        if parsed.scheme in ("", "file"):
            self._remote, self.root = None, parsed.path
        else:
            from pyarrow import fs

            self._remote, self.root = fs.FileSystem.from_uri(uri)

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def create(self, name: str) -> BinaryIO:
        path = self._path(name)
        if self._remote is None:
            import os

            os.makedirs(os.path.dirname(path), exist_ok=True)
            return open(path, "wb")  # noqa: SIM115
        self._remote.create_dir(path.rpartition("/")[0], recursive=True)
        return self._remote.open_output_stream(path)

    def open(self, name: str) -> BinaryIO:
        """A file that can seek; reads fetch only the ranges asked for."""
        path = self._path(name)
        return open(path, "rb") if self._remote is None else self._remote.open_input_file(path)  # noqa: SIM115

    def list(self, suffix: str) -> list[tuple[str, int]]:
        """(name, size) of the files with this suffix, by name."""
        if self._remote is None:
            import os

            found = [(e.name, e.stat().st_size) for e in os.scandir(self.root) if e.is_file()]
        else:
            from pyarrow import fs

            found = [(f.base_name, f.size) for f in self._remote.get_file_info(fs.FileSelector(self.root)) if f.is_file]
        return sorted(x for x in found if x[0].endswith(suffix))
