"""Folders of any file system that pyarrow opens, for sources that read and write files by themselves."""

from __future__ import annotations

import os
import re
import uuid

from pyarrow import fs as pafs


class Folder:
    """A folder of any file system that pyarrow opens by URI; a plain path is a local one."""

    def __init__(self, path: str):
        path = re.sub(r"^file:/*", "file:///", path) if path.startswith("file:") else path
        self.fs, self.root = pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))

    def at(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str = "") -> bool:
        return self.fs.get_file_info(self.at(name)).type != pafs.FileType.NotFound

    def read(self, name: str) -> bytes | None:
        """The bytes of a file, or None if there is no such file."""
        try:
            with self.fs.open_input_stream(self.at(name), compression=None) as f:
                return f.read()
        except (FileNotFoundError, NotADirectoryError):
            return None

    def write(self, name: str, data: bytes) -> None:
        """The file has its name only when it is whole."""
        hidden = f"{os.path.dirname(self.at(name))}/.{uuid.uuid4().hex}"
        self.fs.create_dir(os.path.dirname(hidden), recursive=True)
        with self.fs.open_output_stream(hidden, compression=None) as f:
            f.write(data)
        self.fs.move(hidden, self.at(name))

    def names(self, name: str = "", deep: bool = False) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(self.at(name), allow_not_found=True, recursive=deep))
        return sorted(os.path.relpath(i.path, self.at(name)) for i in found)

    def size(self, name: str) -> int | None:
        """The length of a file, or None if there is no such file."""
        return self.fs.get_file_info(self.at(name)).size

    def move(self, old: str, new: str) -> None:
        self.fs.move(self.at(old), self.at(new))

    def remove(self, name: str) -> None:
        self.fs.delete_dir(self.at(name))
