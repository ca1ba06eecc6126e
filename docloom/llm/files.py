"""Binary files in a folder that all executors share, through Arrow's file systems."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, such as file:, hdfs:, s3: (also s3a:) or gs:."""
    for other in ("s3a://", "s3n://"):
        uri = "s3://" + uri[len(other) :] if uri.startswith(other) else uri
    if uri.startswith("file:/"):
        uri = "file:///" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class Writing:
    """A file that appears under its name when it is whole; a task that runs again replaces it by an equal one."""

    def __init__(self, uri: str):
        self.system, self.path = place(uri)
        self.system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.system.open_output_stream(self.part)

    def write(self, data) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.system.move(self.part, self.path)


def write_file(uri: str, data: bytes) -> None:
    own = Writing(uri)
    own.write(data)
    own.close()


def read_file(uri: str) -> bytes:
    system, path = place(uri)
    with system.open_input_file(path) as f:
        return f.read()
