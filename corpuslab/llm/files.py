"""Files that tasks write themselves: temporary name first, then the final one."""

from __future__ import annotations

from pyspark import TaskContext


def file_system(uri: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class Sink:
    """One file of a task. A retry writes the same bytes under the same final name."""

    def __init__(self, folder: str, name: str):
        self.fs, root = file_system(folder)
        self.fs.create_dir(root, recursive=True)
        self.final = f"{root}/{name}"
        self.temporary = f"{root}/_{name}.{TaskContext.get().taskAttemptId()}.tmp"
        self.stream = self.fs.open_output_stream(self.temporary)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def commit(self) -> None:
        from pyarrow import fs

        self.stream.close()
        if self.fs.get_file_info(self.final).type == fs.FileType.File:
            self.fs.delete_file(self.final)
        self.fs.move(self.temporary, self.final)
