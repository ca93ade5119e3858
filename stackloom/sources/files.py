"""Files at any URL that pyarrow opens (local, s3, gs, hdfs and viewfs), on the driver and on executors."""

from __future__ import annotations

from pathlib import Path

from pyarrow import fs


def at(url: str | Path) -> tuple[fs.FileSystem, str]:
    """The file system of a URL or local path, and the path in it."""
    url = str(url)
    if "://" in url or url.startswith("file:"):
        return fs.FileSystem.from_uri(url)
    return fs.LocalFileSystem(), str(Path(url).absolute())


def kind(url: str | Path) -> str:
    """folder, file or nothing."""
    where, path = at(url)
    return {fs.FileType.Directory: "folder", fs.FileType.File: "file"}.get(where.get_file_info(path).type, "nothing")


def names(folder: str | Path) -> list[str]:
    """Names of the files right in a folder, in order."""
    where, path = at(folder)
    return sorted(f.base_name for f in where.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File)


def inside(folder: str | Path, name: str) -> str:
    return f"{str(folder).rstrip('/')}/{name}"


def read(url: str | Path) -> bytes:
    where, path = at(url)
    with where.open_input_stream(path) as f:
        return f.read()


def write(url: str | Path, data: bytes) -> None:
    where, path = at(url)
    with where.open_output_stream(path) as f:
        f.write(data)
