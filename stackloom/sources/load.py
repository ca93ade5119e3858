"""One way in for files and folders: the reader is chosen by suffix."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from stackloom.sources import asd, files, h5jpk, jpk, npz
from stackloom.stack import FrameStack


def _no_spm(spark: SparkSession, folder: str | Path, channel: str) -> FrameStack:
    raise ValueError("folders of .spm files are not yet supported")


Reader = Callable[..., FrameStack]
FILE_READERS: dict[str, Reader] = {".h5-jpk": h5jpk.load, ".asd": asd.load, ".npz": npz.load}
FOLDER_READERS: dict[str, Reader] = {".jpk": jpk.load_folder, ".spm": _no_spm}


def folder_suffix(folder: str | Path, known: dict[str, Reader] = FOLDER_READERS) -> str:
    """.jpk if the folder has any, else its most frequent known suffix."""
    many = Counter(s for s in (Path(n).suffix.lower() for n in files.names(folder)) if s in known)
    if not many:
        raise FileNotFoundError(f"{folder} has none of {', '.join(known)}")
    return ".jpk" if ".jpk" in many else many.most_common(1)[0][0]


def file_suffix(path: str | Path) -> str:
    suffix = Path(str(path)).suffix.lower()
    if suffix in FILE_READERS:
        return suffix
    if suffix in FOLDER_READERS:
        raise ValueError(f"{suffix} files make a stack together: give their folder")
    raise ValueError(f"{suffix or 'no suffix'} is not supported")


def load_stack(spark: SparkSession, path: str | Path, channel: str = "height_trace") -> FrameStack:
    """From a local path or a URL."""
    there = files.kind(path)
    if there == "folder":
        return FOLDER_READERS[folder_suffix(path)](spark, path, channel)
    if there == "file":
        return FILE_READERS[file_suffix(path)](spark, path, channel)
    raise FileNotFoundError(f"there is nothing at {path}")
