"""Names of output files and folders."""

from __future__ import annotations

from pathlib import Path

NOT_IN_NAMES = '\\/:*?"<>|'
NOT_IN_FOLDERS = '*?"<>|'


def output_name(name: str | None, default: str) -> str:
    """The stem of a name without folders; the default for an empty one."""
    stem = Path(name.strip()).stem if name and name.strip() else default
    if found := {ch for ch in stem if ch in NOT_IN_NAMES}:
        raise ValueError(f"a file name can't hold {' '.join(sorted(found))}")
    return stem


def output_folder(folder: str | Path | None, default: str = "output") -> Path:
    """The folder, made if it isn't there."""
    text = str(folder).strip() if folder is not None else ""
    path = Path(text or default).expanduser().resolve()
    if any(ch in NOT_IN_FOLDERS for part in path.parts for ch in part):
        raise ValueError(f"a folder name can't hold any of {NOT_IN_FOLDERS}")
    path.mkdir(parents=True, exist_ok=True)
    return path
