"""Files of any store that Arrow knows, by URI or local path, from the driver or an executor."""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it)."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def opened(path: str):
    """A readable, seekable file."""
    files, where = place(path)
    return files.open_input_file(where)


def listed(path: str, suffix: str) -> list[str]:
    """``path`` itself if it is a file, else the files below it whose names end in ``suffix``, sorted; paths keep their scheme."""
    files, where = place(path)
    info = files.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = sorted(f.path for f in files.get_file_info(fs.FileSelector(where, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(suffix))
    return [path.rstrip("/") + f[len(where.rstrip("/")) :] for f in found]


def written(folder: str, name: str, data: bytes) -> str:
    """Writes a file under a name of its own and moves it to its place, so that a repeated task leaves one whole file; returns its path."""
    files, where = place(folder)
    files.create_dir(where, recursive=True)
    with files.open_output_stream(own := f"{where}/_{uuid.uuid4().hex}") as out:
        out.write(data)
    files.move(own, f"{where}/{name}")
    return f"{folder.rstrip('/')}/{name}"
