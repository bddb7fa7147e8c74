"""Random access to files by path or URI, on the driver and in tasks: local and mounted paths, and what pyarrow's file systems open."""

from __future__ import annotations

import posixpath
import re
from fnmatch import fnmatch

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+://", path) else (fs.LocalFileSystem(), path)


def size_of(path: str) -> int:
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return info.size


def read_at(path: str, offset: int, n: int) -> bytes:
    system, at = opened(path)
    with system.open_input_file(at) as f:
        return f.read_at(n, offset)


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files with a suffix that a path names: a file, a folder with what is below it, or a pattern whose stars
    stand within the last folders. In order of path; none is an error."""
    system, at = opened(path)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    if any(c in at for c in "*?["):
        parts = at.split("/")
        k = next(i for i, p in enumerate(parts) if any(c in p for c in "*?["))
        top, keep = "/".join(parts[:k]) or ".", lambda p: len(p.split("/")) == len(parts) and all(map(fnmatch, p.split("/"), parts))
    else:
        top, keep = at, lambda p: True
    info = system.get_file_info(top)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(top, recursive=True)) if info.type == fs.FileType.Directory else []
    hidden = lambda p: any(x.startswith(("_", ".")) and x not in (".", "..") for x in posixpath.relpath(p, top).split("/"))
    out = sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffix) and keep(f.path) and not (f is not info and hidden(f.path)))
    if not out:
        raise FileNotFoundError(f"no *{suffix} in {path}")
    return out
