"""Files of byte formats, on whatever file system their path names, as tasks see them."""

from __future__ import annotations

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there.  A path without a scheme is local; hdfs, s3 and gs are known."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def scheme(path: str) -> str:
    """What is to be put before a path of the same file system to name it wholly."""
    return path.split("://")[0] + "://" if "://" in path else ""


def size_of(files: fs.FileSystem, path: str) -> int:
    """Bytes of a file; ``FileNotFoundError`` if there is none."""
    info = files.get_file_info(path)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def list_files(files: fs.FileSystem, path: str, ending: str) -> list[str]:
    """The files of a folder with that ending, hidden ones left out; the path itself if it is no folder."""
    if files.get_file_info(path).type != fs.FileType.Directory:
        return [path]
    found = files.get_file_info(fs.FileSelector(path))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(ending) and not f.base_name.startswith("."))
