"""File access by path or URI: listings through Spark's own file systems, ranges of bytes in
tasks through Arrow's."""

from __future__ import annotations

import fnmatch
import re

from pyarrow import fs
from pyspark.sql import SparkSession

# What Spark's file systems are called there.
_SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "dbfs:/": "/dbfs/", "wasbs://": "abfss://"}


def open_filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a plain path or URI, and the path inside it."""
    for scheme, other in _SCHEMES.items():
        if path.startswith(scheme):
            path = other + path[len(scheme):].lstrip("/")
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def is_glob(path: str) -> bool:
    return re.search(r"[*?\[{]", path) is not None


def glob_regex(name: str) -> str:
    """A regex for one component of a Hadoop glob."""
    out, depth, i = "", 0, 0
    while i < len(name):
        char = name[i]
        if char == "\\" and i + 1 < len(name):
            i += 1
            out += re.escape(name[i])
        elif char == "[" and "]" in name[i + 2:]:
            close = name.index("]", i + 2)
            inside = name[i + 1:close].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]"
            i = close
        elif char in "{}" or char == "," and depth:
            depth += {"{": 1, "}": -1}.get(char, 0)
            out += {"{": "(?:", "}": ")", ",": "|"}[char]
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(char, re.escape(char))
        i += 1
    return out


def places_of(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[tuple[str, str, str]]]:
    """Of configured paths (files, folders, globs on any file system that Spark reads) what to
    hand to a reader, and (configured path, folder, regex of names) to tell whose a file is.
    What is not there is left out. Asks for each configured path, not for the files in it."""
    context = spark.sparkContext
    hadoop, settings = context._jvm.org.apache.hadoop.fs.Path, context._jsc.hadoopConfiguration()
    roots, owners = [], []
    for path in sorted(set(paths)):
        place = hadoop(path.rstrip("/") or "/")
        files = place.getFileSystem(settings)
        folder, name = place.getParent(), place.getName()
        if files.exists(place):
            roots.append(re.sub(r"([\\*?\[\]{}])", r"\\\1", path))
            whole = files.getFileStatus(place).isDirectory()
            owners.append((path, place if whole else folder, ".*" if whole else re.escape(name)))
        elif is_glob(path) and (found := files.globStatus(place)):
            roots.append(path)
            folders = [status.getPath() for status in files.globStatus(folder)] if is_glob(str(folder)) else [folder]
            owners += [(path, f, glob_regex(name)) for f in folders]
            owners += [(path, status.getPath(), ".*") for status in found if status.isDirectory()]
    plain = lambda place: re.sub(r"^file:(//)?(?=/)", "", place.toString()).rstrip("/")
    return roots, [(path, plain(folder), names) for path, folder, names in owners]


def expand(path: str) -> list[str]:
    """Files that a configured path stands for, as a stream's source lists them: itself, those
    in a folder, or those whose names fit a glob in the last component."""
    system, inside = open_filesystem(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.Directory:
        folder, names, head = inside, "*", path.rstrip("/")
    elif info.type == fs.FileType.NotFound and is_glob(path.rsplit("/", 1)[-1]):
        folder, names, head = inside.rsplit("/", 1)[0], path.rsplit("/", 1)[-1], path.rsplit("/", 1)[0]
    else:
        return [path]
    inside_it = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    fits = re.compile(glob_regex(names)).fullmatch
    return sorted(
        f"{head}/{f.base_name}" for f in inside_it
        if f.type == fs.FileType.File and fits(f.base_name) and not fnmatch.fnmatch(f.base_name, "[._]*")
    )


def file_length(path: str) -> int | None:
    """Length in bytes, or None when there is no such file."""
    system, inside = open_filesystem(path)
    info = system.get_file_info(inside)
    return info.size if info.type == fs.FileType.File else None


def end_of_last_line(path: str, start: int, length: int, step: int = 1 << 16) -> int:
    """Position behind the last line feed in [start, length), looking from the end."""
    system, inside = open_filesystem(path)
    with system.open_input_file(inside) as file:
        end = length
        while end > start:
            begin = max(start, end - step)
            file.seek(begin)
            at = file.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start
