"""Finding input files on any file system that Arrow can list."""

from __future__ import annotations

import glob
import os
import re
from dataclasses import dataclass

from pyarrow import fs

from tablemill.errors import SpecError

# Formats tried in a folder, in order, and the marks of an unreadable Parquet file.
FOLDER_FORMATS = ("parquet", "csv.gz", "gz", "csv", "tsv", "txt")
TEMPORARY_PREFIX = "tmp_"
SMALLEST_PARQUET = 16


@dataclass(frozen=True)
class InputFile:
    """One listed file: the path Spark reads, its place below the input root, its bytes."""

    path: str
    relative: str
    size: int

    @property
    def literal(self) -> str:
        """The path with pattern characters escaped, for readers that expand patterns."""
        return literal_path(self.path)

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    @property
    def readable(self) -> bool:
        name = self.name.lower()
        if not name.endswith(".parquet"):
            return True
        return not name.startswith(TEMPORARY_PREFIX) and self.size >= SMALLEST_PARQUET


def literal_path(path: str) -> str:
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def clean_path(text: str) -> str:
    """A path as typed: without stray quotes and spaces, with forward slashes."""
    text = text.replace("\u00a0", " ").strip().strip("\"'").strip().replace("\\", "/")
    if not text:
        raise SpecError("A path is needed.")
    return text if "://" in text else os.path.expanduser(text)


def file_system(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path within it, and the prefix that Spark expects."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        scheme, _, rest = path.partition(":")
        # Hadoop and Arrow name the S3 scheme differently.
        system, inner = fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest)
        return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else scheme + "://"
    return fs.LocalFileSystem(), os.path.abspath(path), ""


def _single(path: str) -> InputFile | None:
    """The file a path names as it stands, whatever characters are in its name."""
    system, inner, prefix = file_system(path)
    info = system.get_file_info(inner)
    return InputFile(prefix + inner, info.base_name, info.size) if info.type == fs.FileType.File else None


def list_files(pattern: str) -> list[InputFile]:
    """Files matching a path or a glob pattern (``*``, ``?``, ``[..]``, ``**``), sorted."""
    pattern = clean_path(pattern)
    exact = _single(pattern)
    if exact:
        return [exact]
    head = re.split(r"[*?\[]", pattern, maxsplit=1)[0]
    wild = head != pattern
    root = head.rsplit("/", 1)[0] if wild and "/" in head else ("." if wild else pattern)
    system, inner, prefix = file_system(root or "/")
    if not wild or system.get_file_info(inner).type != fs.FileType.Directory:
        return []
    rest = pattern[len(root):].lstrip("/") if root != "." else pattern
    wanted = re.compile(glob.translate(rest, recursive=True, seps="/"))
    base = inner.rstrip("/")
    selector = fs.FileSelector(base or "/", recursive="/" in rest or "**" in rest)
    found = [
        InputFile(prefix + item.path, item.path[len(base) + 1:], item.size)
        for item in system.get_file_info(selector)
        if item.type == fs.FileType.File and wanted.match(item.path[len(base) + 1:])
    ]
    return sorted(found, key=lambda f: f.path)


def is_folder(path: str) -> bool:
    system, inner, _ = file_system(clean_path(path))
    return system.get_file_info(inner).type == fs.FileType.Directory


# Endings that stand in for another one.
OTHER_ENDINGS = {".csv.gz": (".gz", ".csv")}


def _candidates(path: str) -> list[str]:
    """Patterns to try for an input, in order of preference."""
    if is_folder(path):
        return [f"{glob.escape(path.rstrip('/'))}/**/*.{ending}" for ending in FOLDER_FORMATS]
    last = path.rsplit("/", 1)[-1]
    folder = path[: len(path) - len(last)]
    folders = [folder, f"{folder}**/"] if "*" in path and not folder.endswith("**/") else [folder]
    ending = next((e for e in OTHER_ENDINGS if last.lower().endswith(e)), "")
    stem = last[: len(last) - len(ending)]
    names = [last, *[stem + other for other in OTHER_ENDINGS.get(ending, ())]]
    return [place + name for name in names for place in folders]


def resolve_inputs(pattern: str) -> list[InputFile]:
    """Readable files behind a file, folder or glob pattern.

    A folder is searched for the first format it holds. A pattern without a match is tried
    again through subfolders, and ``.csv.gz`` also as ``.gz`` and ``.csv``.
    """
    path = clean_path(pattern)
    for candidate in dict.fromkeys(_candidates(path)):
        found = [f for f in list_files(candidate) if f.readable]
        if found:
            return found
    raise SpecError(f"No readable files match {path!r}.")


def as_files(source: str | list[str] | list[InputFile]) -> list[InputFile]:
    """Files from a pattern, a list of patterns or an already resolved list."""
    if isinstance(source, str):
        return resolve_inputs(source)
    files: list[InputFile] = []
    for item in source:
        files += [item] if isinstance(item, InputFile) else resolve_inputs(item)
    if not files:
        raise SpecError("No input files were given.")
    return files
