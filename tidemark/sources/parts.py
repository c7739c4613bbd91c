"""Folders of part files with a manifest, shared by the binary formats.

Tasks write files of names that no other attempt has; nothing is renamed. What a folder holds is what its newest
manifest lists, in that order, with sizes. A commit is the one new manifest ``_manifest-<n>``: an append lists the old
files and its own, an overwrite only its own, and deletes the files of the manifest before it once its own stands. So
a reader sees the state before a commit or after it, also if the driver dies in between; an attempt that is lost or
runs twice leaves a file that nobody lists; files that others put in the folder are never touched.

A file, or a folder without a manifest, is read as it is: all its files in name order, but for hidden ones and side files.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


@dataclass(frozen=True)
class DataFile:
    path: str
    size: int


def _manifests(fs: pafs.FileSystem, root: str) -> list[int]:
    if fs.get_file_info(root).type != pafs.FileType.Directory:
        return []
    names = [os.path.basename(f.path) for f in fs.get_file_info(pafs.FileSelector(root))]
    return sorted(int(n.split("-")[1]) for n in names if n.startswith("_manifest-"))


def _listed(fs: pafs.FileSystem, root: str, number: int) -> list[dict]:
    with fs.open_input_stream(f"{root}/_manifest-{number:08d}") as f:
        return json.loads(f.read())


def data_files(fs: pafs.FileSystem, path: str) -> list[DataFile]:
    """The data files of a file or folder, in order. Raises if there is none at all, or a listed one is not as written."""
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [DataFile(info.path, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if numbers := _manifests(fs, path):
        listed = _listed(fs, path, numbers[-1])
        found = {os.path.basename(f.path): f.size for f in fs.get_file_info(pafs.FileSelector(path))}
        for x in listed:
            if found.get(x["name"]) != x["size"]:
                raise ValueError(f"{path}/{x['name']}: {x['size']} bytes were written, there are {found.get(x['name'])}")
        return [DataFile(f"{path}/{x['name']}", x["size"]) for x in listed]
    hidden = lambda p: os.path.basename(p).startswith(("_", ".")) or p.endswith(".idx")
    found = fs.get_file_info(pafs.FileSelector(path, recursive=False))
    return sorted((DataFile(f.path, f.size) for f in found if f.type == pafs.FileType.File and not hidden(f.path)), key=lambda f: f.path)


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    size: int
    rows: int


class PartWriter(DataSourceArrowWriter):
    """One file a partition; their order is that of the partitions, behind all files that were there before."""

    suffix = ".bin"

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.job = uuid.uuid4().hex[:12]

    def write_stream(self, out, batches) -> tuple[int, int, bytes]:
        """Writes all batches; returns bytes, rows, and the content of a side file (empty: none)."""
        raise NotImplementedError

    def write(self, iterator):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{self.job}-{uuid.uuid4().hex[:12]}{self.suffix}"
        with fs.open_output_stream(f"{root}/{name}") as f:
            size, rows, side = self.write_stream(f, iterator)
        if side:
            with fs.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(side)
        return Written(part, name, size, rows)

    def commit(self, messages):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        numbers = _manifests(fs, root)
        before = _listed(fs, root, numbers[-1]) if numbers else []
        own = [{"name": m.name, "size": m.size, "rows": m.rows} for m in sorted((m for m in messages if m is not None), key=lambda m: m.part)]
        number = numbers[-1] + 1 if numbers else 0
        temp = f"{root}/.manifest-{self.job}"
        with fs.open_output_stream(temp) as f:
            f.write(json.dumps(own if self.overwrite else before + own).encode())
        target = f"{root}/_manifest-{number:08d}"
        if fs.get_file_info(target).type != pafs.FileType.NotFound:
            fs.delete_file(temp)
            raise RuntimeError(f"{self.path}: another write was committed meanwhile")
        fs.move(temp, target)
        self.tidy(fs, root, {x["name"] for x in own}, {x["name"] for x in before} if self.overwrite else set(), numbers)

    def tidy(self, fs: pafs.FileSystem, root: str, listed: set[str], gone: set[str], numbers: list[int]) -> None:
        """Deletes replaced files, files of lost attempts, and older manifests."""
        for f in fs.get_file_info(pafs.FileSelector(root)):
            name = os.path.basename(f.path)
            data = name.removesuffix(".idx")
            if data in gone or (f"-{self.job}-" in data and data not in listed):
                fs.delete_file(f.path)
        for n in numbers:
            fs.delete_file(f"{root}/_manifest-{n:08d}")

    def abort(self, messages):
        fs, root = filesystem(self.path)
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            numbers = _manifests(fs, root)
            if numbers and any(f"-{self.job}-" in x["name"] for x in _listed(fs, root, numbers[-1])):
                return  # it was committed; only the tidying behind it failed
            for f in fs.get_file_info(pafs.FileSelector(root)):
                if f"-{self.job}" in os.path.basename(f.path):
                    fs.delete_file(f.path)


def delete_path(path: str) -> bool:
    """Delete a file or folder; False if there is none."""
    fs, p = filesystem(path)
    kind = fs.get_file_info(p).type
    if kind == pafs.FileType.NotFound:
        return False
    (fs.delete_dir if kind == pafs.FileType.Directory else fs.delete_file)(p)
    return True


def path_exists(path: str) -> bool:
    fs, p = filesystem(path)
    return fs.get_file_info(p).type != pafs.FileType.NotFound


def file_bytes(path: str) -> int:
    """Bytes of a file, or of the data files of a folder."""
    fs, p = filesystem(path)
    return sum(f.size for f in data_files(fs, p))


def with_scheme(path: str, inside: str, file: str) -> str:
    """The path or URI of a file whose folder is ``path``, which is ``inside`` on its file system."""
    return path[: len(path) - len(inside)] + file if path.endswith(inside) else file

