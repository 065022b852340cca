"""Files in shared folders, opened by URI from tasks: local, HDFS, S3 or whatever pyarrow.fs knows."""

from __future__ import annotations

import json
from functools import lru_cache

from pyarrow import fs


@lru_cache(maxsize=64)
def _root(scheme_and_host: str):
    return fs.FileSystem.from_uri(scheme_and_host + "/")[0]


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it); a path without a scheme is a local one."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def open_input(path: str):
    system, at = resolve(path)
    return system.open_input_file(at)


def open_output(path: str):
    system, at = resolve(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(at, compression=None)


def write_manifest(folder: str, entries: list[dict]) -> None:
    """Names the committed files; files of failed or repeated task attempts are in no manifest and so never read."""
    with open_output(f"{folder}/_manifest.json") as f:
        f.write(json.dumps(entries).encode())


def read_manifest(folder: str) -> list[dict]:
    with open_input(f"{folder}/_manifest.json") as f:
        return json.loads(f.read())


def delete_folder(path: str) -> None:
    """Deletes a folder and what is in it, if it is there."""
    system, at = resolve(path)
    if system.get_file_info(at).type == fs.FileType.Directory:
        system.delete_dir(at)


def delete(paths: list[str]) -> None:
    for p in paths:
        system, at = resolve(p)
        if system.get_file_info(at).is_file:
            system.delete_file(at)
