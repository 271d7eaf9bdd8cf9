"""Whole files in folders that all executors share, through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def put(folder: str, name: str, data: bytes) -> str:
    """Writes under a temporary name and moves, so a task that is repeated leaves no half file. Returns the path."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    part = f"{root}/{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{root}/{name}")
    return f"{folder}/{name}"


def get(path: str) -> bytes:
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name, compression=None) as stream:
        return stream.readall()
