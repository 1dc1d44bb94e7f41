"""Files in the shared folder, written and read by Python workers."""

from __future__ import annotations

import os
import uuid


def _filesystem(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, data: bytes) -> None:
    """Writes beside the target and renames: a task that dies leaves no half
    file, and a task that runs twice replaces its own file by the same bytes."""
    store, path = _filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{os.path.dirname(path)}/_{os.path.basename(path)}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    if store.type_name == "local":
        os.replace(draft, path)
    else:
        store.move(draft, path)


def read_whole(uri: str) -> bytes:
    store, path = _filesystem(uri)
    with store.open_input_stream(path) as source:
        return source.read()
