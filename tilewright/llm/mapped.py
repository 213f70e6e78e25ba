"""Arrays that tasks write to the shared folder and other tasks map into memory.

A folder that the machine mounts is mapped in place. For any other store a file is copied to a temporary one,
mapped, and its name removed at once, so nothing stays behind on an executor.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np


def local_path(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def save(uri: str, array: np.ndarray) -> None:
    """Writes under another name first: a repeated task leaves one whole file."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, array)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    body = io.BytesIO()
    np.save(body, array)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(body.getbuffer())
    store.move(part, path)


@lru_cache(maxsize=4096)
def load(uri: str) -> np.ndarray:
    path = local_path(uri)
    if path is not None:
        return np.load(path, mmap_mode="r")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with tempfile.NamedTemporaryFile() as f:
        with store.open_input_stream(path) as source:
            while block := source.read(1 << 22):
                f.write(block)
        f.flush()
        return np.load(f.name, mmap_mode="r")
