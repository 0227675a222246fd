"""Reading parts of files from any store that Arrow knows, by lists that Spark makes."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs

#: Bytes that a task reads at a time.
CHUNK_BYTES = 32 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI and the path in it; file:/x is file:///x."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def write_file(folder: str, name: str, parts: Iterator[bytes]) -> str:
    """A file under a name of its own, moved to its place when it is whole: a task that is lost or tried
    again leaves the same file."""
    import uuid

    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own, compression=None) as f:
        for part in parts:
            f.write(part)
    store.move(own, f"{path}/{name}")
    return f"{folder}/{name}"
