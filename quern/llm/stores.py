"""Files that executors write to shared folders, and read there, themselves."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def put(folder: str, name: str, content: bytes) -> None:
    """Writes a file whole or not at all: under a hidden name first, then renamed. A repeated task puts the same bytes."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    hidden = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(content)
    store.move(hidden, f"{path}/{name}")


def opened(path: str):
    """A file, to be read at any place."""
    store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return store.open_input_file(place)
