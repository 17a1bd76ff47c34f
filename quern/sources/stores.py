"""Files on shared stores, as executors write and read them themselves."""

from __future__ import annotations

import re
import urllib.parse
import uuid

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a full path, and the place there; a path is no URI, so what looks like an escape is part of a name."""
    scheme, place = re.sub("^file:/+", "file:///", path).split("://", 1)
    return fs.FileSystem.from_uri(f"{scheme}://{urllib.parse.quote(place, safe='/:@')}")


def put(folder: str, name: str, content: bytes) -> None:
    """Writes a file whole or not at all: under a hidden name first, then renamed. A repeated task puts the same bytes."""
    store, path = _at(folder)
    store.create_dir(path, recursive=True)
    hidden = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(content)
    store.move(hidden, f"{path}/{name}")


def opened(path: str):
    """A file, to be read at any place."""
    store, place = _at(path)
    return store.open_input_file(place)


def listed(folder: str) -> list[str]:
    """The paths, below ``folder`` and relative to it, of all files that are not hidden, sorted; none if the folder is not there."""
    store, top = _at(folder)
    found = store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
    names = [f.path.removeprefix(top).lstrip("/") for f in found if f.is_file]
    return sorted(n for n in names if not re.search(r"(^|/)[._]", n))


def drop(path: str) -> None:
    """Deletes a file."""
    store, place = _at(path)
    store.delete_file(place)
