"""Files in the shared folder, opened by URI so that any file system that Arrow knows will do."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def new_file(uri: str):
    """A file that appears under its name only when it is whole: a lost or repeated task leaves no part of it."""
    system, path = at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    with system.open_output_stream(part, compression=None) as out:
        yield out
    system.move(part, path)


def open_stream(uri: str):
    system, path = at(uri)
    return system.open_input_stream(path, compression=None, buffer_size=1 << 20)


def open_random(uri: str):
    system, path = at(uri)
    return system.open_input_file(path)
