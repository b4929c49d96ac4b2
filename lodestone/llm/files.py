"""Files of own formats in the shared folder.

A task writes under a name of its own and returns that name in its result; only names in the saved results count,
so files of failed or repeated attempts are never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def create(folder: str, suffix: str):
    """(name, output stream) of a new file in `folder`, a URI or path that all executors share."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return name, system.open_output_stream(f"{path}/{name}", compression=None)


def reopen(folder: str, name: str):
    """A seekable input file."""
    system, path = fs.FileSystem.from_uri(folder)
    return system.open_input_file(f"{path}/{name}")
