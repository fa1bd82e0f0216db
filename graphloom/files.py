"""Arrow files in the shared folder, opened by tasks one at a time; nothing is cached on a node."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs


def write_file(folder: str, table: pa.Table) -> str:
    """Write a table below ``folder``, the URI of a folder, and give the new file's name.

    A retried task writes another file; only names that a successful task hands on are ever read.
    """
    name = uuid.uuid4().hex
    local = _local(folder)
    if local is not None:
        os.makedirs(local, exist_ok=True)
        with pa.OSFile(f"{local}/{name}", "wb") as sink, pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table)
        return name
    store, at = fs.FileSystem.from_uri(folder)
    with store.open_output_stream(f"{at}/{name}") as sink, pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table)
    return name


def read_file(folder: str, name: str) -> pa.Table:
    """The table of :func:`write_file`: mapped where the folder is mounted, else read into memory."""
    local = _local(folder)
    if local is not None:
        return pa.ipc.open_file(pa.memory_map(f"{local}/{name}")).read_all()
    store, at = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{at}/{name}") as source:
        return pa.ipc.open_file(source).read_all()


def _local(folder: str) -> str | None:
    parts = urlparse(folder)
    return parts.path if parts.scheme in ("", "file") else None
