"""Binary files in the shared folder, by any file system that pyarrow reaches (file, hdfs, s3, gs).

A task writes a file under a name of its own and returns that name; only the
names that successful tasks return count, so retried and speculative tasks do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


@contextmanager
def create(folder: str, part: int, suffix: str):
    """(path, stream) of a new file; the path is a URI."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name = f"part-{part:06d}-{uuid.uuid4().hex}{suffix}"
    with store.open_output_stream(f"{root}/{name}", compression=None) as out:
        yield f"{folder}/{name}", out


@contextmanager
def opened(path: str) -> Iterator:
    """A seekable input file."""
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        yield f
