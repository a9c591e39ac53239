"""Small file system operations that are safe against races and escapes."""

from __future__ import annotations

import os
from pathlib import Path


def create_new(path: str | os.PathLike, mode: int = 0o600):
    """Opens a file that must not exist yet."""
    return os.fdopen(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, mode), "wb")


def contained(root: str | os.PathLike, key: str) -> Path:
    """The path of ``key`` below ``root``; a key that leads outside, also by a link, is refused."""
    base = Path(root).resolve()
    path = (base / key).resolve()
    if path == base or not path.is_relative_to(base):
        raise ValueError(f"{key!r} is not inside {base}")
    return path


def make_private_dir(path: str | os.PathLike) -> None:
    """Creates a folder for this user only; one that exists is an error."""
    os.mkdir(path, 0o700)
