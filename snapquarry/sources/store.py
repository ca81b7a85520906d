"""A directory as a key-value store of immutable objects."""

from __future__ import annotations

import errno
import os
import uuid
from pathlib import Path

#: What file systems without fsync answer.
_NO_SYNC = {errno.EINVAL, errno.ENOTSUP, errno.EOPNOTSUPP, errno.ENOSYS, errno.EPERM}


def is_unsupported(error: OSError) -> bool:
    return error.errno in _NO_SYNC


class NotFound(KeyError):
    pass


class LocalStore:
    """Keys are relative paths; writes are atomic, reads may be ranges."""

    def __init__(self, directory: str):
        if not directory:
            raise ValueError("a store needs a directory")
        self.root = Path(directory).absolute()
        self.root.mkdir(mode=0o755, parents=True, exist_ok=True)

    def put(self, key: str, data: bytes) -> None:
        target = self.root / key
        target.parent.mkdir(parents=True, exist_ok=True)
        temp = target.parent / f".tmp-{uuid.uuid4().hex}"
        try:
            with temp.open("wb") as f:
                f.write(data)
                f.flush()
                try:
                    os.fsync(f.fileno())
                except OSError as error:
                    if not is_unsupported(error):
                        raise
            os.replace(temp, target)
        finally:
            temp.unlink(missing_ok=True)

    def get(self, key: str) -> bytes:
        return self.get_range(key, 0, None)

    def get_range(self, key: str, offset: int, length: int | None) -> bytes:
        """Shorter than ``length`` at the end of the object."""
        try:
            with (self.root / key).open("rb") as f:
                f.seek(offset)
                return f.read() if length is None else f.read(length)
        except FileNotFoundError as error:
            raise NotFound(key) from error

    def list(self, prefix: str = "") -> list[str]:
        top = self.root / prefix
        if not top.is_dir():
            return []
        return sorted(p.relative_to(self.root).as_posix() for p in top.rglob("*") if p.is_file() and not p.name.startswith(".tmp-"))

    def exists(self, key: str) -> bool:
        return (self.root / key).is_file()

    def delete(self, key: str) -> None:
        (self.root / key).unlink(missing_ok=True)
