"""Object stores: the few operations that publication needs, over local folders and Hadoop file systems."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import uuid
from abc import ABC, abstractmethod
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path


@dataclass(frozen=True)
class ObjectMeta:
    location: str
    size: int
    last_modified: str
    e_tag: str | None = None
    version: str | None = None

    @property
    def has_identity(self) -> bool:
        return any(x and x.strip() for x in (self.e_tag, self.version))


class Upload(ABC):
    """An upload in parts, which may come in any order and from several threads."""

    @abstractmethod
    def put_part(self, number: int, data: bytes) -> None: ...

    @abstractmethod
    def complete(self) -> None: ...

    @abstractmethod
    def abort(self) -> None:
        """Gives the parts up; the object stays as it was."""


class ObjectStore(ABC):
    """Keys are relative paths.  ``delete`` of what is not there succeeds."""

    @abstractmethod
    def head(self, key: str) -> ObjectMeta: ...

    @abstractmethod
    def get_range(self, key: str, start: int, end: int, meta: ObjectMeta) -> tuple[bytes, ObjectMeta]:
        """Bytes of the object that ``meta`` describes; fails if the object is another one now."""

    @abstractmethod
    def put_file(self, path: str, key: str) -> None: ...

    @abstractmethod
    def put(self, key: str, data: bytes) -> None: ...

    @abstractmethod
    def begin(self, key: str) -> Upload:
        """An upload in parts; nothing is seen under ``key`` before it is completed."""

    @abstractmethod
    def move(self, source: str, target: str) -> None:
        """Puts an object under another key by renaming; the plain way of publishing, without a record."""

    @abstractmethod
    def get(self, key: str) -> bytes: ...

    @abstractmethod
    def copy(self, source: str, target: str) -> None: ...

    @abstractmethod
    def delete(self, key: str) -> None: ...


class _LocalUpload(Upload):
    """Parts as files beside the target; completing joins them."""

    def __init__(self, store: LocalStore, key: str):
        self.store, self.key, path = store, key, store.path(key)
        path.parent.mkdir(parents=True, exist_ok=True)
        self.folder = Path(tempfile.mkdtemp(dir=path.parent, prefix=".parts-"))

    def put_part(self, number: int, data: bytes) -> None:
        (self.folder / f"{number:08d}").write_bytes(data)

    def complete(self) -> None:
        def join(f) -> None:
            for part in sorted(self.folder.iterdir()):
                f.write(part.read_bytes())

        self.store._place(join, self.key)
        self.abort()

    def abort(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class LocalStore(ObjectStore):
    """A folder; an object's ETag is the SHA-256 of its bytes.  Every write appears at once, by rename."""

    def __init__(self, root: str | os.PathLike):
        self.root = Path(root).resolve()

    def path(self, key: str) -> Path:
        from .safety import contained

        return contained(self.root, key)

    def _tag(self, path: Path) -> str:
        h = hashlib.sha256()
        with open(path, "rb") as f:
            while block := f.read(1 << 20):
                h.update(block)
        return h.hexdigest()

    def head(self, key: str) -> ObjectMeta:
        p = self.path(key)
        s = p.stat()
        return ObjectMeta(key, s.st_size, datetime.fromtimestamp(s.st_mtime, UTC).isoformat(), self._tag(p))

    def get_range(self, key: str, start: int, end: int, meta: ObjectMeta) -> tuple[bytes, ObjectMeta]:
        p = self.path(key)
        with open(p, "rb") as f:
            s = os.fstat(f.fileno())
            f.seek(start)
            data = f.read(end - start)
        when = datetime.fromtimestamp(s.st_mtime, UTC).isoformat()
        same = s.st_size == meta.size and when == meta.last_modified
        return data, meta if same else ObjectMeta(key, s.st_size, when, self._tag(p))

    def _place(self, write, key: str) -> None:
        p = self.path(key)
        p.parent.mkdir(parents=True, exist_ok=True)
        fd, temporary = tempfile.mkstemp(dir=p.parent, prefix=".put-")
        try:
            with os.fdopen(fd, "wb") as f:
                write(f)
                f.flush()
                os.fsync(f.fileno())
            os.replace(temporary, p)
        except BaseException:
            Path(temporary).unlink(missing_ok=True)
            raise

    def put_file(self, path: str, key: str) -> None:
        with open(path, "rb") as source:
            self._place(lambda f: shutil.copyfileobj(source, f, 8 << 20), key)

    def put(self, key: str, data: bytes) -> None:
        self._place(lambda f: f.write(data), key)

    def begin(self, key: str) -> Upload:
        return _LocalUpload(self, key)

    def move(self, source: str, target: str) -> None:
        self.path(target).parent.mkdir(parents=True, exist_ok=True)
        os.replace(self.path(source), self.path(target))

    def get(self, key: str) -> bytes:
        return self.path(key).read_bytes()

    def copy(self, source: str, target: str) -> None:
        self.put_file(str(self.path(source)), target)

    def delete(self, key: str) -> None:
        self.path(key).unlink(missing_ok=True)


class _HadoopUpload(Upload):
    """The multipart upload that Hadoop's file systems offer; on S3 it is the store's own."""

    def __init__(self, store: HadoopStore, key: str):
        self.store, self.path = store, store._path(key)
        self.uploader = store.fs.createMultipartUploader(self.path.getParent()).build()
        self.upload, self.parts = self.uploader.startUpload(self.path).get(), store.jvm.java.util.concurrent.ConcurrentHashMap()

    def put_part(self, number: int, data: bytes) -> None:
        stream = self.store.jvm.java.io.ByteArrayInputStream(data)
        self.parts.put(number + 1, self.uploader.putPart(self.upload, number + 1, self.path, stream, len(data)).get())

    def complete(self) -> None:
        self.uploader.complete(self.upload, self.path, self.parts).get()

    def abort(self) -> None:
        self.uploader.abort(self.upload, self.path).get()


class _HadoopParts(Upload):
    """For file systems without multipart uploads: parts as objects in a folder beside the target, joined in the JVM and renamed."""

    def __init__(self, store: HadoopStore, key: str):
        self.store, self.key, self.folder, self.numbers = store, key, f"{key}.parts-{uuid.uuid4().hex}", set()

    def put_part(self, number: int, data: bytes) -> None:
        self.store.put(f"{self.folder}/{number:08d}", data)
        self.numbers.add(number)

    def complete(self) -> None:
        whole = f"{self.folder}/whole"
        out = self.store.fs.create(self.store._path(whole), True)
        try:
            for number in sorted(self.numbers):
                part = self.store.fs.open(self.store._path(f"{self.folder}/{number:08d}"))
                self.store.jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                part.close()
        finally:
            out.close()
        self.store.move(whole, self.key)
        self.abort()

    def abort(self) -> None:
        self.store.fs.delete(self.store._path(self.folder), True)


class HadoopStore(ObjectStore):
    """A folder on any file system the session's Hadoop knows (``s3a://``, ``hdfs://``, ``file://``), through the JVM.

    Where the file system gives no ETag, identity is size and modification time.
    """

    def __init__(self, spark, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.FileSystem.get(self.jvm.java.net.URI.create(self.root), self.conf)

    def _path(self, key: str):
        if ".." in key.split("/"):
            raise ValueError(f"{key} leaves the store")
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")

    def head(self, key: str) -> ObjectMeta:
        s = self.fs.getFileStatus(self._path(key))
        tag = s.getEtag() if hasattr(s, "getEtag") and "EtagSource" in [c.getSimpleName() for c in s.getClass().getInterfaces()] else None
        ms = s.getModificationTime()
        return ObjectMeta(key, s.getLen(), datetime.fromtimestamp(ms / 1000, UTC).isoformat(), tag or f"{s.getLen()}-{ms}")

    def get_range(self, key: str, start: int, end: int, meta: ObjectMeta) -> tuple[bytes, ObjectMeta]:
        stream = self.fs.open(self._path(key))
        try:
            stream.seek(start)
            data = bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, end - start)) if end > start else b""
        finally:
            stream.close()
        return data, self.head(key)

    def put_file(self, path: str, key: str) -> None:
        self.fs.copyFromLocalFile(False, True, self.jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(path)}"), self._path(key))

    def put(self, key: str, data: bytes) -> None:
        out = self.fs.create(self._path(key), True)
        try:
            out.write(data)
        finally:
            out.close()

    def begin(self, key: str) -> Upload:
        able = self.fs.hasPathCapability(self._path(key), "fs.capability.multipart.uploader")
        return _HadoopUpload(self, key) if able else _HadoopParts(self, key)

    def move(self, source: str, target: str) -> None:
        self.delete(target)
        self.fs.mkdirs(self._path(target).getParent())
        if not self.fs.rename(self._path(source), self._path(target)):
            raise OSError(f"renaming {source} to {target} failed")

    def get(self, key: str) -> bytes:
        return self.get_range(key, 0, self.head(key).size, None)[0]

    def copy(self, source: str, target: str) -> None:
        if not self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._path(source), self.fs, self._path(target), False, True, self.conf):
            raise OSError(f"copying {source} to {target} failed")

    def delete(self, key: str) -> None:
        self.fs.delete(self._path(key), False)
