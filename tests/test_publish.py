import json
import os
import threading
import time

import pyarrow.parquet as pq
import pytest

from tessel.publish import (
    CompletionIdentityRequired, CompletionManifest, HadoopStore, InvalidManifest, InvalidSnapshot, LocalStore, ManifestViolation, ObjectMeta, PublicationError, PublicationOutcome,
    PublicationPhase, SnapshotViolation, StagedFile, StagingError, StagingOutcome, StagingPhase, UnsupportedDigestScheme, UnsupportedManifestVersion, decode_manifest, download_completed,
    download_to_temp, manifest_key, publish, publish_dataframe, read_completed, try_delete, upload_from_temp,
)
from tessel.publish import completed
from tessel.publish.errors import ReadManifestError
from tessel.publish.safety import contained, create_new, make_private_dir

OUT = "out/orders.parquet"
INPUT = ObjectMeta("in.csv", 10, "2026-01-01T00:00:00+00:00", "tag")


class Faulty(LocalStore):
    """Fails one call, before or after its effect."""

    def __init__(self, root, call, key_part, after):
        super().__init__(root)
        self.fail = (call, key_part, after)

    def _maybe(self, call, key, action):
        name, part, after = self.fail
        hit = name == call and part in key
        if hit and not after:
            raise OSError("fault before")
        out = action()
        if hit:
            raise OSError("fault after")
        return out

    def put_file(self, path, key):
        return self._maybe("put_file", key, lambda: super(Faulty, self).put_file(path, key))

    def put(self, key, data):
        return self._maybe("put", key, lambda: super(Faulty, self).put(key, data))

    def copy(self, source, target):
        return self._maybe("copy", target, lambda: LocalStore(self.root).copy(source, target))

    def delete(self, key):
        return self._maybe("delete", key, lambda: super(Faulty, self).delete(key))

    def head(self, key):
        return self._maybe("head", key, lambda: super(Faulty, self).head(key))


@pytest.fixture
def files(tmp_path):
    for n in ("old", "new"):
        (tmp_path / n).write_bytes(n.encode() * 100)
    store = LocalStore(tmp_path / "store")
    publish(store, str(tmp_path / "old"), OUT, INPUT, 1, "0" * 16)
    return tmp_path, store


PHASES = [
    ("put_file", ".staging/", PublicationPhase.UPLOAD, PublicationOutcome.NOT_PUBLISHED),
    ("delete", ".manifest.json", PublicationPhase.INVALIDATE_COMPLETION, PublicationOutcome.NOT_PUBLISHED),
    ("copy", OUT, PublicationPhase.PUBLISH_OUTPUT, PublicationOutcome.PUBLICATION_UNKNOWN),
    ("head", OUT, PublicationPhase.CAPTURE_OUTPUT_IDENTITY, PublicationOutcome.PUBLISHED_WITHOUT_COMPLETION),
    ("put", ".manifest.json", PublicationPhase.WRITE_COMPLETION, PublicationOutcome.COMPLETION_UNKNOWN),
    ("delete", ".staging/", PublicationPhase.CLEANUP_STAGING, PublicationOutcome.COMPLETED_CLEANUP_UNKNOWN),
]


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize(("call", "part", "phase", "outcome"), PHASES)
def test_faults(files, call, part, phase, outcome, after):
    tmp_path, store = files
    with pytest.raises(PublicationError) as e:
        publish(Faulty(store.root, call, part, after), str(tmp_path / "new"), OUT, INPUT, 2, "1" * 16)
    assert (e.value.phase, e.value.outcome) == (phase, outcome)
    if outcome is PublicationOutcome.NOT_PUBLISHED:
        assert store.get(OUT) == b"old" * 100
    if outcome is PublicationOutcome.COMPLETED_CLEANUP_UNKNOWN or (phase is PublicationPhase.WRITE_COMPLETION and after):
        assert download_completed(store, OUT, str(tmp_path / "x")).row_count == 2 and (tmp_path / "x").read_bytes() == b"new" * 100
    elif phase not in (PublicationPhase.UPLOAD,) and not (phase is PublicationPhase.INVALIDATE_COMPLETION and not after):
        with pytest.raises(OSError):
            store.get(manifest_key(OUT))
    if phase is not PublicationPhase.CLEANUP_STAGING:
        assert not list((store.root / f"{OUT}.staging").glob("run-*"))


def test_a_failed_older_run_leaves_a_newer_output(files):
    tmp_path, store = files
    publish(store, str(tmp_path / "new"), OUT, INPUT, 2, "1" * 16)
    with pytest.raises(PublicationError):
        publish(Faulty(store.root, "put_file", ".staging/", False), str(tmp_path / "old"), OUT, INPUT, 1, "0" * 16)
    assert download_completed(store, OUT, str(tmp_path / "x")).row_count == 2


def test_no_identity_no_completion(files):
    tmp_path, store = files

    class Nameless(LocalStore):
        def head(self, key):
            m = super().head(key)
            return ObjectMeta(m.location, m.size, m.last_modified, " ", None)

    with pytest.raises(PublicationError) as e:
        publish(Nameless(store.root), str(tmp_path / "new"), OUT, INPUT, 2, "1" * 16)
    assert e.value.phase is PublicationPhase.CAPTURE_OUTPUT_IDENTITY and e.value.__cause__.violation is SnapshotViolation.MISSING_IDENTITY
    with pytest.raises(InvalidSnapshot):
        download_to_temp(Nameless(store.root), OUT, str(tmp_path / "x"))


def test_replaced_output_is_noticed(files):
    tmp_path, store = files
    store.put(OUT, b"other")
    with pytest.raises(InvalidSnapshot) as e:
        download_completed(store, OUT, str(tmp_path / "x"))
    assert e.value.violation is SnapshotViolation.IDENTITY


def test_replacement_between_chunks_is_noticed(files, monkeypatch):
    tmp_path, store = files
    monkeypatch.setattr(completed, "CHUNK_BYTES", 64)

    class Moving(LocalStore):
        n = 0

        def get_range(self, key, start, end, meta):
            self.n += 1
            if self.n == 2:
                self.put(key, b"z" * meta.size)
                os.utime(self.path(key), (1, 1))
            return super().get_range(key, start, end, meta)

    with pytest.raises(InvalidSnapshot) as e:
        download_to_temp(Moving(store.root), OUT, str(tmp_path / "x"))
    assert e.value.violation is SnapshotViolation.IDENTITY


def test_manifests(files):
    _, store = files
    m = decode_manifest(store.get(manifest_key(OUT)))
    assert m.schema_version == 2 and m.output_key == OUT and m.run_id.startswith("run-")
    first = CompletionManifest.first(INPUT, 3, "ab")
    assert set(json.loads(first.encode())) == {"schema_version", "input_key", "input_size", "input_e_tag", "input_last_modified", "row_count", "content_digest"}
    store.put(manifest_key(OUT), first.encode())
    with pytest.raises(CompletionIdentityRequired):
        download_completed(store, OUT, "/dev/null")
    raw = json.loads(m.encode())

    def decode(**changes):
        return decode_manifest(json.dumps({k: v for k, v in (raw | changes).items() if v is not Ellipsis}).encode())

    for changes, violation in (
        ({"run_id": " "}, ManifestViolation.MISSING_RUN_ID), ({"output_key": ...}, ManifestViolation.MISSING_OUTPUT_KEY), ({"output_e_tag": ...}, ManifestViolation.MISSING_OUTPUT_IDENTITY),
        ({"output_version": ""}, ManifestViolation.EMPTY_OUTPUT_IDENTITY), ({"digest_scheme": ...}, ManifestViolation.MISSING_DIGEST_SCHEME),
    ):
        with pytest.raises(InvalidManifest) as e:
            decode(**changes)
        assert e.value.violation is violation
    with pytest.raises(UnsupportedDigestScheme):
        decode(digest_scheme="other")
    with pytest.raises(UnsupportedManifestVersion):
        decode(schema_version=3)
    for bad in (b"", b"[]", b"{}", json.dumps(raw | {"row_count": "1"}).encode()):
        with pytest.raises(ReadManifestError):
            decode_manifest(bad)
    store.put(manifest_key("other"), m.encode())
    store.put("other", b"x")
    with pytest.raises(InvalidManifest) as e:
        download_completed(store, "other", "/dev/null")
    assert e.value.violation is ManifestViolation.OUTPUT_KEY_MISMATCH


def test_read_completed(spark, tmp_path):
    store = LocalStore(tmp_path / "s")
    import pyarrow as pa

    pq.write_table(pa.table({"a": [1, 2]}), tmp_path / "t.parquet")
    publish(store, str(tmp_path / "t.parquet"), OUT, INPUT, 2, "0" * 16)
    df, m = read_completed(spark, store, OUT)
    assert df.count() == m.row_count == 2


def test_hadoop_store(spark, tmp_path):
    store = HadoopStore(spark, f"file://{tmp_path}/h")
    (tmp_path / "f").write_bytes(b"abc" * 10)
    m = publish(store, str(tmp_path / "f"), OUT, INPUT, 1, "0" * 16)
    assert m.output_key == OUT and store.get(OUT) == b"abc" * 10
    assert download_completed(store, OUT, str(tmp_path / "x")).row_count == 1
    with pytest.raises(ValueError):
        store.head("../x")


def test_staged_file(tmp_path, monkeypatch):
    path = tmp_path / "out.bin"
    path.write_bytes(b"old")
    with StagedFile(str(path)) as f:
        f.write(b"new")
        assert path.read_bytes() == b"old"
        f.publish()
    assert path.read_bytes() == b"new" and os.listdir(tmp_path) == ["out.bin"]
    with pytest.raises(RuntimeError), StagedFile(str(path)) as f:
        f.write(b"x")
        raise RuntimeError
    assert path.read_bytes() == b"new" and os.listdir(tmp_path) == ["out.bin"]
    with pytest.raises(StagingError) as e:
        StagedFile(str(tmp_path / "none" / "x"))
    assert e.value.phase is StagingPhase.CREATE
    for name, phase, outcome in (("replace", StagingPhase.RENAME, StagingOutcome.NOT_PUBLISHED), ("fsync", StagingPhase.FILE_SYNC, StagingOutcome.NOT_PUBLISHED)):
        f = StagedFile(str(path))
        with monkeypatch.context() as m, pytest.raises(StagingError) as e:
            m.setattr(os, name, lambda *_: (_ for _ in ()).throw(OSError("fault")))
            f.publish()
        assert (e.value.phase, e.value.outcome) == (phase, outcome) and os.listdir(tmp_path) == ["out.bin"]
    f = StagedFile(str(path))
    f.write(b"newest")
    monkeypatch.setattr(StagedFile, "_sync_parent", lambda _: (_ for _ in ()).throw(OSError("fault")))
    with pytest.raises(StagingError) as e:
        f.publish()
    assert e.value.outcome is StagingOutcome.PUBLISHED_DURABILITY_UNCERTAIN and path.read_bytes() == b"newest"


def test_publish_dataframe(spark, tmp_path):
    path = str(tmp_path / "t")
    publish_dataframe(spark.range(3), path)
    publish_dataframe(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5

    def veto():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        publish_dataframe(spark.range(9), path, before_rename=veto)
    assert spark.read.parquet(path).count() == 5 and os.listdir(tmp_path) == ["t"]


def test_safety(tmp_path):
    (tmp_path / "root").mkdir()
    os.symlink("/tmp", tmp_path / "root" / "out")
    assert contained(tmp_path / "root", "a/b").name == "b"
    for bad in ("../x", "/etc/passwd", "out/x", "."):
        with pytest.raises(ValueError):
            contained(tmp_path / "root", bad)
    create_new(tmp_path / "f").close()
    with pytest.raises(FileExistsError):
        create_new(tmp_path / "f")
    make_private_dir(tmp_path / "d")
    assert (tmp_path / "d").stat().st_mode & 0o777 == 0o700
    with pytest.raises(FileExistsError):
        make_private_dir(tmp_path / "d")


class Counting(LocalStore):
    """Counts the parts in flight; may fail one part, or the abort."""

    def __init__(self, root, fail_part=None, fail_abort=False):
        super().__init__(root)
        self.now, self.most, self.sizes, self.aborted = 0, 0, {}, False
        self.fail_part, self.fail_abort, self.lock = fail_part, fail_abort, threading.Lock()

    def begin(self, key):
        inner, store = super().begin(key), self

        class Watched(type(inner)):
            def __init__(self):
                pass

            def put_part(self, number, data):
                with store.lock:
                    store.now += 1
                    store.most = max(store.most, store.now)
                    store.sizes[number] = len(data)
                time.sleep(0.005)
                try:
                    if number == store.fail_part:
                        raise OSError("part lost")
                    inner.put_part(number, data)
                finally:
                    with store.lock:
                        store.now -= 1

            def complete(self):
                inner.complete()

            def abort(self):
                store.aborted = True
                inner.abort()
                if store.fail_abort:
                    raise OSError("abort lost")

        return Watched()


def test_upload_in_parts(tmp_path):
    data = os.urandom(1_000_003)
    (tmp_path / "big").write_bytes(data)
    store = Counting(tmp_path / "store")
    upload_from_temp(store, str(tmp_path / "big"), "a/b", part_bytes=100_000)
    assert store.get("a/b") == data and store.most == 2 and not store.aborted
    assert [store.sizes[k] for k in range(11)] == [100_000] * 10 + [3]
    upload_from_temp(store, str(tmp_path / "big"), "a/c", part_bytes=1 << 20)
    assert store.get("a/c") == data and len(store.sizes) == 11


@pytest.mark.parametrize("fail_abort", [False, True])
def test_a_lost_part_aborts(tmp_path, fail_abort):
    (tmp_path / "big").write_bytes(b"x" * 1000)
    store = Counting(tmp_path / "store", 3, fail_abort)
    store.put("k", b"old")
    with pytest.raises(OSError, match="part lost") as e:
        upload_from_temp(store, str(tmp_path / "big"), "k", part_bytes=100)
    assert store.aborted and store.get("k") == b"old" and sorted(p.name for p in (tmp_path / "store").iterdir()) == ["k"]
    assert bool(getattr(e.value, "__notes__", [])) == fail_abort


def test_hadoop_store_in_parts_and_moves(spark, tmp_path):
    store = HadoopStore(spark, f"file://{tmp_path}/h")
    (tmp_path / "h").mkdir()
    (tmp_path / "big").write_bytes(b"0123456789" * 50)
    upload_from_temp(store, str(tmp_path / "big"), "k", part_bytes=64)
    assert store.get("k") == b"0123456789" * 50
    store.put("small", b"s")
    store.move("k", "deep/er")
    assert store.get("deep/er") == b"0123456789" * 50 and store.get("small") == b"s"
    with pytest.raises(Exception, match="k"):
        store.head("k")
    local = LocalStore(tmp_path / "l")
    local.put("a", b"1")
    local.move("a", "b/c")
    assert local.get("b/c") == b"1" and try_delete(local, "../x") is not None and try_delete(local, "none") is None
