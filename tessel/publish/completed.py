"""Transfers in chunks, bound to one identity of an object, and reads of completed outputs only."""

from __future__ import annotations

import os
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession

from ..scale import shared_path
from .errors import CompletionIdentityRequired, InvalidManifest, InvalidSnapshot, ManifestViolation, SnapshotViolation
from .manifest import CompletionManifest, decode_manifest, manifest_key
from .store import ObjectMeta, ObjectStore

CHUNK_BYTES = 8 << 20
#: Parts of an upload that are held at a time.
PARTS_IN_FLIGHT = 2


def _download(store: ObjectStore, key: str, dest: str, meta: ObjectMeta) -> ObjectMeta:
    with open(dest, "wb") as f:
        for start in range(0, meta.size, CHUNK_BYTES):
            end = min(start + CHUNK_BYTES, meta.size)
            data, now = store.get_range(key, start, end, meta)
            if now.location != meta.location:
                raise InvalidSnapshot(key, SnapshotViolation.LOCATION, meta.location, now.location)
            if (now.e_tag, now.version) != (meta.e_tag, meta.version):
                raise InvalidSnapshot(key, SnapshotViolation.IDENTITY)
            if now.size != meta.size:
                raise InvalidSnapshot(key, SnapshotViolation.SIZE, meta.size, now.size)
            if len(data) != end - start:
                raise InvalidSnapshot(key, SnapshotViolation.LENGTH, end - start, len(data))
            f.write(data)
    return meta


def download_to_temp(store: ObjectStore, key: str, dest: str) -> ObjectMeta:
    """Copies an object to a local file in chunks, all of the identity captured first."""
    meta = store.head(key)
    if not meta.has_identity:
        raise InvalidSnapshot(key, SnapshotViolation.MISSING_IDENTITY)
    return _download(store, key, dest, meta)


def upload_from_temp(store: ObjectStore, source: str, key: str, part_bytes: int = CHUNK_BYTES, in_flight: int = PARTS_IN_FLIGHT) -> None:
    """Copies a local file to the store: one of at most ``part_bytes`` at once, a larger one in parts.

    At most ``in_flight`` parts are held at a time.  A part that fails stops the others and aborts the upload, so that no
    part stays behind; a failing abort is noted on the first error.
    """
    if os.path.getsize(source) <= part_bytes:
        store.put_file(source, key)
        return
    upload = store.begin(key)
    try:
        with open(source, "rb") as f, ThreadPoolExecutor(in_flight) as pool:
            running, number = set(), 0
            while data := f.read(part_bytes):
                running.add(pool.submit(upload.put_part, number, data))
                number += 1
                if len(running) == in_flight:
                    done, running = wait(running, return_when=FIRST_COMPLETED)
                    for part in done:
                        part.result()
            for part in running:
                part.result()
        upload.complete()
    except BaseException as e:
        try:
            upload.abort()
        except Exception as again:
            e.add_note(f"and the upload could not be aborted: {again}")
        raise


def try_delete(store: ObjectStore, key: str) -> Exception | None:
    """Deletes an object if that can be done; what went wrong is returned, not raised."""
    try:
        store.delete(key)
    except Exception as e:
        return e
    return None


def completed_manifest(store: ObjectStore, output_key: str) -> tuple[CompletionManifest, ObjectMeta]:
    """The record of an output and the output's metadata, which must be what the record says."""
    manifest = decode_manifest(store.get(manifest_key(output_key)))
    if manifest.schema_version != 2:
        raise CompletionIdentityRequired(manifest.schema_version)
    if manifest.output_key != output_key:
        raise InvalidManifest(ManifestViolation.OUTPUT_KEY_MISMATCH)
    meta = store.head(output_key)
    same = meta.version == manifest.output_version if manifest.output_version is not None else meta.e_tag == manifest.output_e_tag
    if not same:
        raise InvalidSnapshot(output_key, SnapshotViolation.IDENTITY)
    return manifest, meta


def download_completed(store: ObjectStore, output_key: str, dest: str) -> CompletionManifest:
    manifest, meta = completed_manifest(store, output_key)
    _download(store, output_key, dest, meta)
    return manifest


def read_completed(spark: SparkSession, store: ObjectStore, output_key: str, folder: str | None = None) -> tuple[DataFrame, CompletionManifest]:
    """The completed output as a DataFrame over a private copy of its bytes, in the session's shared folder."""
    dest = os.path.join(folder or shared_path(spark), os.path.basename(output_key))
    manifest = download_completed(store, output_key, dest)
    return spark.read.parquet(f"file://{dest}"), manifest
