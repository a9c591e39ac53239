"""Remote publication: staged upload, then the output, then the completion record, in an order that never lies."""

from __future__ import annotations

import uuid

from .completed import upload_from_temp
from .errors import PublicationError, PublicationPhase
from .manifest import CompletionManifest, manifest_key
from .store import ObjectMeta, ObjectStore


def publish(store: ObjectStore, local_output: str, output_key: str, input_meta: ObjectMeta, rows: int, digest: str) -> CompletionManifest:
    """Publishes a local file under ``output_key`` with its manifest.

    The old record goes before the output is replaced, and the new one is written last, so a record that is there speaks of
    the bytes that are there.  A failure tells its phase and what is known; only this run's staged object is removed.
    """
    run_id = f"run-{uuid.uuid4().hex}"
    staging, marker = f"{output_key}.staging/{run_id}", manifest_key(output_key)
    phase = PublicationPhase.UPLOAD
    try:
        upload_from_temp(store, local_output, staging)
        phase = PublicationPhase.INVALIDATE_COMPLETION
        store.delete(marker)
        phase = PublicationPhase.PUBLISH_OUTPUT
        store.copy(staging, output_key)
        phase = PublicationPhase.CAPTURE_OUTPUT_IDENTITY
        manifest = CompletionManifest.second(input_meta, rows, digest, run_id, output_key, store.head(output_key))
        phase = PublicationPhase.WRITE_COMPLETION
        store.put(marker, manifest.encode())
    except Exception as e:
        cleanup = None
        try:
            store.delete(staging)
        except Exception as again:
            cleanup = again
        raise PublicationError(phase, output_key, marker, staging, e, cleanup) from e
    try:
        store.delete(staging)
    except Exception as e:
        raise PublicationError(PublicationPhase.CLEANUP_STAGING, output_key, marker, staging, e) from e
    return manifest
