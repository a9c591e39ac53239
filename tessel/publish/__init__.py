"""Publication of outputs: staging, completion manifests, and reads that are bound to what was completed."""

from .completed import download_completed, download_to_temp, read_completed, try_delete, upload_from_temp
from .errors import (
    CompletionIdentityRequired, InvalidManifest, InvalidSnapshot, ManifestViolation, PipelineIoError, PublicationError, PublicationOutcome, PublicationPhase,
    SnapshotViolation, StagingError, StagingOutcome, StagingPhase, UnsupportedDigestScheme, UnsupportedManifestVersion,
)
from .manifest import CompletionManifest, decode_manifest, manifest_key
from .publication import publish
from .staging import StagedFile, publish_dataframe
from .store import HadoopStore, LocalStore, ObjectMeta, ObjectStore

__all__ = [
    "CompletionIdentityRequired", "CompletionManifest", "HadoopStore", "InvalidManifest", "InvalidSnapshot", "LocalStore", "ManifestViolation", "ObjectMeta",
    "ObjectStore", "PipelineIoError", "PublicationError", "PublicationOutcome", "PublicationPhase", "SnapshotViolation", "StagedFile", "StagingError",
    "StagingOutcome", "StagingPhase", "UnsupportedDigestScheme", "UnsupportedManifestVersion", "decode_manifest", "download_completed", "download_to_temp",
    "manifest_key", "publish", "publish_dataframe", "read_completed", "try_delete", "upload_from_temp",
]
