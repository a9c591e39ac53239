"""Completion manifests: a JSON record beside an output that says which input and which bytes are complete."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from ..functions.aggregates import DIGEST_SCHEME
from .errors import InvalidManifest, InvalidSnapshot, ManifestViolation, ReadManifestError, SnapshotViolation, UnsupportedDigestScheme, UnsupportedManifestVersion
from .store import ObjectMeta


def manifest_key(output_key: str) -> str:
    return f"{output_key}.manifest.json"


def _filled(text: str | None) -> bool:
    return bool(text and text.strip())


@dataclass(frozen=True)
class CompletionManifest:
    """Version 1 ends with ``content_digest``; version 2 binds the record to a run and to the output's identity."""

    schema_version: int
    input_key: str
    input_size: int
    input_e_tag: str | None
    input_last_modified: str
    row_count: int
    content_digest: str
    run_id: str | None = None
    input_version: str | None = None
    output_key: str | None = None
    output_e_tag: str | None = None
    output_version: str | None = None
    digest_scheme: str | None = None

    def validate(self) -> CompletionManifest:
        if self.schema_version == 1:
            return self
        if self.schema_version != 2:
            raise UnsupportedManifestVersion(self.schema_version)
        if not _filled(self.run_id):
            raise InvalidManifest(ManifestViolation.MISSING_RUN_ID)
        if not _filled(self.output_key):
            raise InvalidManifest(ManifestViolation.MISSING_OUTPUT_KEY)
        identities = [x for x in (self.output_e_tag, self.output_version) if x is not None]
        if not identities:
            raise InvalidManifest(ManifestViolation.MISSING_OUTPUT_IDENTITY)
        if not all(map(_filled, identities)):
            raise InvalidManifest(ManifestViolation.EMPTY_OUTPUT_IDENTITY)
        if not _filled(self.digest_scheme):
            raise InvalidManifest(ManifestViolation.MISSING_DIGEST_SCHEME)
        if self.digest_scheme != DIGEST_SCHEME:
            raise UnsupportedDigestScheme(self.digest_scheme)
        return self

    def encode(self) -> bytes:
        """JSON; fields of version 2 that are not set are left out."""
        later = {"run_id", "input_version", "output_key", "output_e_tag", "output_version", "digest_scheme"}
        return json.dumps({k: v for k, v in asdict(self).items() if v is not None or k not in later}).encode()

    @staticmethod
    def first(input_meta: ObjectMeta, rows: int, digest: str) -> CompletionManifest:
        return CompletionManifest(1, input_meta.location, input_meta.size, input_meta.e_tag, input_meta.last_modified, rows, digest)

    @staticmethod
    def second(input_meta: ObjectMeta, rows: int, digest: str, run_id: str, output_key: str, output: ObjectMeta) -> CompletionManifest:
        """The record of an output; its metadata must be of that key and have an identity."""
        if output.location != output_key:
            raise InvalidSnapshot(output_key, SnapshotViolation.LOCATION)
        if not output.has_identity:
            raise InvalidSnapshot(output_key, SnapshotViolation.MISSING_IDENTITY)
        kept = [x if _filled(x) else None for x in (output.e_tag, output.version)]
        return CompletionManifest(
            2, input_meta.location, input_meta.size, input_meta.e_tag, input_meta.last_modified, rows, digest, run_id, input_meta.version, output_key, *kept, DIGEST_SCHEME
        ).validate()


_KINDS = {"schema_version": int, "input_size": int, "row_count": int, "input_key": str, "input_last_modified": str, "content_digest": str}


def decode_manifest(data: bytes) -> CompletionManifest:
    """A manifest from its bytes; unknown fields are ignored, and the version's rules are checked."""
    try:
        raw = json.loads(data)
        for name, kind in _KINDS.items():
            if not isinstance(raw[name], kind) or isinstance(raw[name], bool):
                raise TypeError(f"{name} must be {kind.__name__}")
        known = {f.name: raw.get(f.name) for f in fields(CompletionManifest)}
        for name, value in known.items():
            if name not in _KINDS and not isinstance(value, (str, type(None))):
                raise TypeError(f"{name} must be a text")
    except (ValueError, KeyError, TypeError) as e:
        raise ReadManifestError(f"unreadable manifest: {e!r}") from e
    return CompletionManifest(**known).validate()
