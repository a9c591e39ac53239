"""What can go wrong, and what is known afterwards."""

from __future__ import annotations

from enum import Enum


class PipelineIoError(RuntimeError):
    """Any failure of reading, writing or publishing; the cause is kept."""


#: The names of phases and outcomes, which callers tell failures by.
class PublicationPhase(Enum):
    UPLOAD = "Upload"
    INVALIDATE_COMPLETION = "InvalidateCompletion"
    PUBLISH_OUTPUT = "PublishOutput"
    CAPTURE_OUTPUT_IDENTITY = "CaptureOutputIdentity"
    WRITE_COMPLETION = "WriteCompletion"
    CLEANUP_STAGING = "CleanupStaging"


class PublicationOutcome(Enum):
    NOT_PUBLISHED = "NotPublished"
    PUBLICATION_UNKNOWN = "PublicationUnknown"
    PUBLISHED_WITHOUT_COMPLETION = "PublishedWithoutCompletion"
    COMPLETION_UNKNOWN = "CompletionUnknown"
    COMPLETED_CLEANUP_UNKNOWN = "CompletedCleanupUnknown"


#: What is known about the output when a phase has failed.
OUTCOME_OF = {
    PublicationPhase.UPLOAD: PublicationOutcome.NOT_PUBLISHED,
    PublicationPhase.INVALIDATE_COMPLETION: PublicationOutcome.NOT_PUBLISHED,
    PublicationPhase.PUBLISH_OUTPUT: PublicationOutcome.PUBLICATION_UNKNOWN,
    PublicationPhase.CAPTURE_OUTPUT_IDENTITY: PublicationOutcome.PUBLISHED_WITHOUT_COMPLETION,
    PublicationPhase.WRITE_COMPLETION: PublicationOutcome.COMPLETION_UNKNOWN,
    PublicationPhase.CLEANUP_STAGING: PublicationOutcome.COMPLETED_CLEANUP_UNKNOWN,
}


class PublicationError(PipelineIoError):
    """A failed publication.  ``staging_key`` is this run's own and may be deleted; ``output_key`` is shared and may not."""

    def __init__(self, phase: PublicationPhase, output_key: str, manifest_key: str, staging_key: str, cause: BaseException, cleanup_error: BaseException | None = None):
        self.phase, self.outcome = phase, OUTCOME_OF[phase]
        self.output_key, self.manifest_key, self.staging_key, self.cleanup_error = output_key, manifest_key, staging_key, cleanup_error
        tail = f"; removing the staged object failed, too: {cleanup_error}" if cleanup_error else ""
        super().__init__(f"{phase.value} of {output_key} ({self.outcome.value}): {cause}{tail}")
        self.__cause__ = cause


class StagingPhase(Enum):
    CREATE = "Create"
    WRITE = "Write"
    CLOSE = "Close"
    FILE_SYNC = "FileSync"
    RENAME = "Rename"
    PARENT_SYNC = "ParentSync"


class StagingOutcome(Enum):
    NOT_PUBLISHED = "NotPublished"
    PUBLISHED_DURABILITY_UNCERTAIN = "PublishedDurabilityUncertain"


class StagingError(PipelineIoError):
    def __init__(self, phase: StagingPhase, path: str, cause: BaseException):
        self.phase, self.path = phase, path
        self.outcome = StagingOutcome.PUBLISHED_DURABILITY_UNCERTAIN if phase is StagingPhase.PARENT_SYNC else StagingOutcome.NOT_PUBLISHED
        super().__init__(f"{phase.value} of {path} ({self.outcome.value}): {cause}")
        self.__cause__ = cause


class SnapshotViolation(Enum):
    MISSING_IDENTITY = "MissingIdentity"
    LOCATION = "Location"
    IDENTITY = "Identity"
    SIZE = "Size"
    RANGE = "Range"
    LENGTH = "Length"


class InvalidSnapshot(PipelineIoError):
    def __init__(self, key: str, violation: SnapshotViolation, expected: object = None, actual: object = None):
        self.key, self.violation, self.expected, self.actual = key, violation, expected, actual
        detail = f": expected {expected}, found {actual}" if expected is not None or actual is not None else ""
        super().__init__(f"{key}: {violation.value}{detail}")


class ManifestViolation(Enum):
    OUTPUT_KEY_MISMATCH = "OutputKeyMismatch"
    MISSING_RUN_ID = "MissingRunId"
    MISSING_OUTPUT_KEY = "MissingOutputKey"
    MISSING_OUTPUT_IDENTITY = "MissingOutputIdentity"
    EMPTY_OUTPUT_IDENTITY = "EmptyOutputIdentity"
    MISSING_DIGEST_SCHEME = "MissingDigestScheme"


class InvalidManifest(PipelineIoError):
    def __init__(self, violation: ManifestViolation):
        self.violation = violation
        super().__init__(violation.value)


class ReadManifestError(PipelineIoError):
    pass


class UnsupportedManifestVersion(PipelineIoError):
    def __init__(self, version: object):
        self.version = version
        super().__init__(f"manifest version {version} is not supported")


class UnsupportedDigestScheme(PipelineIoError):
    def __init__(self, scheme: str):
        self.scheme = scheme
        super().__init__(f"digest scheme {scheme!r} is not supported")


class CompletionIdentityRequired(PipelineIoError):
    def __init__(self, version: int):
        self.version = version
        super().__init__(f"a completed read needs the output's identity, which version {version} lacks")
