"""What the library raises."""


class EngineError(Exception):
    """Base of all errors of this library."""


class InvalidParameter(EngineError, ValueError):
    """A parameter is out of its range."""


class InvalidFingerprint(EngineError):
    """Fingerprint data is missing or malformed."""


class InvalidIndexData(EngineError):
    """Index and fingerprints do not belong together."""


class InvalidIndexerState(EngineError):
    """An operation that the session's state does not allow."""


class InvalidMatchSequence(EngineError):
    """Query fingerprints are not numbered 0, 1, 2, ..."""


class InvalidCodebook(EngineError):
    """Codebook data of a wrong size."""
