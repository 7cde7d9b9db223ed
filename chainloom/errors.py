"""Errors that the engine raises."""


class EngineError(Exception):
    """Any refusal or failure of the engine."""


class SyntaxRejected(EngineError):
    """The text is not an admissible read-only query."""


class CoverageError(EngineError):
    """A scan reaches beyond the verified block range."""


class SnapshotChanged(EngineError):
    """The data under a captured snapshot was reorganised."""


class FilterError(EngineError):
    """A log filter or subscription request is malformed."""
