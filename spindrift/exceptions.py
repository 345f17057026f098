"""Errors of the lineage engine."""


class LineageError(Exception):
    """Base of all errors here."""


class ManifestNotFoundError(LineageError):
    """No manifest at the path."""


class ManifestParseError(LineageError):
    """The manifest is no JSON object of the expected form."""


class CatalogParseError(LineageError):
    """The catalog is no JSON object of the expected form."""


class ColumnNotFoundError(LineageError):
    """No such column; the message lists the model's columns."""


class SQLParseError(LineageError):
    """SQL that can't be parsed; analysis records it instead of raising."""
