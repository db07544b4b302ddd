"""Exceptions of the engine."""


class MassloomError(Exception):
    """Base of all errors raised here."""


class ReaderError(MassloomError):
    """A dataset can't be opened or lacks a table."""


class WriterError(MassloomError):
    """A dataset can't be written."""


class ContractError(MassloomError):
    """A spectrum breaks the ingest contract."""


class SchemaError(MassloomError):
    """A table lacks a required column or has it with another type."""


class DecodeError(MassloomError):
    """A binary array can't be decoded."""
