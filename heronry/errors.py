"""Errors that tell a caller which contract was broken."""


class IncompatibleIndexError(ValueError):
    """Sources disagree with each other, or a corpus has no source."""


class IncompatibleQueryError(ValueError):
    """A query lacks a feature that a stage needs, or has it from another encoder."""
