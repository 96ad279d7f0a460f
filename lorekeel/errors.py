"""Errors of the engine; each has its own class, so that callers can tell them apart."""

from __future__ import annotations


class EngineError(Exception):
    """Any error of this package."""


class EntityNotFound(EngineError):
    """No entity has the id or name."""


class RevisionNotFound(EngineError):
    """The log has no such revision."""


class RunNotFound(EngineError):
    """No run has the id."""


class ResolutionAmbiguous(EngineError):
    """A name means several entities."""


class ValidationError(EngineError, ValueError):
    """A record or an argument breaks a rule."""
