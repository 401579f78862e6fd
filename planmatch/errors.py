"""One hierarchy for checks that stop a plan; failures of single rows stay data."""


class EngineError(ValueError):
    """A configuration or an input that no plan can be made for."""


class CatalogError(EngineError):
    """The catalog source is missing, incomplete or without coordinates."""


class FieldError(EngineError):
    """A sink lacks fields that are to be written."""


class ServiceError(RuntimeError):
    """A remote service refuses a connection or lacks what is asked of it."""
