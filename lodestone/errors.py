"""What the engine raises."""


class EngineError(Exception):
    """Base of all errors of this package."""


class ConfigError(EngineError, ValueError):
    """A configuration that can't work."""


class ValidationError(EngineError, ValueError):
    """A request that doesn't fit the state or configuration."""


class NoDocumentsError(EngineError):
    """Nothing was ingested."""


class NotBuiltError(EngineError):
    """build() has not run since the last change."""


class StorageError(EngineError, OSError):
    """A graph file can't be read or written."""


class SerializationError(EngineError, ValueError):
    """A payload can't be encoded or decoded."""


class NetworkError(EngineError, ConnectionError):
    """A model server can't be reached."""


class HTTPStatusError(NetworkError):
    """A model server answered with an error status."""


class GenerationError(EngineError):
    """A model server answered without a completion."""


class EmbeddingError(EngineError):
    """A model server answered without an embedding."""
