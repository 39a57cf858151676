"""Errors that callers may tell apart."""


class EngineError(Exception):
    pass


class UnsupportedLanguage(EngineError):
    pass


class ParseFailed(EngineError):
    pass


class ResolutionFailed(EngineError):
    pass


class GraphError(EngineError):
    pass


class NodeNotFound(GraphError):
    pass


class SearchError(EngineError):
    pass


class ConfigError(EngineError):
    pass


class StoreVersionError(GraphError):
    pass
