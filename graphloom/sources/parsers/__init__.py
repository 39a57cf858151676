"""Parsers by language: one file's bytes to its definitions, imports, calls and heritage."""
from .base import Facts, Provider, Registry, default_registry

__all__ = ["Facts", "Provider", "Registry", "default_registry"]
