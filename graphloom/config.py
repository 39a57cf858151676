"""Settings, with four of them from the environment."""
from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

# Names that a scan passes over.
IGNORED = (
    "node_modules", ".git", "dist", "build", "target", ".next", "__pycache__", ".venv", "venv", ".tox", "vendor", ".idea", ".vscode", "coverage", ".nyc_output", ".cache",
    "*.min.js", "*.min.css", "*.map", "*.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
)


@dataclass(frozen=True)
class Config:
    max_file_size: int = 32 * 1024 * 1024
    ast_cache_capacity: int = 500
    chunk_byte_budget: int = 100 * 1024 * 1024
    max_cross_file_reprocess: int = 10_000
    fixpoint_max_iterations: int = 50
    fixpoint_convergence_threshold: float = 0.001
    community_resolution: float = 1.0
    max_processes: int = 200
    max_trace_depth: int = 15
    worker_threads: int = field(default_factory=lambda: max(1, (os.cpu_count() or 4) - 1))
    ignore_patterns: tuple[str, ...] = IGNORED

    @classmethod
    def from_env(cls, environ: dict[str, str] | None = None) -> Config:
        """GG_MAX_FILE_SIZE, GG_AST_CACHE_CAPACITY, GG_WORKER_THREADS, GG_FIXPOINT_MAX_ITERATIONS; what is no number doesn't count."""
        env, given = os.environ if environ is None else environ, {}
        for f in fields(cls):
            if f.name in ("max_file_size", "ast_cache_capacity", "worker_threads", "fixpoint_max_iterations"):
                value = env.get(f"GG_{f.name.upper()}", "")
                if value.isascii() and value.isdigit():
                    given[f.name] = int(value)
        return replace(cls(), **given)
