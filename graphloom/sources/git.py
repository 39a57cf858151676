"""A revision of a repository as a folder of files."""
from __future__ import annotations

import io
import subprocess
import tarfile
from pathlib import Path

from ..errors import EngineError

WORKTREE = "worktree"


def _git(root: str | Path, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", str(root), *args], capture_output=True, check=False)
    if done.returncode:
        raise EngineError(done.stderr.decode("utf-8", "replace").strip() or f"git {args[0]} failed")
    return done.stdout


def resolve(root: str | Path, revision: str) -> str:
    return _git(root, "rev-parse", "--verify", f"{revision}^{{commit}}").decode().strip()


def checkout(root: str | Path, revision: str, into: str | Path) -> Path:
    """The revision's files below `into` (a folder that the cluster shares); the work tree itself for WORKTREE, in any case."""
    if revision.lower() == WORKTREE:
        return Path(root)
    data = _git(root, "archive", "--format=tar", resolve(root, revision))
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        tar.extractall(into, filter="data")
    return Path(into)
