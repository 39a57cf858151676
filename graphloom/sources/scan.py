"""Walking a repository: ignore rules, admission by language and size, contents and hashes."""
from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import extension, glob_regex
from ..schema import EXTENSIONS, FILES, language_of_extension

PARSED = ("typescript", "javascript", "python", "go", "rust")
_LANGUAGE = {e: name for name, exts in EXTENSIONS.items() for e in exts}


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file; `base` is the folder that has the file."""

    pattern: str
    base: str = ""
    folders_only: bool = False
    negated: bool = False

    def matches(self, path: str, is_dir: bool) -> bool:
        if self.folders_only and not is_dir:
            return False
        if self.base:
            if path != self.base and not path.startswith(self.base + "/"):
                return False
            under = path[len(self.base) + 1 :]
        else:
            under = path
        return glob(self.pattern, under if "/" in self.pattern else path.rsplit("/", 1)[-1])


def glob(pattern: str, text: str) -> bool:
    """Whether a pattern in which * is any run of characters fits the whole text."""
    return re.match(glob_regex(pattern), text, re.S) is not None


def parse_rule(line: str, base: str) -> Rule | None:
    """None for a blank line or a comment. A slash in front doesn't anchor; one behind asks for a folder."""
    text = line.strip()
    if not text or text.startswith("#"):
        return None
    text = text[1:] if text.startswith("\\#") else text
    negated = text.startswith("!")
    text = text[1:].lstrip() if negated else text
    folders_only, text = text.endswith("/"), text.rstrip("/").lstrip("/")
    return Rule(text.replace("\\", "/"), base, folders_only, negated) if text else None


def rules_in(folder: Path, base: str) -> list[Rule]:
    try:
        lines = (folder / ".gitignore").read_text().splitlines()
    except (OSError, UnicodeDecodeError):
        return []
    return [r for line in lines if (r := parse_rule(line, base))]


def is_ignored(path: str, is_dir: bool, config: Config, rules: list[Rule]) -> bool:
    """Settings win; else the last rule that fits decides."""
    own = [Rule(p.rstrip("/").replace("\\", "/"), "", p.endswith("/")) for p in config.ignore_patterns]
    if any(r.matches(path, is_dir) for r in own):
        return True
    return next((not r.negated for r in reversed(rules) if r.matches(path, is_dir)), False)


def ignored(path: Column, rules: list[Rule]) -> Column:
    """The same decision over a column of file paths, for rules at the root: the last rule that fits."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.lit(False)
    for r in rules:
        if not r.folders_only:
            out = F.when((path if "/" in r.pattern else name).rlike("(?s)" + glob_regex(r.pattern)), F.lit(not r.negated)).otherwise(out)
    return out


def entries(root: str, base: str, rules: list[Rule], config: Config) -> tuple[list[tuple[str, int]], list[tuple[str, list[Rule]]]]:
    """A folder's files (relative path, size) and subfolders (relative path, rules above) that aren't ignored, by name.

    Links and folders that can't be read are passed over.
    """
    folder = Path(root, base)
    rules = rules + rules_in(folder, base)
    files, folders = [], []
    try:
        found = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return files, folders
    for e in found:
        path = f"{base}/{e.name}" if base else e.name
        if e.is_symlink():
            continue
        is_dir = e.is_dir(follow_symlinks=False)
        if is_ignored(path, is_dir, config, rules):
            continue
        if is_dir:
            folders.append((path, rules))
        elif e.is_file(follow_symlinks=False):
            files.append((path, e.stat(follow_symlinks=False).st_size))
    return files, folders


def walk(root: str | Path, config: Config = Config(), base: str = "", rules: list[Rule] | None = None) -> Iterator[tuple[str, int]]:
    """(relative path, size) of the files that aren't ignored, below a folder whose rules from above are given; folders come after a folder's files."""
    files, folders = entries(str(root), base, rules or [], config)
    yield from files
    for path, own in folders:
        yield from walk(root, config, path, own)


def frontier(root: str | Path, config: Config, most: int) -> tuple[list[tuple[str, int]], list[tuple[str, list[Rule]]]]:
    """The files of the upper folders, and `most` or more folders whose insides haven't been looked at; none if the tree is smaller."""
    files: list[tuple[str, int]] = []
    folders: list[tuple[str, list[Rule]]] = [("", [])]
    while folders and len(folders) < most:
        path, rules = folders.pop(0)
        own, below = entries(str(root), path, rules, config)
        files += own
        folders += below
    return files, folders


def admitted(rows: DataFrame, languages: tuple[str, ...] | None = None, max_file_size: int = Config.max_file_size) -> DataFrame:
    """relative_path, size, language of files of a known language and not too large, by path. rows: relative_path, size."""
    own = rows.withColumn("language", language_of_extension(extension(F.col("relative_path")))).filter(F.col("language").isNotNull() & (F.col("size") <= max_file_size))
    own = own.filter(F.col("language").isin(*languages)) if languages else own
    return own.orderBy("relative_path")


def _extension(path: str) -> str:
    return os.path.splitext(path)[1][1:]


def content_hash(data: bytes) -> int:
    """xxh3 of the bytes, 64 bits as a signed number."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def listing(spark: SparkSession, root: str | Path, config: Config = Config(), languages: tuple[str, ...] | None = PARSED, upper: int | None = None) -> DataFrame:
    """relative_path, size of the files that a scan takes. Ignore files are read top down: the driver walks the upper folders until there
    are `upper` (a few for each executor thread), and the executors walk what is below these; `root` is a folder that all machines see."""
    top, limit = str(root), config.max_file_size
    parts = spark.sparkContext.defaultParallelism

    def taken(path: str, size: int) -> bool:
        return bool((lang := _LANGUAGE.get(_extension(path))) and size <= limit and (not languages or lang in languages))

    files, folders = frontier(top, config, upper or parts * 8)
    found = [(p, s) for p, s in files if taken(p, s)]
    schema = "relative_path string, size long"
    rows = spark.createDataFrame(found, schema).repartition(max(1, min(len(found), parts)))
    if not folders:
        return rows
    below = spark.createDataFrame([(p, [tuple(vars(r).values()) for r in rules]) for p, rules in folders], "folder string, rules array<struct<pattern:string,base:string,folders_only:boolean,negated:boolean>>")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for folder, rules in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = [(p, s) for p, s in walk(top, config, folder, [Rule(**r) for r in rules]) if taken(p, s)]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.string()), pa.array([s for _, s in got], pa.int64())], ["relative_path", "size"])

    return rows.unionByName(below.repartition(min(len(folders), parts * 8)).mapInArrow(run, schema))


def read(rows: DataFrame, root: str | Path) -> DataFrame:
    """FILES of the listed paths, read by the executors; `root` is a folder that all machines see. What can't be read is left out."""
    from pyspark.sql.pandas.types import to_arrow_schema

    top, arrow = str(root), to_arrow_schema(FILES)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    data = Path(top, path).read_bytes()
                except OSError:
                    continue
                out.append({"relative_path": path, "language": _LANGUAGE[_extension(path)], "size": size, "content": data, "hash": content_hash(data)})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.select("relative_path", "size").mapInArrow(run, FILES)


def scan(spark: SparkSession, root: str | Path, config: Config = Config(), languages: tuple[str, ...] | None = PARSED) -> DataFrame:
    """FILES of a repository, with contents and hashes."""
    return read(listing(spark, root, config, languages), root)


def languages_of(files: DataFrame) -> DataFrame:
    return files.select("language").distinct().orderBy("language")
