"""Domains and schemas of the code graph: nodes, edges and the facts that parsers yield."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The domains of labels, relations and languages, and what files each language has.
NODE_LABELS = (
    "Project", "Package", "Module", "Folder", "File", "Class", "Function", "Method", "Variable", "Interface", "Enum", "Decorator", "Import", "Type", "CodeElement", "Community", "Process",
    "Struct", "Macro", "Typedef", "Union", "Namespace", "Trait", "Impl", "TypeAlias", "Const", "Static", "Property", "Record", "Delegate", "Annotation", "Constructor", "Template", "Section", "Route", "Tool",
)
CALLABLE = ("Function", "Method", "Constructor")
TYPE_DEFS = ("Class", "Interface", "Struct", "Enum", "Trait", "TypeAlias", "Record", "Union", "Delegate", "Template")
NOT_SYMBOLS = ("Project", "Package", "Module", "Folder", "File", "Community", "Process", "Section", "Import")
RELATIONS = (
    "CONTAINS", "CALLS", "INHERITS", "OVERRIDES", "IMPORTS", "USES", "DEFINES", "DECORATES", "IMPLEMENTS", "EXTENDS", "HAS_METHOD", "HAS_PROPERTY", "ACCESSES", "MEMBER_OF", "STEP_IN_PROCESS",
    "HANDLES_ROUTE", "FETCHES", "HANDLES_TOOL", "ENTRY_POINT_OF", "WRAPS", "QUERIES",
)
EXTENSIONS = {
    "typescript": ("ts", "tsx", "mts", "cts"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "python": ("py", "pyi"),
    "java": ("java",),
    "kotlin": ("kt", "kts"),
    "go": ("go",),
    "rust": ("rs",),
    "csharp": ("cs",),
    "c": ("c", "h"),
    "cpp": ("cpp", "cxx", "cc", "hpp", "hxx", "hh"),
    "php": ("php",),
    "ruby": ("rb",),
    "swift": ("swift",),
    "dart": ("dart",),
}
IMPACT_RELATIONS = ("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "USES")

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(text: str) -> T.StructType:
    """A schema from "name type, ...", without a session (workers import this, too)."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in text.split(", "))])


NODES = _struct(
    "id string, label string, name string, file_path string, container_name string, qualified_name string, symbol_key string, start_line int, end_line int, language string, "
    "is_exported boolean, parameter_count int, return_type string, visibility string, is_static boolean, is_async boolean, body_hash bigint, annotations array<string>, "
    "heuristic_label string, cohesion double, symbol_count int, process_type string, step_count int, communities array<string>, entry_point_id string, terminal_id string"
)
EDGES = _struct("id string, source_id string, target_id string, rel_type string, confidence double, reason string, step int")
FILES = _struct("relative_path string, language string, size bigint, content binary, hash bigint")
IMPORTS = _struct("source_file string, imported_name string, module_path string, alias string, is_default boolean, is_namespace boolean, line int")
CALLS = _struct("caller_id string, callee_name string, receiver string, file_path string, line int, arguments_count int")
HERITAGE = _struct("child_id string, parent_name string, kind string, file_path string")
ASSIGNMENTS = _struct("variable_name string, assigned_from_kind string, assigned_from string, scope string, file_path string, resolved_type string")
SYMBOLS = _struct("node_id string, name string, label string, file_path string, language string, is_exported boolean, return_type string, start_line int, end_line int")
FILE_HASHES = _struct("file_path string, hash bigint")


def is_symbol(label: Column) -> Column:
    return ~label.isin(*NOT_SYMBOLS)


def is_callable(label: Column) -> Column:
    return label.isin(*CALLABLE)


def is_type_def(label: Column) -> Column:
    return label.isin(*TYPE_DEFS)


def language_of_extension(extension: Column) -> Column:
    """The language's name, null for an extension that isn't known; case counts."""
    known = F.create_map(*[F.lit(x) for name, exts in EXTENSIONS.items() for e in exts for x in (e, name)])
    return F.try_element_at(known, extension)


def edge_id(source: Column, rel_type: Column, target: Column) -> Column:
    """At most one edge for each source, relation and target: its id says so."""
    return F.concat(source, F.lit("-["), rel_type, F.lit("]->"), target)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema, cast; those that are missing are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def make_edges(df: DataFrame, source: Column, target: Column, rel_type: str | Column, confidence: float | Column, reason: str | Column) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    rel = as_col(rel_type)
    return df.select(
        edge_id(source, rel, target).alias("id"), source.alias("source_id"), target.alias("target_id"), rel.alias("rel_type"), as_col(confidence).cast("double").alias("confidence"), as_col(reason).alias("reason"), F.lit(None).cast("int").alias("step")
    )


def file_nodes(df: DataFrame, path: Column, language: Column) -> DataFrame:
    name = F.element_at(F.split(path, "/"), -1)
    return conform(df.select(F.concat(F.lit("file::"), path).alias("id"), F.lit("File").alias("label"), name.alias("name"), path.alias("file_path"), language.alias("language")), NODES)


def qualified_name(container: Column, name: Column) -> Column:
    return F.concat_ws(".", container, name)


def with_diff_metadata(nodes: DataFrame) -> DataFrame:
    """qualified_name and symbol_key (language, label, qualified name, arity) where they are missing."""
    qualified = F.coalesce(F.col("qualified_name"), qualified_name(F.col("container_name"), F.col("name")))
    out = nodes.withColumn("qualified_name", qualified)
    key = F.concat_ws("::", F.coalesce("language", F.lit("unknown")), "label", "qualified_name", F.coalesce("parameter_count", F.lit(0)).cast("string"))
    return out.withColumn("symbol_key", F.coalesce("symbol_key", key))


def location_key() -> Column:
    return F.concat_ws("::", "file_path", "label", F.coalesce("qualified_name", "name"), F.coalesce("parameter_count", F.lit(0)).cast("string"))
