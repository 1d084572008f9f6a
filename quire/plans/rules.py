"""The rules of document trees: which environ may stand under which."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The order of sectioning commands, the environs of children by their parent's, the environs by a file's
# extension, and whose commands bring in what. E_* is any environment but E_document and E_thebibliography.
SECTIONS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")
_BELOW_INPUT = ("chapter", "section", "subsection", "subsubsection", "paragraph", "graphic_file", "E_thebibliography", "E_*")
CHILDREN = {
    "main_file": ("preamble", "E_document"),
    "preamble": ("input_preamble", "usepackage"),
    "input_preamble": ("input_preamble", "usepackage"),
    "input": _BELOW_INPUT,
    "include": _BELOW_INPUT,
    "usepackage": (),
    "bibliography": (),
    "part": ("input", "chapter", "section", "paragraph", "graphic_file", "E_thebibliography", "E_*"),
    "chapter": ("input", "section", "paragraph", "graphic_file", "E_thebibliography", "E_*"),
    "section": ("input", "subsection", "paragraph", "graphic_file", "E_thebibliography", "E_*"),
    "subsection": ("input", "subsubsection", "paragraph", "graphic_file", "E_thebibliography", "E_*"),
    "subsubsection": ("input", "paragraph", "graphic_file", "E_thebibliography", "E_*"),
    "paragraph": ("graphic_file",),
    "E_document": ("include", "input", "part", "chapter", "section", "subsection", "paragraph", "bibliography", "E_thebibliography", "graphic_file", "E_*"),
    "E_thebibliography": (),
    "E_*": ("input", "paragraph", "graphic_file", "E_*"),
}
EXTENSIONS = {
    ".tex": ("main_file", "preamble", "input", "include", "input_preamble", "part", "chapter", "section", "subsection", "subsubsection", "paragraph", "E_document", "E_thebibliography", "E_*"),
    ".sty": ("usepackage",),
    ".bbl": ("E_thebibliography",),
    ".bib": ("bibliography",),
}
PICTURE_COMMANDS = ("includegraphics",)


def _pairs(table: dict[str, tuple]) -> list[tuple[str, str]]:
    return [(a, b) for a, bs in table.items() for b in bs]


def child_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_pairs(CHILDREN), "parent string, child string")


def extension_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_pairs(EXTENSIONS), "ext string, child string")


def _values(table: dict[str, tuple]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in _pairs(table))


def child_rules_sql() -> str:
    return f"rules(parent, child) AS (VALUES {_values(CHILDREN)})"


def extension_rules_sql() -> str:
    return f"exts(ext, child) AS (VALUES {_values(EXTENSIONS)})"


def kind_sql(c: str) -> str:
    return f"CASE WHEN {c} LIKE 'E\\_%' ESCAPE '\\' AND {c} NOT IN ('E_document', 'E_thebibliography') THEN 'E_*' ELSE {c} END"
