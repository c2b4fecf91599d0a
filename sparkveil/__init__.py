"""sparkveil: find, protect and report on sensitive data with Spark DataFrames.

The calls that most users need can be taken from here; each is imported when it is first asked for.
"""

from importlib import import_module

_PUBLIC = {
    "operators.scan": ("TextPattern", "scan", "scan_for", "base_patterns"),
    "operators.documents": ("analyze", "protect", "summarize", "term_spans", "leaks"),
    "operators.table": ("Decision", "Finding", "classify", "apply_decisions", "suggested"),
    "operators.files": ("review_file", "protect_file", "write_file", "file_totals"),
    "operators.pseudonyms": ("assign",),
    "operators.restore": ("restore",),
    "operators.quality": ("parse_annotated", "outcomes", "metrics"),
    "sources.readers": ("read_csv", "read_texts", "read_json_table", "html_tables", "read_docx"),
    "sources.office": ("read_workbooks", "write_workbook", "write_workbook_parts"),
    "sources.pdf": ("read_pdfs",),
    "sources.writers": ("write_csv", "write_equivalences", "encrypt_rows", "decrypt_rows"),
}
_WHERE = {name: f"sparkveil.{module}" for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str) -> object:
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_WHERE[name]), name)
