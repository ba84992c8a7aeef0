"""tabloom: document tables and records on Spark. The names below are loaded when they are first used."""

from importlib import import_module

#: Public names by the module that holds them.
_PUBLIC = {
    "functions.text": ("normalize_text", "normalize_alias", "cell_type", "header_tokens", "keyword_matches", "temporal_patterns", "unit_patterns", "footnote_markers", "pipe_cells", "pipe_row"),
    "functions.values": ("coerce", "format_number", "format_date", "format_text"),
    "operators.tables": ("render", "parse", "parse_sections", "unpivot", "classify", "map_transposed"),
    "operators.pivot": ("detect_pivot", "unpivot_detected", "unpivot_text"),
    "operators.ontology": ("narrower", "lookup", "merge_aliases", "diff_aliases", "check_values", "to_triples", "shape_violations", "profile", "read_ntriples", "read_gazetteer"),
    "plans.contract": ("Contract", "interpret", "save"),
    "plans.documents": ("split_pages", "split_tables", "classify_tables", "route", "run_contract", "save_all", "records", "records_by_page", "to_pandas", "to_arrow", "report_date"),
    "plans.semantics": ("SemanticContext", "materialize", "build_context", "validation_counts"),
    "plans.compile": ("compile_contract",),
    "sources.office": ("read_tables", "html_tables"),
    "session": ("local_session", "table"),
    "sql": ("register",),
}
_WHERE = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(import_module(f".{_WHERE[name]}", __name__), name)
    raise AttributeError(name)


def __dir__() -> list[str]:
    return __all__
