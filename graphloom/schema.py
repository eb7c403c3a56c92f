"""Tables, kinds and edge types of a code graph."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _B, _D = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


_RANGE = T.ArrayType(_I)
_LINES = _table(sl=_I, sc=_I, el=_I, ec=_I)
RELATIONSHIP = _table(symbol=_S, is_reference=_B, is_implementation=_B, is_type_definition=_B, is_definition=_B)
SYMBOL_INFO = _table(symbol=_S, display_name=_S, kind=_I, documentation=T.ArrayType(_S), signature=_S, enclosing_symbol=_S, relationships=T.ArrayType(RELATIONSHIP))
#: The four ways in which a range arrives; unset ones are null.
OCCURRENCE = _table(
    symbol=_S,
    symbol_roles=_I,
    single_line=_table(line=_I, sc=_I, ec=_I),
    multi_line=_LINES,
    range=_RANGE,
    single_line_enclosing=_table(line=_I, sc=_I, ec=_I),
    multi_line_enclosing=_LINES,
    enclosing_range=_RANGE,
)
METADATA = _table(project_root=_S, tool_name=_S, tool_version=_S, tool_arguments=T.ArrayType(_S))
#: Rows of a document (one, unless it is large), after one of metadata (doc_ord 0) and before those of external symbols; first: the place of the row's first symbol, and of its first occurrence, in its document.
INDEX = _table(doc_ord=_L, part=_S, relative_path=_S, language=_S, symbols=T.ArrayType(SYMBOL_INFO), occurrences=T.ArrayType(OCCURRENCE), metadata=METADATA, first=_L)
#: What an index is written of: a row per symbol, per occurrence and per document (what), whose places in the document are in the order of (g, k1, k2).
ITEM = _table(doc_ord=_L, part=_S, what=_I, g=_I, k1=_L, k2=_L, relative_path=_S, language=_S, symbol=SYMBOL_INFO, occurrence=OCCURRENCE, metadata=METADATA)

FILES = _table(id=_L, path=_S, language=_S, subsystem=_S, sha=_S)
SYMBOLS = _table(id=_L, scip_symbol=_S, name=_S, kind=_S, signature=_S, documentation=_S, def_file_id=_L, def_start_line=_I, def_end_line=_I, is_external=_B, subsystem=_S, enclosing_symbol=_S)
OCCURRENCES = _table(id=_L, symbol_id=_L, file_id=_L, start_line=_I, start_col=_I, end_line=_I, end_col=_I, role=_I, enclosing_symbol_id=_L)
EDGES = _table(edge_ord=_L, src_id=_L, dst_id=_L, type=_S, file_id=_L, line=_I, weight=_I, confidence=_D, metadata=_S)
META = _table(key=_S, value=_S)
TABLES = {"files": FILES, "symbols": SYMBOLS, "occurrences": OCCURRENCES, "edges": EDGES, "meta": META}

COMPILE_COMMANDS = _table(directory=_S, file=_S, command=_S, arguments=T.ArrayType(_S), output=_S)

#: Kinds by the number that the index has for them.
KIND_OF_NUMBER = {7: "struct", 8: "constant", 9: "constructor", 11: "enum", 15: "field", 17: "function", 21: "interface", 25: "macro", 26: "method", 29: "module", 37: "parameter", 41: "property", 49: "struct", 55: "typedef", 58: "type_parameter", 59: "union", 60: "global_var", 61: "variable"}
DEFAULT_KIND = "global_var"
EDGE_TYPES = ("calls", "references", "ops_bind", "contains", "type_of", "implements", "defines", "macro_expands", "includes")
NEIGHBOURHOOD_TYPES = ("calls", "references", "ops_bind", "implements", "type_of", "contains")
CALL_TYPES = ("calls", "ops_bind")
OPS_SUFFIXES = ("_operations", "_ops", "_handler", "_table", "_callbacks", "_hooks", "_methods", "_funcs", "_fops")
DEFINITION = 1  # bit of an occurrence's role
