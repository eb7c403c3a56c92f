"""Symbol strings taken apart by regular expressions, inside whole-stage code: no Python on the executors.

A symbol is ``scheme manager name version descriptors`` or ``local id``.  A descriptor is a name, in
backticks if need be, and a suffix that tells its kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"(?:`(?:[^`]|``)*+`?|[\p{L}\p{N}_+$-]*+)"
#: Parameter lists with a full stop, parameters, type parameters, one sign, a bracket that never closes, any other sign, the end.
_SUFFIX = r"(?:\(.*?\)\.|\([^)]*\)|\[[^\]]*\]|[/#.!:]|[(\[].*|.|$)"
_TOKEN = rf"(?s)(?=.){_NAME}{_SUFFIX}"
_PARTS = rf"(?s)^({_NAME})({_SUFFIX})$"


def _descriptor(token: Column) -> Column:
    """struct(name, suffix, kind) of a token; kind is null where a bracket never closes."""
    raw, suffix = F.regexp_extract(token, _PARTS, 1), F.regexp_extract(token, _PARTS, 2)
    quoted = F.startswith(raw, F.lit("`"))
    bare = F.replace(F.regexp_replace(F.substring(raw, 2, 1 << 30), "(?s)^((?:[^`]|``)*+)`$", "$1"), F.lit("``"), F.lit("`"))
    name = F.when(quoted, bare).otherwise(raw)
    first = F.substring(suffix, 1, 1)
    kind = (
        F.when(suffix == "", "global_var")
        .when(first == "/", "module")
        .when(first == "#", "struct")
        .when(first.isin(".", ":"), "global_var")
        .when(first == "!", "macro")
        .when((first == "(") & F.endswith(suffix, F.lit(").")), "function")
        .when((first == "(") & F.endswith(suffix, F.lit(")")), "parameter")
        .when((first == "[") & F.endswith(suffix, F.lit("]")), "type_parameter")
        .when(~first.isin("(", "["), "global_var")
    )
    other = (suffix != "") & ~first.isin("/", "#", ".", ":", "!", "(", "[")
    return F.struct(F.when(other, F.concat(name, suffix)).otherwise(name).alias("name"), F.when(other, "").otherwise(suffix).alias("suffix"), kind.alias("kind"))


def descriptors(text: Column) -> Column:
    """array<struct<name, suffix, kind>> of the part behind the header."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), _descriptor), lambda d: d["kind"].isNotNull())


def _written(d: Column) -> Column:
    """A descriptor as it stands in a symbol; names with other signs than those of identifiers are quoted."""
    quote = F.rlike(d["name"], F.lit(r"[^\p{L}\p{N}_+$`-]"))
    return F.concat(F.when(quote, F.concat(F.lit("`"), F.replace(d["name"], F.lit("`"), F.lit("``")), F.lit("`"))).otherwise(d["name"]), d["suffix"])


def parse_symbol(symbol: Column) -> Column:
    """struct(scheme, package, descriptors, short_name, kind, enclosing_symbol); null for an empty or null symbol."""
    parts = F.split(symbol, " ", 5)
    n = F.size(parts)
    none = F.array().cast("array<struct<name: string, suffix: string, kind: string>>")
    local = F.struct(F.lit("local").alias("scheme"), F.lit("").alias("package"), none.alias("descriptors"), F.substring(symbol, 7, 1 << 30).alias("short_name"), F.lit("variable").alias("kind"), F.lit("").alias("enclosing_symbol"))
    package = F.array_join(F.when(n < 5, F.slice(parts, 2, F.greatest(n - 1, F.lit(0)))).otherwise(F.slice(parts, 2, 3)), " ")
    found = F.when(n < 5, none).otherwise(descriptors(F.get(parts, F.lit(4))))

    def whole(d: Column) -> Column:
        last = F.try_element_at(d, F.lit(-1))
        before = F.array_join(F.transform(F.slice(d, 1, F.greatest(F.size(d) - 1, F.lit(0))), _written), "")
        enclosing = F.when(F.size(d) > 1, F.concat(F.get(parts, F.lit(0)), F.lit(" "), package, F.lit(" "), before)).otherwise("")
        return F.struct(F.get(parts, F.lit(0)).alias("scheme"), package.alias("package"), d.alias("descriptors"), F.coalesce(last["name"], F.lit("")).alias("short_name"), F.coalesce(last["kind"], F.lit("global_var")).alias("kind"), enclosing.alias("enclosing_symbol"))

    general = F.element_at(F.transform(F.array(found), whole), 1)
    return F.when((symbol.isNull()) | (symbol == ""), F.lit(None)).when(F.startswith(symbol, F.lit("local ")), local).otherwise(general)
