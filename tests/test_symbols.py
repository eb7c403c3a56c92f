import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions.symbols import parse_symbol

KIND = {"/": "module", "#": "struct", ".": "global_var", ":": "global_var", "!": "macro"}


def spec(text):
    """The grammar, sign by sign."""
    out, i = [], 0
    ident = lambda c: c.isalnum() or c in "_+-$"
    while i < len(text):
        if text[i] == "`":
            m = re.compile(r"`((?:[^`]|``)*)`?", re.S).match(text, i)
            name, i = m[1].replace("``", "`"), m.end()
        else:
            j = i
            while j < len(text) and ident(text[j]):
                j += 1
            name, i = text[i:j], j
        rest = text[i:]
        if not rest:
            out.append((name, "", "global_var"))
        elif rest[0] in "([":
            for end, kind in (((").", "function"), (")", "parameter")) if rest[0] == "(" else (("]", "type_parameter"),)):
                if (k := rest.find(end)) >= 0:
                    out.append((name, rest[: k + len(end)], kind))
                    i += k + len(end)
                    break
            else:
                break
        elif rest[0] in KIND:
            out.append((name, rest[0], KIND[rest[0]]))
            i += 1
        else:
            out.append((name + rest[0], "", "global_var"))
            i += 1
    return out


HEAD = "cxx . . $ "
TAILS = ["file_operations#", "file_operations#read_iter.", "ext4_file_read_iter().", "__sifields#$anonymous_type_0#_pid.", "loff_t.", "a/b/c#d(+1).", "`odd name`#x.", "`tick``ed`.", "f(x)", "T[U]", "m!", "v:", "bare", "bad(", "bad[", "a b#", "é1#ß.", "x(y).(z)", "f().x(", "``.", "`open"]


def test_descriptors_follow_the_grammar(spark):
    rows = spark.createDataFrame([(HEAD + t, t) for t in TAILS], "s string, t string").select("t", parse_symbol(F.col("s")).alias("p")).collect()
    for r in rows:
        assert [tuple(d) for d in r["p"]["descriptors"]] == spec(r["t"]), r["t"]


@pytest.mark.parametrize(
    ("symbol", "name", "kind", "enclosing"),
    [
        (HEAD + "file_operations#", "file_operations", "struct", ""),
        (HEAD + "file_operations#read_iter.", "read_iter", "global_var", HEAD + "file_operations#"),
        (HEAD + "f().", "f", "function", ""),
        (HEAD + "a#$anonymous_type_0#_pid.", "_pid", "global_var", HEAD + "a#$anonymous_type_0#"),
        ("local 42", "42", "variable", ""),
        ("cxx", "", "global_var", ""),
        ("cxx . . $", "", "global_var", ""),
        ("malformed", "", "global_var", ""),
        ("scip clang c linux v6.12 X#", "X", "struct", "scip clang c linux v6.`12 `"),
    ],
)
def test_parts(spark, symbol, name, kind, enclosing):
    p = spark.createDataFrame([(symbol,)], "s string").select(parse_symbol(F.col("s")).alias("p")).first()["p"]
    assert (p["short_name"], p["kind"], p["enclosing_symbol"]) == (name, kind, enclosing)


def test_empty_symbols_are_null(spark):
    rows = spark.createDataFrame([("",), (None,)], "s string").select(parse_symbol(F.col("s")).alias("p")).collect()
    assert [r["p"] for r in rows] == [None, None]
