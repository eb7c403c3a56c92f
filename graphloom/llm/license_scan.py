"""Operator 8: licence scans by sentence rules, in DataFrame functions only.

After German, Manabe and Inoue, "A sentence-matching method for automatic license identification of
source code files" (2010).  A text is cut into sentences (after ``.``, ``!`` or ``?`` and white space, or at a line's end
unless the next line goes on in lower case); each is normalised (A-Z lower-cased, everything but
letters and digits to single blanks) and looked up among the known licence sentences, or, if it refers to a licence
("licensed under the ...", an SPDX line), its name among the known names.  Identifiers of neighbouring sentences form
sequences; the licence rules, in order, each consume their sequence.  Identifiers that no rule consumes make the licence
``UNKNOWN``.  The tables are in ``licences``; ``scan`` takes others (``Knowledge``).

Before that, each known sentence that is wrapped, whatever its lines begin with (blanks, ``#``, ``*``, ``//``, a blank
line before an address), is taken out whole, if it begins and ends where a sentence may: at a full
stop, or at a line's end that the next line does not go on from in lower case.  A list number before it goes.
``ORACLE_SQL`` does not do this step; the two agree on texts without such notices.

Every known sentence contains one of the anchors, which is checked when this module loads; a text without any
is not cut at all.  Nothing shuffles: one pass, one row in and out.

Defined cases: a null or empty text has no sentences; a sentence that repeats counts each time, its licence is named once;
of rules that fit the same sentences the first counts (ties); a very long text is scanned whole, in one row; an empty
table gives no rows; repeated rows are scanned each; other columns pass unchanged whatever their names, and an output
whose name is taken has an underscore behind it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licences, shared
from .licences import normal

ANCHORS = ("licens", "licenc", "permission", "rights reserved", "redistribut", "cc by", "cc0", "general public", "public domain", "warranties", "spdx", "written authorization", "copy of the mpl", "advertising materials")
_NEUTRAL = "_"


@dataclass
class Knowledge:
    """Sentences (identifier -> wordings), neutral sentences, names (normalised name -> identifier) and rules (licence, identifiers), in order."""

    sentences: dict[str, str] = field(default_factory=lambda: licences.SENTENCES)
    neutral: list[str] = field(default_factory=lambda: licences.NEUTRAL)
    names: dict[str, str] = field(default_factory=lambda: licences.NAME_OF)
    rules: list[tuple[str, tuple[str, ...]]] = field(default_factory=lambda: licences.RULES)

    @property
    def known(self) -> dict[str, str]:
        """Normalised sentence -> identifier."""
        return {normal(x): _NEUTRAL for x in self.neutral} | {normal(x): k for k, v in self.sentences.items() for x in v.split("|")}

    @property
    def single(self) -> dict[str, str]:
        """Identifier -> licence, of rules of one sentence; no longer rule comes after them that has it."""
        return {ids[0]: name for name, ids in reversed(self.rules) if len(ids) == 1}

    @property
    def sequences(self) -> list[tuple[str, str]]:
        """(licence, phrase) of the longer rules, in order."""
        return [(name, "".join(f"<{i}>" for i in ids)) for name, ids in self.rules if len(ids) > 1]


DEFAULT = Knowledge()
SENTENCES = DEFAULT.known
RULES = DEFAULT.rules
_ANCHOR = "(?i)(" + "|".join(a.replace(" ", "[^a-z0-9]+") for a in ANCHORS) + ")"
assert all(re.search(_ANCHOR, s) for s, k in SENTENCES.items() if k != _NEUTRAL), [s for s in SENTENCES if not re.search(_ANCHOR, s)]

_JOIN = r"[ \t]*\r?\n[ \t]*([a-z])"
_CUT = r"[.!?]+[ \t]+|[\r\n]+"


_LINE = r"(?:\r?\n(?![ \t]*[a-z])|\r(?!\n))"
# classes of signs only, each run possessive or ended by a look-ahead: no recursion and no backtracking over long runs
_BEGIN = rf"(\A|[.!?][ \t\r\n]|{_LINE})[^A-Za-z0-9\r\n.!?]*+(?:(?:[0-9]{{1,2}}|[A-Za-z])[.)][^A-Za-z0-9\r\n]*+)?"
_END = rf"(?=[^A-Za-z0-9]*?(?:\z|[.!?][ \t\r\n]|{_LINE}))"


def _spread(sentence: str) -> str:
    """A pattern for the sentence's words, whatever stands between them but the end of a sentence."""
    out = ""
    for m in re.finditer(r"([A-Za-z0-9]+)([^A-Za-z0-9]*)", sentence.rstrip(".:")):
        out += m[1] + ("" if not m[2] else "[^A-Za-z0-9]{1,3}" if "." in m[2] else "[^A-Za-z0-9.!?]++")
    return out.removesuffix("[^A-Za-z0-9.!?]++")


_MARK = "\x01"
_SPDX = r"SPDX-License-Identifier:[ \t]*+[A-Za-z0-9.+-]++"  # ends with its identifier, whatever the next line begins with


def _marked(text: Column, knowledge: Knowledge) -> Column:
    """The text with each known sentence, wrapped as it may be, between two marks: one pass, whose alternatives are tried only where a sentence may begin."""
    ways = sorted({_spread(x) for v in [*knowledge.sentences.values(), *knowledge.neutral] for x in v.split("|")}, key=lambda x: (-len(x), x))
    return F.regexp_replace(F.translate(text, _MARK, " "), F.lit(rf"{_BEGIN}((?i:{'|'.join(ways)}){_END}|{_SPDX})"), F.lit(f"$1{_MARK}$2{_MARK}"))


def _normal(sentence: Column) -> Column:
    return F.btrim(F.regexp_replace(F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))


def _ids(text: Column, knowledge: Knowledge) -> Column:
    """The identifier of each sentence that is neither blank nor neutral, '' for unknown ones."""
    known = F.create_map(*(F.lit(x) for kv in knowledge.known.items() for x in kv))
    names = F.create_map(*(F.lit(x) for kv in (knowledge.names or {"": ""}).items() for x in kv))

    def plain(part: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(part, _JOIN, " $1"), _CUT, -1), _normal)

    parts = F.transform(F.split(_marked(text, knowledge), _MARK, -1), lambda x, i: F.when(i % 2 == 1, F.array(_normal(x))).otherwise(plain(x)))
    name = lambda s: F.try_element_at(names, F.regexp_extract(s, licences.REFERS, 1))
    ids = F.transform(F.filter(F.flatten(parts), lambda s: s != ""), lambda s: F.when(F.rlike(s, F.lit(_ANCHOR)), F.coalesce(F.try_element_at(known, s), name(s), F.lit(""))).otherwise(F.coalesce(F.try_element_at(known, s), F.lit(""))))
    return F.filter(ids, lambda i: i != _NEUTRAL)


def scan(docs: DataFrame, text: str = "text", knowledge: Knowledge = DEFAULT) -> DataFrame:
    """docs with sentence_ids and licences (sorted), both arrays."""
    none = F.array().cast("array<string>")
    t = F.col(f"`{text}`")
    out = shared.packed(docs, docs.columns, ids=F.when(F.rlike(t, F.lit(_ANCHOR)), _ids(t, knowledge)).otherwise(none))
    # one word for each sentence, '-' for an unknown one
    left = F.concat(F.lit("<"), F.array_join(F.transform("ids", lambda i: F.when(i == "", "-").otherwise(i)), "><"), F.lit(">"))
    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("phrase")) for n, p in knowledge.sequences))
    start = F.struct(left.alias("left"), none.alias("found"))

    def consume(state: Column, rule: Column) -> Column:
        after = F.struct(F.replace(state["left"], rule["phrase"], F.lit("<-><->")).alias("left"), F.array_append(state["found"], rule["name"]).alias("found"))
        return F.when(F.contains(state["left"], rule["phrase"]), after).otherwise(state)

    some = F.size(F.filter("ids", lambda i: i != "")) > 0
    out = out.withColumn("state", F.when(some, F.reduce(rules, start, consume) if knowledge.sequences else start))
    single = F.create_map(*(F.lit(x) for kv in (knowledge.single or {"": ""}).items() for x in kv))
    rest = F.transform(F.regexp_extract_all("state.left", F.lit("<([A-Za-z0-9]+)>"), F.lit(1)), lambda i: F.coalesce(F.try_element_at(single, i), F.lit("UNKNOWN")))
    out = out.withColumn("licences", F.coalesce(F.array_sort(F.array_distinct(F.concat("state.found", rest))), none))
    out = out.withColumn("sentence_ids", F.filter("ids", lambda i: i != ""))
    return shared.beside(out, docs.columns, ["sentence_ids", "licences"])


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def _oracle(knowledge: Knowledge = DEFAULT) -> str:
    quoted = lambda rows: ", ".join(f"('{k}', '{v}')" for k, v in rows.items())
    steps, now = [], "s0"
    for k, (_, phrase) in enumerate(knowledge.sequences):
        steps.append(f"s{k + 1} AS (SELECT *, contains(l{k}, '{phrase}') AS r{k}, replace(l{k}, '{phrase}', '<-><->') AS l{k + 1} FROM {now})")
        now = f"s{k + 1}"
    names = ", ".join(f"CASE WHEN r{k} THEN '{n}' END" for k, (n, _) in enumerate(knowledge.sequences))
    last = len(knowledge.sequences)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
parts AS (SELECT r, unnest(regexp_split_to_array(regexp_replace(text, '[ \\t]*\\r?\\n[ \\t]*([a-z])', ' \\1', 'g'), '[.!?]+[ \\t]+|[\\r\\n]+')) AS part,
                 generate_subscripts(regexp_split_to_array(regexp_replace(text, '[ \\t]*\\r?\\n[ \\t]*([a-z])', ' \\1', 'g'), '[.!?]+[ \\t]+|[\\r\\n]+'), 1) AS i FROM docs),
plain AS (SELECT r, i, trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' ') AS part FROM parts),
known AS (SELECT * FROM (VALUES {quoted(knowledge.known)}) k(sentence, id)),
names AS (SELECT * FROM (VALUES {quoted(knowledge.names)}) k(name, id)),
single AS (SELECT * FROM (VALUES {quoted(knowledge.single)}) k(id, licence)),
named AS (SELECT r, i, coalesce(k.id, n.id) AS id FROM plain p LEFT JOIN known k ON k.sentence = p.part LEFT JOIN names n ON n.name = regexp_extract(p.part, '{licences.REFERS}', 1) WHERE p.part <> '' AND coalesce(k.id, '') <> '{_NEUTRAL}'),
s0 AS (SELECT r, count(id) AS n, coalesce(string_agg(id, ',' ORDER BY i), '') AS ids, '<' || string_agg(coalesce(id, '-'), '><' ORDER BY i) || '>' AS l0 FROM named GROUP BY r),
{", ".join(steps)},
rest AS (SELECT r, list(coalesce(licence, 'UNKNOWN')) AS other FROM (SELECT r, unnest(regexp_extract_all(l{last}, '<([A-Za-z0-9]+)>', 1)) AS id FROM {now}) LEFT JOIN single USING (id) GROUP BY r),
found AS (SELECT r, n, ids, array_to_string(list_sort(list_distinct(list_concat([{names}], coalesce(other, [])))), ',') AS licences FROM {now} LEFT JOIN rest USING (r))
SELECT d.doc_id, coalesce(f.n, 0) AS n_sentences, coalesce(f.ids, '') AS sentence_ids, coalesce(f.licences, '') AS licences FROM docs d LEFT JOIN found f ON f.r = d.r
"""


ORACLE_SQL = _oracle()
