"""Operator 4: URL filters by rules indexed under their rarest literal token, in DataFrame functions only.

A pattern rule names literal tokens that every URL it matches contains.  It is indexed under the one that
the fewest URLs of the table have.  A URL's tokens fetch its candidate rules from the index, and only
these run their regular expressions.  Site rules (host and path prefix) come before pattern rules.

``judge`` takes the rules as a list or as a table.  A list of at most ``LITERAL`` rules is an index within the plan, so
one pass over the URLs does all and nothing is shuffled but the counts of the rules' own tokens.  A table of rules,
however many, is joined: distinct URLs meet the index by token, and by each suffix of their host; the index is
broadcast if it is at most ``BROADCAST`` rows, else shuffled, and hot keys are split by adaptive execution.
Which URLs a rule decides is the same either way.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and the verdict
``allow`` unless a pattern matches; rules that tie in length cannot both fit, for they would be equal (of equal ones in
a table the first by ``ord`` counts); repeated rows are judged each; a very long url is judged whole; an empty table, of
urls or of rules, is none at all; other columns pass unchanged whatever their names, and an output whose name is
taken has an underscore behind it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: (verdict, host, path): the longest rule that fits a url wins.
SITE_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: (verdict, regular expression on the lower-cased url, sets of tokens: any match has a token of each); the first that matches wins.
PATTERN_RULES = [
    ("allow", r"/robots\.txt$", (("robots",), ("txt",))),
    ("block", r"[?&]utm_(source|medium|campaign|term|content)=", (("utm",), ("source", "medium", "campaign", "term", "content"))),
    ("block", r"[?&](session|sid|phpsessid)=[0-9a-z]+", (("session", "sid", "phpsessid"),)),
    ("block", r"/wp-login\.php", (("wp",), ("login",), ("php",))),
    ("block", r"/wp-admin/", (("wp",), ("admin",))),
    ("block", r"[?&]replytocom=[0-9]+", (("replytocom",),)),
    ("block", r"/calendar/[0-9]{4}/[0-9]{1,2}", (("calendar",),)),
    ("block", r"/cart/add[/?]", (("cart",), ("add",))),
    ("block", r"[?&]action=(edit|history)(&|$)", (("action",), ("edit", "history"))),
    ("block", r"://(ads|adserver)\.", (("ads", "adserver"),)),
    ("block", r"/doubleclick/", (("doubleclick",),)),
    ("block", r"(^|[^a-z0-9])(casino|poker)([^a-z0-9]|$)", (("casino", "poker"),)),
    ("block", r"/search\?(.*&)?q=", (("search",), ("q",))),
    ("block", r"/tag/[^/]+/page/[0-9]+", (("tag",), ("page",))),
    ("block", r"[?&]print=1(&|$)", (("print",), ("1",))),
]

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


LITERAL = 1_000  # rules in a plan
BROADCAST = 500_000  # rows of an index of some 200 bytes each


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return lower(host), path


def tokens(low: Column) -> Column:
    """The tokens of a lower-cased url."""
    return F.array_distinct(F.split(low, "[^a-z0-9]+", -1))


def index(urls: DataFrame, url: str = "url", rules: list[tuple] = PATTERN_RULES) -> dict[str, list[int]]:
    """token -> rules: each rule under its rarest set of tokens over the rows of urls."""
    sets = sorted({s for r in rules for s in r[2]})
    if not sets:
        return {}
    literals = F.array(*(F.lit(t) for t in sorted({t for s in sets for t in s})))
    low = lower(F.coalesce(F.col(f"`{url}`"), F.lit("")))
    seen = {r["token"]: r["count"] for r in urls.select(F.explode(F.array_intersect(tokens(low), literals)).alias("token")).groupBy("token").count().collect()}  # at most the rules' tokens
    out: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        best = min(rule[2], key=lambda s: (sum(seen.get(t, 0) for t in s), s))
        for t in best:
            out.setdefault(t, []).append(i)
    return out


OUTPUTS = ["host", "path", "rule", "verdict", "pattern"]


def judge(urls: DataFrame, url: str = "url", sites: list[tuple] = SITE_RULES, patterns: list[tuple] = PATTERN_RULES, rules: DataFrame | None = None) -> DataFrame:
    """urls with host, path, rule, verdict and pattern (the number of the pattern rule that decided, else null).

    rules, a table, takes the place of the two lists: (ord long, verdict string, host string, path string, pattern string,
    tokens array<array<string>>); those with a host are site rules, the others pattern rules.
    """
    host, path = host_path(F.col(f"`{url}`"))
    rows = shared.packed(urls, urls.columns, url=F.col(f"`{url}`"), host=host, path=path, low=lower(F.coalesce(F.col(f"`{url}`"), F.lit(""))))
    if rules is None and len(sites) + len(patterns) <= LITERAL:
        return shared.beside(_by_literals(rows, index(urls, url, patterns), sites, patterns), urls.columns, OUTPUTS)
    if rules is None:
        rules = urls.sparkSession.createDataFrame([(i, v, h, p, None, None) for i, (v, h, p) in enumerate(sites)] + [(i, v, None, None, p, [list(x) for x in t]) for i, (v, p, t) in enumerate(patterns)], RULES)
    best = decided(rows, rules)
    out = rows.join(best.withColumnRenamed("url", "of"), F.col("url") == F.col("of"), "left")
    out = out.select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), F.col("best.pattern").cast("int").alias("pattern"))
    return shared.beside(out, urls.columns, OUTPUTS)


RULES = "ord long, verdict string, host string, path string, pattern string, tokens array<array<string>>"


def _by_literals(rows: DataFrame, where: dict[str, list[int]], sites: list[tuple], patterns: list[tuple]) -> DataFrame:
    site = [F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in sites]
    fits = F.filter(F.array(*site), lambda r: ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))) & F.startswith(F.col("path"), r["path"])) if site else None
    out = rows.withColumn("site", F.array_max(fits) if site else F.lit(None).cast("struct<n: int, rule: string, verdict: string>"))
    if not patterns:
        return out.select("row", "host", "path", F.col("site.rule").alias("rule"), F.coalesce("site.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("int").alias("pattern"))
    fetch = F.create_map(*(x for t in sorted(where) for x in (F.lit(t), F.array(*(F.lit(i) for i in where[t])))))
    candidates = F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform(tokens(F.col("low")), lambda t: F.element_at(fetch, t)), lambda x: x.isNotNull()))))
    regexes, verdicts = F.array(*(F.lit(p) for _, p, _ in patterns)), F.array(*(F.lit(v) for v, _, _ in patterns))
    matches = F.filter(candidates, lambda i: F.rlike(F.col("low"), F.element_at(regexes, i + 1)))
    out = out.withColumn("pattern", F.when(F.col("site").isNull(), F.try_element_at(matches, F.lit(1))))
    verdict = F.coalesce(F.col("site.verdict"), F.try_element_at(verdicts, F.col("pattern") + 1), F.lit("allow"))
    return out.select("row", "host", "path", F.col("site.rule").alias("rule"), verdict.alias("verdict"), "pattern")


def decided(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, best): of each distinct url of rows that a rule decides, that rule."""
    site = rules.where("host is not null").select(F.concat(F.lit("h:"), lower(F.col("host"))).alias("key"), F.concat("host", "path").alias("rule"), F.col("path").alias("prefix"), F.lit(None).cast("string").alias("regex"), "verdict", "ord")
    sets = rules.where("host is null").select("ord", "verdict", F.col("pattern").alias("regex"), F.posexplode("tokens").alias("at", "set"))
    literals = shared.bounded(shared.materialise(sets.select(F.explode("set").alias("token")).distinct(), "rule-tokens"), BROADCAST)
    seen = rows.select(F.explode(tokens(F.col("low"))).alias("token")).join(literals, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    weighed = sets.withColumn("token", F.explode("set")).join(seen, "token", "left").groupBy("ord", "at").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.first("verdict").alias("verdict"), F.first("regex").alias("regex"), F.first("set").alias("set"))
    rarest = weighed.groupBy("ord").agg(F.min_by(F.struct("verdict", "regex", "set"), F.struct("n", "set")).alias("x"))
    none = F.lit(None).cast("string")
    pattern = rarest.select("ord", "x", F.explode("x.set").alias("token")).select(F.concat(F.lit("t:"), "token").alias("key"), none.alias("rule"), none.alias("prefix"), F.col("x.regex").alias("regex"), F.col("x.verdict").alias("verdict"), "ord")
    found = shared.bounded(shared.materialise(site.unionByName(pattern), "rule-index"), BROADCAST)
    parts = F.split("host", "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    keys = F.array_union(suffixes, F.transform(tokens(F.col("low")), lambda t: F.concat(F.lit("t:"), t)))
    once = rows.where("url is not null").select("url", "host", "path", "low").distinct()
    met = once.withColumn("key", F.explode(keys)).join(found, "key")
    hit = met.where(F.when(F.col("rule").isNotNull(), F.startswith("path", F.col("prefix"))).otherwise(F.rlike(F.col("low"), F.col("regex"))))
    best = F.struct("verdict", "rule", F.when(F.col("rule").isNull(), F.col("ord")).alias("pattern"))
    return hit.groupBy("url").agg(F.min_by(best, F.struct(F.col("rule").isNull(), F.when(F.col("rule").isNotNull(), -F.length("rule")).otherwise(0), "ord")).alias("best"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE_SQL = f"""
WITH rest AS (SELECT page_id, coalesce(translate(url, '{_UPPER}', '{_LOWER}'), '') AS low,
                     CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
                 regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM rest),
site AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(v)}, {_quoted(h)}, {_quoted(p)})" for v, h, p in SITE_RULES)}) s(verdict, h, p)),
patterns AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_quoted(v)}, {_quoted(p)})" for i, (v, p, _) in enumerate(PATTERN_RULES))}) s(i, verdict, pattern))
SELECT page_id, host, path,
       (SELECT arg_max(h || p, length(h || p)) FROM site WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
       coalesce((SELECT arg_max(verdict, length(h || p)) FROM site WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
                (SELECT arg_min(verdict, i) FROM patterns WHERE regexp_matches(low, pattern)), 'allow') AS verdict
FROM parts
"""
