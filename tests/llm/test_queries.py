"""The registered queries of the training-data operators, against DuckDB and against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from graphloom.llm import decontamination, license_scan, line_dedup, lm_scoring, media, mixing, near_dedup, pii, quality, registry, shared, url_filter
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = con.sql(registry.ORACLE_SQL[name])
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    want = sorted(repr(tuple(plain(dict(zip(rows.columns, r, strict=True))[c]) for c in columns)) for r in rows.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert "pipeline" in names


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def run(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def test_op1(spark, rows):
    """The model's probabilities against Kneser-Ney by hand, and what they decide."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = brute.kneser_ney([r["text"] for r in quality.trusted_sample(docs, labels)[0].collect()])
    got = {r["doc_id"]: r for r in run(spark, "op1_quality_classifier")}
    assert len(got) == len(rows)
    for d, t in rows:
        assert math.isclose(got[d]["log10_prob"], model(t), rel_tol=1e-9), d
        assert got[d]["n_tokens"] == len(brute.words(t)) + 1
        assert math.isclose(got[d]["perplexity"], 10 ** (-model(t) / got[d]["n_tokens"]), rel_tol=1e-6)
        assert got[d]["log10_judged"] <= got[d]["log10_prob"] + 1e-9


def test_op3(spark, rows):
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in rows if not held(d) for w in [*brute.words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    for r in run(spark, "op3_lm_scoring"):
        tokens = [*brute.words(dict(rows)[r["doc_id"]]), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(tokens), sum(w in counts for w in tokens), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens), rel_tol=1e-9)


def test_op6(spark, rows):
    got = {r["doc_id"]: r for r in run(spark, "op6_media_columns")}
    assert got.keys() == dict(rows).keys()
    for d, t in rows:
        body = (t or "").encode()
        payload = body + b" " * (-len(body) % 192 or (192 if not body else 0))
        stored = media.encode(payload)
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), brute.feature(payload))


def test_op7(spark, rows):
    want = {d: (n, c, d == c) for d, n, c in brute.near_duplicates(rows)}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, "op7_near_dedup")} == want


def test_op9(spark, rows):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in run(spark, "op9_decontamination")}
    assert got == brute.contamination(rows, items)


def test_op10(spark, rows):
    got = {r["doc_id"]: r for r in run(spark, "op10_pii")}
    written = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    for (d, t), terms in zip(rows, brute.disclosing([t for _, t in rows]), strict=True):
        base = brute.base_spans(t or "")
        kinds = Counter(k for _, k, _ in base)
        assert tuple(got[d][c] for c in ("n_email", "n_ip", "n_card", "n_phone")) == tuple(kinds[k] for k in range(4))
        assert got[d]["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        assert got[d]["spans"] == written(base + [(a, 4, b) for a, b in terms])


NAMES = "id items kept n_tokens host path rule verdict pattern n_lines n_dropped licences sentence_ids base terms spans row t cleaned left own n_words n_hit score n_known train_tokens base_score perplexity threshold log10_prob log10_judged key limit middle of site low state ids found names held learn h n class block".split()


def test_clashing_names(spark):
    """Columns under every name that operators have for their outputs and helpers come back as they were."""
    values = {n: f"own {n}" for n in NAMES}
    plain = spark.createDataFrame([(i, t, "en", "s", len(t), f"http://x.org/{i}") for i, t in enumerate(["a b c d e f g", "write to a@b.org now", "one two three four"])], "doc_id long, text string, lang string, source string, n_chars long, url string")
    docs = plain.select("*", *(F.lit(v).alias(k) for k, v in values.items()))
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "zzz yyy")], "item_id long, text string")
    same = [quality.accepted(docs, labels), line_dedup.cleaned(docs), near_dedup.deduplicated(docs), decontamination.decontaminated(docs, items), pii.sanitised(docs)]
    assert all(x.columns == docs.columns for x in same)
    more = [quality.classify(docs, labels, docs.columns), line_dedup.dedup_lines(docs), lm_scoring.score(docs, docs.columns), url_filter.judge(docs), license_scan.scan(docs), decontamination.contamination(docs, items, docs.columns), pii.find(docs, docs.columns)]
    assert all(x.columns[: len(docs.columns)] == docs.columns and len(x.columns) > len(docs.columns) and len(set(x.columns)) == len(x.columns) for x in more)
    for x in same + more:
        assert all({k: r[k] for k in NAMES} == values for r in x.collect())


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_side_empty(spark):
    """An empty benchmark, labels or documents beside a table with rows."""
    docs = spark.createDataFrame([(1, "one two three", "en", "s", 13), (None, None, None, None, None)], DOCS)
    none = spark.createDataFrame([], DOCS)
    labels, no_labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items, no_items = spark.createDataFrame([(1, "one two three")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in decontamination.contamination(docs, no_items, ["doc_id"]).collect()] == [0, 0]
    blank = spark.createDataFrame([(1, None), (2, ""), (None, " . ")], "item_id long, text string")
    assert [r["n_hit"] for r in decontamination.contamination(docs, blank, ["doc_id"]).collect()] == [0, 0]
    assert sorted(r["n_hit"] for r in decontamination.contamination(docs, items, ["doc_id"]).collect()) == [0, 3]
    assert decontamination.decontaminated(docs, no_items).count() == 2 and decontamination.contamination(none, items, ["doc_id"]).count() == 0
    assert quality.accepted(docs, no_labels).count() == 2 and quality.accepted(none, labels).count() == 0
    assert mixing.mix(docs, no_labels).count() == 2 and mixing.mix(none, labels).count() == 0


def test_lost_files_are_errors(spark):
    """A block or batch whose file is gone stops the query; it is not read as empty."""
    from pathlib import Path

    docs = spark.createDataFrame([(i, f"some words of document {i}") for i in range(20)], "doc_id long, text string")
    found = decontamination.contamination(docs, spark.createDataFrame([(1, "some words")], "item_id long, text string"), ["doc_id"])
    scored = lm_scoring.score(docs, ["doc_id"])
    base = Path(shared.shared_folder(spark).removeprefix("file:")) / "graphloom"
    for tag in ("benchmark-", "lm-batches-"):
        newest = max(base.glob(f"{tag}*"), key=lambda x: x.stat().st_mtime)
        next(x for x in newest.iterdir() if x.is_file() and not x.name.startswith(".")).unlink()
    for lost in (found, scored):
        with pytest.raises(Exception, match="No such file|FileNotFoundError"):
            lost.collect()


def test_repeated_rows(spark):
    """Rows that repeat are judged each, and alike."""
    texts = ["call +49 170 1234567 or a@b.org", "Released under the MIT License", "one two three four five six"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts) for _ in range(3)] + [(None, texts[2], "en", "s", 9)] * 4, DOCS)
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "three four five"), (1, "three four five")], "item_id long, text string")
    outs = [quality.classify(docs, labels, ["doc_id"]), lm_scoring.score(docs, ["doc_id"]), media.features(media.read_media(spark, media.write_media(docs))), license_scan.scan(docs.select("doc_id", "text")), decontamination.contamination(docs, items, ["doc_id"]), pii.find(docs, ["doc_id"]), near_dedup.near_duplicates(docs)]
    for out in outs:
        assert sorted(Counter(map(str, out.collect())).values()) == [3, 3, 3, 4], out.columns
    mixed = mixing.mix(docs, labels).collect()
    assert len(mixed) == docs.count() and sum(r["size"] for r in mixed) == 3 * (6 + 5 + 6) + 24


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_of_odd_tables(spark, tmp_path, kind):
    """Nulls in any column, empty and repeated rows; and no rows at all."""
    rows = [(1, "plain words of a text", "en", "s", 21), (1, "plain words of a text", "en", "s", 21), (None, None, None, None, None), (None, "", None, "s", 0), (2, "", "en", None, 0), (3, " \n\t", "en", "s", 3), (4, "x " * 50_000, "en", "s", 100_000)]
    spark.createDataFrame(rows if kind == "odd" else [], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, None, None), (2, 1, None)] if kind == "odd" else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "zz yy"), (2, "")] if kind == "odd" else [], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if kind == "empty":
        assert out == []
    else:
        assert Counter(r["doc_id"] for r in out)[1] == 1 and {r["doc_id"] for r in out} >= {1, 2, 3, None}


def test_pipeline_learns_from_every_trusted_document(spark, monkeypatch):
    """The bounds of a sample do not reach the stage: it accepts what a model of all trusted text accepts."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = brute.kneser_ney([r["text"] for r in quality.trusted_sample(docs, labels)[0].collect()])  # all of them, in this small table
    want = {r["doc_id"]: r for r in quality.classify(docs, labels, ["doc_id", "text"]).collect()}
    assert all(math.isclose(r["log10_prob"], model(r["text"]), rel_tol=1e-9) for r in want.values())
    for k in ("TRAIN_BYTES", "TRAIN_DOCS", "HELD_DOCS"):
        monkeypatch.setattr(quality, k, 0)
    got = {r["doc_id"] for r in corpus_pipeline.quality_classifier(spark, docs, SF).collect()}
    assert got == {d for d, r in want.items() if r["kept"]} and len(got) < len(want)


def test_pipeline(spark):
    """Each stage on what the one before it kept, against brute force where the stage is exact."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    columns = docs.columns
    one = shared.materialise(quality.accepted(docs, labels), "t1")
    good = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()}
    kept = {r["doc_id"] for r in one.collect()}
    assert len(good & kept) >= 0.95 * len(good)
    two = shared.materialise(line_dedup.cleaned(one), "t2")
    rows = [(r["doc_id"], r["source"], r["text"]) for r in one.collect()]
    assert sorted((r["doc_id"], r["text"]) for r in two.collect()) == sorted(brute.boilerplate(rows, line_dedup.RATIO, line_dedup.MIN_PAGES))
    three = shared.materialise(near_dedup.deduplicated(two, per_cent=corpus_pipeline.NEAR), "t3")
    want = {d for d, _, c in brute.near_duplicates([(r["doc_id"], r["text"]) for r in two.collect()], corpus_pipeline.NEAR) if d == c}
    assert {r["doc_id"] for r in three.collect()} == want
    four = shared.materialise(decontamination.decontaminated(three, bench), "t4")
    found = brute.contamination([(r["doc_id"], r["text"]) for r in three.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert {r["doc_id"] for r in four.collect()} == {d for d, x in found.items() if not x[4]}
    assert one.columns == two.columns == three.columns == four.columns == columns
    five = mixing.mix(four, labels)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "size", "taken").collect()))
    assert key(five) == key(corpus_pipeline.run(spark, SF))
