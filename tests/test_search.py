import random
import sqlite3

import pytest

from graphloom.operators import search

WORDS = ["ext4", "file", "read", "iter", "vfs", "Write", "Énorme", "café", "open", "x1"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    name = lambda n: "_".join(r.choice(WORDS) for _ in range(n))
    return [(i, name(r.randint(1, 4)), name(r.randint(0, 3)) or None, " ".join(name(2) for _ in range(r.randint(0, 5)))) for i in range(1, 61)]


@pytest.fixture(scope="module")
def at(spark, rows):
    return search.index(spark.createDataFrame(rows, "id long, name string, signature string, documentation string"))


@pytest.mark.parametrize("query", ["ext4_file", "read", "read iter", '"vfs write" OR open', "ext4 NOT file", "wri*", "name:ext4 cafe", "(read OR open) AND enorme", "read NOT open vfs", "read AND (vfs OR open)"])
def test_ranks_as_sqlite_does(at, rows, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(name, signature, documentation)")
    db.executemany("INSERT INTO f(rowid, name, signature, documentation) VALUES (?, ?, ?, ?)", rows)
    want = {i: s for i, s in db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (query,))}
    got = {r["doc"]: r["score"] for r in search.ranked(at, query).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)


@pytest.mark.parametrize("query", ["foo-bar", "foo(", "", "->read_iter", "a.b", "AND", "nocolumn:x", "(read OR open) enorme", "enorme (read OR open)"])
def test_broken_queries(query):
    with pytest.raises(ValueError):
        search.parse(query)
