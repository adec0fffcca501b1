"""The pipeline's stages on a small corpus, and the registered queries against their SQL."""

import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from sigmaloom.llm import queries as llm

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def test_stages(spark):
    text = "the first one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more words here to be sure of it and a few besides so that one edit leaves most of all shingles as they were at the start of this text"
    rows = [(1, text, "en"), (2, text.upper(), "en"), (3, text + " end", "en"), (4, "something else with password=b7db7aa4a5fcc78305 in it", "en"), (5, None, None), (6, "12 34", None), (7, "", "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = [{1, 2, 3, 4}, {2, 3, 4}, {2, 4}, {2, 4}]
    for (_, stage), ids in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == ids
        docs = out
    last = {r["doc_id"]: r for r in docs.collect()}
    assert last[4]["text"] == "something else with <SECRET> in it" and last[4]["n_chars"] == len(last[4]["text"]) and last[2]["text"] == text.upper()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {p["doc_id"] for p in pieces} == {2, 4}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


@needs_data
def test_run(spark):
    """On the driver's tables: who is kept by language, copies and links, as plain Python finds them; whole documents, packed without gaps."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    last = {}
    for r in rows:
        if r["text"] and any(c.isalpha() for c in r["text"]):
            last[lower(r["text"])] = max(r["doc_id"], last.get(lower(r["text"]), -1))
    sets = {}
    for text, i in last.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    at = {}
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    for a, b in {(a, b) for ids in at.values() for a in ids for b in ids if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            top[y] = x
    pieces = corpus_pipeline.run(spark, str(DATA)).collect()
    assert {p["doc_id"] for p in pieces} == {root(i) for i in sets}
    of, sequences = {}, {}
    for p in pieces:
        of.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    for ps in of.values():
        end = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == end and p["length"] > 0
            end += p["length"]
        assert {p["doc_tokens"] for p in ps} == {end}
    for ps in sequences.values():
        end = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == end
            end += p["length"]
        assert end <= 4096


@needs_data
@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_sql(spark, name):
    df = llm.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(llm.SQL[name])
    assert sorted(want.columns) == columns
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want.select(*columns).fetchall(), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.SQL)))
def test_other_queries(spark, name):
    """A row for each row of the whole table, or several for each; no row is lost."""
    table, key = {"op11_whitening": ("embeddings", "vec_id"), "op12_extraction": ("pages", "page_id")}.get(name, ("documents", "doc_id"))
    want = Counter(r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect())
    got = Counter(r[0] for r in llm.QUERIES[name](spark, str(DATA)).select(key).collect())
    if name == "op9_packing":
        assert set(got) == set(want)
    else:
        assert got == {i: n * (8 if name == "op11_whitening" else 1) for i, n in want.items()}
