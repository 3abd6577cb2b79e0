"""Registered queries and stages do the whole job on small tables."""

import os
import random
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute

from gridloom.llm import _components, jaccard_join, kneser_ney, queries, suffix_dedup, winnow
from gridloom.llm._shared import settle


def stored(spark, rows, where):
    """Rows (doc_id, text) as the documents of a folder."""
    spark.createDataFrame([(d, t, "en", "h.example.org", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    return str(where)


def test_kneser_ney_query_is_of_order_three(spark, tmp_path):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice("the of And a b c d e f xx".split()) for _ in range(r.randint(0, 40)))) for i in range(60)]
    got = {x.doc_id: x.score for x in kneser_ney.op1_query(spark, stored(spark, rows, tmp_path)).collect()}
    want = {d: x[5] for d, x in brute.kneser_ney(rows, 3).items()}
    assert got == pytest.approx(want, abs=1e-6)


WORDS = [f"w{i}" for i in range(60)]


def changed(*places):
    return " ".join("other" if i in places else w for i, w in enumerate(WORDS))


def as_documents(spark, rows):
    return settle(spark.createDataFrame([(d, t, "en", "h.example.org", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3), "t")


def test_jaccard_null_id_is_compared(spark):
    near = [(1, changed()), (None, changed(59))]
    got = jaccard_join.jaccard_components(as_documents(spark, near), 3, 0.9).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("1", 1), ("None", 1)]
    ends = [(4, changed(0)), (7, changed(59))]
    alone = jaccard_join.jaccard_components(as_documents(spark, ends), 3, 0.96).collect()
    assert sorted((r.doc_id, r.component_id) for r in alone) == [(4, 4), (7, 7)]
    bridge = jaccard_join.jaccard_components(as_documents(spark, [*ends, (None, changed())]), 3, 0.96).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in bridge) == [("4", 4), ("7", 4), ("None", 4)]
    unknown = jaccard_join.jaccard_components(as_documents(spark, [(None, changed()), (None, changed(59))]), 3, 0.9).collect()
    assert [r.component_id for r in unknown] == [None, None]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_common_passage_makes_no_large_group(spark, monkeypatch, n, percent):
    monkeypatch.setattr(jaccard_join, "BLOCK_WEIGHT", 2000)
    monkeypatch.setattr(jaccard_join, "LARGE", 500, raising=False)
    compared = []

    def counted(df, name):
        out = settle(df, name)
        if name == "blocks":
            compared.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "settle", counted)
    r = random.Random(3)
    rows = []
    for i in range(150):  # texts of their own around one passage, some with a copy that differs in one word
        own = [f"o{i}x{k}" for k in range(40)]
        at = r.randint(0, 40)
        text = [*own[:at], *[f"p{k}" for k in range(60)], *own[at:]]
        rows.append((i, " ".join(text)))
        if i % 10 == 0:
            text[r.randrange(100)] = "other"
            rows.append((1000 + i, " ".join(text)))
    rows += [(2000 + i, " ".join(f"p{k}" for k in range(60) if k != i)) for i in range(3)]  # the passage itself
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(as_documents(spark, rows), n, percent / 100).collect()}
    assert got == brute.jaccard(rows, n, percent)
    assert compared[0] <= 60  # not all 168


def test_jaccard_split_by_rare_tokens_keeps_all_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_WEIGHT", 2000)
    monkeypatch.setattr(jaccard_join, "LARGE", 0, raising=False)
    r = random.Random(5)
    base = [[r.choice("abcdefghijklmnop") + r.choice("xyz") for _ in range(r.randint(1, 150))] for _ in range(12)]
    rows = [(0, None), (1, " ")]
    for i in range(2, 250):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 9])):
            w[r.randrange(len(w))] = r.choice("QRSTUV")
        rows.append((i, " ".join(w[: r.randint(0, 3)] if r.random() < 0.1 else w)))
    for n, percent in ((3, 90), (5, 80)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(as_documents(spark, rows), n, percent / 100).collect()}
        assert got == brute.jaccard(rows, n, percent)


def test_pipeline_drops_null_id_copies(spark):
    import corpus_pipeline

    rows = [(1, changed()), (None, changed()), (None, changed(59)), (None, "quite another text of six words"), (None, None)]
    docs = as_documents(spark, rows)
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == [("1", changed()), ("None", "None"), ("None", "quite another text of six words")]


def test_winnow_query_meets_short_documents(spark, tmp_path):
    """Of every text the first two thirds stay: 15 bytes or more of them are met, in short texts too."""
    r = random.Random(3)
    rows = [(i, "".join(r.choice("abcdefghij ") for _ in range(r.randint(23, 122)))) for i in range(120)]
    got = winnow.op5_query(spark, stored(spark, rows, tmp_path)).collect()
    assert len(got) == 120 and all(x.near_edited > 0 for x in got)


def test_pipeline_keeps_one_row_a_component(spark):
    import corpus_pipeline

    other = "quite another text of six words"
    rows = [(1, changed()), (1, changed()), (1, changed(59)), (2, changed()), (2, other)]
    left = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, as_documents(spark, rows), "").collect())
    assert [d for d, _ in left] == [1, 2] and left[0][1] in (changed(), changed(59)) and left[1][1] == other


def test_ranked_prefix_doubling(spark):
    """Positions by sorted rank pairs cover the same bytes as by names, and as by brute force."""
    r = random.Random(6)
    base = ["".join(r.choice("abé") for _ in range(r.randint(0, 90))) for _ in range(6)]
    rows = [(i, r.choice(base) + r.choice(base)[:40] + "z" * r.choice([0, 0, 30])) for i in range(25)] + [(25, None), (26, "")]
    got = suffix_dedup.ranked_starts(as_documents(spark, rows), 20).collect()
    place = {n: i for i, n in enumerate(sorted({x.row for x in got}))}
    seen, want = set(), {}
    for d, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - 19):
            if b[p : p + 20] in seen:
                want.setdefault(d, []).append(p)
            seen.add(b[p : p + 20])
    starts = {}
    for x in got:
        starts.setdefault(x.row, []).append(x.pos)
    assert len(place) == len(want)
    assert [sorted(starts[n]) for n in sorted(starts)] == [want[d] for d in sorted(want)]


def test_components_of_a_star(spark):
    edges = [(0, i) for i in range(1, 700)] + [(1000 + i, 1001 + i) for i in range(30)] + [(5, 5), (None, 3)]
    got = {x.node: x.root for x in _components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 700)} | {1000 + i: 1000 for i in range(1, 31)}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_as_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.SQL[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)

    def rows(all_):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in all_), key=str)

    assert rows(tuple(r[c] for c in cols) for r in df.collect()) == rows(cur.fetchall())
