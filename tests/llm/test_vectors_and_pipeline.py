import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fixtures import no_docs, odd_docs, odd_rows
from oracle_harness import compare, duck
from propensity.llm import ann, neardup
from propensity.llm.common import blocked, connected_components, forest
from propensity.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    ok, why = compare(QUERIES[name](spark, SF), duck(SF), ORACLE[name])
    assert ok, why


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_returns_every_row(spark, name):
    got = QUERIES[name](spark, SF)
    rows = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").count()
    if name.startswith(("op1_", "op2_", "op5_", "op10_", "op12_", "op13_")):
        assert got.select("doc_id").distinct().count() == rows("documents") == got.count()
    elif name.startswith("op3_"):
        assert got.select("vec_id").distinct().count() == rows("embeddings") == got.count()
    elif name.startswith("op4_"):
        queries = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").count()
        assert got.count() == 5 * queries and got.select("query_id").distinct().count() == queries
    elif name.startswith("op7_"):
        assert got.select("doc_id").distinct().count() == rows("documents")
        assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    else:
        assert name.startswith("op9_")
        assert got.select("page_id").distinct().count() == rows("pages") == got.count()


ODD = [(100, None), (101, []), (102, [0.0] * 8), (103, [1.0, None] + [0.0] * 6), (104, [float("nan")] + [1.0] * 7),
       (105, [float("inf")] + [1.0] * 7), (106, [1.0, 2.0]), (107, [2.0, 4.0])]


def vectors(spark, n=300, dim=8, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[1::10] = x[0] + 0.05 * rng.normal(size=(len(x[1::10]), dim))  # near copies
    x[2::30] = x[3]                                                 # equal vectors
    x[4] = 2 * x[5]
    rows = [(i + 1000, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    df = spark.createDataFrame([(i, v, "c", 0, 1) for i, v in ODD + rows],
                               "vec_id long, embedding array<float>, t string, dim int, id int")
    return df, np.array([i for i, _ in rows]), np.array([v for _, v in rows])


@pytest.mark.parametrize("block", [neardup.BLOCK, 7])
def test_near_duplicates_equal_brute_force(spark, block):
    df, ids, x = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = forest(*np.nonzero(near), len(x))
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df, block=block).collect()}
    want = {int(i): (int(near[k].sum()), int(ids[root[k]])) for k, i in enumerate(ids)}
    want |= {i: (0, i) for i, _ in ODD[:6]} | {106: (1, 106), 107: (1, 106)}
    assert got == want
    assert neardup.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_tables_reach_the_promised_probability():
    for n in (10, 10_000, 10 ** 6, 10 ** 10):
        bits, tables = neardup.plan_tables(n)
        assert (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables <= neardup.MISS
        assert n / 2 ** bits <= 2 * neardup.PER_BUCKET


def brute_nearest(ids, x, queries, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = u @ u[q]
        out[int(ids[q])] = [int(ids[j]) for j in np.lexsort((ids, -np.round(s, 12))) if j != q][:k]
    return out


@pytest.mark.parametrize("block", [ann.BLOCK, 16])
def test_nearest_with_all_probes_equals_brute_force(spark, block):
    df, ids, x = vectors(spark)
    got = ann.nearest(df, F.col("vec_id") % 10 == 0, tables=1, probes=16, block=block).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["id"])
    want = brute_nearest(ids, x, np.flatnonzero(ids % 10 == 0))
    assert {q: v for q, v in found.items() if q >= 1000} == want
    assert not {r["id"] for r in got} & {100, 101, 102, 103, 104, 105}
    assert ann.nearest(df.where("vec_id < 0"), F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 17, 30])
def test_every_query_gets_its_rows(spark, n):
    """With the defaults, in tables far smaller than the axes, and with several vector lengths in one."""
    rng = np.random.default_rng(n)
    sides = {64: rng.normal(size=(n, 64)), 7: rng.normal(size=(3, 7)), 1: np.ones((1, 1))}
    rows = [(1000 * d + i, [float(v) for v in r]) for d, x in sides.items() for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.nearest(df, F.lit(True)).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["id"])
    want = {}
    for d, x in sides.items():
        want |= brute_nearest(np.arange(len(x)) + 1000 * d, x, range(len(x)))
    if n > 6:  # enough to be met by hashing alone: complete, and nearly always right
        assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items() if v}
    else:
        assert got == {q: v for q, v in want.items() if v}


def clustered(spark, n=3000, dim=32, centres=300):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(centres, dim))[rng.integers(centres, size=n)] + 0.1 * rng.normal(size=(n, dim))
    x[:5] = rng.normal(size=(5, dim))  # far from all others: no near neighbours
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), x


def test_joined_axes_settle_near_queries_and_pass_on_the_others(spark, monkeypatch):
    df, x = clustered(spark)
    passes = []
    was = ann.hashed
    monkeypatch.setattr(ann, "hashed", lambda rows, t, joined, p, s: passes.append((p, joined, rows.count())) or was(rows, t, joined, p, s))
    got = {}
    for r in sorted(ann.nearest(df, F.col("vec_id") < 200, bucket=8).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["id"])
    want = brute_nearest(np.arange(len(x)), x, range(200))
    assert all(len(v) == 5 for v in got.values()) and len(got) == 200
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.9 * 5 * 200
    asked = [(joined, n) for p, joined, n in passes if p > 1]
    assert asked[0] == ({32: 2}, 200) and 5 <= asked[1][1] < 60  # the rest was settled by joined axes


def test_buckets_do_not_grow_with_rows():
    for n in (10, 10 ** 6, 10 ** 9, 10 ** 12):
        j = ann.joined_axes(n, 64, ann.BUCKET)
        assert n <= ann.BUCKET * 128 ** j and (j == 1 or n > ann.BUCKET * 128 ** (j - 1))
    assert ann.sure_cosine(64, 2, 8, 12) <= 0.9


def test_ids_must_be_numbers(spark):
    with pytest.raises(TypeError):
        ann.nearest(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"), F.lit(True))
    with pytest.raises(TypeError):
        ann.nearest(spark.createDataFrame([(1, 1.0)], "vec_id long, embedding double"), F.lit(True))


def test_vectors_with_null_ids(spark):
    rows = [(50, [1.0, 0.0]), (51, [1.0, 0.1]), (None, [1.0, 0.01]), (None, [0.0, 1.0]), (None, None), (7, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, probes=4).collect()
    assert [(r["query_id"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(50, None), (50, 51), (50, 7)]
    got = neardup.near_duplicates(df).collect()
    assert sorted((str(r["id"]), r["n_links"], r["component_id"]) for r in got) == [
        ("50", 2, 50), ("51", 2, 50), ("7", 0, 7), ("None", 0, None), ("None", 0, None), ("None", 2, 50)]


def test_recall_over_the_table(spark):
    path = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    want = brute_nearest(ids, x, np.flatnonzero(ids % 50 == 0))
    got = {(r["query_id"], r["vec_id"]) for r in QUERIES["op4_nearest_neighbours"](spark, path).collect()}
    hits = sum((q, v) in got for q, vs in want.items() for v in vs)
    assert hits >= 0.9 * 5 * len(want)


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 48))
    assert np.allclose(np.linalg.norm(ann.Rotation(48, 3)(x), axis=1), np.linalg.norm(x, axis=1))


def test_connected_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(60)] + [(200, int(i)) for i in range(201, 260)] + [
        (int(a), int(b)) for a, b in rng.integers(300, 400, (60, 2))] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    a, b = np.array(edges).T
    root = forest(a, b, 400)
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    want = {int(n): int(root[n]) for n in np.unique([e for e in edges if e[0] != e[1]])}
    assert got == want


def test_blocked_lets_each_pair_meet_once(spark):
    df = spark.range(50).select(F.lit(1).alias("g"), F.col("id").alias("n"))
    rows = blocked(df, ["g"], 8, F.col("n")).collect()
    met = {}
    for r in rows:
        met.setdefault((r["bi"], r["bj"]), []).append((r["n"], r["own"]))
    pairs = [(x, y) for (i, j), v in met.items() for x, p in v for y, q in v if x < y and (i == j or p != q)]
    assert len(pairs) == len(set(pairs)) == 50 * 49 // 2


# --- the pipeline

def test_stages_on_odd_and_empty_tables(spark):
    for docs in (odd_docs(spark), no_docs(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == columns, name
            docs = spark.createDataFrame(out.collect(), docs.schema)
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_language_stage_keeps_clean_documents(spark):
    docs = odd_docs(spark)
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, SF).collect()
    assert all(any(c.isalpha() for c in r["text"]) for r in kept)
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    left = dict(corpus_pipeline.STAGES)["language_id"](spark, real, "")
    gone = real.join(left, "doc_id", "left_anti").collect()
    assert all(not any(c.isalpha() for c in r["text"] or "") for r in gone)


def test_language_stage_without_labels_keeps_texts_with_letters(spark):
    rows = [(1, "some words", None), (2, "日本語", None), (3, "12 !", None), (4, None, None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_near_copies_leave_no_stubs(spark):
    """Near copies go as a whole; documents that share a passage or repeat themselves keep the rest."""
    rng = np.random.default_rng(12)
    line = lambda: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(12))
    texts = {i: [line() for _ in range(12)] for i in range(20)}
    for i in range(5):  # one word changed
        texts[100 + i] = [*texts[i]]
        texts[100 + i][i] = "changed " + texts[i][i][7:]
    texts[200] = [*texts[6][:5], *[line() for _ in range(6)]]  # a passage of another document, and its own text
    texts[201] = [line()] * 30 + texts[7][:1]                  # its own line again and again
    docs = spark.createDataFrame([(i, "\n".join(t), "en", "s", len("\n".join(t))) for i, t in texts.items()],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, SF).collect()}
    assert set(got) == set(texts) - {100, 101, 102, 103, 104}
    assert all(got[i]["text"] == "\n".join(texts[i]) for i in range(20))
    assert got[200]["text"] == "\n".join(texts[200][5:]) and got[201]["text"] == texts[201][0]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_run_packs_what_the_stages_kept(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "mix_sources", "pack_sequences"]
    got = corpus_pipeline.run(spark, SF).collect()
    known = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got and {r["doc_id"] for r in got} <= known and max(r["length"] for r in got) <= 2048
    assert len(odd_rows()) > 20
