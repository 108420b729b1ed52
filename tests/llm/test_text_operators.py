import collections
import hashlib
import html as stdhtml
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fixtures import no_docs, odd_docs, odd_rows
from propensity.llm import html, jaccard, langid, linededup, mixing, packing, suffix, tokens
from propensity.llm.queries import BYTE_BPE, PIECES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return odd_docs(spark).cache()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def doc_key(i, t):
    return (i is None, i if i is not None else 0, t is None, t or "")


# --- 1 language ID

def test_language_accuracy_held_out(spark):
    got = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = got.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
    assert got.where("score < 0 or score > 1").isEmpty()


def test_language_odd_rows(docs, spark):
    model = langid.learn(docs)
    got = langid.identify(docs, model, name="found").select("text", "language", "found.*").collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert r["language"] in (None, "l")
        no_letter = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == no_letter and (not no_letter or r["score"] == 0)
    assert langid.learn(no_docs(spark)) == {}
    assert langid.identify(docs, {}).where("language.lang_pred <> 'und'").isEmpty()


def test_language_vectors_are_bound_and_bundled():
    enc = langid.Encoder(dim=64)
    a, b = enc.letter(ord("a")).astype(int), enc.letter(ord("b")).astype(int)
    gap = enc.letter(32).astype(int)
    two = {(" ", "a", "b"): 1, ("a", "b", " "): 1}
    vec = {" ": gap, "a": a, "b": b}
    want = sum(n * np.roll(vec[x], 2) * np.roll(vec[y], 1) * vec[z] for (x, y, z), n in two.items())
    assert (enc.bundle([enc.codes("Ab!")])[0] == want).all()
    many = enc.codes("".join(chr(0x4E00 + i) for i in range(400)))  # a large alphabet takes the sorted path
    assert enc.bundle([many, enc.codes("ab")])[1].tolist() == want.tolist()


# --- 2 token counts

def test_token_counts_equal_the_library(docs, texts):
    counter = tokens.PieceCounts(PIECES)
    pool = [r[1] for r in odd_rows()] + list(texts.values()) + [" ", "  a", "a  b ", "▁a▁▁b", "\n a\n", "a\x00 b", "日本 語  "]
    assert counter.count_all(pool) == [len(x) for x in counter.sp.encode([t or "" for t in pool])]
    got = docs.select("doc_id", "text", tokens.token_count(F.col("text"), PIECES).alias("n")).collect()
    assert all(r["n"] == len(counter.sp.encode(r["text"] or "")) for r in got)


def test_token_memory_is_bounded(monkeypatch, texts):
    monkeypatch.setattr(tokens, "_MEMORY", 100)
    monkeypatch.setattr(tokens, "_BLOCK", 500)
    counter = tokens.PieceCounts(PIECES)
    pool = list(texts.values())[:40]
    assert counter.count_all(pool) == [len(x) for x in counter.sp.encode(pool)]


# --- 5 suffix-array dedup

def brute_removal(rows, length=100):
    seen, out = set(), []
    for t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i:i + length] in seen:
                gone[i:i + length] = b"\x01" * length
            seen.add(b[i:i + length])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [suffix.GROUP, 2])
def test_suffix_removal_equals_brute_force(spark, texts, group, monkeypatch):
    if group == 2:  # every anchor that repeats is dealt by whole contexts
        monkeypatch.setattr(suffix, "SAMPLE", 1)
        monkeypatch.setattr(suffix, "HOT_LEAST", 0)
    # documents in descending order of rows; periodic texts, copies and shared passages
    rng = random.Random(5)
    base = "".join(rng.choices("abc d", k=400))
    rows = [(i, t) for i, t in texts.items()][:60] + [
        (1000, None), (1001, ""), (1002, "ab" * 300), (1003, base), (1004, base[50:] + "x" * 250), (1005, "é" * 120),
        (1006, base[:180] + "Q" + base[181:]), (1007, base[100:199]), (1008, base[100:200])]
    rows += [(1100 + i, base[:i] + "#" * (i % 7) + base[i:]) for i in range(0, 300, 11)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in reversed(rows)], "doc_id long, text string, uid string").repartition(1)
    df = spark.createDataFrame(df.collect(), df.schema)
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in suffix.removal(df, group=group).collect()}
    want = dict(zip([i for i, _ in sorted(rows)], brute_removal([t for _, t in sorted(rows)])))
    assert got == want


@pytest.mark.parametrize("size", [104, 130])
def test_suffix_groups_of_a_common_passage_are_bounded(spark, monkeypatch, size):
    # a passage between surroundings that differ: no two contexts are equal as a whole
    rng, group, seen = random.Random(6), 8, []
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = word(size)
    rows = [(i, word(150) + passage + word(150)) for i in range(60)]
    compare = suffix.compare
    monkeypatch.setattr(suffix, "compare", lambda found, length: seen.append(found) or compare(found, length))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.removal(df, group=group).collect()}
    assert got == dict(zip([i for i, _ in rows], brute_removal([t for _, t in rows])))
    assert (seen[0].groupBy("h", "part", "core").count().agg(F.max("count")).first()[0] or 0) <= group


def test_suffix_common_passage_is_spread_over_tasks(spark):
    """A passage in thousands of documents, between surroundings that differ."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = word(104)
    df = spark.createDataFrame([(i, word(100) + passage + word(100)) for i in range(3000)], "doc_id long, text string").repartition(6)
    texts = suffix.compressed(suffix.numbered(df, "doc_id", "text")).cache()
    found, hot = suffix.find_contexts(texts, 100, 20).cache(), suffix.common_anchors(texts, 100, 20)
    names = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        largest = {}
        for name, list_ in (("spread", hot), ("dealt by anchor", hot.limit(0))):
            rows = suffix.settle(found, list_).groupBy(F.spark_partition_id()).count().collect()
            largest[name] = max(r["count"] for r in rows) / sum(r["count"] for r in rows)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert hot.count() >= 1 and largest["spread"] < 0.15 < 0.3 < largest["dealt by anchor"]


def test_suffix_odd_rows(spark):
    rows = odd_rows()
    got = suffix.removal(odd_docs(spark)).collect()
    assert len(got) == len(rows)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    want = brute_removal([rows[i][1] for i in order])
    assert sorted(tuple(r)[2:] for r in got) == sorted(want)
    assert suffix.removal(no_docs(spark)).count() == 0


def test_interleave_gives_common_prefixes():
    data = [bytes(random.Random(i).choices(b"ab", k=60)) for i in range(12)]
    b, step = b"".join(data), 5
    ctx = np.repeat(np.arange(12), 60)
    inside = np.arange(len(b)) % 60
    places = np.flatnonzero(inside <= 55)
    symbol = np.zeros(len(b), dtype=np.int64)
    grams = sorted({b[p:p + step] for p in places})
    symbol[places] = [grams.index(b[p:p + step]) + 1 for p in places]
    after = np.where(inside <= 50, np.arange(len(b)) + step, len(b))
    before = np.where(inside >= step, np.arange(len(b)) - step, -1)
    halves = [places[ctx[places] < 6], places[ctx[places] >= 6]]
    order, common = suffix.merge([suffix.Shard(symbol, ctx * step + inside % step, after, before, h) for h in halves], 4, step)
    assert sorted(order) == sorted(places)
    whole = [p for p in order if inside[p] <= 40]
    strings = [b[p:p + 20] for p in whole]
    assert strings == sorted(strings)
    for i in range(1, len(order)):
        x, y = order[i - 1], order[i]
        if inside[x] <= 40 and inside[y] <= 40:
            same = next((k for k in range(4) if b[x + 5 * k:x + 5 * k + 5] != b[y + 5 * k:y + 5 * k + 5]), 4)
            assert common[i] == 5 * same


# --- 6 line dedup

def brute_lines(rows, min_lines=3, min_words=50, line_words=None):
    """Rows in order -> (text, removed): straight from the definition."""
    seen, out = set(), []
    for t in rows:
        if t is None:
            out.append((None, 0))
            continue
        raw = t.split("\n")
        at = [(i, x.strip(" \t\x0b\x0c\r")) for i, x in enumerate(raw)]
        at = [(i, x) for i, x in at if x]
        gone = set()
        for k in range(len(at)):
            if line_words and len(re.findall(r"[^ \t\x0B\f\r]+", at[k][1])) >= line_words:
                if at[k][1] in seen:
                    gone.add(at[k][0])
                seen.add(at[k][1])
            words = 0
            for m in range(k, min(k + min_lines, len(at))):
                words += len(re.findall(r"[^ \t\x0B\f\r]+", at[m][1]))
                if words >= min_words or m - k + 1 == min_lines:
                    window = tuple(x for _, x in at[k:m + 1])
                    if window in seen:
                        gone.update(range(at[k][0], at[m][0] + 1))
                    seen.add(window)
                    break
        out.append(("\n".join(x for i, x in enumerate(raw) if i not in gone), len(gone)))
    return out


def test_lines_odd_rows(docs, spark):
    got = linededup.dedup_lines(docs, n_removed="gone")
    assert got.columns == docs.columns + ["gone"]
    distinct = sorted({(r[0], r[1]) for r in odd_rows()}, key=lambda r: doc_key(*r))
    want = dict(zip(distinct, brute_lines([t for _, t in distinct])))
    found = got.collect()
    assert len(found) == len(odd_rows())
    assert sorted(((r["text"] or "", r["gone"]) for r in found)) == sorted(
        ((want[r[0], r[1]][0] or "", want[r[0], r[1]][1]) for r in odd_rows()))
    assert any(r["gone"] for r in found)
    assert linededup.dedup_lines(no_docs(spark)).count() == 0


def test_lines_repeat_inside_a_document(spark):
    text = "\n".join(["a b", "c d", "e f", "x", "a b ", "", " c d", "e f", "y"])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert linededup.dedup_lines(df).first()["text"] == "a b\nc d\ne f\nx\ny"


def line_texts(seed, n=300, vocab=25):
    """Documents out of few different lines: every kind of partial, nested and shifted repeat."""
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abcdef") * rng.randrange(1, 4) for _ in range(rng.choice([1, 2, 3, 20, 30, 60]))) for _ in range(vocab)]
    return ["\n".join(rng.choice(["", "  ", rng.choice(lines), rng.choice(lines) + "\t", rng.choice(lines[:4])])
                      for _ in range(rng.randrange(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("line_words", [None, 4])
@pytest.mark.parametrize("seed, vocab, hot", [(1, 25, 10_000), (2, 8, 1), (4, 3, 10_000)])
def test_lines_equal_brute_force(spark, monkeypatch, seed, vocab, hot, line_words):
    monkeypatch.setattr(linededup, "HOT_LEAST", hot)  # 1: every repeated fingerprint is joined by broadcast
    texts = line_texts(seed, vocab=vocab)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["text"], r["gone"]) for r in linededup.dedup_lines(df, n_removed="gone", line_words=line_words).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts, line_words=line_words)


def test_fingerprints_are_selected_positions(spark):
    """Fewer rows than windows, one at least in each window, and equal runs select equal lines."""
    rng = random.Random(5)
    line = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(4))
    texts = ["\n".join(line() for _ in range(60)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = linededup.fingerprints(df, "doc_id", "text", 3, 50).select("id", "p0", "wins").collect()
    assert len(rows) < 0.6 * 20 * 58 and len({(r["id"], r["p0"]) for r in rows}) == len(rows)
    windows = sorted((r["id"], r["p0"] + w["lo"]) for r in rows for w in r["wins"])
    assert windows == [(i, k) for i in range(20) for k in range(58)]  # each window has one position
    assert all(w["lo"] <= 0 < w["lo"] + w["n"] for r in rows for w in r["wins"])


def test_runs_come_through_fingerprints(spark):
    """Without the fingerprints of a run the run stays."""
    rng = random.Random(6)
    line = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(4))
    run = [line() for _ in range(9)]
    texts = ["\n".join([line(), *run, line()]), "\n".join([line(), line(), *run])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = linededup.fingerprints(df, "doc_id", "text", 3, 50)
    found = [(r["id"], r["first"], r["last"], ) for r in linededup.merged(linededup._matched(fps, 2)).collect()]
    assert found == [(1, 2, 10)]
    mine = [r["p0"] for r in fps.where("id = 1 and p0 between 2 and 10").orderBy("p0").collect()]
    cut = linededup.merged(linededup._matched(fps.where(f"not (id = 1 and p0 = {mine[0]})"), 2)).collect()
    assert [(r["first"], r["last"]) for r in cut] != [(2, 10)]
    none = linededup._matched(fps.where("not (id = 1 and p0 between 2 and 10)"), 2)
    assert none.isEmpty()


def test_copied_characters(spark):
    rows = [(1, "a b c d e\nf g h i\nj k l m"), (2, "x1 x2 x3 x4\nx1 x2 x3 x4\nx1 x2 x3 x4"), (3, "a b c d e\nj k l m\nmine"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["c"], r["n"]) for r in linededup.dedup_lines(df, line_words=4, n_copied="c", n_removed="n").collect()}
    assert got == {1: (rows[0][1], 0, 0), 2: ("x1 x2 x3 x4", 0, 2), 3: ("mine", 17, 2), 4: (None, 0, 0)}


def test_pipeline_deletes_planted_single_lines(spark):
    # boilerplate of four to twelve words alone between lines that differ, and a run of short lines
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    planted = [" ".join(word() for _ in range(n)) for n in (4, 9, 12)]
    own = lambda: " ".join(word() for _ in range(7))
    rows = [(i, "\n".join([own(), planted[i % 3], own(), " " + planted[(i + 1) % 3], own(), "a b c", own()])) for i in range(30)]
    rows += [(100, "x y\nz z\nq r\n" + own()), (101, own() + "\nx y\nz z\nq r")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, SF).collect()}
    seen, want = set(), {}
    for i, t in rows:
        lines = [x for x in t.split("\n") if len(x.split()) < 4 or x.strip() not in seen]
        seen |= {x.strip() for x in t.split("\n")}
        want[i] = "\n".join(lines)
    want[101] = want[101].split("\n")[0]  # three short lines are a run
    assert got == want


# --- 7 packing

def test_packing_equals_the_tokenizer_and_is_gapless(docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in odd_rows():
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        start, stop, k = 0, len(ids) % 2048 or 2048, 0
        while start < len(ids):
            want[r[0], k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())] += 1
            start, stop, k = stop, stop + 2048, k + 1
    found = packing.pack(packing.pieces(docs, *BYTE_BPE)).collect()
    assert collections.Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    check_sequences(found)


def check_sequences(rows, capacity=2048):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_ranks_give_the_ids_of_the_tokenizer(texts):
    fast, slow = packing.TokenIds(*BYTE_BPE), packing.TokenIds(BYTE_BPE[0])
    pool = list(texts.values()) + [r[1] for r in odd_rows()] + [
        "it's we'll 'S '  's a’b", "²½ ªº µ ×÷ ǀ", "\x85\xa0  x", " \n\n\t  a", "_a_ __ 1_2", "!?'s"]
    assert all(fast(t) == slow(t) for t in pool)


@pytest.mark.parametrize("choose", ["any", "awkward"])
def test_packing_exchanges_until_certified(spark, choose):
    rng = random.Random(1)
    sizes = [rng.randint(1, 2048) if choose == "any" else rng.choice([1030, 700, 690, 340, 33, 5, 2048, 1024])
             for _ in range(3000)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id long, length long")
    rows = packing.pack(df, group=300).collect()
    assert sorted(r["length"] for r in rows) == sorted(sizes)
    used = check_sequences(rows)
    counts = np.bincount(sizes, minlength=2049)
    whole = counts[2048] + len(packing.best_fit(np.array([n for n in sizes if n < 2048]), 2048)[2])
    assert packing.lower_bound(counts) <= used <= 1.01 * whole  # hardly more than one best fit over all
    if choose == "any":
        assert used <= 1.01 * packing.lower_bound(counts)
    assert packing.pack(df.where("length < 0")).count() == 0


def test_dual_feasible_bound_is_a_bound():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = rng.integers(1, 21, rng.integers(1, 9))
        bound = packing.lower_bound(np.bincount(sizes, minlength=21))
        _, _, fill = packing.best_fit(sizes, 20)
        assert -(-sizes.sum() // 20) <= bound <= len(fill) and fill.max() <= 20
    assert packing.lower_bound(np.bincount([11, 11, 11, 9, 9, 9, 1], minlength=21)) == 4
    assert packing.lower_bound(np.bincount([12, 12, 12], minlength=21)) == 3


# --- 8 mixing

def test_mix_meets_targets(docs, spark):
    plan = mixing.plan_mix(docs).collect()
    assert len(plan) == len(odd_rows())
    assert all(0 <= r["copies"] <= 3 for r in plan)
    total = sum(r["size"] for r in plan)
    target = {r["source"]: r["target"] for r in plan}
    size = {r["source"]: r["source_size"] for r in plan}
    assert abs(sum(target.values()) - total) < 1e-6 * max(total, 1)
    assert all(target[s] <= 3 * size[s] + 1e-9 for s in target)
    weight = dict(zip(sorted(target, key=lambda s: (s is None, s)), [5, 2, 1] * 3))
    level = [target[s] / weight[s] for s in target if target[s] < 3 * size[s] - 1e-6]
    assert max(level, default=0) - min(level, default=0) < 1e-6
    again = mixing.plan_mix(docs).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, plan))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in plan)
    assert mixing.mix(no_docs(spark)).count() == 0


def test_mix_of_equal_and_similar_rows(spark):
    """Rows of one id and size with other texts, whole rows that are equal, null ids: reruns agree
    and every row comes as often as the plan says."""
    rows = [(1, f"a{k % 4} b c", "s") for k in range(12)] + [(None, f"w{k} w", None) for k in range(9)] + [(2, "x y", "t")] * 7
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("m", F.create_map(F.lit("k"), F.col("text")))
    mixes = []
    for parts in (1, 3, 5):
        mixed = mixing.mix(df.repartition(parts))
        assert mixed.columns == df.columns
        mixes.append(collections.Counter((r["doc_id"], r["text"], r["source"], r["m"]["k"]) for r in mixed.collect()))
    assert mixes[0] == mixes[1] == mixes[2]
    plan = collections.Counter()
    for r in mixing.plan_mix(df).collect():
        plan[r["id"], r["source"]] += r["copies"]
    got = collections.Counter()
    for (i, _, s, _), n in mixes[0].items():
        got[i, s] += n
    assert got == +plan


def test_mix_shuffles_texts_once(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().explainString(
        docs.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "regexp_count" not in plan  # counted once, when the sizes were written


def test_mix_taken_words_near_target(spark):
    got = QUERIES["op8_mixing"](spark, "/root/testdata/sf0.01").collect()
    taken, target, longest = collections.Counter(), {}, 0
    docs = {r["doc_id"]: r["source"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in got:
        taken[docs[r["doc_id"]]] += r["taken"]
        target[docs[r["doc_id"]]] = r["target"]
        longest = max(longest, r["size"])
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - t) <= longest for s, t in target.items())


# --- 9 HTML extraction

def test_pages_of_the_tables(spark):
    rows = QUERIES["op9_html_extraction"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet"), ["page_id", "url"]).collect()
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(stdhtml.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


LONG = "This is a paragraph of the story, with commas, and some words more. It goes on for a while, so it is long."


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("no tags &amp; one", "no tags & one"), ("<p>a\n b<br>c<p>d", "a b c\n\nd"),
    (f"<body><div class='sidebar'><p>{LONG}</p></div><div id=content><h2>Head</h2><p>{LONG}</p></div></body>", f"Head\n\n{LONG}"),
    (f"<header><h1>Site</h1></header><main><h1>Title</h1><p>{LONG}</p><form><p>{LONG}</p></form></main>", f"Title\n\n{LONG}"),
    (f"<article><header><h1>T</h1></header><p>{LONG}</p><footer>f</footer></article><section id='comments'><article class='comment'><p>{LONG}</p></article></section>",
     f"T\n\n{LONG}"),
    (f"<div class='cookie-notice'>{LONG}</div><div><p>{LONG}</p><ul><li>one<li>two</ul></div>", f"{LONG}\n\none\n\ntwo"),
    (f"<script>if (a<b) '</p>'</script><style>p{{}}</style><p>{LONG}</p><!-- <p>x</p> --><p hidden>h</p>", LONG),
    (f"<article><p>{LONG}</p><p>cut &am", f"{LONG}\n\ncut &am"),
    (f"<div class='content with-ads'><article class='has-ads'><p>{LONG}</p></article></div>", LONG),
    (f"<div class='content with-ads'><p>{LONG}</p></div><nav>{LONG}</nav>", LONG),
    (f"<main><article><p>{LONG}</p></article><article class='comment'><p>{LONG}</p></article></main>", LONG),
    (f"<aside><article><p>{LONG} {LONG}</p></article></aside><div><p>{LONG}</p><p>Yes.</p></div>", f"{LONG}\n\nYes."),
    (f"<form><main><p>{LONG}</p></main></form><div>{LONG} {LONG}</div>", LONG),
    (f"<section id='comments'><article><p>{LONG} {LONG}</p></article></section><div><p>{LONG}</p></div>", LONG),
    (f"<article><div class='header'><h1>T</h1></div><p>{LONG}</p><div class='share'>Share</div></article>", f"T\n\n{LONG}"),
    ("<nav><a>Home</a></nav><footer>c</footer>", ""), ("<p>x", "x"), ("<div hidden><p>x</p></div>", ""),
    (f"<div role='complementary'>{LONG}</div><p>{LONG}</p>", LONG),
])
def test_main_text(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("page, want", [
    (f"<body><div id=content><div>{LONG}</div><div>Yes.</div></div></body>", f"{LONG}\n\nYes."),
    (f"<div id=content><h2>Head</h2><div>{LONG}</div><div>Yes.</div><div>{LONG}</div></div>", f"Head\n\n{LONG}\n\nYes.\n\n{LONG}"),
    (f"<div id=content><div><h2>Head</h2></div><div><p>{LONG}</p></div><div><p>No.</p></div></div>", f"Head\n\n{LONG}\n\nNo."),
    (f"<table><tr><td>{LONG}</td></tr><tr><td>Yes.</td></tr><tr><td>{LONG}</td></tr></table>", f"{LONG}\n\nYes.\n\n{LONG}"),
    (f"<div><ul><li>Home</li><li>About</li></ul></div><div id=content><div>{LONG}</div><div>Yes.</div></div>", f"{LONG}\n\nYes."),
])
def test_paths_are_aggregated_over_the_page(page, want):
    assert html.main_text(page) == want


def table_pages(spark):
    return [r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()]


def test_ratios_decide_not_names(spark, monkeypatch):
    """Without the threshold most pages change; without the list of names hardly one does."""
    pages = table_pages(spark)
    normal = [html.main_text(p) for p in pages]
    assert sum(html.main_text(p, 0) != t for p, t in zip(pages, normal)) > 0.9 * len(pages)
    monkeypatch.setattr(html, "DOUBTFUL_NAMES", set())
    monkeypatch.setattr(html, "FOREIGN_NAMES", set())
    assert sum(html.main_text(p) == t for p, t in zip(pages, normal)) >= 0.95 * len(pages)


def test_ratios_decide_without_declared_articles(spark, monkeypatch):
    """The same pages with plain divs instead of their articles: ratios find most of them."""
    pages = table_pages(spark)
    plain = [re.sub(r"(</?)article", r"\1div", p) for p in pages]
    same = sum(html.main_text(a) == html.main_text(b) for a, b in zip(plain, pages))
    assert same >= 0.8 * len(pages)


def brute_scores(page):
    """Ratios of a simple page by the formula, path by path."""
    found = [(m.start(), m[1].split(), m[2]) for m in re.finditer(r"<!--([^>]*)-->([^<]+)", page)]
    per = collections.defaultdict(list)
    for _, path, text in found:
        per[tuple(path)].append(text)
    return {p: sum(map(len, ts)) / len(ts) * (1 + np.log1p(sum(t.count(".") + t.count(",") for t in ts) / len(ts))) for p, ts in per.items()}


def test_scores_by_hand():
    page = ("<body><nav><ul><li><!--nav ul li-->Home</li><li><!--nav ul li-->About us.</li></ul></nav><div><h2><!--div h2-->Head</h2>"
            "<p><!--div p-->One, two, three and four.</p><p><!--div p-->Five.</p></div></body>")
    ratio = brute_scores(page)
    texts = ["Home", "About us.", "Head", "One, two, three and four.", "Five."]
    mean = (ratio["div", "h2"] * 4 + ratio["div", "p"] * 30) / 34
    got = html.scored(page)
    assert [t for _, _, t in got] == texts and got[0][1] == pytest.approx(mean)
    want = [html.AWAY * ratio["nav", "ul", "li"]] * 2 + [mean] + [max(mean, ratio["div", "p"])] * 2
    assert [s for s, _, _ in got] == pytest.approx(want)


@pytest.mark.parametrize("page", ["<div>word " * 20_000, "<li>a<ul>" * 20_000 + "x", "<article><h1>x</h1>" * 20_000,
                                  "<b>" * 50_000 + "<p>word</p>" * 500])
def test_deep_pages_take_linear_time(page):
    start = time.monotonic()
    assert html.main_text(page)
    assert time.monotonic() - start < 20


# --- 10 n-gram Jaccard join

def brute_pairs(rows):
    sets = []
    for t in rows:
        w = re.findall(r"[^ \t\n\x0b\f\r]+", t or "")
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


@pytest.mark.parametrize("block", [jaccard.BLOCK, 4])
def test_jaccard_equals_brute_force(spark, texts, block):
    rng = random.Random(2)
    base = [rng.choice(list(texts.values())).split()[:120] for _ in range(3)]
    rows = [(i, t) for i, t in texts.items()]
    for k in range(40):  # a group of near copies, all different
        w = list(base[k % 3])
        w[rng.randrange(len(w))] = f"new{k}"
        rows.append((2000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links, root = collections.Counter(), {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in brute_pairs([t for _, t in rows]):
        a, b = rows[i][0], rows[j][0]
        links.update([a, b])
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {r["id"]: (r["n_links"], r["class_id"], r["kept"]) for r in jaccard.near_classes(df, block=block).collect()}
    assert got == {i: (links[i], top(i), top(i) == i) for i, _ in rows}


def test_jaccard_odd_rows(docs, spark):
    got = jaccard.near_classes(docs).collect()
    assert len(got) == len(odd_rows())
    links = collections.Counter()
    for i, j in brute_pairs([r[1] for r in odd_rows()]):
        links.update([i, j])
    assert sorted(r["n_links"] for r in got) == sorted(links[i] for i in range(len(odd_rows())))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    words = [r["text"] for r in kept.collect() if (r["text"] or "").split()]
    assert not brute_pairs(words)
    assert jaccard.keep_one(no_docs(spark)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    least = jaccard.least_agreements(0.8, 96, 16, 1e-6)
    rng = np.random.default_rng(3)
    agree = (rng.random((20_000, 96)) < 0.8).cumsum(axis=1)
    alive = np.all([agree[:, n - 1] >= m for n, m in least.items()], axis=0)
    assert alive.mean() > 0.999
    far = (rng.random((20_000, 96)) < 0.3).cumsum(axis=1)
    assert np.all([far[:, n - 1] >= m for n, m in least.items()], axis=0).mean() < 0.001
