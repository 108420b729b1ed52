"""Periodic runs, URL filters and tokenizer alignment against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixtures import no_docs, odd_docs, odd_rows
from propensity.llm import align, runs, urls
from propensity.llm.queries import BYTE_BPE, PIECES, QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return odd_docs(spark).cache()


# --- 12 periodic runs

def brute_runs(words, length=6, exponent=4):
    """Every stretch by its definition: for each period the maximal stretches, smallest period first."""
    n, best = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(length, exponent * q):
                best.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, ln, q) for (s, ln), q in best.items())


def numbers(texts):
    flat = [w for t in texts for w in t]
    ids = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    return np.array([ids[w] for w in flat], dtype=np.int64), np.cumsum([0, *map(len, texts)])


def check_runs(texts, **kw):
    got = defaultdict(list)
    for t, *r in runs.find_runs(*numbers(texts), **kw).tolist():
        got[t].append(tuple(r))
    for k, t in enumerate(texts):
        assert got[k] == brute_runs(t, **kw), t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=4), st.sampled_from([(6, 4), (2, 2), (9, 3), (5, 2)]))
def test_runs_of_two_words(texts, limits):
    check_runs([list(t) for t in texts], length=limits[0], exponent=limits[1])


def test_runs_planted():
    rng = random.Random(1)
    texts = []
    for k in range(60):
        t = [rng.choice("abcdefgh") for _ in range(rng.randrange(200))]
        for _ in range(3):
            p = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))]
            at = rng.randrange(len(t) + 1)
            t[at:at] = (p * 7)[:rng.randrange(7 * len(p)) + 1]
        texts.append(t)
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    texts += [list(fib[-1]), ["x"] * 700, list("ab" * 300 + "a"), list("aab" * 50 + "b" + "aab" * 50), [], ["x"]]
    check_runs(texts)
    check_runs(texts, length=2, exponent=2)


def test_runs_collapse_odd_rows(docs, spark):
    got = runs.periodic_runs(docs, name="th").collect()
    assert len(got) == len(odd_rows()) and [r["language"] for r in got] == ["l" if r["size"] else None for r in got]
    some = 0
    for r in got:
        if r["text"] is None:
            assert r["th"]["collapsed"] is None and r["th"]["runs"] == [] and r["th"]["n_words"] == 0
            continue
        words = WORD.findall(r["text"])
        want = brute_runs(words) if len(words) < 4000 else brute_runs(words[:3200])
        assert r["th"]["n_words"] == len(words) and [tuple(x) for x in r["th"]["runs"]] == want
        gone = {i for s, ln, q in want for i in range(s + q, s + ln)}
        assert r["th"]["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)
        some += bool(want)
    assert some >= 2
    assert runs.periodic_runs(no_docs(spark)).isEmpty()
    with pytest.raises(ValueError):
        runs.runs_of(F.col("text"), exponent=1)


def test_runs_in_small_blocks(docs, monkeypatch):
    texts = [WORD.findall(r["text"] or "") for r in docs.select("text").collect()]
    whole = runs.find_runs(*numbers(texts)).tolist()
    apart = [[k, *r[1:]] for k, t in enumerate(texts) for r in runs.find_runs(*numbers([t])).tolist()]
    assert whole == apart


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op12_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_periodic_runs"](spark, SF).collect()
    assert len(rows) == len(texts)
    periodic = 0
    for r in rows:
        words = WORD.findall(texts[r["doc_id"]] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        want = brute_runs(words)
        periodic += bool(want)
        gone = {i for s, ln, q in want for i in range(s + q, s + ln)}
        assert r["n_runs"] == len(want)
        assert r["runs_sha256"] == sha("".join(f"{s},{ln},{q}\n" for s, ln, q in want))
        assert r["collapsed_sha256"] == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
        top = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else None
        if top:
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (*top, 1000 * top[1] // top[2])
        else:
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (None,) * 4
    assert periodic >= 5


def test_op12_query_odd_ids(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    assert len(rows) == len(odd_rows())
    assert all(None not in (r["runs_sha256"], r["collapsed_sha256"], r["n_runs"]) for r in rows)


# --- 11 URL filters

URLS = [None, "", "no scheme", "://", "http://", "http:///x", "HTTP://EXAMPLE.Org/ES/", "http://example.org", "http://example.org/",
        "http://example.org/es/1", "https://a.example.org/en/12?x=1", "https://a.example.org/en/2", "https://example.org.evil.net/es/",
        "https://evil.net/www.example.org/es/", "http://org/", "http://.org/x", "http://xorg/", "http://x.com/fr/1", "http://x.com/de/1",
        "http://x.com/it/#/fr/", "http://x.com?/fr/", "http://x.com#/fr/", "a://b://c.org/x", "http://casino.net/de/", "http://casino",
        "http://x.net/casino/", "http://x.net/pics/ä.JPG", "http://x.net/pics/ä.jpg", "http://x.net/login", "http://x.net/login/2",
        "http://x.net/login2", "http://user@x.com:80/fr/", "http://İ.org/", "http://x.org/" + "a/" * 5000, "http://x.net/日本.pdf",
        "http://x.net/ spaced \n line.pdf", "http://free-casino.example.com/fr/1"]


def brute_verdict(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest)[0][len(host):]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits)[1:]
    bad = any(brute_glob(g, host + path) for g in urls.UNWANTED)
    return host, path, None, "block" if bad else "allow"


def brute_glob(glob, text):
    """By the definition, position by position."""
    if not glob:
        return not text
    if glob.startswith("**"):
        return any(brute_glob(glob[2:], text[k:]) for k in range(len(text) + 1))
    if glob[0] == "*":
        inside = len(text.split("/")[0])
        return any(brute_glob(glob[1:], text[k:]) for k in range(inside + 1))
    if glob[0] == "?":
        return bool(text) and text[0] != "/" and brute_glob(glob[1:], text[1:])
    if glob[0] == "\\" and len(glob) > 1:
        glob = glob[1:]
    return text[:1] == glob[0] and brute_glob(glob[1:], text[1:])


GLOBS = st.lists(st.sampled_from(["a", "b", "/", "*", "**", "?", "é", "\\*", "日"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(GLOBS, min_size=1, max_size=30), st.lists(st.text("ab/é日*", max_size=12), min_size=1, max_size=8))
def test_automaton_equals_definition(globs, texts):
    import pyarrow as pa
    globs = [g.replace("***", "**") for g in globs]
    got = urls.Automaton([urls.Rule(g, "block", (g,)) for g in globs])(pa.array([t.encode() for t in texts]))
    for t, k in zip(texts, got.tolist()):
        assert k == next((i for i, g in enumerate(globs) if brute_glob(g, t)), -1), (t, globs)


def test_op11_query(spark, tmp_path):
    rows = [(i, u, "<p>") for i, u in enumerate(URLS)] + [(3, URLS[9], None), (None, URLS[9], None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op11_url_filters"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        url = URLS[9] if r["page_id"] is None or r["page_id"] == 3 and r["path"] else URLS[r["page_id"]]
        if len(url or "") < 1000:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_verdict(url), url
    assert {r["rule"] for r in got} == {None, "org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/"}


def test_judge_keeps_columns_and_rules_order(spark):
    df = spark.createDataFrame([("http://a.org/x", "h", 1), (None, None, 2)], "url string, host string, number int")
    both = [urls.Rule("first", "block", ("a.org/*",)), urls.Rule("second", "allow", ("**",))]
    got = {r["number"]: r for r in urls.judge(df, both, name="verdict").collect()}
    assert got[1]["host"] == "h" and got[1]["verdict"]["rule"] == "first" and got[2]["verdict"]["rule"] == "second"
    assert urls.judge(df, [], default="block").where("judged.verdict <> 'block' or judged.rule is not null").isEmpty()
    assert urls.judge(df.limit(0), both).isEmpty()
    many = [urls.Rule(str(k), "block", (f"*/{k}/**",)) for k in range(500)]
    nets = spark.range(500).withColumn("url", F.concat(F.lit("x://h/"), F.col("id"), F.lit("/y")))
    assert urls.judge(nets, many).where("judged.number <> id").isEmpty()


# --- 13 tokenizer alignment

def brute_alignment(rows):
    """Per row: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups), token by token."""
    import sentencepiece
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BYTE_BPE[0])
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = {}
    extra = 256
    for b in range(256):
        shown = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        letters[chr(b if shown else extra)] = b
        extra += not shown
    laid, count = [], Counter()
    for text in rows:
        laid.append(None)
        if not text:
            continue
        a = tok.encode(" " + text, add_special_tokens=False).ids
        b = sp.encode(text)
        ta = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a]
        tb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
        if not b"".join(ta) == b"".join(tb) == (" " + text).encode():
            continue
        sa, sb = np.cumsum([0, *map(len, ta)]).tolist(), np.cumsum([0, *map(len, tb)]).tolist()
        links, j = [], 0
        for i in range(len(a)):
            while sb[j + 1] <= sa[i]:
                j += 1
            k = j
            while k < len(b) and sb[k] < sa[i + 1]:
                links.append((a[i], b[k]))
                k += 1
        ends = sorted(set(sa[1:]) & set(sb[1:]))
        parts = []
        for lo, hi in zip([0, *ends], ends):
            parts.append(",".join(str(x) for x, e in zip(a, sa[1:]) if lo < e <= hi) + "|"
                         + ",".join(str(x) for x, e in zip(b, sb[1:]) if lo < e <= hi)) if len(a) < 3000 else None
        laid[-1] = (len(a), len(b), len(ends), links, ";".join(parts) if len(a) < 3000 else None)
        count.update(set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else
            (*x[:3], len(x[3]), sum(count[p] == best[p[0]] for p in x[3]), sum(count[p] for p in x[3]), x[4]) for x in laid]


def hold_alignment(rows, want, digest):
    for r, w in zip(rows, want):
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == w[:6]
        if w[6] is not None:
            assert r[-1] == (sha(w[6]) if digest and w[6] else w[6])


@pytest.mark.parametrize("block", [1, 500, 1 << 22])
def test_alignment_odd_rows(spark, docs, block, monkeypatch):
    monkeypatch.setattr(align, "HOT_LEAST", 1)  # every copied text is dealt over several tasks
    texts = [r["text"] for r in docs.select("text").collect()] + ["\x00\x01", "ﬁ", "a  b", "<s></s><unk> <0x41>", "▁a", "a\u2581b"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "id long, text string, `key` string").repartition(3)
    got = align.align(df, *BYTE_BPE, PIECES, id_col="id", block=block).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(len(texts)))
    hold_alignment(got, brute_alignment(texts), digest=False)


def test_alignment_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    got = align.align(df, *BYTE_BPE, PIECES).collect()
    assert sorted(r["count_sum"] for r in got) == [0, 4, 4] and {r["id"] for r in got} == {None}
    assert align.align(df.limit(0), *BYTE_BPE, PIECES).isEmpty()
    assert align.align(df.where("text is null"), *BYTE_BPE, PIECES).where("n_a <> 0 or groups <> ''").isEmpty()


def test_op13_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = QUERIES["op13_tokenizer_alignment"](spark, SF).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    hold_alignment(got, brute_alignment([r["text"] for r in rows]), digest=True)


def test_packed_numbers():
    x = np.array([0, 1, 2**32 - 1, 70_000], dtype=np.int64)
    assert align.unpack_numbers(align.pack_numbers(x), 4).tolist() == x.tolist()
    assert align.unpack_numbers(align.pack_numbers(x[:0]), 0).tolist() == []
