"""Line dedup: winnowing over line hashes, in DataFrame operations only.

A *run* is a stretch of consecutive lines (blank lines are passed over, white space
around a line is ignored) with at least ``MIN_LINES`` lines or ``MIN_WORDS`` words.  A
line is deleted if it lies in a run that also occurs earlier: in a document with a
smaller id, or further up in the same document.

With ``line_words`` a single line of at least so many words counts as a run as well, so
boilerplate between lines that differ goes too.

From every line on, the shortest run that starts there is a window of one to
``MIN_LINES`` lines, and every run contains such a window.  Winnowing selects the line
with the smallest hash of each window, so two equal runs are sure to share a
fingerprint.  Only the selected positions are written, one row each, with the hashes of the
lines around them as far as a window reaches.

* join: every position meets the first occurrence of its fingerprint, found by a
  decomposable ``min``.  Fingerprints that hold more than a thousandth of all positions, at
  most a thousand of them, are joined by broadcast, so no task gets a common line's rows.
* extend: from the joined pair the match is extended line by line both ways; the windows of the
  position that lie inside it occur earlier.  Runs longer than a window hold further
  fingerprints, and the stretches of neighbouring ones merge.
* rest: a window that differs from the one at the first occurrence may equal one in between.  These
  windows, of repeated fingerprints only, meet the first of their kind by 128 bits over all their lines.

No pairs of occurrences are listed, so a passage with any number of copies stays linear.  Texts
are read twice: for the fingerprints and for the deletion.

Defined results: null text stays null (0 lines); a text without a repeated run is
returned unchanged, blank lines and spaces included; deleted lines go with their line
break; null ids come last; rows with the same id and text are one document in this
order, each gets the same result; other columns, whatever their names, pass through; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propensity.llm.common import fresh, written

MIN_LINES = 3
MIN_WORDS = 50
LINE_WORDS = 4  # a single line of as many words, where single lines count
HOT_SHARE = 1000  # a fingerprint with more than one in so many positions is joined by broadcast
HOT_LEAST = 10_000
SPACES = " \t\x0b\f\r"
WORD = r"[^ \t\x0B\f\r]+"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _words(t: Column) -> Column:
    """Number of words of a trimmed line.  Lines with single spaces only, which most are, are
    counted without the pattern."""
    odd = reduce(or_, [F.contains(t, F.lit(c)) for c in ("  ", *SPACES[1:])])
    return F.when(odd, F.regexp_count(t, F.lit(WORD))).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, min_lines: int, min_words: int,
                 line_words: int | None = None) -> DataFrame:
    """One row per selected position: ``id, th`` (hash of the text), the fingerprint
    itself in ``h0, g0``, the lines around it in ``h-2 .. h2, g-2 .. g2`` and their positions in ``p-2 .. p2``, and
    ``wins``: the windows that selected it, as (first line relative to it, number of lines)."""
    trimmed = F.transform(_lines(F.col(text_col)), lambda x, i: F.struct(
        i.alias("pos"), F.trim(x, F.lit(SPACES)).alias("t")))
    hashed = F.transform(F.filter(trimmed, lambda x: x["t"] != ""), lambda x: F.struct(
        F.xxhash64(x["t"]).alias("h"), F.xxhash64(F.lit("second"), x["t"]).alias("g"), x["pos"].alias("pos"),
        F.least(_words(x["t"]), F.lit(min_words)).alias("w")))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), hashed.alias("l"))
    reach = min_lines - 1

    def window(win: Column) -> Column:
        """Number of lines of the shortest run at the start of ``win``, null where there is none."""
        n, words = None, F.lit(0)
        for k in range(min_lines):
            words = words + F.get(win, F.lit(k))["w"]
            full = (F.size(win) > k) & ((words >= min_words) | F.lit(k + 1 == min_lines))
            n = F.when(full, k + 1) if n is None else n.when(full, k + 1)
        return n

    def chosen(win: Column, n: Column) -> Column:
        """Where in the window the smallest hash is, the last of equal ones."""
        return -F.array_min(F.transform(F.slice(win, F.lit(1), n), lambda y, j: F.struct(
            y["h"].alias("h"), y["g"].alias("g"), (-j).alias("j"))))["j"]

    def let(value: Column, body) -> Column:  # ``value`` is computed once, as a lambda's argument
        return F.get(F.transform(F.array(value), body), F.lit(0))

    lines = let(hashed, lambda l: F.transform(l, lambda x, i: let(F.slice(l, i + 1, F.lit(min_lines)), lambda win: let(
        window(win), lambda n: F.struct(*[x[c].alias(c) for c in ("h", "g", "pos", "w")], n.alias("n"), chosen(win, n).alias("at"))))))
    # neighbours by shifted copies of the list, so that nothing is sorted or exchanged
    pad = F.array_repeat(F.lit(None).cast("struct<h:bigint,g:bigint,pos:int,w:int,n:int,at:int>"), reach)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), lines.alias("l"))
    rows = rows.where(F.size("l") > 0).select("id", "th", F.size("l").alias("n"), F.concat(pad, "l", pad).alias("l"))
    rows = rows.select("id", "th", F.inline(F.arrays_zip(*[
        F.slice("l", k + 1 + reach, F.col("n")).alias(f"l{k}") for k in range(-reach, reach + 1)])))
    line = lambda k: F.col(f"`l{k}`")
    wins = [F.when(line(first)["at"] == -first, F.struct(F.lit(first).alias("lo"), line(first)["n"].alias("n")))
            for first in range(-reach, 1)]
    if line_words is not None:
        wins.append(F.when(line(0)["w"] >= min(line_words, min_words), F.struct(F.lit(0).alias("lo"), F.lit(1).alias("n"))))
    rows = rows.withColumn("wins", F.array_compact(F.array(*wins))).where(F.size("wins") > 0)
    around = [line(k)[c].alias(f"{c[0]}{k}") for c in ("h", "g", "pos") for k in range(-reach, reach + 1)]
    return rows.select("id", "th", "wins", *around)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, line_words: int | None = None) -> DataFrame:
    """``(id, th, first, last, other)``: the stretches of lines to delete, as they were matched, and
    whether their first occurrence lies in another document."""
    reach = min_lines - 1
    fps = written(fingerprints(docs, id_col, text_col, min_lines, min_words, line_words), "fingerprints")
    return _matched(fps, reach)


def _matched(fps: DataFrame, reach: int) -> DataFrame:
    span = range(-reach, reach + 1)
    keys = ["h0", "g0"]
    spot = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("th"), F.col("p0").alias("at"))
    around = F.struct(*[F.col(f"`{c}{k}`").alias(f"{c}{k}") for c in "hg" for k in span if k])
    firsts = (fps.groupBy(*keys).agg(F.min(F.struct(spot.alias("spot"), around.alias("around"))).alias("lo"), F.count("*").alias("n"))
              .where("n > 1").select(*keys, "n", F.col("lo.spot").alias("spot"), F.col("lo.around").alias("around")))
    firsts = written(firsts, "firsts")
    share = F.greatest(F.lit(HOT_LEAST), F.ceil(F.lit(fps.count() / HOT_SHARE)))
    hot, cold = firsts.where(F.col("n") > share), firsts.where(F.col("n") <= share)
    met = fps.join(F.broadcast(hot), keys).unionByName(
        fps.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))
    # lines to the left and to the right of the pair that are equal
    same = {k: F.coalesce((F.col(f"`h{k}`") == F.col(f"around.`h{k}`")) & (F.col(f"`g{k}`") == F.col(f"around.`g{k}`")), F.lit(False))
            for k in span if k}
    left = sum((F.when(reduce(and_, [same[-j] for j in range(1, k + 1)]), 1).otherwise(0) for k in range(1, reach + 1)), F.lit(0))
    right = sum((F.when(reduce(and_, [same[j] for j in range(1, k + 1)]), 1).otherwise(0) for k in range(1, reach + 1)), F.lit(0))
    places = F.array(*[F.col(f"`p{k}`") for k in span])
    met = met.where(~spot.eqNullSafe(F.col("spot"))).select(
        "id", "th", "wins", "spot", left.alias("left"), right.alias("right"), places.alias("places"),
        F.array(*[F.struct(F.col(f"`h{k}`").alias("h"), F.col(f"`g{k}`").alias("g")) for k in span]).alias("lines"))
    inside = lambda w: (w["lo"] >= -F.col("left")) & (w["lo"] + w["n"] - 1 <= F.col("right"))
    met = met.withColumn("in", F.filter("wins", inside)).withColumn("out", F.filter("wins", lambda w: ~inside(w)))
    place = lambda k: F.get("places", k + reach)
    found = met.where(F.size("in") > 0).select(
        "id", "th", place(F.array_min(F.transform("in", lambda w: w["lo"]))).alias("first"),
        place(F.array_max(F.transform("in", lambda w: w["lo"] + w["n"] - 1))).alias("last"),
        (~F.col("id").eqNullSafe(F.col("spot.id")) | (F.col("th") != F.col("spot.th"))).alias("other"))
    # windows unlike the one at the first occurrence
    rest = met.where(F.size("out") > 0).select("id", "th", "places", "lines", F.explode("out").alias("w"))
    win = F.slice("lines", F.col("w.lo") + reach + 1, F.col("w.n"))
    rest = rest.select("id", "th", place(F.col("w.lo")).alias("first"), place(F.col("w.lo") + F.col("w.n") - 1).alias("last"),
                       F.xxhash64(F.transform(win, lambda x: x["h"])).alias("ka"), F.xxhash64(F.transform(win, lambda x: x["g"])).alias("kb"))
    begin = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("th"), F.col("first"))
    kinds = rest.groupBy("ka", "kb").agg(F.min(begin).alias("lo"), F.max(begin).alias("hi")).where("lo <> hi").select("ka", "kb", "lo")
    more = rest.join(kinds, ["ka", "kb"]).where(~begin.eqNullSafe(F.col("lo"))).select(
        "id", "th", "first", "last", (~F.col("id").eqNullSafe(F.col("lo.id")) | (F.col("th") != F.col("lo.th"))).alias("other"))
    return found.unionByName(more)


def merged(runs: DataFrame) -> DataFrame:
    """``(id, th, first, last)``: maximal stretches of overlapping or touching ones."""
    runs = runs.select("id", "th", "first", "last").distinct()
    doc = Window.partitionBy("id", "th")
    reach = F.max("last").over(doc.orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.col("opens")).over(doc.orderBy("first", "last"))
    runs = runs.withColumn("opens", F.when(F.col("first") <= reach + 1, 0).otherwise(1)).withColumn("run", island)
    return runs.groupBy("id", "th", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def _masks(runs: DataFrame, mask: str) -> DataFrame:
    """One byte for every line up to the last one of a stretch: 1 where it lies in one."""
    before = F.lag("last", 1, -1).over(Window.partitionBy("id", "th").orderBy("first"))
    part = F.concat(F.repeat(F.lit("0"), F.col("first") - before - 1), F.repeat(F.lit("1"), F.col("last") - F.col("first") + 1))
    return (runs.withColumn("part", part).groupBy("id", "th")
            .agg(F.array_sort(F.collect_list(F.struct("first", "part"))).alias("parts"),
                 F.sum(F.col("last") - F.col("first") + 1).alias(f"{mask}_n"))
            .select("id", "th", f"{mask}_n", F.array_join("parts.part", "").cast("binary").alias(mask)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES,
                min_words: int = MIN_WORDS, n_lines: str | None = None, n_removed: str | None = None,
                line_words: int | None = None, n_copied: str | None = None) -> DataFrame:
    """``docs`` with the repeated runs deleted from ``text_col``; the counts of lines
    before and of deleted lines are added under the names given, and under ``n_copied`` the
    characters of the deleted lines that first occur in another document."""
    runs = repeated_runs(docs, id_col, text_col, min_lines, min_words, line_words)
    if n_copied:
        runs = written(runs, "runs")
    masks = _masks(merged(runs), "mask")
    if n_copied:
        masks = masks.join(_masks(merged(runs.where("other")), "copied").withColumnsRenamed({"id": "i", "th": "h"}),
                           F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")), "left").drop("i", "h")
    masks = masks.withColumnsRenamed({"id": "_mid", "th": "_mth"})
    inner, th = fresh(docs, "row"), fresh(docs, "th")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(inner), F.xxhash64(F.col(text_col)).alias(th))
    text = F.col(f"{inner}.`{text_col}`")
    rows = rows.join(masks, F.col(f"{inner}.`{id_col}`").eqNullSafe(F.col("_mid")) & (F.col(th) == F.col("_mth")), "left")

    def picked(mask: str, byte: bytes) -> Column:
        in_mask = lambda x, i: F.coalesce(F.substring(F.col(mask), i + 1, F.lit(1)) == F.lit(b"1"), F.lit(False))
        return F.array_join(F.filter(_lines(text), in_mask if byte == b"1" else lambda x, i: ~in_mask(x, i)), "\n")

    out = [F.when(F.col("mask").isNull(), text).otherwise(picked("mask", b"0")).alias(c) if c == text_col
           else F.col(f"{inner}.`{c}`").alias(c) for c in docs.columns]
    if n_lines:
        out.append(F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("long").alias(n_lines))
    if n_removed:
        out.append(F.coalesce("mask_n", F.lit(0)).cast("long").alias(n_removed))
    if n_copied:
        out.append(F.when(F.col("copied").isNull(), 0).otherwise(F.length(picked("copied", b"1"))).cast("long").alias(n_copied))
    return rows.select(*out)


ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
c AS (
  SELECT * FROM (SELECT doc_id, pos, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM l) WHERE t <> ''),
w AS (
  SELECT *, least({MIN_WORDS}, len(regexp_extract_all(t, '{WORD}'))) AS n FROM c),
z AS (
  SELECT doc_id, pos, t, n, lead(t) OVER o AS t1, lead(n) OVER o AS n1, lead(pos) OVER o AS p1,
         lead(t, 2) OVER o AS t2, lead(pos, 2) OVER o AS p2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
k AS (
  SELECT doc_id, pos AS first,
         CASE WHEN n >= {MIN_WORDS} THEN pos WHEN n + n1 >= {MIN_WORDS} THEN p1 ELSE p2 END AS last,
         CASE WHEN n >= {MIN_WORDS} THEN t WHEN n + n1 >= {MIN_WORDS} THEN t || chr(10) || t1
              ELSE t || chr(10) || t1 || chr(10) || t2 END AS win FROM z),
g AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, first) AS nth FROM k WHERE last IS NOT NULL),
s AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) AS nth FROM w WHERE n >= {LINE_WORDS}),
gone AS (
  SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(generate_series(first, last)) AS pos FROM g WHERE nth > 1)
  UNION SELECT doc_id, pos FROM s WHERE nth > 1),
r AS (
  SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(gone.pos)::BIGINT AS n_removed,
         coalesce(string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL), '') AS kept
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE r.n_lines END AS n_lines, r.n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE r.kept END AS text
FROM documents d JOIN r ON r.doc_id = d.doc_id
"""
