"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Rules are globs over the *canonical* URL, which is the host in lower case followed by the
path, without scheme, query and fragment.  In a glob ``*`` stands for any run of characters
without ``/``, ``**`` for any run at all, ``?`` for one character other than ``/``, and a
backslash makes the next character plain.  A host holds no ``/``, so a pattern that starts
with ``*.org/`` can't match inside a path.

All globs are packed, one bit for each position in each glob, into the 64-bit words of one
multiword Shift-And automaton: a position's bit is set while the characters so far match the
glob up to there.  One step for a byte ``c`` is ``D = ((D << 1) & ENTER[c]) | (D & STAY[c])``,
with carries between words; ``ENTER`` has the positions that ``c`` leads into and ``STAY``
those that a star holds open.  All globs advance at once for all URLs of a batch, byte by
byte; URLs are ordered by length, so that each step touches only those that go on.  Globs are
packed in the rules' order, hence the lowest final bit left at the end names the first rule
that fits.

The automaton grows with the rules (a few bytes times 512 for each character), not with the
data; a batch holds its URLs and ``rules' characters / 8`` bytes for each.  Nothing is shuffled.

Defined results: a null URL and one without ``://`` have an empty host and path, which only
globs that match the empty string fit; each of several equal rows gets the same result; URLs
of any length and any characters are read whole, as UTF-8; all columns of the input pass
through; an empty table gives an empty result; without rules every URL gets the default.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"

#: Globs of hosts and paths that hold no prose, blocked unless a rule before them fits.
UNWANTED = (
    "*adult**", "*bets**", "*casino**", "*lottery**", "*pills**", "*porn**", "*spam**", "*xxx**",
    "*/cart", "*/cart/**", "*/login", "*/login/**", "*/search", "*/search/**", "*/wp-admin/**",
    "**.css", "**.exe", "**.gif", "**.ico", "**.jpeg", "**.jpg", "**.js", "**.mp3", "**.mp4", "**.pdf", "**.png",
    "**.svg", "**.zip",
)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    globs: tuple[str, ...]


def plain(text: str) -> str:
    """``text`` as a glob that matches nothing else."""
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host and all its subdomains, for paths that start with ``path``."""
    tail = plain(host.lower() + path) + "**"
    return Rule(host + path, verdict, (tail, "*." + tail))


def longest_first(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: -len(r.name))


_ANY = np.ones(256, dtype=bool)
_INSIDE = _ANY.copy()  # all but the slash
_INSIDE[ord("/")] = False
_MORE = np.zeros(256, dtype=bool)  # bytes that continue a character
_MORE[0x80:0xC0] = True


def positions(glob: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each position of a glob: the bytes that lead into it, and those that it stays at."""
    none = np.zeros(256, dtype=bool)
    out = [(none, none.copy())]
    i = 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            wide = glob.startswith("**", i)
            out[-1] = (out[-1][0], out[-1][1] | (_ANY if wide else _INSIDE))
            i += 2 if wide else 1
            continue
        if c == "?":
            out.append((_INSIDE & ~_MORE, _MORE.copy()))
        else:
            if c == "\\" and i + 1 < len(glob):
                i += 1
            for b in glob[i].encode():
                enter = none.copy()
                enter[b] = True
                out.append((enter, none.copy()))
        i += 1
    return out


class Automaton:
    """All globs of ``rules``; calling it gives the number of the first rule that fits each URL, or -1."""

    def __init__(self, rules: Sequence[Rule]):
        bits = [(k, p, last) for k, r in enumerate(rules) for g in r.globs for ps in [positions(g)]
                for i, p in enumerate(ps) for last in [(i == 0, i == len(ps) - 1)]]
        words = max(1, -(-len(bits) // 64))
        self.enter, self.stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        self.start, self.final = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        self.rule = np.full(words * 64 + 1, -1, dtype=np.int64)
        for n, (k, (enter, stay), (first, last)) in enumerate(bits):
            w, bit = n // 64, np.uint64(1 << n % 64)
            self.enter[enter, w] |= bit
            self.stay[stay, w] |= bit
            if first:
                self.start[w] |= bit
            if last:
                self.final[w] |= bit
            self.rule[n] = k

    def __call__(self, urls: pa.Array) -> np.ndarray:
        """``urls``: binary, without nulls."""
        urls = urls.cast(pa.large_binary())
        size = np.diff(np.frombuffer(urls.buffers()[1], np.int64)[urls.offset:urls.offset + len(urls) + 1])
        at = np.frombuffer(urls.buffers()[1], np.int64)[urls.offset:urls.offset + len(urls)]
        data = np.frombuffer(urls.buffers()[2] or b"", np.uint8)
        order = np.argsort(-size, kind="stable")
        size, at = size[order], at[order]
        going = np.searchsorted(-size, -np.arange(size.max(initial=0)), side="left")  # URLs longer than each step
        state = np.tile(self.start, (len(order), 1))
        one, top = np.uint64(1), np.uint64(63)
        for step, m in enumerate(going.tolist()):
            d, c = state[:m], data[at[:m] + step]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[:m] = (moved & self.enter[c]) | (d & self.stay[c])
        hits = state & self.final
        word = (hits != 0).argmax(axis=1)
        low = hits[np.arange(len(hits)), word]
        bit = np.bitwise_count((low & (~low + one)) - one).astype(np.int64)  # 64 where no bit is set
        number = np.where(low != 0, word * 64 + bit, len(self.rule) - 1)
        out = np.empty(len(order), dtype=np.int64)
        out[order] = self.rule[number]
        return out


def host(url: Column) -> Column:
    """What lies behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def first_fit(canonical: Column, rules: Sequence[Rule]) -> Column:
    """The number, from 0, of the first rule that fits a canonical URL; -1 where none does."""
    rules = tuple(rules)

    def fit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = Automaton(rules)
        for urls in batches:
            yield pa.array(automaton(urls.cast(pa.binary()).fill_null(b"")), pa.int64())

    fit.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(fit, "long")(canonical)


def judge(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", name: str = "judged", default: str = ALLOW) -> DataFrame:
    """``pages`` with the struct column ``name`` (another of that name is replaced): ``host``,
    ``path``, ``rule`` (the name of the first rule that fits, or null), ``verdict`` and
    ``number`` (of that rule, from 0, or -1)."""
    url = F.col(f"`{url_col}`")
    rules = list(rules)
    number = first_fit(F.concat(host(url), path(url)), rules)
    names = F.array(*[F.lit(r.name) for r in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array().cast("array<string>")
    return pages.withColumn(name, number).withColumn(name, F.struct(
        host(url).alias("host"), path(url).alias("path"), F.get(names, F.col(f"`{name}`")).alias("rule"),
        F.coalesce(F.get(verdicts, F.col(f"`{name}`")), F.lit(default)).alias("verdict"), F.col(f"`{name}`").alias("number")))
