"""Cleaning rules for raw lead values.

Each rule is written once as a Spark SQL expression generator (``*_sql``, taking a
SQL expression such as a quoted column name); the Column helpers wrap it with
``F.expr``, and the DataFrame steps apply many at once through ``selectExpr``.
All of it stays in the JVM: no Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from propensity.constants import CSV_NA_TOKENS

# Whitespace that str.strip() removes: ASCII controls \t..\r, \x1c-\x1f, NEL and
# every Unicode separator.  The same class works in Java regex and RE2.
WS_CLASS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"
STRIP_PATTERN = f"^{WS_CLASS}+|{WS_CLASS}+$"
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INF_PATTERN = r"^(?i)[+-]?(inf|infinity)$"


def quote(name: str) -> str:
    """A column name as a SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def sql_string(value: str) -> str:
    """A Spark SQL string literal holding exactly ``value`` (backslashes kept)."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_TOKENS = ", ".join(sql_string(t) for t in CSV_NA_TOKENS)


def na_token_sql(e: str) -> str:
    return f"CASE WHEN {e} IN ({_TOKENS}) THEN NULL ELSE {e} END"


# The same set as WS_CLASS, listed: \t \n \v \f \r, U+001C-U+001F, space, U+0085, and the
# Unicode separators U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
_WS_LITERAL = "'" + "".join(f"\\u{ord(c):04X}" for c in WS_CHARS) + "'"


def strip_sql(e: str) -> str:
    """Both-ends trim of the whitespace set (a character-set trim, no regex)."""
    return f"btrim({e}, {_WS_LITERAL})"


def placeholder_sql(e: str) -> str:
    return stripped_placeholder_sql(strip_sql(e))


def stripped_placeholder_sql(s: str) -> str:
    """The placeholder rule on an already stripped value."""
    return f"CASE WHEN lower({s}) = 'select' OR {s} = '' THEN NULL ELSE {s} END"


def yes_no_sql(e: str) -> str:
    return f"coalesce({e} = 'Yes', false)"


def number_sql(e: str) -> str:
    return (f"CASE WHEN regexp_like({e}, {sql_string(NUMBER_PATTERN)}) THEN try_cast({e} AS DOUBLE) "
            f"WHEN regexp_like({e}, {sql_string(INF_PATTERN)}) "
            f"THEN CASE WHEN startswith({e}, '-') THEN double('-inf') ELSE double('inf') END END")


def flag_sql(e: str) -> str:
    n = number_sql(e)
    return f"CASE WHEN ({n}) = 1.0 THEN true WHEN ({n}) = 0.0 THEN false END"


def nan_sql(e: str) -> str:
    return f"CASE WHEN isnan({e}) THEN NULL ELSE {e} END"


def non_blank_sql(e: str) -> str:
    return f"coalesce({e} IS NOT NULL AND {strip_sql(e)} <> '', false)"


def _col(name: str, rule) -> Column:
    return F.expr(rule(quote(name)))


def na_token_to_null(col: str) -> Column:
    """CSV reader semantics: the default missing-value tokens become NULL (exact match)."""
    return _col(col, na_token_sql)


def strip(col: str) -> Column:
    """Remove leading/trailing Unicode whitespace (tabs and newlines too)."""
    return _col(col, strip_sql)


def placeholder_to_null(col: str) -> Column:
    """Strip, then ``select`` in any case or the empty string -> NULL."""
    return _col(col, placeholder_sql)


def yes_no_to_bool(col: str) -> Column:
    """``Yes`` -> true, anything else (``No``, other text, NULL) -> false; case-sensitive."""
    return _col(col, yes_no_sql)


def to_number(col: str) -> Column:
    """Numeric text -> double; anything unparseable -> NULL (``'5d'`` included,
    which a bare cast would accept)."""
    return _col(col, number_sql)


def flag_to_bool(col: str) -> Column:
    """1 / 1.0 -> true, 0 / 0.0 -> false, anything else or NULL -> NULL."""
    return _col(col, flag_sql)


def nan_to_null(col: str) -> Column:
    return _col(col, nan_sql)


def non_blank(col: str) -> Column:
    """Null-safe "present and not blank after stripping" (never NULL itself)."""
    return _col(col, non_blank_sql)
