"""Expressions on log text.

Expressions are built as SQL text: one call into the JVM per expression instead of one per node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: placeholder patterns, applied in this order to lower-cased text
PLACEHOLDERS = (
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>"),
    (r"\b0x[0-9a-f]+\b", "<hex>"),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<guid>"),
    (r"\b\d+\b", "<num>"),
    (r"\s+", " "),
)
# fixed values: words that make a rare message suspicious
SUSPICIOUS_WORDS = ("error", "fail", "timeout", "panic", "denied", "refused", "critical")


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def signature(column: str = "message") -> Column:
    """Message with its variable parts replaced, so that repeats of one message compare equal."""
    text = f"lower({column})"
    for pattern, placeholder in PLACEHOLDERS:
        # (?U): letters of any alphabet are word characters
        text = f"regexp_replace({text}, {quoted('(?U)' + pattern)}, {quoted(placeholder)})"
    return F.expr(f"trim({text})")


def cluster_id(source: str = "source", sig: str = "signature") -> Column:
    """Short stable name of a (source, signature) pair."""
    letters = f"substring(regexp_replace(lower({source}), '[^a-z0-9]', ''), 1, 6)"
    digest = f"substring(sha1(concat({source}, '|', {sig})), 1, 8)"
    return F.expr(f"concat('cl-', coalesce(nullif({letters}, ''), 'src'), '-', {digest})")


def any_word(text: str, words: Sequence[str]) -> str:
    """SQL condition: the text holds at least one of the words."""
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")" if words else "false"


def severity_from(text: str, warning: Sequence[str] = (), critical: Sequence[str] = ()) -> Column:
    """Severity by keywords of lower-cased text; a critical keyword wins over a warning one."""
    return F.expr(
        f"CASE WHEN {any_word(text, critical)} THEN 'critical' "
        f"WHEN {any_word(text, warning)} THEN 'warning' ELSE 'info' END"
    )


def severity_rank(column: str = "severity") -> Column:
    return F.expr(f"CASE {column} WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END")


# what (?U)\s matches
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def share(part: str, whole: str, digits: int = 3) -> Column:
    """part / whole, rounded; 0.0 when there is nothing to divide by."""
    return F.expr(f"CASE WHEN {whole} > 0 THEN round({part} / {whole}, {digits}) ELSE 0.0D END")
