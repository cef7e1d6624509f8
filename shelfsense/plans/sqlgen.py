"""DuckDB SQL fragments shared by the oracles (generated from the same constants
the Spark operators use, so both sides read one definition)."""

from __future__ import annotations

from ..functions import lexicons as L
from ..functions.text import PUNCT


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def clean_sql(expr: str) -> str:
    """Same as functions.text.clean_text defaults: lower, drop punctuation, squeeze spaces, strip."""
    return strip_sql(f"regexp_replace(translate(lower({expr}), {q(PUNCT)}, ''), '\\s+', ' ', 'g')")


def valence_case_sql(tok: str, valence=L.VALENCE) -> str:
    whens = " ".join(f"WHEN {q(w)} THEN {float(v)!r}" for w, v in valence)
    return f"CASE {tok} {whens} ELSE 0.0 END"


def contains_count_sql(text: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {q(t)}) AS INTEGER)" for t in terms) + ")"


def md5_mod_sql(expr: str, modulus: int) -> str:
    """int(md5(expr), 16) % modulus from the two hex halves (same as functions.text.md5_mod)."""
    h = f"md5({expr})"
    hi = f"CAST(CAST(('0x' || substr({h}, 1, 16)) AS UBIGINT) AS HUGEINT)"
    lo = f"CAST(CAST(('0x' || substr({h}, 17, 16)) AS UBIGINT) AS HUGEINT)"
    two64 = (1 << 64) % modulus
    return f"CAST((({hi} % {modulus}) * {two64} + {lo} % {modulus}) % {modulus} AS BIGINT)"
