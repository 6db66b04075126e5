"""The two answer scales (ordinal 1..4 and score 0..1) and the per-form means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formpulse import fixed_values as fv
from formpulse.functions.literals import literal_array, map_sql, sql_literal
from formpulse.functions.numbers import row_mean

# A block holds 2..7 answers, so its mean is a multiple of 1/420; see numbers.exact_mean.
MEAN_DENOMINATOR = 420


_WORDS = {word: i for i, word in enumerate(fv.RATING_WORDS, start=1)}
_RATED = {a: _WORDS[w] for a, w in fv.USUAL_ANSWERS.items() if w in _WORDS}
_UNRATED = [a for a, w in fv.USUAL_ANSWERS.items() if w not in _WORDS]
_FIFTHS = {answer: i for i, answer in enumerate(fv.LIKERT_ANSWERS, start=1)}


# The answer scales take column names and build one SQL expression each: a form has 28 answers, and
# composing them call by call would take the driver longer than running a small report.


def likert_ordinal(name: str) -> Column:
    """1..4 from an answer column, ignoring case and accents; any other text is null.

    Texts are compared by Unicode's rules without case and accents, so that a letter with its mark in
    one character and one followed by a combining mark are the same. Forms offer fixed answers, so the
    usual spellings are looked up as they are; only other texts pay for that comparison.
    """
    unrated = ", ".join(map(sql_literal, _UNRATED))
    folded = f"collate(`{name}`, 'UNICODE_CI_AI')"
    words = " ".join(f"WHEN {folded} = {sql_literal(w)} THEN {i}" for w, i in _WORDS.items())
    return F.expr(
        f"CASE WHEN `{name}` NOT IN ({unrated}) THEN "
        f"coalesce(element_at({map_sql(_RATED)}, `{name}`), CASE {words} END) END"
    )


def likert_fifths(name: str) -> Column:
    """0..5 from the exact answer text of a column: 0 for any other text, null for null."""
    return F.expr(
        f"CASE WHEN `{name}` IS NOT NULL THEN "
        f"coalesce(element_at({map_sql(_FIFTHS)}, `{name}`), 0) END"
    )


def likert_score(name: str) -> Column:
    """0.2, 0.4 .. 1.0 from the exact answer text: 0 for any other text, null for null."""
    return likert_fifths(name) / F.lit(5.0)


def rating_label(x: Column, other: str | None = None) -> Column:
    """Label of an ordinal rating; ``other`` names everything outside 1..4."""
    label = F.when(x.between(1, 4), F.get(literal_array(fv.RATING_LABELS), x - 1))
    return label if other is None else F.coalesce(label, F.lit(other))


def block_means() -> dict[str, Column]:
    """``m_a`` .. ``m_h``: mean of the answered questions of each block of the general form."""
    return {
        f"m_{block}": row_mean([f"{block}_{i}" for i in range(1, size + 1)])
        for block, size in fv.BLOCK_SIZES.items()
    }


def mean_of_means() -> Column:
    """Mean of the block means of a form (not of its answers)."""
    return row_mean([f"m_{block}" for block in fv.BLOCK_SIZES])
