"""Rating counts: per question, per period, as histograms of form means, and sector counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formpulse import fixed_values as fv
from formpulse.functions.literals import literal_array
from formpulse.functions.numbers import count_when, row_mean, share
from formpulse.operators.keys import CONSOLIDATION

GENERAL, AMBULATORY = "x", "y"


def rating_by_question(
    df: DataFrame, questions: Sequence[str] = fv.QUESTIONS, keys: Sequence[str] = CONSOLIDATION
) -> DataFrame:
    """Counts of the four ratings per question.

    A form becomes one row per ``GROUPED`` questions, and the four ratings of each are counted in
    place: partial aggregation leaves one row per task, period and group of questions, and sixteen
    counters still compile to a small loop where 28 x 4 would not. Question names replace the
    positions after the shuffle.
    """
    names = list(questions) + [None] * (-len(questions) % GROUPED)
    groups = [names[i:i + GROUPED] for i in range(0, len(names), GROUPED)]
    answers = F.array(*(F.struct(*(
        (F.lit(None).cast("int") if q is None else F.col(q)).alias(f"q{i}") for i, q in enumerate(group)
    )) for group in groups))
    rows = df.select(*keys, F.posexplode(answers).alias("group", "answers"))
    counts = rows.groupBy(*keys, "group").agg(
        *(count_when(F.col(f"answers.q{i}") == r).alias(f"n{i}{r}") for i in range(GROUPED) for r in range(1, 5)))
    each = F.array(*(F.struct(
        F.get(literal_array(questions), F.col("group") * GROUPED + i).alias("x"),
        *(F.col(f"n{i}{r}").alias(label) for r, label in enumerate(fv.RATING_LABELS, start=1))
    ) for i in range(GROUPED)))
    answered = sum((F.col(label) for label in fv.RATING_LABELS[1:]), F.col(fv.RATING_LABELS[0]))
    return counts.select(*keys, F.inline(each)).where(answered > 0)


#: Questions of a form that are counted in one row.
GROUPED = 4


# A form has at most 28 answers, so how often it gives each rating fits into eight bits.
_BITS = 8


def packed_ratings(questions: Sequence[str]) -> Column:
    """How often a form gives each of the four ratings, packed into one whole number."""
    if len(questions) >= 2**_BITS:
        raise ValueError(f"{len(questions)} answers do not fit into {_BITS} bits")
    return F.expr(" + ".join(
        f"coalesce(shiftleft(1L, {_BITS} * (`{q}` - 1)), 0L)" for q in questions
    ))


def unpacked_rating(packed: str, rating: int) -> Column:
    shifted = F.shiftright(F.col(packed), _BITS * (rating - 1))
    return shifted.bitwiseAND(F.lit(2**_BITS - 1))


def _packed_forms(
    keys: Sequence[str], general: DataFrame, ambulatory: DataFrame | None = None
) -> DataFrame:
    """One row per form with its packed counts; counting answers needs no exploded rows."""
    forms = general.select(*keys, packed_ratings(fv.QUESTIONS).alias(GENERAL))
    if ambulatory is None:
        return forms
    others = ambulatory.select(*keys, packed_ratings(fv.AMBULATORY_QUESTIONS).alias(AMBULATORY))
    return forms.unionByName(others, allowMissingColumns=True).fillna(0, [GENERAL, AMBULATORY])


def _bucket(df: DataFrame, questions: Sequence[str], keys: Sequence[str], form: str) -> DataFrame:
    mean = row_mean(questions)
    return df.select(*keys, F.ceil(mean).cast("int").alias("rating"), F.lit(form).alias("form"))


def _both_forms(general: DataFrame, ambulatory: DataFrame, keys: Sequence[str], side) -> DataFrame:
    return side(general, fv.QUESTIONS, keys, GENERAL).unionByName(
        side(ambulatory, fv.AMBULATORY_QUESTIONS, keys, AMBULATORY)
    )


def _four_by_two(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per period with counters ``x1``..``x4`` and ``y1``..``y4``, in one shuffle."""
    return rows.groupBy(*keys).agg(
        *(
            count_when((F.col("form") == form) & (F.col("rating") == r)).alias(f"{form}{r}")
            for form in (GENERAL, AMBULATORY)
            for r in range(1, 5)
        )
    )


def _kept(complete: bool) -> dict[int, Column]:
    """Ratings that survive: those both forms have, or all with ``complete``."""
    return {
        r: F.lit(True) if complete else (F.col(f"x{r}") > 0) & (F.col(f"y{r}") > 0)
        for r in range(1, 5)
    }


def rating_distribution(
    general: DataFrame, ambulatory: DataFrame, keys: Sequence[str] = CONSOLIDATION, *,
    complete: bool = False,
) -> DataFrame:
    """Answers per rating of each form, of both, and their percents, per period.

    Parity keeps only ratings that both forms have in the period; ``complete`` keeps all four with
    zeros. The four ratings of a period sit in one row until the end, so neither the merge of the
    forms nor the shares need a join or a window.
    """
    wide = _packed_forms(keys, general, ambulatory).groupBy(*keys).agg(
        *(F.sum(unpacked_rating(form, r)).alias(f"{form}{r}")
          for form in (GENERAL, AMBULATORY) for r in range(1, 5))
    )
    return distribution_of_counts(wide, keys, complete=complete)


def distribution_of_counts(wide: DataFrame, keys: Sequence[str], *, complete: bool = False) -> DataFrame:
    """The distribution from a row per period with answers ``x1``..``x4`` and ``y1``..``y4``."""
    kept = _kept(complete)
    totals = {
        form: sum((F.when(kept[r], F.col(f"{form}{r}")).otherwise(0) for r in range(2, 5)),
                  F.when(kept[1], F.col(f"{form}1")).otherwise(0))
        for form in (GENERAL, AMBULATORY)
    }
    wide = wide.withColumns({f"__{form}": total for form, total in totals.items()})
    rows = F.array(
        *(
            F.struct(
                kept[r].alias("kept"),
                F.lit(label).alias("avaliacao"),
                F.col(f"x{r}").alias("freq_x"),
                F.col(f"y{r}").alias("freq_y"),
            )
            for r, label in enumerate(fv.RATING_LABELS, start=1)
        )
    )
    long = wide.select(*keys, "__x", "__y", F.inline(rows)).where("kept")
    freq = F.col("freq_x") + F.col("freq_y")
    return long.select(
        *keys,
        "avaliacao",
        "freq_x",
        "freq_y",
        (share(F.col("freq_x"), F.col("__x")) * 100).alias("fr_x"),
        (share(F.col("freq_y"), F.col("__y")) * 100).alias("fr_y"),
        freq.alias("freq"),
        (share(freq, F.col("__x") + F.col("__y")) * 100).alias("fr"),
    )


def merge_rating_totals(
    general: DataFrame, ambulatory: DataFrame, keys: Sequence[str] = CONSOLIDATION, *,
    complete: bool = False,
) -> DataFrame:
    """The merged totals per rating without percents."""
    merged = rating_distribution(general, ambulatory, keys, complete=complete)
    return merged.select(*keys, "avaliacao", "freq_x", "freq_y")


def rating_distribution_general(
    general: DataFrame, keys: Sequence[str] = CONSOLIDATION
) -> DataFrame:
    """The older rule: totals and percents of the general form alone."""
    wide = _packed_forms(keys, general).groupBy(*keys).agg(
        *(F.sum(unpacked_rating(GENERAL, r)).alias(f"x{r}") for r in range(1, 5))
    )
    wide = wide.withColumn("__x", F.expr("x1 + x2 + x3 + x4"))
    rows = F.array(
        *(F.struct(F.lit(label).alias("avaliacao"), F.col(f"x{r}").alias("freq"))
          for r, label in enumerate(fv.RATING_LABELS, start=1))
    )
    long = wide.select(*keys, "__x", F.inline(rows)).where(F.col("freq") > 0)
    return long.select(
        *keys, "avaliacao", "freq", (share(F.col("freq"), F.col("__x")) * 100).alias("fr")
    )


def mean_rating_histogram(
    general: DataFrame, ambulatory: DataFrame, keys: Sequence[str] = CONSOLIDATION
) -> DataFrame:
    """Forms per rounded-up mean answer (1..4), per form and period."""
    wide = _four_by_two(_both_forms(general, ambulatory, keys, _bucket), keys)
    return histogram_of_counts(wide, keys)


def histogram_of_counts(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The histogram from a row per period with forms ``x1``..``x4`` and ``y1``..``y4``."""
    names = {GENERAL: "general", AMBULATORY: "ambulatory"}
    rows = F.array(
        *(
            F.struct(F.lit(name).alias("form"), F.lit(r).alias("bucket"),
                     F.col(f"{form}{r}").alias("n"))
            for form, name in names.items()
            for r in range(1, 5)
        )
    )
    return wide.select(*keys, F.inline(rows)).where(F.col("n") > 0)


def merge_mean_buckets(
    general: DataFrame, ambulatory: DataFrame, keys: Sequence[str] = CONSOLIDATION, *,
    complete: bool = False,
) -> DataFrame:
    """Histogram buckets of both forms side by side; see ``rating_distribution`` for parity."""
    wide = _four_by_two(_both_forms(general, ambulatory, keys, _bucket), keys)
    kept = _kept(complete)
    rows = F.array(
        *(
            F.struct(kept[r].alias("kept"), F.lit(r).alias("bucket"),
                     F.col(f"x{r}").alias("value_x"), F.col(f"y{r}").alias("value_y"))
            for r in range(1, 5)
        )
    )
    long = wide.select(*keys, F.inline(rows)).where("kept").drop("kept")
    return long.withColumn("total", F.col("value_x") + F.col("value_y"))


def good_or_excellent_indicator(
    general: DataFrame, ambulatory: DataFrame, keys: Sequence[str] = CONSOLIDATION, *,
    complete: bool = False,
) -> DataFrame:
    """Two indicators per period: forms whose mean answer is above 2, and forms in all."""
    buckets = _both_forms(general, ambulatory, keys, _bucket)
    wide = buckets.groupBy(*keys).agg(
        *(
            count_when((F.col("form") == form) & (F.col("rating") == r)).alias(f"{form}{r}")
            for form in (GENERAL, AMBULATORY)
            for r in (3, 4)
        ),
        F.count("*").alias("n"),
    )
    return indicator_of_counts(wide, keys, complete=complete)


def indicator_of_counts(wide: DataFrame, keys: Sequence[str], *, complete: bool = False) -> DataFrame:
    """The indicators from a row per period with ``x3``, ``x4``, ``y3``, ``y4`` and all forms ``n``."""
    kept = _kept(complete)
    good = sum(
        (F.when(kept[r], F.col(f"x{r}") + F.col(f"y{r}")).otherwise(0) for r in (4,)),
        F.when(kept[3], F.col("x3") + F.col("y3")).otherwise(0),
    )
    rows = F.array(
        *(
            F.struct(F.lit(i).alias("ordinal"), F.lit(label).alias("indicador"),
                     value.alias("resultado"))
            for i, (label, value) in enumerate(
                zip(fv.INDICATOR_LABELS, (good, F.col("n")), strict=True), start=1)
        )
    )
    return wide.select(*keys, F.inline(rows))


def informed_sector(sector: Column) -> Column:
    """The sector, or one common label where it is blank or missing."""
    return F.coalesce(F.nullif(sector, F.lit("")), F.lit(fv.SECTOR_NOT_INFORMED))


def sector_form_counts(
    general: DataFrame, ambulatory: DataFrame, keys: Sequence[str] = CONSOLIDATION
) -> DataFrame:
    """Forms per sector and period; ambulatory forms count for the ambulatory sector.

    Every period has an ambulatory row, with 0 if need be; those rows are added to the counts, not to
    the forms, and no task gathers a period's sectors.
    """
    n = F.lit(1).cast("long").alias("n")
    rows = general.select(*keys, informed_sector(F.col("setor")).alias("setor"), n).unionByName(
        ambulatory.select(*keys, F.lit(fv.SECTOR_AMBULATORY).alias("setor"), n))
    return sectors_of_counts(rows, keys)


def sectors_of_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Forms per sector from rows that stand for ``n`` forms each."""
    counts = rows.groupBy(*keys, "setor").agg(F.sum("n").alias("qtde"))
    zeros = counts.select(*keys, F.lit(fv.SECTOR_AMBULATORY).alias("setor"), F.lit(0).cast("long").alias("qtde"))
    return counts.unionAll(zeros.distinct()).groupBy(*keys, "setor").agg(F.sum("qtde").alias("qtde"))
