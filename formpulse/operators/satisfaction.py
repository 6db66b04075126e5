"""Satisfaction measures: block means per period, composites and reception reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formpulse import fixed_values as fv
from formpulse.functions import dates, nps
from formpulse.functions.numbers import (
    count_when,
    exact_mean,
    half_even,
    percent_label,
    row_mean,
)
from formpulse.functions.ratings import MEAN_DENOMINATOR, likert_fifths, likert_score
from formpulse.operators.keys import CONSOLIDATION
from formpulse.operators.reshape import dcast, share_of_total

# A composite is a sum of fifths over 1..13 answers: a multiple of 1/(5 * lcm(1..13)).
COMPOSITE_DENOMINATOR = 5 * 360_360


def measure_summary(
    general: DataFrame, ambulatory: DataFrame, keys: Sequence[str] = CONSOLIDATION
) -> DataFrame:
    """Ten satisfaction measures in percent per period, in long form.

    Eight block means, the ambulatory mean and their unweighted mean, each times 25. The two forms
    meet in one aggregate instead of a join, so a period known to one form only is kept.
    """
    blocks = [f"m_{b}" for b in fv.BLOCK_SIZES]
    both = general.select(*keys, *blocks).unionByName(
        ambulatory.select(*keys, "m"), allowMissingColumns=True
    )
    means = both.groupBy(*keys).agg(
        *(exact_mean(F.col(c), MEAN_DENOMINATOR).alias(c) for c in (*blocks, "m"))
    )
    return measures_of_means(means, keys)


def measures_of_means(means: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The measures from the means of a period, in one row."""
    blocks = [f"m_{b}" for b in fv.BLOCK_SIZES]
    means = means.select(*keys, *((F.col(c) * 100 / 4).alias(c) for c in (*blocks, "m")))
    values = [*(F.col(c) for c in (*blocks, "m")), row_mean([*blocks, "m"])]
    measures = F.array(
        *(
            F.struct(F.lit(i).alias("medida_ordinal"), F.lit(label).alias("medida"),
                     value.alias("percentual"))
            for i, (label, value) in enumerate(
                zip(fv.MEASURE_LABELS, values, strict=True), start=1)
        )
    )
    return means.select(*keys, F.inline(measures)).withColumn("meta", F.lit(fv.MEASURE_TARGET))


def _consolidation_period(df: DataFrame) -> tuple[Column, Column]:
    return F.col("ano_consolidacao").try_cast("int"), F.col("mes_consolidacao")


def composite_satisfaction(
    raw_general: DataFrame, questions: Sequence[str | None] = fv.COMPOSITE_QUESTIONS
) -> DataFrame:
    """Thirteen scores of each general form, their sum, answered count, composite and band.

    Takes raw answer texts. A position without a question scores 0. A missing answer makes the sum
    and the composite missing; an answer that scores 0 counts as not answered.
    """
    names = [f"S{i:02d}" for i in range(1, len(questions) + 1)]
    # Whole fifths are added and divided once, so the sum is exact.
    fifths = [F.lit(0) if q is None else likert_fifths(q) for q in questions]
    year, month = _consolidation_period(raw_general)
    scored = raw_general.select(
        *(c for c in raw_general.columns if c not in fv.LAYOUTS["general46"]),
        dates.period_from_parts(year, month).alias("PERIODO"),
        *(f.alias(f"__{n}") for n, f in zip(names, fifths, strict=True)),
    )
    whole = [F.col(f"__{n}") for n in names]
    total = sum(whole[1:], whole[0])
    answered = sum(((w > 0).cast("int") for w in whole[1:]), (whole[0] > 0).cast("int"))
    out = scored.select(
        *(c for c in scored.columns if not c.startswith("__S")),
        *((w / F.lit(5.0)).alias(n) for n, w in zip(names, whole, strict=True)),
        total.alias("__total"),
        answered.alias("QTD_RESP"),
    )
    satisfaction = F.when(F.col("QTD_RESP") > 0, F.col("__total") / (F.col("QTD_RESP") * 5.0)).when(
        F.col("QTD_RESP") == 0, 0.0
    )
    out = out.withColumns({"SGERAL": F.col("__total") / 5.0, "SATISFACAO": satisfaction})
    return out.withColumn("S", nps.satisfaction_band(F.col("SATISFACAO"))).drop("__total")


def satisfaction_by_period(
    composite: DataFrame, keys: Sequence[str] = ("PERIODO",), *, strict_nulls: bool = False,
    approx_accuracy: int | None = None,
) -> DataFrame:
    """Forms, sum, mean and median of the composite per period.

    With ``approx_accuracy`` the median is a value of the period whose rank is off by no more than
    ``n / approx_accuracy`` of its n answered forms: each task keeps a sketch of that many entries a
    period and sketches are merged, so that composites of any number of different values, which the
    exact way would count one by one, take one row per task and period. It is the lower of two middle
    values where the exact median is their mean.

    Missing composites are ignored, or with ``strict_nulls`` make the whole period missing. Forms
    are first counted per value, by a plain hash aggregate: composites take a few hundred values at
    most, so the statistics of a period, its exact median among them, come from few rows.
    """
    if approx_accuracy is not None:
        return _sketched_satisfaction(composite, keys, strict_nulls, approx_accuracy)
    counts = composite.groupBy(*keys, "SATISFACAO").agg(F.count("*").alias("__n"))
    value, n = F.col("SATISFACAO"), F.col("__n")
    answered = F.sum(F.when(value.isNotNull(), n))
    units = F.sum(F.rint(value * F.lit(float(COMPOSITE_DENOMINATOR))).cast("long") * n)
    stats = {
        "TOTAL_SATISFACAO": units / F.lit(float(COMPOSITE_DENOMINATOR)),
        "MEDIA": units / (answered * F.lit(COMPOSITE_DENOMINATOR)),
        "MEDIANA": F.percentile(value, F.lit(0.5), n),
    }
    if strict_nulls:
        whole = F.coalesce(answered, F.lit(0)) == F.sum(n)
        stats = {name: F.when(whole, stat) for name, stat in stats.items()}
    return counts.groupBy(*keys).agg(
        F.sum(n).alias("QTDE"), *(stat.alias(name) for name, stat in stats.items())
    )


def _sketched_satisfaction(
    composite: DataFrame, keys: Sequence[str], strict_nulls: bool, accuracy: int
) -> DataFrame:
    value = F.col("SATISFACAO")
    units = F.sum(F.rint(value * F.lit(float(COMPOSITE_DENOMINATOR))).cast("long"))
    stats = {
        "TOTAL_SATISFACAO": units / F.lit(float(COMPOSITE_DENOMINATOR)),
        "MEDIA": units / (F.count(value) * F.lit(COMPOSITE_DENOMINATOR)),
        "MEDIANA": F.percentile_approx(value, 0.5, accuracy),
    }
    if strict_nulls:
        stats = {name: F.when(F.count(value) == F.count("*"), stat) for name, stat in stats.items()}
    stats["MEDIA"] = F.when(F.count(value) > 0, stats["MEDIA"])
    return composite.groupBy(*keys).agg(
        F.count("*").alias("QTDE"), *(stat.alias(name) for name, stat in stats.items()))


def satisfaction_table_for_year(
    composite: DataFrame, year: int, keys: Sequence[str] = ()
) -> DataFrame:
    """The period table of one year with labels such as ``Jan/2019``."""
    first, after = F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(
        F.lit(year + 1), F.lit(1), F.lit(1))
    chosen = composite.where((F.col("PERIODO") >= first) & (F.col("PERIODO") < after))
    return satisfaction_by_period(chosen, (*keys, "PERIODO")).withColumn(
        "PERIODO", dates.period_label(F.col("PERIODO"))
    )


def ambulatory_satisfaction(
    raw_ambulatory: DataFrame, min_year: int | None = 2019, keys: Sequence[str] = ()
) -> DataFrame:
    """Reception, doctor and joint score of each ambulatory form, with a sign for the NPS answer.

    The joint score is the mean of both if both count, else the one that counts, else 0; it is
    missing where an answer is missing before that is decided. A missing NPS counts as neutral.
    """
    year, month = _consolidation_period(raw_ambulatory)
    reception, doctor = likert_fifths("recepcao"), likert_fifths("medico")
    scored = raw_ambulatory.select(
        *keys,
        year.alias("ANO"),
        F.when(dates.month_ordinal(month).isNotNull(), month).alias("MES"),
        F.col("id").try_cast("bigint").alias("ID"),
        F.col("atendente").alias("ATENDENTE"),
        reception.alias("__r"),
        doctor.alias("__m"),
        nps.nps_sign(F.col("nps").try_cast("int"), null_score="neutral").alias("NPS"),
    )
    if min_year is not None:
        scored = scored.where(F.col("ANO") >= min_year)
    r, m = F.col("__r"), F.col("__m")
    both = (r > 0) & (m > 0)
    joint = (
        F.when(both.isNull(), F.lit(None))
        .when(both, (r + m) / 10.0)
        .when(r.isNull(), F.lit(None))
        .when(r > 0, r / 5.0)
        .when(m.isNull(), F.lit(None))
        .when(m > 0, m / 5.0)
        .otherwise(0.0)
    )
    return scored.select(
        *keys, "ANO", "MES", "ID", "ATENDENTE",
        (r / 5.0).alias("RECEPCAO"), (m / 5.0).alias("MEDICO"), joint.alias("SATISFACAO"), "NPS",
    )


def reception_frequency(
    raw_ambulatory: DataFrame, min_year: int = 2019, question: str = "recepcao",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Score of the reception answers per month: answers, good ones, total, frequency and loss."""
    year, month = _consolidation_period(raw_ambulatory)
    fifths = likert_fifths(question)
    answers = raw_ambulatory.select(
        *keys,
        year.alias("ANO"),
        F.when(dates.month_ordinal(month).isNotNull(), month).alias("MES"),
        F.col(question).alias("NOTA"),
        fifths.alias("__fifths"),
    ).where((F.col("ANO") >= min_year) & F.col("NOTA").isNotNull() & (F.col("__fifths") > 0))
    counts = answers.groupBy(*keys, "ANO", "MES").agg(
        F.count("*").alias("N_RESPOSTAS"),
        count_when(F.col("NOTA").isin(*fv.GOOD_ANSWERS)).alias("BOM_OTIMO"),
        (F.sum("__fifths") / 5.0).alias("SCORE_TOTAL"),
    )
    frequency = half_even(F.col("SCORE_TOTAL") / F.col("N_RESPOSTAS") * 100, 1)
    return (
        counts.withColumn("FREQ", frequency)
        .withColumn("PERDA", F.lit(100.0) - F.col("FREQ"))
        .withColumn("PROP", percent_label(F.col("FREQ"), 1))
        .withColumn("PERIODO", F.concat(F.col("ANO").cast("string"), F.lit("/"), "MES"))
    )


def reception_share(frequency: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Frequency and loss in long form as shares of their sum (two rows per period)."""
    period = [*keys, "ANO", "MES", "PERIODO"]
    long = frequency.unpivot(period, ["PERDA", "FREQ"], "variable", "value")
    return share_of_total(long, "value", period, "share", scale=1.0)


def score_distribution_for_year(
    raw_general: DataFrame, year: int, question: str = fv.SAFETY_QUESTION,
    keys: Sequence[str] = (),
) -> DataFrame:
    """How often each score was given to a question in a year; missing answers are one group."""
    chosen = raw_general.where(F.col("ano_consolidacao").try_cast("int") == year)
    return chosen.groupBy(*keys, likert_score(question).alias("score")).agg(
        F.count("*").alias("n")
    )


def month_answer_crosstab(
    raw_general: DataFrame, year: int, question: str = fv.SAFETY_QUESTION,
    keys: Sequence[str] = (), others: str | None = None,
) -> DataFrame:
    """Month by answer text counts of a year; missing answers and months are left out.

    The columns are the known answers; ``others`` names a column that counts all other texts.
    """
    chosen = raw_general.where(
        (F.col("ano_consolidacao").try_cast("int") == year)
        & F.col("mes_consolidacao").isNotNull()
        & F.col(question).isNotNull()
    )
    columns = list(fv.RECEPTION_ANSWERS)
    if others is not None:
        known = F.col(question).isin(columns)
        chosen = chosen.withColumn(question, F.when(known, F.col(question)).otherwise(F.lit(others)))
        columns.append(others)
    return dcast(chosen, [*keys, "mes_consolidacao"], question, columns)


def answer_frequency(raw: DataFrame, question: str, keys: Sequence[str] = ()) -> DataFrame:
    """How often each answer text was given; missing answers are left out."""
    answers = raw.where(F.col(question).isNotNull())
    return answers.groupBy(*keys, F.col(question).alias("resposta")).agg(F.count("*").alias("n"))


def distinct_answers(raw: DataFrame, question: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct answer texts of a question with their scores."""
    answers = raw.select(*keys, F.col(question).alias("resposta")).distinct()
    return answers.withColumn("score", likert_score("resposta"))
