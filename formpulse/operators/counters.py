"""All per-period counters of both forms in one aggregate each, and the reports that follow from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formpulse import fixed_values as fv
from formpulse.functions.numbers import count_when, row_mean
from formpulse.functions.ratings import MEAN_DENOMINATOR
from formpulse.operators import ratings, satisfaction
from formpulse.operators.keys import CONSOLIDATION

BLOCKS = tuple(f"m_{b}" for b in fv.BLOCK_SIZES)


def form_counters(
    general: DataFrame, ambulatory: DataFrame, keys: Sequence[str] = CONSOLIDATION
) -> DataFrame:
    """One row per period, form and sector with everything the period reports count.

    ``n`` forms; per mean its sum in whole units and how many forms have it (``u_``, ``c_``); answers per
    rating (``r1``..``r4``); forms per rounded-up mean answer (``b1``..``b4``). All add up, so rows of
    several runs can be merged. Each form is scanned once, and partial aggregation leaves a row per task
    and group.
    """

    def counted(df: DataFrame, form: str, sector, means: Sequence[str], questions: Sequence[str]) -> DataFrame:
        rows = df.select(
            *keys, F.lit(form).alias("form"), sector.alias("setor"), *means,
            ratings.packed_ratings(questions).alias("__packed"),
            F.ceil(row_mean(questions)).cast("int").alias("__bucket"))
        units = {c: F.rint(F.col(c) * F.lit(float(MEAN_DENOMINATOR))).cast("long") for c in means}
        return rows.groupBy(*keys, "form", "setor").agg(
            F.count("*").alias("n"),
            *(F.sum(u).alias(f"u_{c}") for c, u in units.items()),
            *(F.count(c).alias(f"c_{c}") for c in means),
            *(F.sum(ratings.unpacked_rating("__packed", r)).alias(f"r{r}") for r in range(1, 5)),
            *(count_when(F.col("__bucket") == r).alias(f"b{r}") for r in range(1, 5)),
        )

    both = counted(general, ratings.GENERAL, ratings.informed_sector(F.col("setor")), BLOCKS, fv.QUESTIONS)
    other = counted(ambulatory, ratings.AMBULATORY, F.lit(fv.SECTOR_AMBULATORY), ("m",), fv.AMBULATORY_QUESTIONS)
    return both.unionByName(other, allowMissingColumns=True)


def counted_reports(
    counters: DataFrame, keys: Sequence[str] = CONSOLIDATION, *, complete: bool = False
) -> dict[str, DataFrame]:
    """The reports of measures, ratings, buckets, indicators and sectors from counters."""
    sides = (ratings.GENERAL, ratings.AMBULATORY)

    def total(name: str, form: str | None = None):
        value = F.col(name) if form is None else F.when(F.col("form") == form, F.col(name))
        return F.coalesce(F.sum(value), F.lit(0))

    def mean(name: str):
        return F.when(total(f"c_{name}") > 0, F.sum(f"u_{name}") / (F.sum(f"c_{name}") * F.lit(MEAN_DENOMINATOR)))

    def four_by_two(letter: str) -> DataFrame:
        return counters.groupBy(*keys).agg(
            *(total(f"{letter}{r}", form).alias(f"{form}{r}") for form in sides for r in range(1, 5)), total("n").alias("n"))

    means = counters.groupBy(*keys).agg(*(mean(c).alias(c) for c in (*BLOCKS, "m")))
    buckets = four_by_two("b")
    sectors = counters.select(*keys, "setor", "n")
    return {
        "medidas": satisfaction.measures_of_means(means, keys),
        "avaliacoes": ratings.distribution_of_counts(four_by_two("r"), keys, complete=complete),
        "histograma": ratings.histogram_of_counts(buckets, keys),
        "indicadores": ratings.indicator_of_counts(buckets, keys, complete=complete),
        "setores": ratings.sectors_of_counts(sectors, keys),
    }
