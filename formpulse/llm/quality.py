"""Quality rules: plain limits, and robust multivariate outliers per language and source.

Each text gives a vector of transformed statistics: log of the mean word length, and angles
(arcsine of the root) of the shares of symbols, capitals, repeated words and repeated lines. For each
model (a language and source; see ``models``) the minimum covariance determinant is sought: of all
subsets of h = (n + 6) / 2 documents, that whose covariance has the least determinant. Concentration
goes from one estimate to the mean and covariance of the h documents nearest to it, which never
raises the determinant. It starts from twelve centres a model: shortest-half centres, medians, and
each statistic at its lower and upper quartile. After two steps the three least determinants go on
until theirs no longer falls. The least is reweighted once: mean and covariance of the documents within
the 0.975 quantile of chi-square. Documents beyond the cut from that estimate are rejected.

Covariances of a subset are scaled to those of a normal sample, and constant floors are added to their
variances (a regularised determinant: most sources have no symbols and no repeats at all).

The statistics are whole multiples of 1/4096, so moments are exact integers and the result does not
depend on how the rows are spread. A step reads the narrow table of statistics once for all models and
starts: rows are summed by model, start and distance class; the nearest classes and the fitting
fraction of the next make up h documents.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, stored, table

UNIT = 4096
NAMES = ("word_length", "symbols", "capitals", "repeats", "lines")
D = len(NAMES)
#: Deviation below which a statistic is never held against a text, added to each estimate's
#: variances.
FLOORS = (0.08, 0.04, 0.08, 0.12, 0.15)
#: Starts of a model that go on after two steps.
BEST = 3
#: Steps at most. Ten or so are needed; the determinant of an estimate cut off here is still valid.
STEPS = 40
#: Rows that a model needs at least; sources with fewer are pooled. Where all that is left is still
#: fewer, the floors grow as the rows get fewer.
LEAST = 60
#: Distance classes of an octave of 1 + d2, and classes at most.
OCTAVE, CLASSES = 32, 1400
PAIRS = tuple(combinations_with_replacement(range(D), 2))
#: Quantiles that the starts are made of, and how many steps of them the shortest half spans: eleven
#: twentieths of a normal sample span 1.511 deviations.
TWENTIETHS, HALF, SPANNED = 20, 11, 1.511


def chi_square_tail(x: float, degrees: int) -> float:
    """The chance of more than ``x``; ``degrees`` is odd."""
    tail = math.erfc(math.sqrt(x / 2))
    for j in range((degrees - 1) // 2):
        tail += (x / 2) ** (j + 0.5) * math.exp(-x / 2) / math.gamma(j + 1.5)
    return tail


def chi_square_cut(tail: float, degrees: int = D) -> float:
    """The value that is exceeded with chance ``tail``."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_tail(middle, degrees) > tail else (low, middle)
    return (low + high) / 2


def shrunk(held: float) -> float:
    """The fraction of its variance that the inner ``held`` of a normal sample keeps."""
    return 1.0 if held >= 1 else (1 - chi_square_tail(chi_square_cut(1 - held), D + 2)) / held


#: ``shrunk`` at 0.50, 0.55, ... 1.00, between which it is taken as straight.
SHRUNK = tuple(shrunk(k / 20) for k in range(10, 21))
#: Rows within this squared distance make the reweighted estimate.
REWEIGHTED = 0.975
#: A normal document lies beyond the cut once in a thousand million.
TAIL = 1e-9
CUT = chi_square_cut(TAIL)


def statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals,
    n_lines (lines with a word), of whole texts; null text counts as none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(key, "lang", "source", text.alias("__text"))
    rows = rows.select(
        key, "lang", "source",
        F.filter(F.split("__text", SPACES), lambda w: w != "").alias("__words"),
        F.filter(F.split("__text", "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "").alias("__lines"),
        F.length(F.translate("__text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length("__text") - F.length(F.regexp_replace("__text", "\\p{Lu}", ""))).cast("long").alias("n_capitals"),
    )
    # Hashes of the windows of eight words; most texts have no two that are equal.
    hashed = F.transform("__words", lambda w: F.xxhash64(w))
    rows = rows.withColumn("__hashes", hashed)
    n = F.size("__hashes")
    windows = F.when(n >= 9, F.transform(
        F.sequence(F.lit(1), n - 7), lambda i: F.xxhash64(F.slice("__hashes", i, 8))))
    rows = rows.withColumn("__windows", windows)
    repeats = F.col("__windows").isNotNull() & (F.size(F.array_distinct("__windows")) < F.size("__windows"))
    # Windows sorted by (hash, place): equal ones are neighbours.
    ordered = F.when(repeats, F.sort_array(F.transform(
        "__windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    rows = rows.withColumn("__sorted", ordered)
    places = F.expr("""sort_array(transform(filter(
        transform(__sorted, (x, k) -> named_struct('i', x.i, 'twice',
            coalesce(x.w = get(__sorted, k - 1).w, false) OR coalesce(x.w = get(__sorted, k + 1).w, false))),
        y -> y.twice), y -> y.i))""")
    rows = rows.withColumn("__places", places)
    covered = F.expr("""aggregate(__places, named_struct('n', 0L, 'end', -1),
        (a, i) -> named_struct('n', a.n + (i + 8 - greatest(i, a.end)), 'end', i + 8), a -> a.n)""")
    return rows.select(
        key, "lang", "source", F.size("__words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_capitals",
        F.size("__lines").cast("long").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _angle(part: str, whole: str) -> Column:
    share = F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    return F.asin(F.sqrt(share))


def vector() -> list[Column]:
    """The transformed statistics in units of 1/4096, as x0 .. x4."""
    values = (
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        _angle("n_symbols", "word_chars"), _angle("n_capitals", "word_chars"),
        _angle("n_repeat_words", "n_words"), _angle("n_dup_lines", "n_lines"),
    )
    return [F.round(v * UNIT).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


def models(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """__lang, __source, model (a name): the source's own model where it has ``least`` rows that passed
    the limits, else that of its language's small sources, else that of all that are left."""
    passed = F.count(F.when(~F.col("base_failed"), 1))
    groups = rows.groupBy("lang", "source").agg(passed.alias("n"))
    by_lang = groups.withColumn("small", F.sum(F.when(F.col("n") < least, F.col("n"))).over(
        Window.partitionBy("lang")))
    own, pooled = F.col("n") >= least, F.col("small") >= least
    level = F.when(own, 2).when(pooled, 1).otherwise(0)
    name = F.struct(level.alias("level"), F.when(level >= 1, F.col("lang")).alias("lang"),
                    F.when(level == 2, F.col("source")).alias("source"))
    return by_lang.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.to_json(name).alias("model"))


def factors(estimates: DataFrame) -> DataFrame:
    """model, start, logdet, m_i (centre) and the cells l_i_j of the covariance's Cholesky factor.

    ``estimates`` has model, start, m_i and c_i_j. The cells are folded row by row into one array: columns
    that refer to each other would be a projection each, which every later step plans again.
    """
    cells = ", ".join(
        f"named_struct('own', {i * (i + 1) // 2 + 1}, 'other', {j * (j + 1) // 2 + 1}, 'j', {j}, 'c', cast(c_{j}_{i} AS double))"
        for i in range(D) for j in range(i + 1))
    rest = "aggregate(zip_with(slice(l, x.own, x.j), slice(l, x.other, x.j), (a, b) -> a * b), x.c, (r, v) -> r - v)"
    # The floors keep the matrix positive definite; rounding may take no more than this.
    cell = f"if(x.own = x.other, sqrt(greatest({rest}, 1e-9D)), {rest} / get(l, x.other + x.j - 1))"
    folded = f"aggregate(array({cells}), cast(array() AS array<double>), (l, x) -> array_append(l, {cell})) AS l"
    centre = [f"m_{i}" for i in range(D)]
    named = [f"get(l, {i * (i + 1) // 2 + j}) AS l_{i}_{j}" for i in range(D) for j in range(i + 1)]
    logdet = " + ".join(f"2 * ln(get(l, {i * (i + 1) // 2 + i}))" for i in range(D))
    return estimates.selectExpr("model", "start", *centre, folded).selectExpr(
        "model", "start", *centre, *named, f"{logdet} AS logdet")


def with_distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` once for each estimate of their model, with start and d2, the squared distance from it
    (both null without one)."""
    along = []
    for i in range(D):
        rest = " - ".join([f"x{i} / {UNIT} - m_{i}", *(f"l_{i}_{k} * y_{k}" for k in range(i))])
        along.append(f"({rest}) / l_{i}_{i} AS y_{i}")
    d2 = " + ".join(f"y_{i} * y_{i}" for i in range(D))
    columns = [f"`{c}`" for c in rows.columns]
    return rows.join(estimates, "model", "left").selectExpr(*columns, "start", *along, f"{d2} AS d2").selectExpr(
        *columns, "start", "d2")


def _starts(rows: DataFrame) -> DataFrame:
    """Twelve centres a model, all with the spread of the shortest halves; distinct values, which
    the quantiles count, are bounded by the unit."""
    at = F.array(*(F.lit(k / TWENTIETHS) for k in range(TWENTIETHS + 1)))
    found = rows.groupBy("model").agg(*(F.percentile(f"x{i}", at).alias(f"q_{i}") for i in range(D)))
    for i in range(D):
        # The shortest stretch of eleven twentieths; of equal ones the lowest.
        found = found.withColumn(f"h_{i}", F.expr(
            f"array_min(transform(sequence(0, {TWENTIETHS - HALF}), k -> named_struct("
            f"'width', q_{i}[k + {HALF}] - q_{i}[k], 'low', q_{i}[k])))"))
    shortest = [F.col(f"h_{i}.low") + F.col(f"h_{i}.width") / 2 for i in range(D)]
    quantile = lambda i, k: F.col(f"q_{i}")[k]
    centres = [shortest, [quantile(i, TWENTIETHS // 2) for i in range(D)]]
    centres += [[quantile(i, k) if i == j else shortest[i] for i in range(D)] for j in range(D) for k in (5, 15)]
    starts = F.explode(F.array(*(F.struct(
        F.lit(number).alias("start"), *((c / UNIT).alias(f"m_{i}") for i, c in enumerate(centre)))
        for number, centre in enumerate(centres))))
    spread = [F.col(f"h_{i}.width") / UNIT / SPANNED for i in range(D)]
    cells = [(spread[i] * spread[i] + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in PAIRS]
    return found.select("model", starts.alias("s"), *cells).select("model", "s.*", *(f"c_{i}_{j}" for i, j in PAIRS))


#: The sums an estimate is made of, by name.
SUMS = {"n": "1", **{f"s_{i}": f"x{i}" for i in range(D)}, **{f"p_{i}_{j}": f"x{i} * x{j}" for i, j in PAIRS}}


def _estimated(sums: DataFrame, kept_variance: str) -> DataFrame:
    """The estimates of summed subsets (``SUMS``, and the model's total of rows)."""
    wider = f"greatest(1D, {LEAST} / total)"
    cells = []
    for i, j in PAIRS:
        cell = f"(p_{i}_{j} / n / {UNIT} / {UNIT} - m_{i} * m_{j}) / ({kept_variance})"
        cells.append(f"{cell}{f' + {FLOORS[i] ** 2!r}D * {wider}' if i == j else ''} AS c_{i}_{j}")
    return factors(sums.selectExpr("model", "start", *(f"s_{i} / n / {UNIT} AS m_{i}" for i in range(D)), *cells))


def _concentrate(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """The estimate of the h rows nearest to each estimate."""
    near = F.expr(f"cast(least({CLASSES}, floor({OCTAVE} * log2(1 + d2))) AS int)")
    sums = with_distance(rows, estimates).where("start IS NOT NULL").groupBy("model", "start", near.alias("near")).agg(
        *(F.expr(f"sum({what}) AS {name}") for name, what in SUMS.items()))
    own = "(PARTITION BY model, start{})"
    before = own.format(" ORDER BY near ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    sums = sums.selectExpr("*", f"coalesce(sum(n) OVER {before}, 0) AS before", f"sum(n) OVER {own.format('')} AS total")
    sums = sums.selectExpr("*", f"least(total, floor((total + {D + 1}) / 2)) AS h").where("before < h")
    # Whole classes are summed as integers; one class at most counts in part.
    whole = "before + n <= h"
    chosen = sums.groupBy("model", "start").agg(F.expr("max(total) AS total"), F.expr("max(h) AS h"), *(
        F.expr(f"coalesce(sum(if({whole}, {c}, NULL)), 0) + coalesce(max(if({whole}, NULL, {c} * ((h - before) / n))), 0D) AS {c}")
        for c in SUMS))
    known = f"array({', '.join(f'{v!r}D' for v in SHRUNK)})"
    place = "((h / total - 0.5D) * 20)"
    step = f"cast(least(floor({place}), {len(SHRUNK) - 2}) AS int)"
    chosen = chosen.selectExpr("*", f"{known} AS known", f"{place} AS place", f"{step} AS step")
    return _estimated(chosen, "get(known, step) + (get(known, step + 1) - get(known, step)) * (place - step)")


def _reweighted(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """The estimate of all rows within the quantile of chi-square of each estimate."""
    near = f"d2 <= {chi_square_cut(1 - REWEIGHTED)!r}D"
    sums = with_distance(rows, estimates).groupBy("model", "start").agg(F.expr("count(*) AS total"), *(
        F.expr(f"sum(if({near}, {what}, NULL)) AS {name}") for name, what in SUMS.items()))
    return _estimated(sums.where("n > 0"), f"{shrunk(REWEIGHTED)!r}D")


def _least(estimates: DataFrame, kept: int) -> DataFrame:
    """The ``kept`` least determinants of each model; of equal ones the first starts."""
    order = Window.partitionBy("model").orderBy("logdet", "start")
    return estimates.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= kept).drop("__rank")


def least_determinant(rows: DataFrame, steps: int = STEPS, best: int = BEST) -> DataFrame:
    """The estimate of least determinant of each model of ``rows`` (model, x0 .. x4).

    Each written table is two steps on from the one before. The driver gets one number a table:
    whether any estimate still falls.
    """
    both = lambda estimates: _concentrate(rows, _concentrate(rows, estimates))
    estimates = stored(_least(both(factors(_starts(rows))), best).withColumn("fell", F.lit(True)), "estimates")
    columns = [c for c in estimates.columns if c != "fell"]
    for _ in range(0, steps, 2):
        after = both(estimates.where("fell").drop("fell"))
        after = after.select("model", "start", F.struct(*columns).alias("after"))
        joined = estimates.join(after, ["model", "start"], "left").withColumn(
            "falls", F.expr("coalesce(after.logdet < logdet - 1e-6D, false)"))
        estimates = stored(joined.selectExpr(
            *(f"if(falls, after.{c}, {c}) AS {c}" for c in columns), "falls AS fell"), "estimates")
        if estimates.where("fell").isEmpty():
            break
    return _least(estimates.drop("fell"), 1)


def judge(docs: DataFrame, key: str = "doc_id", cut: float = CUT, least: int = LEAST,
          steps: int = STEPS) -> DataFrame:
    """key, lang, source, the statistics, base_failed, model, d2 (null if base_failed), kept; one row
    per row.

    Null and empty texts have no words and fail the limits; null languages and sources are groups of
    their own; texts are read whole; repeated rows and ties count each. Sources with fewer than
    ``least`` rows are pooled by language, then all together; a last pool that is smaller still has
    wider floors instead of no verdict. An empty frame gives an empty frame. Other columns are not
    read.
    """
    rows = statistics(docs, key).withColumn("base_failed", base_failed())
    rows = stored(rows.select("*", *vector()), "statistics")
    named = models(rows, least)
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    fitted = stored(rows.join(named, same).drop("__lang", "__source"), "modelled")
    clean = fitted.where(~F.col("base_failed")).select("model", *(f"x{i}" for i in range(D)))
    estimates = stored(_reweighted(clean, least_determinant(clean, steps)), "reweighted")
    judged = with_distance(fitted, estimates)
    d2 = F.when(~F.col("base_failed"), F.col("d2"))
    return judged.select(
        key, "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_capitals", "n_lines", "base_failed", "model", d2.alias("d2"),
        (~F.col("base_failed") & (F.coalesce(d2, F.lit(0.0)) <= cut)).alias("kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", F.round("d2", 6).alias("d2"))
