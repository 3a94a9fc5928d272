"""Quality rules: per-language, per-source robust outliers by the minimum covariance determinant.

Only DataFrame functions. Texts are reduced to five counts, the counts to five transformed statistics.
In each group the half of the rows with the least determinant of its covariance is sought by concentration steps
from three deterministic starts: the half of the rows nearest by the current mean and covariance gives the next ones.
The start with the least determinant after two steps goes on until no step lessens it, and the rows that are
near by this half give the final mean and covariance. A step is an aggregation by group and distance bin, 32 for
each doubling of the distance, and one of the rows in the bin where the half ends, by 4,096 finer ones; so it moves a
few thousand small rows whatever the size of a group. Distances are scaled down where their median exceeds that of the
chi-square distribution.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, materialize

#: 0.5, 0.975 and 1 - 1e-7 quantiles of the chi-square distribution with 5 degrees of freedom, and the factor that makes a covariance of the rows below the second consistent.
CHI2_MEDIAN, CHI2_NEAR, CHI2_CUT, CONSISTENT = 4.351460, 12.832502, 40.863021, 1.055533
NAMES = ("x1", "x2", "x3", "x4", "x5")
P = len(NAMES)
SYMBOLS = "#*$%&|<>"
#: Floor of each statistic's spread: what a title, a repeated line or a few odd words make in an ordinary text. Most texts
#: have no symbols or repeats at all, so the half nearest to the centre may have no spread there.
SPREAD = (0.06, 0.06, 0.10, 0.15, 0.10)
#: Groups up to which their fits are broadcast: some 21 numbers each, so at most about 10 MB. More are joined by shuffle.
BROADCAST_GROUPS = 50_000
#: Least rows of a group that has an estimate of its own; smaller ones are judged by that of all rows of their language, or of all rows.
LEAST = 50


def counted(df: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint) over the whole text; a null text has none."""
    body = F.coalesce(F.col(text), F.lit(""))
    word = lambda a: F.filter(a, lambda w: w != "")
    with_arrays = df.withColumn("__t", body).withColumn("__w", word(F.split("__t", BLANKS)))
    bare = reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), SYMBOLS, F.col("__t"))
    with_arrays = with_arrays.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).withColumn("__n", F.size("__w"))
    # one hash for each window of three words
    with_arrays = with_arrays.withColumn(
        "__h",
        F.when(
            F.col("__n") >= 3,
            F.zip_with(
                F.zip_with(F.slice("__w", F.lit(1), F.col("__n") - 2), F.slice("__w", F.lit(2), F.col("__n") - 2), lambda a, b: F.xxhash64(a, b)),
                F.slice("__w", F.lit(3), F.col("__n") - 2),
                lambda a, b: F.xxhash64(a, b),
            ),
        ),
    )
    # windows sorted by hash and place; one that equals a neighbour is a repeat; places then cover three words each
    both = F.sort_array(F.arrays_zip(F.col("__h").alias("h"), F.sequence(F.lit(1), F.col("__n") - 2).alias("i")))
    with_arrays = with_arrays.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), both))
    hs = F.col("__s.h")
    m = F.size("__s")
    none = F.array(F.lit(None).cast("bigint"))
    before, after = F.concat(none, F.slice(hs, F.lit(1), m - 1)), F.concat(F.slice(hs, F.lit(2), m - 1), none)
    same = F.zip_with(F.zip_with(hs, before, lambda a, b: a.eqNullSafe(b)), F.zip_with(hs, after, lambda a, b: a.eqNullSafe(b)), lambda a, b: a | b)
    places = F.array_sort(F.transform(F.filter(F.arrays_zip(F.col("__s.i").alias("i"), same.alias("d")), lambda x: x["d"]), lambda x: x["i"]))
    with_arrays = with_arrays.withColumn("__p", F.when(F.col("__s").isNotNull(), places))
    k = F.size("__p")
    steps = F.zip_with(F.slice("__p", F.lit(2), k - 1), F.slice("__p", F.lit(1), k - 1), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.when(F.col("__p").isNull(), 0).otherwise(F.aggregate(steps, F.lit(3), lambda s, x: s + x))
    out = with_arrays.withColumns(
        {
            "n_words": F.col("__n").cast("bigint"),
            "word_chars": F.length(F.array_join("__w", "")).cast("bigint"),
            "n_symbols": (F.length("__t") - F.length(bare)).cast("bigint"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint"),
            "n_repeat_words": covered.cast("bigint"),
        }
    )
    return out.drop("__t", "__w", "__l", "__n", "__h", "__s", "__p")


def statistics() -> dict[str, Column]:
    """The transformed statistics, each of about the same spread in ordinary text."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "x1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "x2": F.sqrt(F.col("n_symbols") / n),
        "x3": F.sqrt(F.col("n_dup_lines") / n) * 2,
        "x4": F.sqrt(F.col("n_repeat_words") / n),
        "x5": F.log(n) / 8,
    }


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


COUNTS = ["c", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in _pairs()]]
FIT = [*[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in _pairs()]]


def _sums(x: Sequence[str] = NAMES, name: str = "") -> list[Column]:
    """Count, sums and sums of products of five columns. As texts, since plans are made anew for each step."""
    parts = ["count(1)", *[f"sum({x[i]})" for i in range(P)], *[f"sum({x[i]} * {x[j]})" for i, j in _pairs()]]
    return [F.expr(f"{part} AS {name}{c}") for part, c in zip(parts, COUNTS, strict=True)]


def _totals() -> list[Column]:
    return [F.expr(f"sum({c}) AS {c}") for c in COUNTS]


def _small(groups: DataFrame, few: bool) -> DataFrame:
    """A table of groups for a join: a shuffle by group would bring a large group's rows to one task."""
    return F.broadcast(groups) if few else groups


def _factor(groups: DataFrame, scale: float = 1.0) -> DataFrame:
    """From sums: g, k, means m*, the rows l** of the Cholesky factor of the scaled covariance, no pivot below SPREAD, and the logarithm of its determinant's root."""
    out = [f"s{i} / greatest(c, 1) AS m{i}" for i in range(P)]
    for i, j in _pairs():  # a name may be used further on in the same list
        rest = f"(q{i}{j} / greatest(c, 1) - m{i} * m{j}) * {scale!r}D" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        out.append(f"sqrt(greatest({rest}, {SPREAD[i] ** 2!r}D)) AS l{i}{i}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return groups.selectExpr("g", "k", *out, " + ".join(f"ln(l{i}{i})" for i in range(P)) + " AS logdet")


def _distance(rows: DataFrame, fit: DataFrame, few: bool, how: str = "left") -> DataFrame:
    """Adds d, the squared Mahalanobis distance, and the columns of fit other than its numbers; fit has one row for each group, or several."""
    kept = [f"`{c}`" for c in dict.fromkeys([*rows.columns, *fit.columns]) if c not in (*FIT, "logdet")]
    y = [f"({NAMES[i]} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i)) + f") / l{i}{i} AS y{i}" for i in range(P)]
    return rows.join(_small(fit, few), "g", how).selectExpr(*kept, *y, " + ".join(f"y{i} * y{i}" for i in range(P)) + " AS d").drop(*[f"y{i}" for i in range(P)])


def _place(d: Column) -> Column:
    """A distance on the scale of bins."""
    return 32 * F.log2(d + F.lit(1e-3))


def _bin(d: Column) -> Column:
    return F.floor(_place(d)).cast("int")


def _step(rows: DataFrame, fit: DataFrame, few: bool) -> DataFrame:
    """A concentration step of each fit (g, k): mean and factor of the (n + p + 1) / 2 rows nearest by it, to the end of a fine bin."""
    by = ["g", "k"]
    near = _distance(rows, fit, few, "inner").withColumn("b", _bin(F.col("d")))
    w = Window.partitionBy(*by).orderBy("b")
    # summed by group and bin before a group's bins meet: one task would else read a group's bins of every task
    bins = near.groupBy(*by, "b").agg(*_sums()).repartition(*by)
    bins = bins.withColumn("below", F.sum("c").over(w) - F.col("c")).withColumn("half", F.floor((F.sum("c").over(Window.partitionBy(*by)) + P + 1) / 2))
    edge = bins.where("below < half and below + c > half").select(*by, F.col("b").alias("edge"), (F.col("half") - F.col("below")).alias("need"))
    fine = F.least(F.floor((_place(F.col("d")) - F.col("b")) * 4096), F.lit(4095)).cast("int").alias("f")
    parts = near.join(_small(edge, few), by).where("b = edge").groupBy(*by, "need", fine).agg(*_sums()).repartition(*by)
    parts = parts.withColumn("below", F.sum("c").over(Window.partitionBy(*by).orderBy("f")) - F.col("c")).where("below < need")
    whole = bins.where("below + c <= half").select(*by, *COUNTS).union(parts.select(*by, *COUNTS))
    return _factor(whole.groupBy(*by).agg(*_totals()))


def _medians(rows: DataFrame, values: dict[str, Column], name: str) -> DataFrame:
    """g and name_x for each value x: the median of each group, to a 128th. By counts of bins, so that a large group is summed in every task."""
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.floor(v * 128).cast("int").alias("b")) for x, v in values.items()]))
    counts = rows.select("g", cells.alias("v")).groupBy("g", "v.x", "v.b").agg(F.count(F.lit(1)).alias("c")).repartition("g", "x")
    w = Window.partitionBy("g", "x")
    middle = counts.withColumn("below", F.sum("c").over(w.orderBy("b")) - F.col("c")).withColumn("all", F.sum("c").over(w)).where(F.col("below") < F.col("all") / 2)
    tops = middle.groupBy("g", "x").agg(((F.max("b") + 0.5) / 128).alias("m"))
    return tops.groupBy("g").agg(*[F.max(F.when(F.col("x") == x, F.col("m"))).alias(f"{name}_{x}") for x in values])


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """Three first fits of each group: its medians with the median deviations; mean and covariance of all rows; and those of the rows drawn in to two deviations from the median."""
    med = materialize(_medians(rows, {x: F.col(x) for x in NAMES}, "c"), "mcd-start")
    dev = _medians(rows.join(_small(med, few), "g"), {x: F.abs(F.col(x) - F.col(f"c_{x}")) for x in NAMES}, "a")
    centre = materialize(med.join(dev, "g"), "mcd-start")
    wide = {i: F.greatest(F.col(f"a_{x}") * 1.4826, F.lit(SPREAD[i])) for i, x in enumerate(NAMES)}
    drawn = [F.greatest(F.least(F.col(x), F.col(f"c_{x}") + 2 * wide[i]), F.col(f"c_{x}") - 2 * wide[i]).alias(f"w{i}") for i, x in enumerate(NAMES)]
    both = rows.join(_small(centre, few), "g").select("g", *NAMES, *drawn)
    sums = materialize(both.groupBy("g").agg(*_sums(), *_sums([f"w{i}" for i in range(P)], "d")), "mcd-start")
    flat = centre.select("g", F.lit(0).alias("k"), *[F.col(f"c_{x}").alias(f"m{i}") for i, x in enumerate(NAMES)], *[(wide[i] if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in _pairs()], F.lit(0.0).alias("logdet"))
    names = [c[1:] for c in sums.columns if c[0] == "d"]
    whole = _factor(sums.select("g", F.lit(1).alias("k"), *names))
    inner = _factor(sums.select("g", F.lit(2).alias("k"), *[F.col(f"d{c}").alias(c) for c in names]))
    return flat.unionByName(whole).unionByName(inner)


def _middle(rows: DataFrame, fit: DataFrame, few: bool) -> DataFrame:
    """Adds each group's median distance `middle` and number of `rows` to fit."""
    w = Window.partitionBy("g").orderBy("b")
    counts = _distance(rows, fit, few, "inner").groupBy("g", _bin(F.col("d")).alias("b")).agg(F.count(F.lit(1)).alias("c")).repartition("g")
    counts = counts.withColumn("below", F.sum("c").over(w) - F.col("c")).withColumn("all", F.sum("c").over(Window.partitionBy("g")))
    middle = counts.where(F.col("below") < F.col("all") / 2).groupBy("g").agg((F.pow(F.lit(2.0), (F.max("b") + 1) / 32) - 1e-3).alias("middle"), F.max("all").alias("rows"))
    return materialize(fit.join(middle, "g"), "mcd-fit")


def least_determinant(rows: DataFrame, few: bool) -> DataFrame:
    """g, means, factor and logdet of the half found: from the best start, until no step lessens the determinant."""
    fits = materialize(_starts(rows, few), "mcd-fit")
    for _ in range(2):
        fits = materialize(_step(rows, fits, few), "mcd-fit")
    best = fits.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("logdet", "k"))).where("r = 1").drop("r")
    best = materialize(_step(rows, best, few), "mcd-fit")
    done, going = None, best
    while True:  # each round lessens the determinant of the groups that go on, so it ends
        new = _step(rows, going, few)
        both = new.join(going.select("g", F.col("logdet").alias("was")), "g")
        new = materialize(both.withColumn("less", F.col("logdet") < F.col("was") - 1e-9).drop("was"), "mcd-fit")
        rest = going.join(new.where("not less").select("g"), "g", "left_semi")
        done = rest if done is None else done.unionByName(rest)
        going = new.where("less").drop("less")
        if going.limit(1).count() == 0:
            return done.drop("k")


def fit_mcd(rows: DataFrame, few: bool) -> DataFrame:
    """One row for each group g of rows (g, x1..x5): mean and Cholesky factor of the rows near by the least determinant's half, the median distance `middle`, the number of `rows`.

    few: whether there are at most BROADCAST_GROUPS groups.
    """
    raw = _middle(rows, materialize(least_determinant(rows, few), "mcd-fit"), few)
    near = _distance(rows, raw, few, "inner").where(F.col("d") * CHI2_MEDIAN <= CHI2_NEAR * F.col("middle"))
    return _middle(rows, materialize(_factor(near.withColumn("k", F.lit(0)).groupBy("g", "k").agg(*_sums()), CONSISTENT).drop("k"), "mcd-fit"), few)


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cut: float = CHI2_CUT, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of df: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    base_failed: under 50 words, or more than half of them in repeated three-word windows. The others are
    grouped by language and source (nulls are a group of their own) and kept if the scaled squared distance from
    their group's centre is at most cut. A group of under LEAST rows is judged by the estimate of all rows of its
    language, or of all rows if these are as few. Null and empty texts have no words and fail. Repeated rows come out as
    often; an empty table gives no rows. keep: further columns of df to carry along; other columns are not read.
    """
    kept_cols = {f"__k{i}": F.col(c) for i, c in enumerate(keep)}
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"), F.col(source_col).cast("string").alias("__source"), *[c.alias(k) for k, c in kept_cols.items()])
    stats = counted(rows, "__text").drop("__text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = materialize(stats.withColumn("base_failed", failed), "quality-stats")
    passed = stats.where(~F.col("base_failed"))
    sizes = passed.groupBy("__lang", "__source").agg(F.count(F.lit(1)).alias("n"))
    own = F.to_json(F.struct("__lang", "__source"), {"ignoreNullFields": "false"})
    lang = F.to_json(F.struct("__lang"), {"ignoreNullFields": "false"})
    of_lang = F.sum("n").over(Window.partitionBy("__lang"))
    groups = sizes.withColumn("lang_rows", of_lang).withColumn("g", F.when(F.col("n") >= LEAST, own).when(F.col("lang_rows") >= LEAST, lang).otherwise(F.lit("all")))
    asked = F.max((F.col("g") == lang).cast("int")).over(Window.partitionBy("__lang")) == 1
    groups = materialize(groups.withColumn("lang_asked", asked), "quality-groups")  # a row for each pair of language and source
    few = groups.count() <= BROADCAST_GROUPS
    all_asked = groups.where("g = 'all'").limit(1).count() > 0
    # a row counts for its own group, and for its language and all rows where small groups are judged by these
    used = F.array_compact(F.array(F.when(F.col("n") >= LEAST, own), F.when(F.col("lang_asked"), lang), F.when(F.lit(all_asked), F.lit("all"))))
    pairs = groups.select(F.col("__lang").alias("gl"), F.col("__source").alias("gs"), "g", used.alias("used"))
    same = F.col("__lang").eqNullSafe(F.col("gl")) & F.col("__source").eqNullSafe(F.col("gs"))
    measured = passed.join(_small(pairs, few), same).withColumns(statistics())
    measured = materialize(measured.select(F.explode("used").alias("g"), *NAMES), "mcd-rows")
    fit = fit_mcd(measured, few)
    grouped = stats.join(_small(pairs.drop("used"), few), same, "left").drop("gl", "gs").withColumns(statistics())
    judged = _distance(grouped, fit, few)
    distance = F.when(~F.col("base_failed"), F.col("d") * CHI2_MEDIAN / F.greatest(F.col("middle"), F.lit(CHI2_MEDIAN)))
    kept = ~F.col("base_failed") & (distance <= cut)
    return judged.withColumn("distance", distance).select(
        F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", F.coalesce(kept, F.lit(False)).alias("kept"), *[F.col(k).alias(c) for k, c in zip(kept_cols, keep, strict=True)]
    )
