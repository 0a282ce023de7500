"""Quality rules: statistics of each text, plain limits, and robust multivariate outliers.

Ratios of the statistics, transformed, form a vector of four. Per language and source its centre and
covariance come from a search for the minimum covariance determinant: several starts (medians and quartile
ranges, and small random subsets), from each two concentration steps, on the three quarters of the rows that are
nearest by the last estimate, then the start with the least determinant until it falls no more. Small groups lean
on their language's estimate by `prior_rows` rows. A row is rejected when its squared Mahalanobis distance is
beyond `cutoff`.

Only DataFrame functions. The text is read once; every step then aggregates a slim table once: moments
in fixed bins of the distance, of which the nearest three quarters are added up. So there is
no sort and no group in one task: groups of any size are pre-aggregated map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlens.llm.common import SPACES, WORD, null_safe, same, written

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
D = 4
#: Smallest spread (a standard deviation of the transformed vector) that a group is credited with.
FLOORS = (0.045, 0.05, 0.15, 0.15)
#: The nearest share of the rows that a concentration step keeps, and what makes the covariance of
#: that share consistent for four normal variables: share / P(chi2_6 <= q), q the chi2_4 quantile.
NEAREST, CONSISTENT = 0.75, 1.486
#: The 0.9999 quantile of chi-squared with four degrees of freedom.
CUTOFF = 23.51


def with_statistics(docs: DataFrame, window: int = 8) -> DataFrame:
    """docs with the five statistics and _n_lines (lines with a word) added; null counts as empty.

    Repeated windows are found by the sorted hashes of a text's windows, and only for texts in which
    two are equal; a word is counted once however many repeated windows cover it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    after = lambda array, i, by: F.get(array, i + by)
    return (
        docs.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
        .withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
        .withColumn("_n", F.size("_words"))
        .withColumn("_hashes", F.when(F.col("_n") >= window, F.transform(F.sequence(F.lit(1), F.col("_n") - (window - 1)), lambda i: F.xxhash64(F.slice(F.col("_words"), i, window)))))
        .withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .withColumn("_twice", F.filter("_sorted", lambda x, i: F.coalesce(x["h"] == after("_sorted", i, -1)["h"], F.lit(False)) | F.coalesce(x["h"] == after("_sorted", i, 1)["h"], F.lit(False))))
        .withColumn("_at", F.sort_array(F.transform("_twice", lambda x: x["i"])))
        .withColumn("_covered", F.transform("_at", lambda p, i: F.least(F.lit(window), F.coalesce(after("_at", i, 1) - p, F.lit(window)))))
        .withColumns(
            {
                "n_words": F.col("_n").cast("long"),
                "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
                "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": F.coalesce(F.aggregate("_covered", F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
                "_n_lines": F.size("_lines").cast("long"),
            }
        )
        .drop("_words", "_lines", "_n", "_hashes", "_sorted", "_twice", "_at", "_covered")
    )


def _vector(words: int = 20, letters: float = 5.0, lines: int = 5) -> dict[str, Column]:
    """The transformed statistics. As if `words` words of `letters` letters and `lines` lines without
    a fault stood before each text, so that the ratios of short texts vary no more than those of long."""
    n = F.col("n_words") + words
    return {
        "x0": F.log((F.col("word_chars") + words * letters) / n),
        "x1": F.sqrt(F.col("n_symbols") / n),
        "x2": F.sqrt(F.col("n_dup_lines") / (F.col("_n_lines") + lines)),
        "x3": F.sqrt(F.col("n_repeat_words") / n),
    }


def _base_failed(min_words: int = 20, max_repeat: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def _triangle() -> list[tuple[int, int]]:
    return [(i, j) for i in range(D) for j in range(i + 1)]


def _cholesky(groups: DataFrame) -> DataFrame:
    """Add the Cholesky factor l_ij of the covariance c_ij with the floors on its diagonal."""
    for i, j in _triangle():
        left = F.col(f"c{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
        for k in range(j):
            left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        groups = groups.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-12))) if i == j else left / F.col(f"l{j}{j}"))
    return groups


def _distance(rows: DataFrame) -> DataFrame:
    """Add d2, the squared Mahalanobis distance from m_i under the factor l_ij."""
    for i in range(D):
        left = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            left = left - F.col(f"l{i}{k}") * F.col(f"_y{k}")
        rows = rows.withColumn(f"_y{i}", left / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum(F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(D))).drop(*[f"_y{i}" for i in range(D)])


def _with_group(rows: DataFrame, per_group: DataFrame, group: str = "group", salts: int = 32) -> DataFrame:
    """rows with their group's columns. A group may hold a third of the rows, so rows are spread by a
    hash of their vector and each group's row is there once for every salt."""
    salt = F.pmod(F.xxhash64(*[f"x{i}" for i in range(D)]), F.lit(salts)).cast("int")
    spread = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(spread, [group, "_salt"], "left").drop("_salt")


_MOMENTS = ["h", *[f"s{i}" for i in range(D)], *[f"p{i}{j}" for i, j in _triangle()]]


def _moments() -> list[Column]:
    """Number of rows, sums and sums of products of x_i."""
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(D)]
    return [F.count(F.lit(1)).alias("h"), *sums, *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in _triangle()]]


def _estimates(sums: DataFrame) -> DataFrame:
    """(group, start, n, m_i, c_ij, volume) from moments; volume is the log determinant of c_ij with the floors."""
    mean = lambda i: F.col(f"s{i}") / F.col("h")
    spread = lambda i, j: F.col(f"p{i}{j}") / F.col("h") - mean(i) * mean(j)
    states = sums.select(
        "group", "start", "n",
        *[F.round(mean(i), 9).alias(f"m{i}") for i in range(D)],
        *[F.round((F.greatest(F.lit(0.0), spread(i, j)) if i == j else spread(i, j)) * CONSISTENT, 9).alias(f"c{i}{j}") for i, j in _triangle()],
    )
    return _cholesky(states).withColumn("volume", sum(2 * F.log(f"l{i}{i}") for i in range(D)))


def concentrated(rows: DataFrame, states: DataFrame) -> DataFrame:
    """A concentration step: the estimates of the nearest three quarters of each group's rows under each of its states.

    The rows are read once: moments per bin of the distance, of which the nearest are added up."""
    near = _distance(_with_group(rows, states.drop("volume"))).withColumn("bin", F.floor(8 * F.log2(F.col("d2") + 1e-6)))
    bins = near.groupBy("group", "start", "n", "bin").agg(*_moments())
    before = Window.partitionBy("group", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inner = bins.withColumn("before", F.coalesce(F.sum("h").over(before), F.lit(0))).where(F.col("before") < F.ceil(F.col("n") * NEAREST))
    return _estimates(inner.groupBy("group", "start", "n").agg(*[F.sum(c).alias(c) for c in _MOMENTS]))


def _starts(rows: DataFrame, starts: int, few: int = 16) -> DataFrame:
    """States to begin from: start 0 has medians and quartile ranges, each other one the moments of some `few` rows
    of the group, drawn by hash."""
    first = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[F.percentile(F.round(f"x{i}", 3), [0.25, 0.5, 0.75]).alias(f"q{i}") for i in range(D)])
    first = written(first)
    zero = F.lit(0.0)
    middle = first.select("group", F.lit(0).alias("start"), "n", *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(D)], *[(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) if i == j else zero).alias(f"c{i}{j}") for i, j in _triangle()])
    middle = _cholesky(middle).withColumn("volume", zero)
    if starts < 2:
        return middle
    draws = _with_group(rows, first.select("group", "n")).withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(starts - 1))))
    drawn = draws.where(F.pmod(F.xxhash64(*[f"x{i}" for i in range(D)], "start"), F.greatest(F.lit(1).cast("long"), F.expr(f"n div {few}"))) == 0)
    return middle.unionByName(_estimates(drawn.groupBy("group", "start", "n").agg(*_moments())))


def robust_estimates(rows: DataFrame, *, starts: int = 5, first_steps: int = 2, most_steps: int = 25, least_gain: float = 1e-6) -> DataFrame:
    """Per `group` of rows with x_i: n, centre m_i, covariance c_ij and volume (log determinant) of the three quarters
    of the rows with the least determinant that the search finds.

    From each start come `first_steps` concentration steps; the start with the least determinant goes on until no
    group's determinant falls by `least_gain` of itself, or for `most_steps` steps. A group keeps its least."""
    states = written(_starts(rows, starts))
    for _ in range(first_steps):
        states = written(concentrated(rows, states))
    columns = [c for c in states.columns if c != "group"]
    states = states.groupBy("group").agg(F.min_by(F.struct(*columns), F.struct("volume", "start")).alias("best")).select("group", "best.*")
    for _ in range(most_steps):
        after = concentrated(rows, states).select("group", F.struct(*columns).alias("after"))
        falls = F.coalesce(F.col("after.volume") < F.col("before.volume") - least_gain, F.lit(False))
        pairs = states.select("group", F.struct(*columns).alias("before")).join(after, "group", "left")
        both = written(pairs.select("group", falls.alias("falls"), F.when(falls, F.col("after")).otherwise(F.col("before")).alias("best")))
        states = both.select("group", "best.*")
        if not both.where("falls").limit(1).count():
            break
    return states


def quality_verdicts(docs: DataFrame, *, carry: tuple[str, ...] = ("doc_id",), cutoff: float = CUTOFF, prior_rows: int = 50, starts: int = 5) -> DataFrame:
    """The carried columns, the five statistics, base_failed, kept and distance (squared).

    A null or empty text has statistics 0 and fails the base rules. Null languages and sources are
    groups like any other. Rows that fail the base rules take no part in the estimates; their
    distance may be null where their whole group failed. Repeated rows count each and get the same
    verdict. An empty table gives no rows. Columns of docs that aren't named don't matter. A very long text is
    one row's arrays of words and window hashes in its task; nothing else depends on its length.
    """
    own = docs.select(*[F.col(c).alias(f"c_{c}") for c in carry], null_safe("lang").alias("_lang"), null_safe("source").alias("_source"), F.col("text"))
    slim = written(with_statistics(own).drop("text").withColumn("base_failed", _base_failed()).withColumns(_vector()))
    levels = F.array(F.concat(F.lit("L"), F.col("_lang")), F.concat(F.lit("S"), F.col("_source"), F.lit("\x1f"), F.col("_lang")))
    slim = slim.withColumns({"_of_lang": levels[0], "_of_both": levels[1]})
    states = robust_estimates(slim.where(~F.col("base_failed")).select(F.explode(F.array("_of_lang", "_of_both")).alias("group"), *[f"x{i}" for i in range(D)]), starts=starts)
    values = [f"m{i}" for i in range(D)] + [f"c{i}{j}" for i, j in _triangle()]
    pairs = slim.select("_of_lang", "_of_both").distinct()
    of_lang = states.select(F.col("group").alias("_of_lang"), *[F.col(v).alias(f"p_{v}") for v in values])
    of_both = states.withColumnRenamed("group", "_of_both")
    n = F.coalesce(F.col("n"), F.lit(0))
    leaning = pairs.join(of_lang, "_of_lang").join(of_both, "_of_both", "left").select("_of_both", *[((F.coalesce(F.col(v), F.lit(0.0)) * n + F.col(f"p_{v}") * prior_rows) / (n + prior_rows)).alias(v) for v in values])
    judged = _distance(_with_group(slim, _cholesky(leaning), "_of_both"))
    return judged.select(*[F.col(f"c_{c}").alias(c) for c in carry], *STATISTICS, "base_failed", (~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).alias("kept"), F.col("d2").alias("distance"))


def good_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose verdict is kept. Verdicts come back by document, text hash, language
    and source, on which alone they depend: repeated rows are kept or dropped together."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", F.xxhash64("text").alias("_text"), "lang", "source", "text")
    verdicts = quality_verdicts(keyed, carry=("doc_id", "_text", "lang", "source"), **options).where("kept").select("doc_id", "_text", "lang", "source").distinct()
    keyed = keyed.drop("text")
    return keyed.join(verdicts, same(keyed, verdicts, "doc_id", "_text", "lang", "source"), "left_semi").select("_row.*")
