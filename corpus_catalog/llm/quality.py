"""Quality rules: word statistics and robust multivariate outliers, in DataFrame functions only.

Plain rules reject texts of fewer than 50 words or of mostly repeated 3-word
windows. The others are judged within their language and source: a minimum
covariance determinant estimate of the centre and scatter of transformed
statistics, and a limit on the Mahalanobis distance from it.

The estimate repeats concentration steps: mean and covariance of the half of a
group's rows nearest to the last estimate, until the determinant stops falling. Of
two starts, medians with quartile ranges and medians with median deviations, the one
that ends at the lower determinant counts. Each step is one aggregation whose partial
sums are combined before the shuffle, so a group may hold any share of the rows;
its result has one row per group and start. Groups too small to estimate (``MIN_GROUP``)
are judged by the estimate over their language, or over all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpus_catalog.llm.common import Work, let, words

#: Rows that a group needs for an estimate of its own.
MIN_GROUP = 200
#: Part of the rows that each step keeps.
CORE = 0.5
#: Steps end when no group's log determinant falls by more.
FALL = 0.001
#: Limit of the squared distance, the chi-square quantile 1 - 1.5e-5 for five statistics.
LIMIT = 30.0
#: Covariance of normal rows over that of their nearest half, by the number of statistics with
#: scatter: 0.5 / P(chi-square of p + 2 <= median of chi-square of p).
CONSISTENT = [1.0, 7.0, 3.259, 2.449, 2.105, 1.913]
STATS = ["s0", "s1", "s2", "s3", "s4"]
#: Shares of lines repeated beyond one and of words in repeated windows that reject a text by themselves.
ODD_LINES, ODD_WORDS = 0.3, 0.4
#: Least scatter of each transformed statistic. Most texts have no symbols or repeats at
#: all, so their core has no scatter; differences below these mean nothing. Those of the
#: repeats put a text of the odd share, where others have none, at the limit.
FLOOR = [0.08, 0.03, (ODD_LINES / LIMIT) ** 0.5, (ODD_WORDS / LIMIT) ** 0.5, 0.05]
GROUP = ["scope", "lang", "source"]
RUN = [*GROUP, "start"]


def _repeated_positions(w: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more among the words ``w``."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")),
    )

    def covered(s: Column) -> Column:
        # Equal windows are neighbours once sorted.
        twice = F.filter(
            F.transform(
                s,
                lambda x, j: F.when(
                    ((j > 0) & (F.try_element_at(s, j)["h"] == x["h"])) | (F.try_element_at(s, j + 2)["h"] == x["h"]),
                    x["i"],
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))

    any_twice = lambda s: F.when(
        F.size(F.array_distinct(F.transform(s, lambda x: x["h"]))) == F.size(s), F.lit(0)
    ).otherwise(let(F.sort_array(s), covered))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, any_twice)).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every text: words, their code points, symbols, repeated lines and words.

    Returns ``doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_capitals, n_lines``. A null text has no words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    filled = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated_positions(w).alias("n_repeat_words"),
        )

    lines = let(filled, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("u")))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        *(F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")),
        let(words(text), counts).alias("c"),
        lines.alias("l"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
    ).select(
        "doc_id", "lang", "source", "c.*", "n_symbols", "n_capitals",
        (F.col("l.n") - F.col("l.u")).cast("long").alias("n_dup_lines"), F.col("l.n").alias("n_lines"),
    )


def _transformed() -> list[Column]:
    """Statistics made comparable: logs of sizes, shares as square roots. One repeated line counts as none."""
    n = F.greatest("n_words", F.lit(1))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("s0"),
        F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("s1"),
        F.sqrt(F.greatest(F.col("n_dup_lines") - 1, F.lit(0)) / F.greatest("n_lines", F.lit(1))).alias("s2"),
        F.sqrt(F.col("n_repeat_words") / n).alias("s3"),
        F.sqrt(F.col("n_capitals") / F.greatest("word_chars", F.lit(1))).alias("s4"),
    ]


def _distance(center: str = "m", factor: str = "w") -> Column:
    """Squared length of the factor times a row's difference from the centre."""
    total, at = [], 0
    for i in range(len(STATS)):
        dot = []
        for j in range(i + 1):
            dot.append(F.col(factor)[at] * (F.col(STATS[j]) - F.col(center)[j]))
            at += 1
        total.append(F.pow(reduce(lambda a, b: a + b, dot), 2))
    return reduce(lambda a, b: a + b, total)


def _estimates(rows: DataFrame) -> DataFrame:
    """Mean and scatter of each group's rows: ``scope, lang, source, start, m, w, det``, the determinant as a log."""
    p = len(STATS)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = rows.groupBy(RUN).agg(
        *(F.avg(s).alias(f"m{i}") for i, s in enumerate(STATS)),
        *(F.covar_pop(STATS[i], STATS[j]).alias(f"c{i}{j}") for i, j in pairs),
    )
    # A statistic whose scatter no factor lifts above its floor has none.
    widest = max(CONSISTENT)
    free = sum((F.when(F.col(f"c{i}{i}") * widest > FLOOR[i] ** 2, 1).otherwise(0) for i in range(p)), F.lit(0))
    sums = sums.withColumn("consistent", F.element_at(F.array(*map(F.lit, CONSISTENT)), free + 1))
    for i, j in pairs:
        sums = sums.withColumn(f"c{i}{j}", F.col(f"c{i}{j}") * F.col("consistent"))
    for i in range(p):  # each factor a column, used by the next ones
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            value = F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}")
            sums = sums.withColumn(f"l{i}{j}", value)
    for i in range(p):
        for j in range(i, -1, -1):
            value = 1 / F.col(f"l{i}{i}") if i == j else -sum(
                (F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0)
            ) / F.col(f"l{i}{i}")
            sums = sums.withColumn(f"w{i}{j}", value)
    return sums.select(
        *RUN, F.array(*(f"m{i}" for i in range(p))).alias("m"), F.array(*(f"w{i}{j}" for i, j in pairs)).alias("w"),
        (2 * sum((F.log(f"l{i}{i}") for i in range(p)), F.lit(0.0))).alias("det"),
    )


def _starts(rows: DataFrame) -> DataFrame:
    """Medians, with quartile ranges and with median deviations as independent scatter."""
    p = len(STATS)
    quart = rows.groupBy(GROUP).agg(*(F.percentile_approx(s, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, s in enumerate(STATS)))
    away = [F.percentile_approx(F.abs(F.col(s) - F.col(f"q{i}")[1]), 0.5, 1000).alias(f"a{i}") for i, s in enumerate(STATS)]
    around = rows.join(_named(quart), _same()).groupBy(GROUP).agg(*away)

    def start(found: DataFrame, name: str, width: list[Column]) -> DataFrame:
        factor = [
            1 / F.greatest(width[i], F.lit(FLOOR[i])) if i == j else F.lit(0.0) for i in range(p) for j in range(i + 1)
        ]
        center = F.array(*(F.col(f"q{i}")[1] for i in range(p)))
        return found.select(*GROUP, F.lit(name).alias("start"), center.alias("m"), F.array(*factor).alias("w"))

    both = around.join(_named(quart), _same())
    return start(quart, "quartiles", [(F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349 for i in range(p)]).unionByName(
        start(both, "deviations", [F.col(f"a{i}") / 0.6745 for i in range(p)])
    )


def _same(columns: list[str] = GROUP) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in columns))


def _named(df: DataFrame, columns: list[str] = GROUP) -> DataFrame:
    return df.withColumnsRenamed({c: f"e_{c}" for c in columns})


def _measured(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Each row once per start, with its distance from that estimate."""
    named = _named(estimates.select(*RUN, "m", "w"))
    return rows.join(named, _same()).withColumn("d", _distance()).drop("m", "w", *(f"e_{c}" for c in GROUP))


def _concentrated(work: Work, rows: DataFrame) -> DataFrame:
    """``scope, lang, source, m, w`` of the lower determinant of each group's starts."""
    estimates, best, step = work.store(_starts(rows), "start"), None, 0
    while True:
        measured = work.store(_measured(rows, estimates), f"distance{step}")
        cut = work.store(measured.groupBy(RUN).agg(F.percentile_approx("d", CORE, 1000).alias("cut")), f"cut{step}")
        core = measured.join(_named(cut, RUN), _same(RUN)).filter("d <= cut")
        estimates = work.store(_estimates(core.select(*RUN, *STATS)), f"estimate{step}")
        work.release(measured)
        if best is None:
            best = estimates
        else:
            old = _named(best.select(*RUN, F.col("det").alias("old")), RUN)
            fell = not estimates.join(old, _same(RUN)).filter(F.col("old") - F.col("det") > FALL).isEmpty()
            best = work.store(
                best.unionByName(estimates).groupBy(RUN).agg(F.min(F.struct("det", "m", "w")).alias("x")).select(*RUN, "x.*"),
                f"best{step}",
            )
            if not fell:
                break
        step += 1
    return best.groupBy(GROUP).agg(F.min(F.struct("det", "m", "w")).alias("x")).select(*GROUP, "x.m", "x.w")


def outliers(work: Work, rows: DataFrame) -> DataFrame:
    """``rows (lang, source, s0..s3, ...)`` with ``distance``, the squared robust distance in their group.

    Any group judges its rows by the narrowest scope that has ``MIN_GROUP`` rows.
    """
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    sizes = work.store(sizes, "sizes")
    langs = sizes.groupBy("lang").agg(F.sum("n").alias("n_lang")).withColumnRenamed("lang", "l_lang")
    scopes = work.store(
        sizes.join(langs, F.col("lang").eqNullSafe(F.col("l_lang")))
        .select(
            F.col("lang").alias("g_lang"), F.col("source").alias("g_source"),
            F.when(F.col("n") >= MIN_GROUP, "source").when(F.col("n_lang") >= MIN_GROUP, "lang").otherwise("all").alias("scope"),
        ),
        "scopes",
    )
    # A narrow scope's rows count for the wider ones that others need.
    used = [r["scope"] for r in scopes.select("scope").distinct().collect()]  # three at most
    placed = rows.join(
        scopes, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    ).drop("g_lang", "g_source").withColumnRenamed("scope", "own_scope")
    narrow = {"source": ("lang", "source"), "lang": ("lang",), "all": ()}
    fitted = None
    for scope in used:
        part = placed.withColumn("scope", F.lit(scope))
        if scope == "source":
            part = part.filter(F.col("own_scope") == "source")
        for c in ("lang", "source"):
            if c not in narrow[scope]:
                part = part.withColumn(c, F.lit(None).cast("string"))
        fitted = part if fitted is None else fitted.unionByName(part)
    if fitted is None:
        return rows.withColumn("distance", F.lit(0.0))
    fitted = work.store(fitted.select(*GROUP, *STATS), "fitted")
    judged = _named(work.keep(_concentrated(work, fitted), "judged"))
    kept_scopes = work.keep(scopes, "scopes")
    judged = (
        kept_scopes.join(
            judged,
            (F.col("scope") == F.col("e_scope"))
            & F.when(F.col("scope") == "all", F.lit(True)).otherwise(F.col("g_lang").eqNullSafe(F.col("e_lang")))
            & F.when(F.col("scope") != "source", F.lit(True)).otherwise(F.col("g_source").eqNullSafe(F.col("e_source"))),
        ).select("g_lang", "g_source", "m", "w")
    )
    judged = work.keep(judged, "limits")
    return (
        rows.join(judged, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
        .withColumn("distance", _distance()).drop("g_lang", "g_source", "m", "w")
    )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """Statistics and verdict of every row of ``docs``.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    distance, kept``. A null, empty or blank text has no words and fails. Null or missing languages
    and sources form groups of their own; null ids and repeated rows are judged like others. Only the
    rows that pass the plain rules are used for the estimates; a group too small for any scope
    (under ``MIN_GROUP`` rows in all) is estimated all the same. An empty table gives an empty one.
    """
    with Work(docs.sparkSession, "quality") as work:
        stats = statistics(docs, id_col, text_col)
        failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        stats = work.keep(stats.withColumn("base_failed", failed).select("*", *_transformed()), "statistics")
        judged = outliers(work, stats.filter(~F.col("base_failed")))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = judged.select(*columns, "distance", (F.coalesce("distance", F.lit(0.0)) <= limit).alias("kept"))
    rejected = stats.filter("base_failed").select(
        *columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")
    )
    return passed.unionByName(rejected)
