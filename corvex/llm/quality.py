"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates, in DataFrame functions only.

Each document gets a vector of transformed statistics (log length, log mean word length, and the variance-stabilised
shares of symbols, repeated lines and repeated word windows). For each group of one language and source, a deterministic
FAST-MCD finds the mean and covariance of the tightest ``SUPPORT`` of its documents. It has four starts: medians with
absolute deviations, the half of the documents nearest to those, mean with covariance, and medians with the covariance
of spatial signs. From each, ``STEPS`` concentration steps keep the documents of smallest distance and estimate again; the start of least determinant goes on
until no determinant falls. A document is rejected if its squared Mahalanobis distance exceeds ``CUTOFF``, a chi-square
quantile. Every statistic covers the whole text and every document.

``FLOORS``, squared, are added to the variances: most documents have no repeated line at all, and the bare determinant
of such a group would be zero and any deviation an outlier. Groups of fewer than ``LEAST`` documents are judged with
all such groups of their language together; if those are too few as well, by the estimate of their whole language, and
if that is too small, by that of all documents, so that every document gets a verdict at any size.

Groups are only ever aggregated, with partial sums before each shuffle; no group is gathered anywhere. Estimates, a row
for each group, are broadcast if they are counted to be at most ``GROUPS``; beyond that the join is salted, so that a
group with a third of all documents is dealt to ``SALTS`` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvex.llm._common import BLANK, stage

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SUPPORT, STEPS, LEAST = 0.75, 2, 50
#: Concentration steps of the best start, at most, and by how much the logarithm of its determinant must fall to go on.
MOST_STEPS, FALL = 30, 1e-6
#: The median and the 0.999 quantile of a chi-square variable of five degrees of freedom.
CHI2_MEDIAN, CUTOFF = 4.351, 20.515
FEATURES = ("x0", "x1", "x2", "x3", "x4")
FLOORS = (0.3, 0.08, 0.06, 0.15, 0.15)
D = len(FEATURES)
#: The columns of an estimate: its group, mean, factor and determinant.
FIT = ("g", *(f"m{i}" for i in range(D)), *(f"l{i}{j}" for i in range(D) for j in range(i + 1)), "log_det")
#: Groups whose estimates (some 200 bytes each) are broadcast, at most; parts of each group beyond that.
GROUPS, SALTS = 20_000, 64


def let(value: Column, body) -> Column:
    """body(v) with v bound to value, which is so evaluated once even where body has it inside of lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeats(windows: Column) -> Column:
    """The words in windows that are there twice or more; windows are the hashes of all windows of a text, in order."""

    def flagged(s: Column) -> Column:
        same = lambda i, j: s[i]["h"] == s[j]["h"]
        last = F.size(s) - 1
        hit = F.filter(F.sequence(F.lit(0), last), lambda i: F.when(i > 0, same(i, i - 1)).otherwise(False) | F.when(i < last, same(i, i + 1)).otherwise(False))
        return F.sort_array(F.transform(hit, lambda i: s[i]["i"]))

    covered = lambda p: F.lit(WINDOW) + F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(0), lambda a, i: a + F.least(F.lit(WINDOW), p[i] - p[i - 1]))
    slow = lambda v: let(F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: let(flagged(s), covered))
    return let(windows, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(slow(v)))


def statistics(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, lang, source and the counts of each text: words, characters in words, symbols, lines and what repeats.

    A null text is empty. Words are runs without blanks; windows of words are compared by their 64-bit hashes. With
    whole, ``row`` is all of docs' columns.
    """
    text = F.coalesce("text", F.lit(""))
    more = ["row"] if whole else []
    docs = docs.select("doc_id", "text", "lang", "source", *([F.struct(*docs.columns).alias("row")] if whole else []))
    rows = docs.select(*more, "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("t"), F.split(F.btrim(text, F.lit(BLANK)), BLANKS).alias("w"))
    bare = F.col("t")
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    rows = rows.select(
        *more,
        "doc_id",
        "lang",
        "source",
        F.when(F.element_at("w", 1) == "", 0).otherwise(F.size("w")).alias("n"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.octet_length("t") - F.octet_length(bare)).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    windows = let(F.col("h"), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(h[i + k] for k in range(WINDOW)))))
    return rows.select(
        *more,
        "doc_id",
        "lang",
        "source",
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("n") >= WINDOW, _repeats(windows)).otherwise(0).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _features(stats: DataFrame) -> DataFrame:
    share = lambda part, whole: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(whole), F.lit(1)))))
    return stats.select(
        "*",
        F.log1p(F.col("n_words").cast("double")).alias("x0"),
        F.log((F.col("word_chars") + 250.0) / (F.col("n_words") + 50.0)).alias("x1"),
        share("n_symbols", "word_chars").alias("x2"),
        share("n_dup_lines", "n_lines").alias("x3"),
        share("n_repeat_words", "n_words").alias("x4"),
    )


def _factor(sums: DataFrame) -> DataFrame:
    """The group's mean and the Cholesky factor of its covariance with the floors added, from its sums."""
    m = [F.col(f"s_{i}") / F.col("c") for i in range(D)]
    return _cholesky(sums.select("g", *(m[i].alias(f"m{i}") for i in range(D)), *((F.col(f"s_{i}_{j}") / F.col("c") - m[i] * m[j]).alias(f"v{i}{j}") for i in range(D) for j in range(i + 1))))


def _cholesky(moments: DataFrame) -> DataFrame:
    """The mean m, the factor l of the covariance v with the floors added, and the logarithm of its determinant."""
    out = moments.select("g", *(f"m{i}" for i in range(D)), *((F.greatest(F.col(f"v{i}{j}"), F.lit(0.0)) + FLOORS[i] ** 2 if i == j else F.col(f"v{i}{j}")).alias(f"v{i}{j}") for i in range(D) for j in range(i + 1)))
    for j in range(D):
        for i in range(j, D):
            rest = F.col(f"v{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    log_det = F.lit(0.0)
    for i in range(D):
        log_det = log_det + 2 * F.log(f"l{i}{i}")
    return out.withColumn("log_det", log_det).select(*FIT)


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("c"), *(F.sum(FEATURES[i]).alias(f"s_{i}") for i in range(D)), *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s_{i}_{j}") for i in range(D) for j in range(i + 1))]


def _matched(points: DataFrame, fit: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """points joined with the row of their group."""
    if small:
        return points.join(F.broadcast(fit), "g", how)
    dealt = points.withColumn("salt", F.pmod(F.xxhash64("doc_id", *FEATURES), F.lit(SALTS)))
    each = fit.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(each, ["g", "salt"], how).drop("salt")


def _distance(points: DataFrame, fit: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """points with their squared distance d2 under the estimate of their group."""
    out = _matched(points, fit, small, how)
    total = F.lit(0.0)
    for i in range(D):
        rest = F.col(FEATURES[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
        total = total + F.col(f"y{i}") * F.col(f"y{i}")
    return out.withColumn("d2", total).select(*points.columns, "d2")


def _quantile(name: str, p: float) -> Column:
    return F.percentile_approx(name, p, 10_000)


def _ladder(stats: DataFrame, least: int, everyone: bool) -> DataFrame:
    """Of each language and source (g), the group that judges it (to), and whether its language is one as a whole (wide).

    The groups' names begin with their rank: 0 one source, 1 the small sources of a language, 2 a language, 3 all.
    """
    sources = stats.groupBy("g", "l").agg(F.count_if(~F.col("base_failed")).alias("members"))
    few = F.col("members") < least
    langs = sources.groupBy("l").agg(F.coalesce(F.sum(F.when(few, F.col("members"))), F.lit(0)).alias("rest"), F.sum("members").alias("whole"), F.bool_or(few).alias("any_few"))
    langs = langs.withColumn("wide", F.lit(everyone) & F.col("any_few") & (F.col("rest") < least) & (F.col("whole") >= least))
    rest = F.concat(F.lit("1"), "l")
    to = F.when(~few, F.col("g")).when(F.lit(not everyone) | (F.col("rest") >= least), rest).when(F.col("wide"), F.concat(F.lit("2"), "l")).otherwise("3")
    return sources.join(langs, "l").select("g", to.alias("to"), "wide")


def _step(clean: DataFrame, fit: DataFrame, support: float, small: bool) -> DataFrame:
    """A concentration step: the estimates from the documents of each group nearest to its estimate."""
    near = stage(_distance(clean, fit, small).groupBy("g").agg(_quantile("d2", support).alias("edge")), "quality-edge")
    inside = _matched(_distance(clean, fit, small), near, small).filter(F.col("d2") <= F.col("edge"))
    return stage(_factor(inside.groupBy("g").agg(*_sums())), "quality-fit")


def _starts(clean: DataFrame, middle: DataFrame, small: bool) -> list[DataFrame]:
    """The four estimates that the search of each group starts from; middle is its medians."""
    lower = [(i, j) for i in range(D) for j in range(i + 1)]
    centred = _matched(clean, middle, small)
    keep = [F.first(f"m{i}").alias(f"m{i}") for i in range(D)]
    spread = centred.groupBy("g").agg(*keep, *(_quantile(F.abs(F.col(x) - F.col(f"m{i}")), 0.5).alias(f"d{i}") for i, x in enumerate(FEATURES)))
    spread = stage(spread.select("g", *(f"m{i}" for i in range(D)), *((1.4826 * F.col(f"d{i}")).alias(f"d{i}") for i in range(D))), "quality-spread")
    medians = _cholesky(spread.select("g", *(f"m{i}" for i in range(D)), *((F.col(f"d{i}") ** 2 if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i, j in lower)))

    means = _factor(_matched(clean, middle.select("g"), small).groupBy("g").agg(*_sums()))

    width = [F.sqrt(F.col(f"d{i}") ** 2 + FLOORS[i] ** 2) for i in range(D)]
    z = _matched(clean, spread, small).withColumns({f"z{i}": (F.col(x) - F.col(f"m{i}")) / width[i] for i, x in enumerate(FEATURES)})
    square = sum((F.col(f"z{i}") ** 2 for i in range(1, D)), F.col("z0") ** 2)
    z = z.withColumn("zz", F.greatest(square, F.lit(1e-12)))
    signs = z.groupBy("g").agg(*keep, *(F.first(f"d{i}").alias(f"d{i}") for i in range(D)), *(F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("zz")).alias(f"u{i}{j}") for i, j in lower))
    signs = _cholesky(signs.select("g", *(f"m{i}" for i in range(D)), *((D * F.col(f"u{i}{j}") * width[i] * width[j]).alias(f"v{i}{j}") for i, j in lower)))
    medians = stage(medians, "quality-medians")
    return [medians, means, signs, _step(clean, medians, 0.5, small)]


def estimates(clean: DataFrame, *, support: float = SUPPORT, steps: int = STEPS, least: int = LEAST) -> tuple[DataFrame, bool]:
    """The estimate of each group g of ``least`` documents, or of that which is all, and whether they are few enough to broadcast.

    Four starts take ``steps`` concentration steps; the one of least determinant takes more until it doesn't fall in any
    group. Of all that a group went through, the estimate of least determinant counts.
    """
    middle = clean.groupBy("g").agg(F.count(F.lit(1)).alias("c"), *(_quantile(x, 0.5).alias(f"m{i}") for i, x in enumerate(FEATURES))).filter((F.col("c") >= least) | (F.col("g") == "3"))
    middle = stage(middle.drop("c"), "quality-middle")
    small = 4 * middle.count() <= GROUPS
    begun = _starts(clean, middle, small)
    fit = None
    for k, start in enumerate(begun):
        start = start.withColumn("g", F.concat(F.lit(str(k)), "g"))
        fit = start if fit is None else fit.union(start)
    fit = stage(fit, "quality-starts")
    each = F.explode(F.array(*(F.lit(str(k)) for k in range(len(begun)))))
    trial = clean.withColumn("start", each).withColumn("g", F.concat("start", "g")).drop("start")
    for _ in range(steps):
        fit = _step(trial, fit, support, small)
    best = fit.withColumn("start", F.left("g", F.lit(1))).withColumn("g", F.substr("g", F.lit(2)))
    fit = stage(best.groupBy("g").agg(F.min(F.struct("log_det", "start", *(c for c in FIT if c not in ("g", "log_det")))).alias("b")).select("g", *(F.col(f"b.{c}") for c in FIT[1:])), "quality-fit")
    for _ in range(MOST_STEPS):
        new = _step(clean, fit, support, small)
        both = fit.select("g", F.struct(*FIT).alias("old")).join(new.select("g", F.struct(*FIT).alias("new")), "g", "left")
        both = both.withColumn("fell", F.coalesce(F.col("new.log_det") < F.col("old.log_det") - FALL, F.lit(False)))
        both = stage(both.select("fell", F.when(F.coalesce(F.col("new.log_det") < F.col("old.log_det"), F.lit(False)), F.col("new")).otherwise(F.col("old")).alias("f")), "quality-fit")
        fit = both.select("f.*")
        if both.filter("fell").isEmpty():
            break
    return fit, small


def judge(stats: DataFrame, *, cutoff: float = CUTOFF, support: float = SUPPORT, steps: int = STEPS, least: int = LEAST, everyone: bool = False) -> DataFrame:
    """stats with ``d2``, the squared robust distance (null: no estimate), and ``kept``.

    kept is false if base_failed or d2 > cutoff. Documents that fail the base rules take no part in the estimates.
    With everyone, what its language has too few of for an estimate is judged by the whole language, or by all documents:
    d2 is then null only where all documents fail the base rules. Null languages and sources are values of their own.
    An empty table gives an empty one. Other columns of stats stay as they are, row by row.
    """
    lang = F.coalesce("lang", F.lit("\x00"))
    points = _features(stage(stats, "quality-statistics")).withColumn("l", lang).withColumn("g", F.concat(F.lit("0"), lang, F.lit("\x1f"), F.coalesce("source", F.lit("\x00"))))
    ladder = stage(_ladder(points, least, everyone), "quality-groups")
    every = not ladder.filter(F.col("to") == "3").isEmpty()
    points = _matched(points, ladder, ladder.count() <= GROUPS).withColumn("g", F.col("to")).drop("to")
    clean = stage(points.filter(~F.col("base_failed")).select("doc_id", "l", "g", "wide", *FEATURES), "quality-points")
    if everyone:  # a document takes part in the estimates of its own group, its language and all, as far as they are used
        own = F.when(F.left("g", F.lit(1)).isin("0", "1"), F.col("g"))
        parts = F.array(own, F.when(F.col("wide"), F.concat(F.lit("2"), "l")), F.lit("3" if every else None).cast("string"))
        clean = clean.withColumn("g", F.explode(F.array_compact(parts)))

    fit, small = estimates(clean, support=support, steps=steps, least=least)
    scale = _distance(clean, fit, small).groupBy("g").agg(F.greatest(F.lit(1.0), _quantile("d2", 0.5) / CHI2_MEDIAN).alias("scale"))
    fit = stage(fit.join(scale, "g"), "quality-fit")
    out = _distance(_matched(points, fit.select("g", "scale"), small, "left"), fit.drop("scale"), small, "left")
    out = out.select(*stats.columns, (F.col("d2") / F.col("scale")).alias("d2"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("d2") > cutoff, F.lit(False)))


def verdicts(docs: DataFrame) -> DataFrame:
    """Of each document, its counts, base_failed and kept."""
    judged = judge(statistics(docs), everyone=True)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. Each row has a verdict of its own, whatever its id."""
    return judge(statistics(docs, whole=True), everyone=True).filter("kept").select("row.*")
