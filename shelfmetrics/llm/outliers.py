"""Quality rules: text statistics, and robust multivariate outliers by the minimum covariance determinant.

Everything is built from DataFrame functions. Statistics are whole-text array expressions; the minimum-covariance
estimates of each (language, source) are rounds of grouped sums of a few numbers per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _joined(hashes: str, step: int) -> Column:
    """A hash of each entry of the column with the one ``step`` places on; the last ``step`` have no partner and stand for nothing."""
    return F.zip_with(F.col(hashes), F.slice(hashes, F.lit(step + 1), F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def _union_of(places: Column) -> Column:
    """The words covered by windows at sorted places: eight for each, less what it shares with the one before."""
    steps = F.transform(
        places, lambda p, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(places, k - 1)))
    )
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and further counts; all columns are kept.

    Null and empty texts have zeros. Counts are of whole texts.
    """
    base = docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_words", words(F.col(text)))
    base = base.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    base = base.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    # windows of eight words: pairs, pairs of pairs and pairs of these, each a column, as an expression of it would be evaluated wherever it stands
    base = base.withColumn("_pairs", _joined("_hashes", 1)).withColumn("_fours", _joined("_pairs", 2)).withColumn("_eights", _joined("_fours", 4))
    base = base.withColumn("_windows", F.slice("_eights", F.lit(1), F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0))))
    # sorted with their places, equal windows are neighbours; most texts have none, which a look at the distinct ones tells
    sorted_windows = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), sorted_windows))
    twice = F.filter(
        "_sorted",
        lambda w, k: (F.get("_sorted", k - 1)["h"] == w["h"]) & (k > 0) | F.coalesce(F.get("_sorted", k + 1)["h"] == w["h"], F.lit(False)),
    )
    base = base.withColumn("_places", F.array_sort(F.transform(twice, lambda w: w["i"]))).withColumn("_squeezed", F.translate("_text", "\x20\x09\x0a\x0b\x0c\x0d", ""))
    return base.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length("_squeezed").cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_union_of(F.col("_places")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("_hashes")).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace("_squeezed", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_squeezed", r"[\p{L}\p{N}]+", "")).cast("long").alias("n_marks"),
    )


#: A text's rates scatter by its length: their variance is that of long texts times 1 + SHORT / words.
SHORT = 100.0


#: The transformed statistics. Rates are pulled towards a usual value by a few words' weight, as short texts scatter.
def vector(w: Column | None = None) -> list[Column]:
    n = F.col("n_words").cast("double")
    chars = F.col("word_chars").cast("double")
    return [
        F.log((chars + 30.0) / (n + 6.0)),
        F.log((F.col("n_marks") + 3.0) / (chars + 60.0)),
        F.log((F.col("n_upper") + 3.0) / (chars + 60.0)),
        # distinct words follow a power of length
        F.log((F.col("n_distinct") + 6.0) / F.pow(n + 8.0, F.lit(0.85))),
        F.log((F.col("n_repeat_words") + F.col("n_dup_lines") + 2.0) / (n + 20.0)) * 0.5,
    ]


def _distance(p: int) -> Column:
    """The squared Mahalanobis distance by forward substitution with the covariance's Cholesky factor, scaled by the text's length."""
    x, centre = [F.col(f"_x{i}") for i in range(p)], [F.col(f"_m{i}") for i in range(p)]
    lower = [[F.col(f"_l{i}{k}") for k in range(i + 1)] for i in range(p)]
    solved: list[Column] = []
    for i in range(len(x)):
        rest = x[i] - centre[i]
        for k in range(i):
            rest = rest - lower[i][k] * solved[k]
        solved.append(rest / lower[i][i])
    return F.col("_w") * sum((s * s for s in solved[1:]), solved[0] * solved[0])


def _factored(sums: DataFrame, keys: list[str], p: int, floor: float) -> DataFrame:
    """From a group's weighted sums: centre, Cholesky factor column by column, and the log determinant.

    The least variance ``floor`` keeps the estimate from collapsing where a statistic is constant.
    """
    n = F.col("_n").cast("double")
    out = sums.select(
        *keys, "_n", *[(F.col(f"_s{i}") / F.col("_weight")).alias(f"_m{i}") for i in range(p)],
        *[((F.col(f"_q{i}{k}") - F.col(f"_s{i}") / F.col("_weight") * F.col(f"_s{k}")) / n + (F.lit(floor) if i == k else F.lit(0.0))).alias(f"_c{i}{k}") for i in range(p) for k in range(i + 1)],
    )
    for k in range(p):
        rest = F.col(f"_c{k}{k}")
        for j in range(k):
            rest = rest - F.col(f"_l{k}{j}") * F.col(f"_l{k}{j}")
        columns = {f"_l{k}{k}": F.sqrt(F.greatest(rest, F.lit(floor)))}
        out = out.withColumns(columns)
        below = {}
        for i in range(k + 1, p):
            rest = F.col(f"_c{i}{k}")
            for j in range(k):
                rest = rest - F.col(f"_l{i}{j}") * F.col(f"_l{k}{j}")
            below[f"_l{i}{k}"] = rest / F.col(f"_l{k}{k}")
        if below:
            out = out.withColumns(below)
    det = sum((F.log(F.col(f"_l{i}{i}")) * 2 for i in range(1, p)), F.log(F.col("_l00")) * 2)
    return out.withColumn("_det", det)


def _sums(rows: DataFrame, keys: list[str], p: int, where: Column) -> DataFrame:
    pick = lambda c: F.sum(F.when(where, c))
    return rows.groupBy(*keys).agg(
        F.sum(F.when(where, 1).otherwise(0)).alias("_n"),
        pick(F.col("_w")).alias("_weight"),
        *[pick(F.col("_w") * F.col(f"_x{i}")).alias(f"_s{i}") for i in range(p)],
        *[pick(F.col("_w") * F.col(f"_x{i}") * F.col(f"_x{k}")).alias(f"_q{i}{k}") for i in range(p) for k in range(i + 1)],
    )


def _estimate_columns(p: int) -> list[str]:
    return [f"_m{i}" for i in range(p)] + [f"_l{i}{k}" for i in range(p) for k in range(i + 1)]


def _sent(groups: DataFrame, most: int = 100_000) -> DataFrame:
    """A table with a row for each group, counted, and sent to all executors if there are at most ``most``.

    So a hot group's rows stay where they are. With more groups they are joined by a shuffle, which splits hot keys.
    """
    groups = written(groups, "groups")
    return F.broadcast(groups) if groups.count() <= most else groups


def _measured(rows: DataFrame, fits: DataFrame, keys: list[str], p: int) -> DataFrame:
    return rows.join(_sent(fits.select(*keys, *_estimate_columns(p))), keys).withColumn("_d", _distance(p)).drop(*_estimate_columns(p))


def chi_square_quantile(share: float, p: int) -> float:
    """By bisection on the regularised lower incomplete gamma function's series."""

    def below(x: float) -> float:
        a, term, total = p / 2, 1 / (p / 2), 1 / (p / 2)
        for k in range(1, 2000):
            term *= (x / 2) / (a + k)
            total += term
        return total * math.exp(-x / 2 + a * math.log(x / 2) - math.lgamma(a))

    low, high = 1e-9, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < share else (low, mid)
    return high


def mcd_outliers(
    docs: DataFrame,
    keep_share: float = 0.75,
    quantile: float = 1 - 1e-12,
    rounds: int = 8,
    floor: float = 1e-3,
    least_group: int = 60,
    key: str = "doc_id",
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Rejects documents whose statistics lie far from the bulk of their language and source.

    For each (lang, source), the minimum covariance determinant: from the medians and median deviations, concentration
    steps take the ``keep_share`` of rows nearest by Mahalanobis distance and estimate centre and covariance
    from them anew, which lowers the determinant each time, until it moves in no group, or ``rounds`` are done. Short texts' rates scatter, so a row's
    deviations are scaled by its length (``SHORT``) in estimates and distances alike. Distances are scaled so that their median is that of a
    chi-square with as many degrees as statistics; a document goes beyond that distribution's ``quantile``, which lies far out as texts' tails are heavier. Groups with
    fewer than ``least_group`` rows use their language's estimate, and languages with as few that of all rows.

    Documents that fail the base rules (under 20 words, or over 30 % of words in repeated windows) are rejected and
    take no part in the estimates.

    Returns all columns of docs, the statistics, base_failed, distance (squared, scaled; null where base_failed) and kept.
    Null lang or source: a group of their own. Null or empty text: base_failed. Repeated rows are judged alike
    and count once in the estimates, so that copies don't draw them in. No rows: no rows. Columns of docs with a statistic's name are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_marks", "base_failed", "distance", "kept"]
    plain = docs.drop(*[c for c in made if c in docs.columns])
    stats = text_statistics(plain, text).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return verdicts(stats, keep_share, quantile, rounds, floor, least_group, lang, source)


def verdicts(stats: DataFrame, keep_share: float, quantile: float, rounds: int, floor: float, least_group: int, lang: str, source: str) -> DataFrame:
    """Adds distance and kept to rows with the statistics and base_failed."""
    v = vector()
    p = len(v)
    stats = written(stats.withColumns({f"_x{i}": c for i, c in enumerate(v)} | {"_w": F.col("n_words") / (F.col("n_words") + SHORT), "_lang": F.coalesce(lang, F.lit("\x00")), "_source": F.coalesce(source, F.lit("\x00"))}), "statistics")
    xs = [f"_x{i}" for i in range(p)]
    good = stats.where("NOT base_failed").select("_lang", "_source", "_w", *xs).distinct()
    # small groups use a wider one's estimate; counts are a row for each group
    counts = good.groupBy("_lang", "_source").agg(F.count("*").alias("_rows"))
    by_lang = counts.groupBy("_lang").agg(F.sum("_rows").alias("_lang_rows"))
    level = F.when(F.col("_rows") >= least_group, 2).when(F.col("_lang_rows") >= least_group, 1).otherwise(0)
    levels = written(counts.join(by_lang, "_lang").select("_lang", "_source", level.alias("_level")), "levels")
    used = levels.select("_level").distinct()
    scoped = (
        good.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in range(3)])))
        .join(F.broadcast(used), "_level", "left_semi")  # three rows at most
        .select(
            F.when(F.col("_level") >= 1, F.col("_lang")).otherwise("").alias("_a"), F.when(F.col("_level") == 2, F.col("_source")).otherwise("").alias("_b"), "_level", "_w", *xs
        )
    )
    keys = ["_level", "_a", "_b"]

    centres = scoped.groupBy(*keys).agg(*[F.percentile_approx(x, 0.5, 2000).alias(f"_m{i}") for i, x in enumerate(xs)])
    spread = scoped.join(_sent(centres), keys).groupBy(*keys).agg(
        *[F.first(f"_m{i}").alias(f"_m{i}") for i in range(p)], *[F.percentile_approx(F.abs(F.col(f"_x{i}") - F.col(f"_m{i}")) * F.sqrt("_w"), 0.5, 2000).alias(f"_v{i}") for i in range(p)]
    )
    scale = 1.4826  # a normal's deviation over its median deviation
    fits = written(
        spread.select(
            *keys, *[f"_m{i}" for i in range(p)],
            *[(F.greatest(F.col(f"_v{i}") * scale, F.lit(math.sqrt(floor))) if i == k else F.lit(0.0)).alias(f"_l{i}{k}") for i in range(p) for k in range(i + 1)],
        ),
        "fits",
    )
    fits = fits.withColumn("_det", F.lit(math.inf))
    for _ in range(rounds):
        near = _measured(scoped, fits, keys, p)
        cuts = near.groupBy(*keys).agg(F.percentile_approx("_d", keep_share, 2000).alias("_cut"))
        last, fits = fits, written(_factored(_sums(near.join(_sent(cuts), keys), keys, p, F.col("_d") <= F.col("_cut")), keys, p, floor).select(*keys, *_estimate_columns(p), "_det"), "fits")
        moved = fits.join(last.select(*keys, F.col("_det").alias("_last")), keys).where(F.abs(F.col("_det") - F.col("_last")) > 1e-6)
        if moved.isEmpty():
            break
    middles = _measured(scoped, fits, keys, p).groupBy(*keys).agg(F.percentile_approx("_d", 0.5, 2000).alias("_middle"))
    fits = written(fits.join(middles, keys), "fits")

    home = F.when(F.col("_level") >= 1, F.col("_lang")).otherwise(""), F.when(F.col("_level") == 2, F.col("_source")).otherwise("")
    mapped = written(levels.select("_lang", "_source", "_level", home[0].alias("_a"), home[1].alias("_b")).join(fits, keys).drop(*keys), "fits")
    scaled = F.when(~F.col("base_failed"), _distance(p) / F.greatest(F.col("_middle"), F.lit(1e-6)) * chi_square_quantile(0.5, p))
    out = stats.join(_sent(mapped), ["_lang", "_source"], "left").withColumn("distance", scaled)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi_square_quantile(quantile, p)))
    return out.select(*[c for c in stats.columns if not c.startswith("_")], "distance", "kept")
