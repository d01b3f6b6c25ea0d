"""Explanations: linear Shapley (X1), top factors (X3/X4), global
importance (X5), attribution with values (X7), sampled Shapley for any
Spark ML model (X2), fallback text (X6).

Attributions are kept per row as 21 columns ``phi_<feature>`` (a projection,
no shuffle); the long (CustomerId, feature, feature_index, phi) form is an
``explode`` of that row.  Top-k per customer sorts a 21-element array inside
the row, so it never groups or shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import feature_label
from ..functions.scorecard import TERM_FEATURES, scorecard_terms
from ..schema import FEATURES, SCORECARD_WEIGHTS

PHI_DIGITS = 6


def phi_col(feature: str) -> str:
    return f"phi_{feature}"


def _term_means(df: DataFrame, terms: dict[str, Column]) -> DataFrame:
    """One-row background: mean of each 0/1 term (integer sum / count)."""
    return df.agg(*[(F.sum(t).cast("double") / F.count(F.lit(1))).alias(f"m_{n}") for n, t in terms.items()])


def term_means(background: DataFrame) -> DataFrame:
    """One-row table of scorecard term means over a background table."""
    return _term_means(background, scorecard_terms())


def scorecard_shapley(feat: DataFrame, background: DataFrame | None = None,
                      means: DataFrame | None = None) -> DataFrame:
    """X1 on the scorecard: for an additive model the interventional Shapley
    value is w * (x - E[x]) per term; terms are summed per attributed feature.
    Features the scorecard ignores get 0.  ``background`` defaults to ``feat``;
    precomputed ``means`` (see :func:`term_means`) skip that aggregate.
    The background means are one row, joined as a broadcast."""
    terms = scorecard_terms()
    if means is None:
        means = _term_means(background if background is not None else feat, terms)
    j = feat.crossJoin(F.broadcast(means))
    phis = {}
    for feature in FEATURES:
        expr = None
        for n in TERM_FEATURES.get(feature, []):
            part = F.lit(SCORECARD_WEIGHTS[n]) * (terms[n] - F.col(f"m_{n}"))
            expr = part if expr is None else expr + part
        phis[feature] = F.bround(expr, PHI_DIGITS) if expr is not None else F.lit(0.0)
    return j.select(*feat.columns, *[v.alias(phi_col(k)) for k, v in phis.items()])


def feature_means(background: DataFrame, features: list[str] = FEATURES) -> dict[str, float]:
    """Background means, one row."""
    return background.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in features]).first().asDict()


def linear_shapley(df: DataFrame, weights: dict[str, float], background: DataFrame | None = None,
                   features: list[str] = FEATURES, means: dict[str, float] | None = None) -> DataFrame:
    """X1 for any linear model on raw features: phi_j = w_j (x_j - mean_j)."""
    if means is None:
        means = feature_means(background if background is not None else df, features)
    return df.select(*df.columns, *[
        F.bround(F.lit(float(weights.get(c, 0.0))) * (F.col(c) - F.lit(means[c])), PHI_DIGITS).alias(phi_col(c))
        for c in features])


def _phi_array(features: list[str] = FEATURES) -> Column:
    return F.array(*[F.struct(F.abs(F.col(phi_col(f))).alias("abs_phi"), F.lit(i).alias("feature_index"),
                              F.lit(f).alias("feature"), F.col(phi_col(f)).alias("phi"))
                     for i, f in enumerate(features)])


def long_attributions(att: DataFrame, id_col: str = "CustomerId", features: list[str] = FEATURES) -> DataFrame:
    """(id, feature, feature_index, phi) - one row per customer and feature."""
    return (att.select(F.col(id_col), F.explode(_phi_array(features)).alias("s"))
            .select(id_col, "s.feature", "s.feature_index", "s.phi"))


def top_k(att: DataFrame, k: int = 3, id_col: str = "CustomerId", with_magnitude: bool = True,
          features: list[str] = FEATURES) -> DataFrame:
    """The k largest |phi| per row (ties: higher feature index first),
    long form with rank and display text.  ``with_magnitude`` adds the
    3-decimal magnitude as in the batch explainer; the serving form omits it."""
    ranked = F.slice(F.sort_array(_phi_array(features), asc=False), 1, k)
    rows = att.select(F.col(id_col), F.posexplode(ranked).alias("pos", "s"))
    direction = F.when(F.col("s.phi") > 0, "increases").otherwise("decreases")
    label = feature_label(F.col("s.feature"))
    text = (F.format_string("%s (%s risk, magnitude=%.3f)", label, direction, F.bround(F.col("s.abs_phi"), 3))
            if with_magnitude else F.format_string("%s (%s risk)", label, direction))
    return rows.select(id_col, (F.col("pos") + 1).alias("rank"), F.col("s.feature").alias("feature"),
                       F.col("s.feature_index").alias("feature_index"), F.col("s.phi").alias("phi"),
                       text.alias("factor"))


def factor_texts(attributions: Column, k: int = 3, with_magnitude: bool = False) -> Column:
    """X3 array form: display texts of the k top entries of an array of
    (abs_phi, feature_index, feature, phi)."""
    def text(s):
        direction = F.when(s["phi"] > 0, "increases").otherwise("decreases")
        if with_magnitude:
            return F.format_string("%s (%s risk, magnitude=%.3f)", feature_label(s["feature"]), direction,
                                   F.bround(s["abs_phi"], 3))
        return F.format_string("%s (%s risk)", feature_label(s["feature"]), direction)
    return F.transform(F.slice(F.sort_array(attributions, asc=False), 1, k), text)


def factor_array(k: int = 3, with_magnitude: bool = False, features: list[str] = FEATURES) -> Column:
    """The k top factors' display texts of a row with ``phi_`` columns."""
    return factor_texts(_phi_array(features), k, with_magnitude)


def contributions(k: int = 10, features: list[str] = FEATURES) -> Column:
    """X4 array form: the k largest |phi| of a row with ``phi_`` columns, as
    (feature, phi), largest first."""
    return F.transform(F.slice(F.sort_array(_phi_array(features), asc=False), 1, k),
                       lambda s: F.struct(s["feature"].alias("feature"), s["phi"].alias("phi")))


def factors_of(long_phi: DataFrame, k: int = 3, id_col: str = "CustomerId") -> DataFrame:
    """(id, top_risk_factors) from the long form; a row's group is its features."""
    entry = F.struct(F.abs(F.col("phi")).alias("abs_phi"), "feature_index", "feature", "phi")
    return long_phi.groupBy(id_col).agg(factor_texts(F.collect_list(entry), k).alias("top_risk_factors"))


# The factor list returned when no attribution is available
FALLBACK_FACTORS = ["SHAP not available"]


def with_fallback(scored: DataFrame, factors: DataFrame | None, id_col: str = "CustomerId") -> DataFrame:
    """Rows without an attribution get the one-element fallback list."""
    fallback = F.array(*[F.lit(x) for x in FALLBACK_FACTORS])
    if factors is None:
        return scored.withColumn("top_risk_factors", fallback)
    j = scored.join(factors, id_col, "left")
    return j.withColumn("top_risk_factors", F.coalesce(F.col("top_risk_factors"), fallback))


def global_importance(att: DataFrame, k: int = 15, features: list[str] = FEATURES) -> DataFrame:
    """Mean |phi| per feature in one aggregate (no explode, no shuffle of
    rows), unpivoted; top k, ties by feature order."""
    row = att.agg(*[F.avg(F.abs(F.col(phi_col(f)))).alias(f"i{i}") for i, f in enumerate(features)])
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("feature_index"),
                             F.bround(F.col(f"i{i}"), 6).alias("mean_abs_shap")) for i, f in enumerate(features)])
    return (row.select(F.explode(arr).alias("s")).select("s.*")
            .orderBy(F.col("mean_abs_shap").desc(), F.col("feature_index")).limit(k))


def attribution_values(att: DataFrame, k: int = 15, id_col: str = "CustomerId",
                       features: list[str] = FEATURES) -> DataFrame:
    """(id, feature, value, phi) for the top-k features by importance
    (the data behind the beeswarm figure).  The k feature names come from a
    <= 21-row table, joined as a broadcast semi-join."""
    vals = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                              F.col(phi_col(f)).alias("phi")) for f in features])
    long = att.select(F.col(id_col), F.explode(vals).alias("s")).select(id_col, "s.feature", "s.value", "s.phi")
    top = global_importance(att, k, features).select("feature")
    return long.join(F.broadcast(top), "feature", "left_semi")


# X2 ------------------------------------------------------------------------
def _hash(*parts) -> Column:
    """Seeded order key that any engine can rebuild: md5 of the parts, ':'-joined."""
    return F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def background_rows(background: DataFrame, features: list[str], size: int, seed: int, id_col: str) -> DataFrame:
    """(bidx, bvec): the ``size`` rows with the smallest seeded hash of their id,
    fewer if the table has fewer (a sampling operator; its size is the bound).
    A stored sample (``background_sample``) is taken as it is."""
    if {"bidx", "bvec"} <= set(background.columns):
        return background.select("bidx", "bvec")
    picked = (background.select(F.col(id_col), *[F.col(f).cast("double").alias(f) for f in features])
              .withColumn("_h", _hash(id_col, F.lit(seed))).orderBy("_h", id_col).limit(size))
    return picked.select((F.row_number().over(Window.orderBy("_h", id_col)) - 1).cast("int").alias("bidx"),
                         F.array(*[F.col(f) for f in features]).alias("bvec"))


def background_sample(background: DataFrame, model_name: str, features: list[str] = FEATURES, size: int = 64,
                      seed: int = 42, id_col: str = "CustomerId") -> DataFrame:
    """S8 for a model that isn't linear: the background rows that X2 draws from,
    with the features they stand for.  Stored beside the model, it explains it
    without the training table."""
    return background_rows(background, features, size, seed, id_col).select(
        F.lit(model_name).alias("model_name"), F.lit(features).alias("features"), "bidx", "bvec")


def sampled_paths(rows: DataFrame, background: DataFrame, features: list[str], permutations: int,
                  background_size: int, seed: int, id_col: str) -> DataFrame:
    """(id, pair, k, xvec, bvec, perm): each row once per permutation, in pairs: one
    background row and one feature order drawn by hash, and the same order
    backwards (k = 1).  An odd number of permutations is rounded up.  The draw is
    modulo the number of background rows there are, so every row has a path."""
    bg = background_rows(background, features, background_size, seed, id_col)
    found = bg.count()                                     # <= background_size
    if not found:
        raise ValueError("sampled_shapley needs at least one background row")
    draw = F.pmod(F.conv(F.substring(_hash(id_col, "pair", F.lit(seed)), 1, 8), 16, 10).cast("long"), F.lit(found)).cast("int")
    pairs = (rows.select(F.col(id_col), F.array(*[F.col(f).cast("double") for f in features]).alias("xvec"))
             .withColumn("pair", F.explode(F.sequence(F.lit(0), F.lit((permutations + 1) // 2 - 1)))).withColumn("bidx", draw))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(len(features) - 1)),
                                     lambda j: F.struct(_hash(id_col, "pair", j, F.lit(seed + 1)).alias("h"), j.alias("j"))))
    drawn = (pairs.join(F.broadcast(bg), "bidx")
             .select(id_col, "pair", "xvec", "bvec", F.transform(order, lambda s: s["j"]).alias("_drawn")))
    return drawn.select(id_col, "pair", "xvec", "bvec", F.posexplode(F.array("_drawn", F.reverse("_drawn"))).alias("k", "perm"))


def sampled_shapley(model, rows: DataFrame, background: DataFrame, features: list[str] = FEATURES,
                    permutations: int = 4, background_size: int = 64, seed: int = 42,
                    id_col: str = "CustomerId", digits: int | None = PHI_DIGITS) -> DataFrame:
    """Permutation-sampled Shapley values of a fitted Spark ML pipeline
    (probability of class 1) or of any scoring function (DataFrame -> DataFrame
    with a column ``f``), with their standard errors.

    A path leads from a drawn background row to the row, switching one feature
    after another; all its points are scored in one pass.  The step that
    switches feature j contributes f(after) - f(before): each scored point adds
    +f to the feature just switched and -f to the one switched next, so the sum
    per (row, feature) needs no order and is partially aggregated where the
    points are made.  Over the features of a row, phi adds up to the mean of
    f(row) - f(background) over its paths.

    Paths come in antithetic pairs; a pair's two contributions to a feature are
    averaged, and ``stderr`` is the standard error of the mean over the pairs
    (null with one pair): with n times the permutations expect it to shrink by
    the root of n.  The rows are dealt out by id before they are multiplied, so
    both sums stay in place."""
    from pyspark.ml.functions import vector_to_array

    nf = len(features)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = sampled_paths(rows.repartition(tasks, id_col), background, features, permutations, background_size, seed, id_col)
    steps = paths.select(id_col, "pair", "xvec", "bvec", "perm", F.explode(F.sequence(F.lit(0), F.lit(nf))).alias("step"))
    switched = F.slice("perm", F.lit(1), F.col("step"))
    point = F.transform(F.sequence(F.lit(0), F.lit(nf - 1)),
                        lambda j: F.when(F.array_contains(F.col("_on"), j), F.get("xvec", j)).otherwise(F.get("bvec", j)))
    pts = steps.withColumn("_on", switched).withColumn("_point", point)
    pts = pts.select(id_col, "pair", F.get("perm", F.col("step") - 1).alias("_now"), F.get("perm", F.col("step")).alias("_next"),
                     *[F.get("_point", F.lit(i)).alias(f) for i, f in enumerate(features)])
    if hasattr(model, "transform"):
        scored = model.transform(pts).select(id_col, "pair", "_now", "_next", vector_to_array(F.col("probability"))[1].alias("f"))
    else:
        scored = model(pts).select(id_col, "pair", "_now", "_next", "f")
    parts = F.array_compact(F.array(F.when(F.col("_now").isNotNull(), F.struct(F.col("_now").alias("j"), F.col("f").alias("v"))),
                                    F.when(F.col("_next").isNotNull(), F.struct(F.col("_next").alias("j"), (-F.col("f")).alias("v")))))
    of_pair = (scored.select(id_col, "pair", F.explode(parts).alias("s")).groupBy(id_col, F.col("s.j").alias("feature_index"), "pair")
               .agg((F.sum("s.v") / 2).alias("v")))
    sums = (of_pair.groupBy(id_col, "feature_index")
            .agg(F.avg("v").alias("phi"), F.when(F.count("*") > 1, F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("stderr")))
    names = F.array(*[F.lit(f) for f in features])

    def shown(c: str) -> Column:
        return (F.col(c) if digits is None else F.bround(c, digits) + F.lit(0.0)).alias(c)

    return sums.select(id_col, F.get(names, F.col("feature_index")).alias("feature"), "feature_index", shown("phi"), shown("stderr"))
