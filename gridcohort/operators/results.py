"""Coefficient tables: bounds, significance, views, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .features import add_group_share

LEVEL_NAMES = {0.1: "p10", 0.05: "p05", 0.01: "p01"}
# Two-sided normal critical values of the three levels.
CRITICAL = {0.1: 1.6448536269514722, 0.05: 1.959963984540054, 0.01: 2.5758293035489004}
MIN_SAMPLE = 100_000


def confidence_bounds(coefs: DataFrame, critical_value: float = 1.96) -> DataFrame:
    """``lower``, ``upper`` and whether both share a sign."""
    half = F.lit(critical_value) * F.col("se")
    bounded = coefs.withColumns({"lower": F.col("coef") - half, "upper": F.col("coef") + half})
    same = (F.col("lower") > 0) | (F.col("upper") < 0)
    return bounded.withColumn("significant", F.coalesce(same, F.lit(False)))


def zero_nonsignificant(coefs: DataFrame) -> DataFrame:
    """Coefficient 0 where the bounds lie on both sides of zero; unknown bounds keep it."""
    across = (F.col("lower") < 0) & (F.col("upper") > 0)
    return coefs.withColumn("coef", F.when(across, 0.0).otherwise(F.col("coef")))


def flip_sign(coefs: DataFrame, where: Column) -> DataFrame:
    """Negate the chosen rows and swap their bounds."""
    swap = {
        "coef": F.when(where, -F.col("coef")).otherwise(F.col("coef")),
        "lower": F.when(where, -F.col("upper")).otherwise(F.col("lower")),
        "upper": F.when(where, -F.col("lower")).otherwise(F.col("upper")),
    }
    return coefs.withColumns(swap)


def significance_summary(
    coefs: DataFrame, by: Sequence[str], levels: Sequence[float] = (0.1, 0.05, 0.01), set_by: Sequence[str] | None = None
) -> DataFrame:
    """Per specification: estimates, significant ones by level and sign, consistency of sign, and,
    with ``set_by``, totals of the wider set with their share of all its estimates."""
    size = F.abs(F.try_divide("coef", "se"))
    counts = [F.count("coef").alias("estimates")]
    names = []
    for level in levels:
        hit = size > CRITICAL[level]
        for sign, side in (("pos", F.col("coef") > 0), ("neg", F.col("coef") < 0)):
            names.append(f"{LEVEL_NAMES[level]}_{sign}")
            counts.append(F.count_if(hit & side).alias(names[-1]))
    out = coefs.groupBy(*by).agg(*counts)
    return finish_summary(out, names, set_by)


def finish_summary(counts: DataFrame, names: Sequence[str], set_by: Sequence[str] | None = None) -> DataFrame:
    """Consistency flags (no significant negative at the level), then set totals and shares."""
    flags = {f"consistent_{n[:-4]}": F.col(n) == 0 for n in names if n.endswith("_neg")}
    out = counts.withColumns(flags)
    return add_group_share(out, set_by, list(names), "estimates") if set_by else out


def harmonize_extremes(term: Column | str) -> Column:
    """Day-count terms under the names of the temperature terms: hot is the positive side."""
    t = F.col(term) if isinstance(term, str) else term
    side = F.when(t.rlike("^hd(35|40)_"), F.concat(t, F.lit("_pos_int"))).when(
        t.rlike("^(fd|id)_"), F.concat(t, F.lit("_neg_int"))
    )
    return F.regexp_replace(F.coalesce(side, t), r"^(hd35|hd40|fd|id)_", "t_")


# Term prefixes of the two exposure kinds.
SPI_PREFIXES = ("spi1_", "spi3_", "spi6_", "spi9_", "spi12_", "spi24_", "spi48_")
TEMP_PREFIXES = ("stdm_t_", "absdifm_t_", "absdif_t_", "std_t_", "t_")
EXTREME_PREFIXES = ("hd35_", "hd40_", "fd_", "id_")


def _starts(prefixes: Sequence[str]) -> str:
    return "^(" + "|".join(prefixes) + ")"


def with_term_parts(coefs: DataFrame, term: str = "term") -> DataFrame:
    """``kind`` (spi, temp or extreme) and ``key``: the term without its variable."""
    t = F.col(term)
    kind = (
        F.when(t.rlike(_starts(SPI_PREFIXES)), "spi")
        .when(t.rlike(_starts(EXTREME_PREFIXES)), "extreme")
        .when(t.rlike(_starts(TEMP_PREFIXES)), "temp")
    )
    key = F.regexp_replace(harmonize_extremes(t), _starts((*SPI_PREFIXES, *TEMP_PREFIXES)), "")
    return coefs.withColumns({"kind": kind, "key": key})


def coefficient_view(
    coefs: DataFrame, view: str, min_n: int | None = None, cell_level: int = 1, critical_value: float = 1.96
) -> DataFrame:
    """Regrouped coefficients with bounds.

    ``horserace``: standard and extreme estimates of a key side by side; ``heterogeneity``: one row
    per key and group with at least ``min_n`` (by default MIN_SAMPLE) records; ``window``: the window length split off the
    key; ``model``: one row per outcome, cell levels side by side.
    """
    parts = with_term_parts(confidence_bounds(coefs, critical_value)).filter(F.col("kind").isNotNull())
    if view == "heterogeneity" and min_n is None:
        min_n = MIN_SAMPLE
    if min_n is not None:
        parts = parts.filter(F.col("n") >= min_n)
    estimate = F.struct("coef", "se", "lower", "upper")
    if view == "model":
        wide = [F.max(F.when(F.col("cell_level") == i, estimate)).alias(f"cell{i}") for i in (1, 2, 3)]
        return parts.groupBy("spec_id", "outcome", "kind", "key").agg(*wide)
    level = parts.filter(F.col("cell_level") == cell_level)
    if view == "horserace":
        side = F.when(F.col("kind") == "extreme", "extreme").otherwise("standard")
        shown = F.when(F.col("kind") == "spi", "spi").otherwise("temp")
        return (
            level.withColumns({"side": side, "kind": shown})
            .groupBy("spec_id", "outcome", "kind", "key")
            .agg(*[F.max(F.when(F.col("side") == s, estimate)).alias(s) for s in ("standard", "extreme")])
        )
    if view == "heterogeneity":
        return level.filter(F.col("group_value").isNotNull()).select(
            "spec_id", "outcome", "kind", "key", "group_var", "group_value", "coef", "se", "lower", "upper", "n"
        )
    if view == "window":
        window = F.regexp_extract("key", r"_(avg|max|min|w\d+)(?:_|$)", 1)
        return level.withColumns({"window": window, "key": F.regexp_replace("key", r"_(avg|max|min|w\d+)(?=_|$)", "")}).select(
            "spec_id", "outcome", "kind", "key", "window", "coef", "se", "lower", "upper", "n"
        )
    raise ValueError(f"unknown view {view}")


def country_comparison(coefs: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """Significant coefficients by country, others null; optionally only listed countries."""
    if countries is not None:
        coefs = coefs.join(countries, "country", "left_semi")
    return coefs.withColumn("coef", F.when(F.col("significant"), F.col("coef"))).select(
        "country", "term", "spec_id", "coef"
    )


def parse_spec_name(df: DataFrame, col: str) -> DataFrame:
    """Columns read from a report name such as ``version 3 drought 2_5 12 months - Decade - controls.tex``.

    ``name`` parts are separated by `` - ``: the specification words, an optional fixed-effects
    part and an optional controls part.
    """
    name = F.regexp_replace(F.col(col), r"\.tex$", "")
    parts = F.split(name, " - ")
    has_controls = F.element_at(parts, -1).contains("controls")
    rest = F.when(has_controls, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    has_effects = F.element_at(rest, -1).rlike("Decade|No Trend|Country FE")
    words = F.split(F.trim(parts[0]), " ")
    version = F.get(words, F.lit(1))

    def word(*at: int) -> Column:
        """Word at a position by version: 1 and 2 share one layout, then 3, then 4."""
        a, b, c = at
        return F.when(version.isin("1", "2"), F.get(words, F.lit(a))).when(
            version == "3", F.get(words, F.lit(b))
        ).when(version == "4", F.get(words, F.lit(c)))

    threshold = F.when(version.isin("1", "2"), F.lit(" - ")).otherwise(
        F.concat(F.regexp_replace(F.get(words, F.lit(4)), "_", "."), F.lit(" SD"))
    )
    return df.withColumns(
        {
            "version": version,
            "threshold": threshold,
            "spi_months": word(2, 3, 3),
            "aggregation": F.when(version == "3", "min-max").otherwise(word(3, 3, 6)),
            "temperature": word(4, 5, 5),
            "fixed_effects": F.when(has_effects, F.element_at(rest, -1)).otherwise("Standard FE"),
            "controls": F.when(has_controls, F.element_at(parts, -1)).otherwise("Standard Controls"),
            "subset": F.lit("Last 10 years & from 2003"),
            "country": F.nullif(F.regexp_extract(F.col(col), r"([A-Z]{3})", 1), F.lit("")),
        }
    )
