"""Model specifications and the stacked runs behind them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import day_count_bins, negative_part, positive_part
from ..operators.cohort import survivors
from ..operators.features import AGE_BINS, parse_feature
from ..operators.joins import skew_join
from ..operators.quantiles import long_values, many_quantiles, outside_quantiles, quantile_table
from ..operators.regression import fe_models
from ..operators.stacked import Model
from ..session import materialize

# Period lists of the standard runs, with the exposure scheme and the age bins of the outcome.
SEMESTER = ("inutero", "born_1m6m", "born_6m12m", "born_12m18m", "born_18m24m", "born_24m30m", "born_30m36m")
QUARTERLY = ("inutero_1m3m", "inutero_3m6m", "inutero_6m9m", "born_1m3m", "born_3m6m", "born_6m9m", "born_9m12m")
MONTHLY = tuple([f"inutero_{i}m" for i in range(1, 10)] + [f"born_{i}m" for i in range(1, 7)])
IUFOCUS = ("inutero_1m3m", "inutero_3m6m", "inutero_6m9m", "born_1m", "born_2m3m", "born_3m6m")
CONTROLS = (
    "child_fem", "child_mulbirth", "birth_order", "rural",
    "d_weatlh_ind_2", "d_weatlh_ind_3", "d_weatlh_ind_4", "d_weatlh_ind_5",
    "mother_ageb", "mother_ageb_squ", "mother_ageb_cub",
    "mother_eduy", "mother_eduy_squ", "mother_eduy_cub",
)

QUARTILES = (0.25, 0.5, 0.75)
FAMILIES = ("linear", "quadratic", "spline", "extremes", "horserace")


@dataclass(frozen=True)
class ModelSpec:
    """One family of models over a list of life periods.

    ``signs`` splits each exposure into its positive and negative part. Extremes use the day
    counts ``hot`` and ``cold`` (``binned``: as range dummies) in place of the temperature,
    horse-race models use both. ``cut`` sets the spline limits: sample quartiles, or one
    standard deviation around zero.
    """

    periods: tuple[str, ...] = SEMESTER
    drought: str | None = "spi1"
    temp: str | None = "stdm_t"
    scheme: str = "b"
    stat: str = "avg"
    family: str = "linear"
    signs: bool = True
    hot: str = "hd35"
    cold: str = "fd"
    binned: bool = False
    cut: str = "quartile"
    controls: tuple[str, ...] = CONTROLS
    cells: tuple[str, ...] = ("ID_cell1", "ID_cell2", "ID_cell3")
    trend: str = "linear"
    month: str = "chb_month"
    year: str = "chb_year"
    age: str = "child_agedeath"
    age_scheme: str = "biannual"
    min_survival: int | None = None

    def __post_init__(self):
        if self.family not in FAMILIES or self.cut not in ("quartile", "sd"):
            raise ValueError(f"unknown family or cut in {self}")

    @property
    def spec_id(self) -> str:
        parts = [self.family, "signs" if self.signs else "plain"]
        parts += [v for v in (self.drought, self.temp, self.scheme, self.stat) if v]
        if self.family in ("extremes", "horserace"):
            parts.append(self.hot + self.cold + ("bins" if self.binned else ""))
        if self.family == "spline":
            parts.append(self.cut)
        if self.min_survival is not None:
            parts.append(f"from{self.min_survival}")
        return " ".join([*parts, self.trend])

    def exposure(self, var: str, period: str) -> str:
        return f"{var}_{period}_{self.scheme}_{self.stat}"

    def outcome(self, period: str) -> str:
        """Event dummy of a period: from the age scheme, or from another one that has its label."""
        label = period.removeprefix("born_")
        scheme = next((s for s in (self.age_scheme, *AGE_BINS) if label in AGE_BINS[s][1]), None)
        if scheme is None:
            raise ValueError(f"no age bin for {period}")
        return f"{self.age}_{scheme}_{label}"

    @property
    def before(self) -> tuple[str, ...]:
        return tuple(p for p in self.periods if p.startswith("inutero"))

    @property
    def steps(self) -> tuple[str, ...]:
        return tuple(p for p in self.periods if not p.startswith("inutero"))

    @property
    def variables(self) -> list[str]:
        extreme = [self.hot, self.cold]
        chosen = {
            "extremes": [self.drought, *extreme],
            "horserace": [self.drought, self.temp, *extreme],
        }.get(self.family, [self.drought, self.temp])
        return [v for v in chosen if v]


def required_columns(spec: ModelSpec, columns: Sequence[str]) -> list[str]:
    """Columns a specification reads, by parsed name; raises for one that is missing."""
    exposures = [spec.exposure(v, p) for v in spec.variables for p in spec.periods]
    needed = [
        *exposures,
        *[spec.outcome(p) for p in spec.steps],
        *spec.controls,
        *spec.cells,
        spec.month,
        spec.year,
        *([spec.age] if spec.min_survival is not None else []),
    ]
    missing = [c for c in dict.fromkeys(needed) if c not in columns]
    if missing:
        known = sorted({p.var for p in map(parse_feature, columns) if p})
        raise ValueError(f"columns missing: {missing}; exposure variables present: {known}")
    return list(dict.fromkeys(needed))


def model_frame(
    df: DataFrame, spec: ModelSpec, where: Column | None = None, plus: Sequence[str] = ()
) -> DataFrame:
    """Pruned and filtered input of a specification."""
    if where is not None:
        df = df.filter(where)
    if spec.min_survival is not None:
        df = survivors(df, spec.age, spec.min_survival)
    return df.select(*dict.fromkeys([*required_columns(spec, df.columns), *plus]))


# --- terms -----------------------------------------------------------------


def spline_edges(sample: DataFrame, columns: dict[str, Column], cut: str) -> dict[str, list[float]]:
    """Three limits per column: its quartiles, or minus, zero and plus one standard deviation."""
    if cut == "quartile":
        return many_quantiles(sample, columns, QUARTILES)
    row = sample.agg(*[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns.values())]).first()
    return {name: [-row[f"s{i}"], 0.0, row[f"s{i}"]] for i, name in enumerate(columns)}


def grouped_edges(sample: DataFrame, columns: dict[str, Column], cut: str, group: str) -> DataFrame:
    """(group, _edges): the limits of each column in each group, as a map by name. A column without
    values in a group has no entry."""
    values = long_values(sample, columns, [group])
    if cut == "quartile":
        edges = quantile_table(values, [group, "name"], QUARTILES)
    else:
        sd = F.stddev_samp("v")
        edges = values.groupBy(group, "name").agg(F.array(-sd, F.lit(0.0), sd).alias("edges")).filter("edges[2] IS NOT NULL")
    return edges.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("name", "edges"))).alias("_edges"))


def spline_terms(name: str, edges: Sequence[float] | Column) -> dict[str, Column]:
    """Value times bin: q1 below the first edge, q2 up to the middle one with both ends, q3 up to
    the last edge, q4 above. Null stays null; where there are no edges, because the column has no
    values, all terms are zero and drop out as collinear."""
    if isinstance(edges, Column):
        known, (low, mid, high) = edges.isNotNull(), (F.get(edges, F.lit(i)) for i in range(3))
    else:
        known, (low, mid, high) = F.lit(all(e == e for e in edges)), (F.lit(float(e)) for e in edges)
    x = F.col(name)
    inside = {
        "q4": x > high,
        "q3": (x > mid) & (x <= high),
        "q2": (x >= low) & (x <= mid),
        "q1": x < low,
    }
    return {
        f"{name}_{q}_int": F.when(~known, 0.0).when(x.isNotNull(), F.when(c, x).otherwise(0.0)) for q, c in inside.items()
    }


def sign_terms(name: str) -> dict[str, Column]:
    return {f"{name}_neg_int": negative_part(name), f"{name}_pos_int": positive_part(name)}


def terms(spec: ModelSpec, period: str, edges: dict[str, Sequence[float] | Column] | None = None) -> dict[str, Column]:
    """Regressors of one period, by name. Nothing is written to the frame."""

    def standard(name: str) -> dict[str, Column]:
        x = F.col(name)
        if spec.family == "spline":
            return spline_terms(name, edges[name])
        if spec.family == "quadratic" and spec.signs:
            square = {
                f"{name}_sq_neg_int": F.when(x.isNotNull(), F.when(x <= 0, x * x).otherwise(0.0)),
                f"{name}_sq_pos_int": F.when(x.isNotNull(), F.when(x >= 0, x * x).otherwise(0.0)),
            }
            return {**sign_terms(name), **square}
        if spec.family == "quadratic":
            return {name: x, f"{name}_sq": x * x}
        return sign_terms(name) if spec.signs else {name: x}

    def extremes() -> dict[str, Column]:
        out = {}
        for var in (spec.hot, spec.cold):
            name = spec.exposure(var, period)
            out |= day_count_bins(name) if spec.binned else {name: F.col(name)}
        return out

    drought = spec.exposure(spec.drought, period) if spec.drought else None
    temp = spec.exposure(spec.temp, period) if spec.temp else None
    out: dict[str, Column] = {}
    if spec.family == "extremes":
        out |= sign_terms(drought) if drought else {}
    else:
        for name in (drought, temp):
            out |= standard(name) if name else {}
    return out | extremes() if spec.family in ("extremes", "horserace") else out


# --- runs ------------------------------------------------------------------

COEFFICIENTS = (
    "spec_id", "outcome", "cell_level", "term", "coef", "se", "t", "n", "r2", "n_clusters", "rank", "status", "group_var", "group_value",
)


class _Stack:
    """Variables and models of several specifications over one frame."""

    def __init__(self, df: DataFrame, group: str | None) -> None:
        self.frame = df.filter(F.col(group).isNotNull()) if group else df
        self.group = group
        self.columns: dict[str, Column] = {}
        self.models: list[Model] = []
        self.about: list[tuple[ModelSpec, str, dict[str, str]]] = []

    def add(self, spec: ModelSpec, where: Column | None = None) -> None:
        """One model per life period after birth: the outcome is the event in the period, the sample
        the records without an event before, the regressors the exposures of all periods so far."""
        required_columns(spec, self.frame.columns)
        number = len({id(s) for s, _, _ in self.about})
        steps = spec.steps
        alive = F.lit(True) if where is None else where
        if spec.min_survival is not None:
            alive = alive & (F.col(spec.age).isNull() | (F.col(spec.age) >= spec.min_survival))
        sample = []
        for period in steps:
            sample.append(alive)
            alive = alive & (F.col(spec.outcome(period)) == 0)
        entered = [(s, p) for s, period in enumerate(steps) for p in ([*spec.before, period] if s == 0 else [period])]
        edges = self._edges(spec, sample, entered, number) if spec.family == "spline" else None
        # Limits differ between specifications, so their terms are kept apart; all others are known by name.
        known = {name: f"{name}@{number}" if spec.family == "spline" else name for s, p in entered for name in terms(spec, p, edges)}
        first = {name: s for s, p in entered for name in terms(spec, p, edges)}
        self.columns |= {known[name]: column for _, p in entered for name, column in terms(spec, p, edges).items()}
        self.columns |= {c: F.col(c) for c in (*spec.controls, *(spec.outcome(p) for p in steps))}
        for s, period in enumerate(steps):
            xs = [*(known[n] for n in known if first[n] <= s), *spec.controls]
            self.models.append(Model(spec.outcome(period), tuple(xs), sample[s], tuple(enumerate(spec.cells, 1)), number))
            self.about.append((spec, spec.outcome(period), {k: n for n, k in known.items()}))

    def _edges(self, spec: ModelSpec, sample: list[Column], entered: list[tuple[int, str]], number: int) -> dict:
        # A period's terms are made before the events of the period before leave the sample, so its
        # limits come from that sample; with groups, from the group's records. All in one pass.
        seen = {spec.exposure(v, p): F.when(sample[max(s - 1, 0)], F.col(spec.exposure(v, p))) for s, p in entered for v in spec.variables}
        if not self.group:
            return spline_edges(self.frame, seen, spec.cut)
        found = materialize(grouped_edges(self.frame, seen, spec.cut, self.group)).withColumnRenamed("_edges", f"_edges{number}")
        self.frame = skew_join(self.frame, found, [self.group], "left")
        return {name: F.try_element_at(f"_edges{number}", F.lit(name)) for name in seen}

    def fit(self) -> DataFrame:
        one = self.about[0][0]
        names = {c: f"m{i}" for i, c in enumerate(self.columns)}
        cells = list(dict.fromkeys(c for m in self.models for _, c in m.cells))
        places = {c: f"c{i}" for i, c in enumerate(cells)}
        rows = self.frame.select(
            *([F.col(self.group).cast("string").alias("group_value")] if self.group else []),
            F.col(one.month).alias("month"),
            F.col(one.year).alias("year"),
            *[F.col(c).alias(n) for c, n in places.items()],
            *[c.alias(names[n]) for n, c in self.columns.items()],
            *[m.sample.alias(f"in{j}") for j, m in enumerate(self.models)],
        )
        models = [Model(names[m.y], tuple(names[x] for x in m.xs), F.col(f"in{j}"), tuple((k, places[c]) for k, c in m.cells), m.block) for j, m in enumerate(self.models)]
        by = ["group_value"] if self.group else []
        fitted = fe_models(rows, models, "month", "year", one.trend, by)
        shown = {f"m{i}": c for i, c in enumerate(self.columns)}
        label = F.create_map(*[F.lit(x) for n, c in shown.items() for x in (n, c.rpartition("@")[0] if "@" in c else c)])
        # every model has a row, also one that no record is in
        asked = F.array(*[F.struct(F.lit(j).alias("model"), F.lit(k).alias("cell_level")) for j, m in enumerate(models) for k, _ in m.cells])
        groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1)
        due = groups.select(*by, F.explode(asked).alias("m")).select(*by, "m.*")
        found = skew_join(due, fitted, [*by, "model", "cell_level"], "left")
        specs = F.array(*[F.lit(s.spec_id) for s, _, _ in self.about])
        outcomes = F.array(*[F.lit(y) for _, y, _ in self.about])
        return found.select(
            specs[F.col("model")].alias("spec_id"),
            outcomes[F.col("model")].alias("outcome"),
            "cell_level",
            label[F.col("term")].alias("term"),
            "coef", "se", "t", F.coalesce("n", F.lit(0)).alias("n"), "r2", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"),
            F.coalesce("rank", F.lit(0)).alias("rank"),
            F.coalesce("status", F.lit("no rows")).alias("status"),
            F.lit(self.group).cast("string").alias("group_var"),
            (F.col("group_value") if self.group else F.lit(None).cast("string")).alias("group_value"),
        )


def survivor_models(df: DataFrame, spec: ModelSpec, group: str | None = None, where: Column | None = None) -> DataFrame:
    """One model per life period after birth and per cell level, all in one pass.

    A column that is missing raises. A model that no record is in has one row without a term.
    """
    stack = _Stack(df, group)
    stack.add(spec, where)
    return stack.fit()


def run_specs(df: DataFrame, specs: Sequence[ModelSpec], group: str | None = None) -> DataFrame:
    """Coefficients of every specification, optionally per value of a column, with a status each.

    Specifications with the same month, year and trend share one reading of the records. One whose
    columns are missing doesn't end the run: it has one row, whose status names them.
    """
    stacks: dict[tuple, _Stack] = {}
    failed: list[tuple[str, str]] = []
    for spec in specs:
        try:
            required_columns(spec, df.columns)
        except ValueError as missing:
            failed.append((spec.spec_id, str(missing)))
            continue
        stacks.setdefault((spec.month, spec.year, spec.trend), _Stack(df, group)).add(spec)
    out = [s.fit() for s in stacks.values()]
    if failed:
        kinds = "outcome string, cell_level int, term string, coef double, se double, t double, n long, r2 double, n_clusters long, rank int"
        rows = [(i, *[None] * 6, 0, None, 0, 0, why, group, None) for i, why in failed]
        out.append(df.sparkSession.createDataFrame(rows, f"spec_id string, {kinds}, status string, group_var string, group_value string"))
    return reduce(DataFrame.unionByName, out)


def shock_group(
    df: DataFrame, col: str = "stdm_t_inutero_b_avg", lower_p: float = 0.15, upper_p: float = 0.85, out: str = "shock"
) -> DataFrame:
    """Mark records outside the two quantiles of an exposure; a missing exposure counts as inside."""
    return outside_quantiles(df, col, lower_p, upper_p, out)


def write_coefficients(coefs: DataFrame, path: str, order: Sequence[str] | None = None) -> None:
    """Result table, ordered within each specification by a list of terms."""
    place = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("term")) if order else F.lit(0)
    ranked = coefs.withColumn("term_order", F.when(place > 0, place).otherwise(len(order or []) + 1))
    ranked.repartition("spec_id").sortWithinPartitions("outcome", "cell_level", "term_order").write.mode(
        "overwrite"
    ).partitionBy("spec_id").parquet(path)
