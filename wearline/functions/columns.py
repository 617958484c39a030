"""Column expressions: coercion, keys, elapsed time, classes, bins, features, residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
YEAR_DAYS = 365.25
YEAR_MICROS = 31_557_600_000_000

# Classes of surface and treatment tokens.
SURFACE_CLASSES = {"ab": "AB", "abk": "AB", "abs": "AB", "ea": "AB", "pab-v": "PAB", "pab-b": "PAB", "pab-o": "PAB", "sma": "SMA"}
MATERIAL_CLASSES = {
    "lta": "new", "mp": "new", "mpkj": "new", "art": "new", "mpk": "new",
    "rem": "recycled", "urem": "recycled", "remo": "recycled", "rem+": "recycled",
}
# Horizon windows in days, inclusive.
HORIZON_WINDOWS = (("1y", 274, 457), ("2y", 639, 822), ("3y", 1004, 1187), ("4y", 1370, 1553))


def to_number(c: Column) -> Column:
    """A double, with a comma or a point; anything else is null, NaN too."""
    x = F.replace(F.trim(c.cast("string")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(x), x)


def to_date(c: Column) -> Column:
    """A timestamp without zone; anything else is null."""
    return c.cast("string").try_cast("timestamp_ntz")


def clamp(c: Column, low: float, high: float) -> Column:
    """Values outside of [low, high] become null."""
    return F.when(c.between(low, high), c)


def asset_id(keys: Sequence[str]) -> Column:
    """Keys joined by underscores; a null key reads ``nan``, as in the data this comes from."""
    return F.concat_ws("_", *(F.coalesce(F.col(k).cast("string"), F.lit("nan")) for k in keys))


def lifecycle_id(asset: Column, cycle: Column) -> Column:
    return F.concat(asset, F.lit("_C"), cycle.cast("string"))


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole days between, by the clock and not by calendar days."""
    return F.floor((micros(later) - micros(earlier)) / DAY_MICROS).cast("double")


def elapsed_years(later: Column, earlier: Column) -> Column:
    return elapsed_days(later, earlier) / F.lit(YEAR_DAYS)


def not_negative(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def token(c: Column) -> Column:
    """Trimmed lower case; blank is null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def classify(c: Column, classes: dict[str, str], missing: str) -> Column:
    """The token's class; ``missing`` without a token, ``other`` for unknown ones."""
    table = F.create_map(*(F.lit(x) for pair in classes.items() for x in pair))
    t = token(c)
    return F.when(t.isNull(), missing).otherwise(F.coalesce(F.try_element_at(table, t), F.lit("other")))


def horizon_window(days: Column, windows: Sequence[tuple[str, float, float]] = HORIZON_WINDOWS) -> Column:
    out = F.lit("outside_windows")
    for name, low, high in reversed(windows):
        out = F.when(days.between(low, high), name).otherwise(out)
    return out


def cut_bins(c: Column, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> Column:
    """Right-closed bins between edges; null outside of them."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        above = c >= low if include_lowest and low == edges[0] else c > low
        out = F.when(above & (c <= high), label).otherwise(out)
    return out


def quantile_bin(c: Column, edges: Column) -> Column:
    """Number (from 0) of the right-closed bin, the lowest edge included; null for null."""
    n = F.size(F.filter(edges, lambda e: e < c))
    return F.when(c.isNotNull(), F.greatest(n - 1, F.lit(0)).cast("int"))


def ratio(num: Column, den: Column) -> Column:
    """Null unless the denominator is above 0."""
    return F.when(den > 0, num / den)


def derived_features(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "heavy_share": ratio(c("KVL_raskas"), c("KVL")),
        "iri_rate": ratio(c("IRI") - c("prev_IRI"), c("Delta_t_years")),
        "ura_rate": ratio(c("URA") - c("prev_URA"), c("Delta_t_years")),
        "age_x_traffic": c("Pavement_Age_years") * c("KVL"),
        "age_x_heavy": c("Pavement_Age_years") * c("KVL_raskas"),
    })


def fill_category(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("missing"))


def reconstruct(target_type: Column, current: Column, predicted: Column) -> Column:
    """The predicted level: predictions of deltas are added to the current value; unknown types raise."""
    return (
        F.when(target_type.startswith("delta"), current + predicted)
        .when(target_type == "direct", predicted)
        .otherwise(F.raise_error(F.concat(F.lit("unknown target type: "), F.coalesce(target_type, F.lit("null")))).cast("double"))
    )


def residuals(actual: Column, predicted: Column, current: Column, sign: str = "actual_minus_predicted") -> dict[str, Column]:
    error = actual - predicted if sign == "actual_minus_predicted" else predicted - actual
    return {"residual": error, "abs_error": F.abs(error), "actual_delta": actual - current, "predicted_delta": predicted - current}


def pick_by_name(name: Column, columns: dict[str, Column]) -> Column:
    """The column that ``name`` names, null for other names."""
    out = F.lit(None).cast("double")
    for key, value in columns.items():
        out = F.when(name == key, value).otherwise(out)
    return out


def label_of(*parts: Column) -> Column:
    return F.concat_ws(" | ", *parts)


def trend(current: Column, rate: Column, horizon: Column) -> Column:
    return current + horizon * rate


def parameter_key(params: Column, names: Sequence[str]) -> Column:
    """A struct's fields as JSON in one fixed order, so that equal parameters have equal keys."""
    return F.to_json(F.struct(*(params[n].alias(n) for n in sorted(names))))


def ordered(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Preferred columns first (absent ones skipped), the others after them."""
    head = [c for c in preferred if c in df.columns]
    return df.select(*head, *(c for c in df.columns if c not in head))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for results that two engines compare."""
    return df.select(*((F.round(c, digits).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes))
