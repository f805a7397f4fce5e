"""Column functions: identifiers, metadata fields, labels. All but ``mantissa`` are built-in expressions; a missing
value is NULL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Component ids that are solvent, not ligands.
WATER_IDS = ("HOH", "WAT", "DOD")
#: Upper limits of p for the marks, in order.
STARS = ((1e-4, "****"), (1e-3, "***"), (1e-2, "**"), (0.05, "*"))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """The number, NULL for NaN and infinities."""
    c = _c(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def insertion_code(c) -> Column:
    """Blank, missing, '?' and '.' are the empty code; others are trimmed."""
    t = F.trim(F.regexp_replace(_c(c).cast("string"), r"\s", " "))
    return F.when(t.isNull() | t.isin("", "?", ".", "NaN", "nan"), "").otherwise(t)


def structure_codes(text) -> Column:
    """Distinct four-character codes of a text (a digit, then three letters or digits), in order, lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"\b([0-9][A-Za-z0-9]{3})\b")), F.lower))


def first_number(values) -> Column:
    """The first element that is a number."""
    return F.get(F.filter(F.transform(_c(values), lambda v: finite(v.try_cast("double"))), lambda v: v.isNotNull()), F.lit(0))


def least_number(values) -> Column:
    return F.array_min(F.filter(F.transform(_c(values), lambda v: finite(v.try_cast("double"))), lambda v: v.isNotNull()))


def first_text(values) -> Column:
    """The first element that isn't blank, as it stands."""
    return F.get(F.filter(_c(values), lambda v: v.isNotNull() & (F.trim(v) != "")), F.lit(0))


def growth_ph(numbers, ranges) -> Column:
    """The first number as text, else the first range that isn't blank."""
    return F.coalesce(first_number(numbers).cast("string"), first_text(ranges))


def joined_details(values) -> Column:
    """Non-blank elements with white space collapsed, joined by '; '; NULL if none."""
    t = F.filter(F.transform(_c(values), lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: v.isNotNull() & (v != ""))
    return F.when(F.size(t) > 0, F.array_join(t, "; "))


def ligand_names(ids) -> Column:
    """Sorted distinct component ids without solvent, joined by '|'."""
    return F.array_join(F.array_sort(F.array_except(F.coalesce(_c(ids), F.array().cast("array<string>")), F.array(*[F.lit(x) for x in WATER_IDS]))), "|")


def starting_model(accessions, texts) -> tuple[Column, Column]:
    """(status, value): codes of both sources, accessions first.

    Status ``conflict`` if both have codes and the sets differ, ``ok`` if any has, ``text`` for free text without a code,
    else ``missing``; the value joins codes by ' | ' or is the first free text in lower case.
    """
    empty = F.array().cast("array<string>")
    codes = lambda a: F.array_distinct(F.flatten(F.transform(F.filter(F.coalesce(_c(a), empty), lambda v: v.isNotNull()), structure_codes)))
    a, b = codes(accessions), codes(texts)
    both = F.array_union(a, b)
    free = first_text(F.coalesce(_c(texts), empty))
    status = (
        F.when((F.size(a) > 0) & (F.size(b) > 0) & (F.array_sort(a) != F.array_sort(b)), "conflict")
        .when(F.size(both) > 0, "ok").when(free.isNotNull(), "text").otherwise("missing")
    )
    return status, F.when(F.size(both) > 0, F.array_join(both, " | ")).otherwise(F.lower(F.trim(free)))


def max_cell_diff(a: list, b: list) -> Column:
    """Largest relative difference of paired cell parameters, in percent of their mean."""
    d = [F.try_divide(F.lit(200.0) * F.abs(_c(x) - _c(y)), _c(x) + _c(y)) for x, y in zip(a, b, strict=True)]
    return F.greatest(*d) if len(d) > 1 else d[0]


def stars(p) -> Column:
    """Marks of a p-value; 'ns' above all limits, '' if missing."""
    p = finite(p)
    out = F.when(p.isNull(), "")
    for limit, mark in STARS:
        out = out.when(p < limit, mark)
    return out.otherwise("ns")


@F.pandas_udf(DoubleType())
def _three_digits(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if pd.isna(x) else float(f"{x:.2e}"))


def mantissa(p) -> Column:
    """A number rounded to three significant digits, by its exact binary value (Java's formats round its shortest decimal)."""
    return _three_digits(finite(p))


#: Names of the metrics as reports show them.
METRIC_LABELS = {
    "edia": "EDIA", "b_factor_zscore": "B-factor z-score", "b_factor": "B-factor", "occupancy": "occupancy", "resolution": "resolution (Å)",
    "deposited_r_free": "deposited R-free", "deposited_r_work": "deposited R-work", "r_free": "R-free", "r_work": "R-work",
    "num_water": "#water (clustered)", "num_water_deposited": "#water (deposited)", "unit_cell_volume": "unit-cell volume (Å³)",
    "f1": "F1", "precision": "precision", "recall": "recall",
}
#: Metrics that are shares and shown in percent.
SHARES = ("deposited_r_free", "deposited_r_work", "r_free", "r_work")


def label(c, labels: dict[str, str] = METRIC_LABELS) -> Column:
    """The name shown for each value; one without a name stays as it is."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[_c(c)], _c(c))


def in_percent(metric, value) -> tuple[Column, Column]:
    """(name, value) of a metric: shares are multiplied by 100, their names end in `` (%)``."""
    share = _c(metric).isin(*SHARES)
    return F.when(share, F.concat(label(metric), F.lit(" (%)"))).otherwise(label(metric)), F.when(share, _c(value) * 100).otherwise(_c(value))


def rigid(rotation: list[float], shift: list[float], xyz: list) -> list[Column]:
    """R x + t as three linear expressions; the rotation is row major."""
    x = [_c(v) for v in xyz]
    return [sum((F.lit(float(rotation[3 * i + j])) * x[j] for j in range(3)), F.lit(float(shift[i]))) for i in range(3)]
