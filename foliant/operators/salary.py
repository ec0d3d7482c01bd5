"""Salary grids: from the cells of untidy worksheets to typed rows.

Cells are a table (wb_id, sheet_no, sheet, row_no, col_no, v, v_type): one row for each cell up to a
row's length, empty ones with null v, so that a sheet's width is known. Every step is an
aggregation or window over a sheet or a row of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliant.config import DEFAULT, Settings
from foliant.functions import text as T

# Normalised headers of typed money columns, and of others that only mark the grid.
GROSS = ("total", "total anual", "bruto anual", "bruto ano", "importe anual", "salario anual")
HOURLY = ("€/hora", "e/hora", "euro/hora", "euros/hora", "hora", "precio hora", "precio/hora", "coste hora", "/hora", "bruto/hora", "bruto hora", "salario hora")
EXTRA = ("pagas extra", "paga extra", "pagas extras", "paga extras")
NIGHT = ("plus nocturno", "nocturnidad", "plus noche", "nocturno", "plus nocturnidad", "plus hora nocturna", "plus hora noctur", "hora nocturna")
OTHER = (
    "sb", "sb anual", "comp", "comp smi", "comp. smi", "comp smi / ano", "comp smi / mes", "14", "12", "bruto mes", "bruto/mes 14 pagas", "bruto/mes 12 pagas", "salario base",
    "dedica", "pc", "paga 16", "p.p.paga extra", "plus transporte", "plus tpte/dia", "5% mejora sedena", "1,2,3,5 quinquenio", "4 quinquenio", "quinquenio", "antiguedad",
)
MONEY = GROSS + HOURLY + EXTRA + NIGHT + OTHER
SHEET = ["wb_id", "sheet_no", "sheet"]


def _is_money(label: Column) -> Column:
    return label.isin(*MONEY) | T.is_hours(label)


def headers(cells: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(sheet, header_row, width): the first of the best-scoring rows among the first ones, if at least two of its cells are money headers.

    One pass over the cells: the first rows of a sheet each for itself, all below them as one; only labels of the former are made."""
    first = F.col("row_no") < settings.header_rows
    marked = cells.select(*SHEET, F.least("row_no", F.lit(settings.header_rows)).alias("row_no"), "col_no", F.when(first, T.label(F.col("v"))).alias("label"))
    by_row = marked.groupBy(*SHEET, "row_no").agg((F.max("col_no") + 1).alias("width"), F.count_if(_is_money(F.col("label"))).alias("score"))
    fit = F.when(first & (F.col("score") >= 2), F.struct("score", -F.col("row_no")))
    return by_row.groupBy(*SHEET).agg(F.max("width").alias("width"), F.max_by("row_no", fit).alias("header_row"))


def grids(cells: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """By sheet with a header its row, its first money column, and by column the label and typed field (`heads`); only the first rows of sheets are read.

    A header has two money cells or more, so that no sheet needs to be searched for the first column of numbers."""
    first = cells.filter(F.col("row_no") < settings.header_rows).select(*SHEET, "row_no", "col_no", T.label(F.col("v")).alias("label"))
    by_row = first.groupBy(*SHEET, "row_no").agg(F.count_if(_is_money(F.col("label"))).alias("score"), F.collect_list(F.struct("col_no", "label")).alias("top"))
    best = by_row.filter("score >= 2").groupBy(*SHEET).agg(F.max_by(F.struct("row_no", "top"), F.struct("score", -F.col("row_no"))).alias("h"))
    kind = lambda x: F.when(x.isin(*GROSS), "gross_annual").when(x.isin(*HOURLY) | T.is_hours(x), "hourly_rate").when(x.isin(*EXTRA), "extra_pay").when(x.isin(*NIGHT), "night_plus")
    top = best.select(*SHEET, F.col("h.row_no").alias("header_row"), F.array_sort("h.top").alias("top"))
    gross = F.array_min(F.transform(F.filter("top", lambda x: x["label"].isin(*GROSS)), lambda x: x["col_no"]))
    top = top.withColumns({"first_money": F.array_min(F.transform(F.filter("top", lambda x: _is_money(x["label"])), lambda x: x["col_no"])), "gross": gross})
    field = lambda x: F.when(~x["label"].isin(*GROSS) | (x["col_no"] == F.col("gross")), kind(x["label"]))
    heads = F.map_from_arrays(F.transform("top", lambda x: x["col_no"]), F.transform("top", lambda x: F.struct(x["label"].alias("label"), field(x).alias("field"))))
    return top.select(*SHEET, "header_row", "first_money", heads.alias("heads"))


def rows(cells: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Typed rows with all original values of the grid in `raw_values`."""
    data = cells.join(grids(cells, settings), SHEET).filter("row_no > header_row").withColumn("head", F.col("heads")[F.col("col_no")])
    data = data.select(*SHEET, "row_no", "col_no", "v", "v_type", "first_money", "head.label", "head.field")
    in_grid = F.col("col_no") >= F.col("first_money")
    filled = F.coalesce(F.col("v"), F.lit("")) != ""
    name = T.clean_label(F.col("v"))
    key = F.when(F.coalesce("label", F.lit("")) != "", F.col("label")).otherwise(F.concat(F.lit("col"), F.col("col_no").cast("string")))
    kept = F.when(F.col("v_type") == "float", F.round(F.col("v").try_cast("double"), 6).cast("string")).otherwise(F.col("v"))
    last = lambda f: F.max_by(F.struct(T.to_number(F.col("v")).alias("x")), F.when(in_grid & filled & (F.col("field") == f), F.col("col_no")))["x"]
    grouped = data.groupBy(*SHEET, "row_no").agg(
        F.array_sort(F.collect_list(F.when(~in_grid & F.col("v").isNotNull() & (name != ""), F.struct("col_no", name.alias("s"))))).alias("labels"),
        F.max(in_grid & T.is_number(F.col("v"), F.col("v_type"))).alias("has_number"),
        F.array_sort(F.collect_list(F.when(in_grid & filled, F.struct("col_no", key.alias("k"), kept.alias("v"))))).alias("raw"),
        *[last(f).alias(f) for f in ("gross_annual", "hourly_rate", "extra_pay", "night_plus")],
    )
    good = grouped.filter("has_number and size(labels) > 0")
    names = F.array_distinct(F.transform("raw", lambda e: e["k"]))
    value = lambda k: F.element_at(F.filter("raw", lambda e: e["k"] == k), -1)["v"]
    only = F.element_at("labels", 1)["s"]
    gross = F.col("gross_annual")
    return good.select(
        *SHEET,
        "row_no",
        T.year_in(F.col("sheet")).alias("year"),
        F.element_at("labels", -1)["s"].alias("job_category_name"),
        F.when((F.size("labels") >= 2) | only.rlike(r"^\d+(\.\d+)?'?$"), only).alias("group_code"),
        F.round(gross, 2).alias("gross_annual"),
        F.round(gross / settings.payments, 2).alias("base_salary_monthly"),
        F.round("extra_pay", 2).alias("extra_pay"),
        F.when(gross.isNotNull(), settings.payments).alias("num_payments"),
        F.round("hourly_rate", 4).alias("hourly_rate"),
        F.round("night_plus", 2).alias("night_plus"),
        F.map_from_arrays(names, F.transform(names, value)).alias("raw_values"),
        F.lit(None).cast("date").alias("validity_start"),
        F.lit(None).cast("date").alias("validity_end"),
    )


def warnings(cells: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """What was done with each sheet, one line each."""
    heads = headers(cells, settings)
    found = rows(cells, settings).groupBy(*SHEET).agg(F.count("*").alias("n"))
    year = F.coalesce(T.year_in(F.col("sheet")).cast("string"), F.lit("None"))
    said = (
        F.when(F.coalesce("width", F.lit(0)) < 2, F.concat(F.lit("sheet '"), "sheet", F.lit("' skipped (empty/too small)")))
        .when(F.col("header_row").isNull() | F.col("n").isNull(), F.concat(F.lit("sheet '"), "sheet", F.lit("' skipped (no salary-grid header found)")))
        .otherwise(F.concat(F.lit("sheet '"), "sheet", F.lit("': header on row "), F.col("header_row").cast("string"), F.lit(", "), F.col("n").cast("string"), F.lit(" category rows, year "), year))
    )
    return heads.join(found, SHEET, "left").select(*SHEET, said.alias("warning"))
