"""The five SQL reports as Spark SQL text over a temp view of the cleaned table.

A report is described by its keys and the names of its measures; the text is put
together from that description. Same results as the DataFrame versions in
operators.reports (money summed in DECIMAL, averages and percentages unrounded).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

VIEW = "retail_sales"
MONTH = "substr(transaction_date, 1, 7)"

# Base aggregates, and measures derived from them by name.
BASE = {
    "n": "count(1)",
    "valid": "count(total_spent)",
    "money": "sum(CAST(total_spent AS DECIMAL(28,6)))",
    "units": "sum(CAST(quantity AS DOUBLE))",
}
MEASURES = {
    "records": "n", "valid": "valid", "missing": "n - valid", "units": "units", "sales": "CAST(money AS DOUBLE)",
    "average": "CAST(money AS DOUBLE) / nullif(valid, 0)", "coverage_pct": "100.0D * valid / n", "missing_pct": "100.0D * (n - valid) / n",
    "previous": "CAST(before AS DOUBLE)", "change_pct": "100.0D * CAST(money - before AS DOUBLE) / nullif(CAST(before AS DOUBLE), 0)",
}


@dataclass(frozen=True)
class Report:
    """Keys (name -> expression), measures (name -> entry of MEASURES), an order, and what is left out."""

    keys: dict[str, str]
    measures: dict[str, str]
    order: str
    rows: str = "true"
    groups: str = "true"
    limit: int | None = None
    lagged: bool = False

    def sql(self) -> str:
        base = ", ".join([f"{e} AS {k}" for k, e in self.keys.items()] + [f"{e} AS {k}" for k, e in BASE.items()])
        grouped = f"SELECT {base} FROM {VIEW} WHERE {self.rows} GROUP BY {', '.join(self.keys)}"
        if self.lagged:  # one row a month: the window is bounded by the calendar
            grouped = f"SELECT *, lag(money) OVER (ORDER BY {', '.join(self.keys)}) AS before FROM ({grouped})"
        shown = ", ".join([*self.keys, *(f"{MEASURES[m]} AS {name}" for name, m in self.measures.items())])
        text = f"SELECT {shown} FROM ({grouped}) WHERE {self.groups} ORDER BY {self.order}"
        return f"{text} LIMIT {self.limit}" if self.limit else text


REPORTS = {
    "monthly_channel": Report({"sales_month": MONTH, "channel": "location"}, {
        "total_records": "records", "valid_sales_records": "valid", "recorded_sales": "sales", "sales_per_valid_transaction": "average",
        "sales_coverage_pct": "coverage_pct"}, "sales_month, channel"),
    "top_products": Report({"item": "item", "category": "category"}, {"transaction_count": "records", "units_sold": "units", "recorded_sales": "sales"},
                           "units_sold DESC, item, category", rows="item_imputed = 'No' AND quantity IS NOT NULL", groups="n >= 20", limit=10),
    "missing_rate_by_category": Report({"category": "category"}, {"total_records": "records", "missing_sales_records": "missing", "missing_sales_pct": "missing_pct"},
                                       "missing_sales_pct DESC, category"),
    "customer_summary": Report({"customer_id": "customer_id"}, {"transaction_count": "records", "valid_sales_records": "valid", "recorded_sales": "sales",
                                                                "average_transaction_value": "average"}, "recorded_sales DESC, customer_id"),
    "month_over_month": Report({"sales_month": MONTH}, {"recorded_sales": "sales", "previous_month_sales": "previous", "month_over_month_pct": "change_pct"},
                               "sales_month", lagged=True),
}


def run_sql_report(spark: SparkSession, clean: DataFrame, name: str) -> DataFrame:
    """Register the cleaned table as ``retail_sales`` and run one report's SQL text."""
    clean.createOrReplaceTempView(VIEW)
    return spark.sql(REPORTS[name].sql())
