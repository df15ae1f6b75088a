"""Numeric cleaning, ratios and scaling. Missing is null; NaN and infinities become null at the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Name, numerator and denominator of each ratio.
RATIOS = (
    ("gross_profit_margin", "income_statement_total_revenues - income_statement_total_operating_expenses", "income_statement_total_revenues"),
    ("return_on_assets", "income_statement_net_income_loss", "balance_sheet_total_assets"),
    ("return_on_equity", "income_statement_net_income_loss", "balance_sheet_total_shareholders_equity"),
    ("operating_margin", "income_statement_profit_loss_operations", "income_statement_total_revenues"),
    ("current_ratio", "balance_sheet_total_current_assets", "balance_sheet_accounts_payable_accrued"),
    ("quick_ratio", "balance_sheet_cash + balance_sheet_accounts_receivable", "balance_sheet_accounts_payable_accrued"),
    ("debt_to_equity", "balance_sheet_total_liabilities", "balance_sheet_total_shareholders_equity"),
    ("debt_ratio", "balance_sheet_total_liabilities", "balance_sheet_total_assets"),
    ("times_interest_earned", "income_statement_profit_loss_before_taxes", "income_statement_interest_expense"),
    ("asset_turnover", "income_statement_total_revenues", "balance_sheet_total_assets"),
    ("days_sales_outstanding", "365 * balance_sheet_accounts_receivable", "income_statement_total_revenues"),
    ("inventory_turnover", "income_statement_total_revenues", "balance_sheet_inventory"),
)


def coerced(text: Column) -> Column:
    """A number, or null for text that is none (also for the suffixes that a cast would accept)."""
    return F.when(text.cast("string").rlike(NUMBER), text.cast("string").try_cast("double"))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def filled(x: Column) -> Column:
    return F.coalesce(finite(x), F.lit(0.0))


def cleaned(df: DataFrame, label: str = "is_fraudulent", fallback: str = "misstate", drop: tuple[str, ...] = ("fyear", "gvkey"), null_labels: str = "drop") -> DataFrame:
    """All columns as numbers without gaps. null_labels: drop the rows, keep them, or make the labels zero."""
    name = label if label in df.columns else fallback
    if name not in df.columns:
        raise ValueError(f"neither {label} nor {fallback} is a column")
    out = df.select(*(finite(coerced(F.col(f"`{c}`"))).alias(c) for c in df.columns))
    out = out.na.drop(subset=[name]) if null_labels == "drop" else out
    keep = [c for c in out.columns if c not in drop]
    return out.select(*(F.col(c) if c == name and null_labels == "keep" else F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in keep))


def aligned(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns asked for, in order; those that are missing are 0."""
    return df.select(*(F.col(f"`{c}`") if c in df.columns else F.lit(0.0).alias(c) for c in columns))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def ratio_features(df: DataFrame) -> DataFrame:
    """df with the twelve ratios, as far as their columns are there."""
    out = {}
    for name, top, bottom in RATIOS:
        if all(w in df.columns for w in (top + " " + bottom).replace("365 *", "").replace("+", " ").replace("-", " ").split()):
            out[name] = F.expr(f"try_divide({top}, {bottom})")
    return df.withColumns(out)


def min_max(x: Column, low: Column, high: Column) -> Column:
    return (x - low) / (high - low + F.lit(1e-8))


def outlier_share(features: Column, limit: float = 3.0) -> Column:
    """Percentage of a row's own features, but for nulls and NaN, that are further than limit deviations from their mean."""
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), f)

    def share(xs: Column) -> Column:
        n = F.size(xs)
        far = _let(
            total(xs, lambda a, x: a + x) / n,
            lambda mean: _let(F.sqrt(total(xs, lambda a, x: a + (x - mean) * (x - mean)) / n) + F.lit(1e-8), lambda spread: F.size(F.filter(xs, lambda x: F.abs((x - mean) / spread) > limit))),
        )
        return F.when(n > 0, F.least(F.lit(100.0), 100.0 * far / n)).otherwise(0.0)

    return F.when(features.isNull(), 0.0).otherwise(_let(F.filter(features, lambda x: x.isNotNull() & ~F.isnan(x)), share))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, where a lambda would compute it for every element."""
    return F.get(F.transform(F.array(value), f), 0)


def padded(features: Column, steps: int = 10) -> Column:
    """Features as an array of `steps` rows of equal size, zeros at the end; one row where there are fewer than steps.

    As many zeros as the remainder lacks are added, a whole row's worth of steps where it lacks none.
    """
    n = F.size(features)
    zeros = F.array_repeat(F.lit(0.0), (F.lit(steps) - n % steps).cast("int"))
    filled_up = F.concat(features, zeros)
    width = (n + steps - n % steps) / steps
    rows = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.slice(filled_up, (i * width + 1).cast("int"), width.cast("int")))
    return F.when(n < steps, F.array(features)).otherwise(rows)


def outlier_recode(label: Column) -> Column:
    """1 for the label -1 of an outlier, else 0."""
    return F.when(label == -1, 1).otherwise(0)
