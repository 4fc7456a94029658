"""What-if scenarios: multipliers then additive shifts on numeric columns, named templates,
free-text matching, and several scenarios side by side over one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.plans.spec import Scenario

# fixed values: the five named scenario templates (multipliers, then additive shifts)
TEMPLATES: dict[str, Scenario] = {
    "recession": Scenario("recession", {
        "consumer_spending": 0.72, "revenue": 0.78, "salary": 0.90, "income": 0.88, "sales": 0.75,
        "profit": 0.65, "investment": 0.60, "gdp": 0.85, "employment": 0.92}, {"unemployment_rate": 3.5}),
    "pandemic": Scenario("pandemic", {
        "patient_count": 2.5, "hospital_capacity": 1.8, "icu_occupancy": 3.2, "consumer_spending": 0.65,
        "travel_volume": 0.15, "revenue": 0.70, "online_sales": 2.1}, {"mortality_rate": 1.2, "infection_rate": 8.5}),
    "boom": Scenario("boom", {
        "revenue": 1.35, "salary": 1.18, "consumer_spending": 1.25, "investment": 1.40, "stock_price": 1.50,
        "gdp": 1.08, "employment": 1.05, "profit": 1.45}, {"unemployment_rate": -1.5}),
    "demonetization": Scenario("demonetization", {
        "cash_transactions": 0.15, "consumer_spending": 0.60, "retail_sales": 0.55, "atm_withdrawals": 4.5,
        "digital_payments": 3.2, "bank_deposits": 2.8}, {}),
    "drought": Scenario("drought", {
        "crop_yield": 0.45, "agricultural_revenue": 0.50, "water_availability": 0.35, "food_prices": 1.65,
        "farmer_income": 0.55, "livestock_count": 0.80}, {"drought_index": 2.8}),
}

# fixed values: free-text keywords for templates, tried in this order
KEYWORDS: list[tuple[str, str]] = [
    ("recession", "recession"), ("downturn", "recession"), ("economic crisis", "recession"),
    ("financial crisis", "recession"), ("pandemic", "pandemic"), ("covid", "pandemic"), ("epidemic", "pandemic"),
    ("outbreak", "pandemic"), ("boom", "boom"), ("bull market", "boom"), ("expansion", "boom"),
    ("demonetisation", "demonetization"), ("demonetization", "demonetization"), ("note ban", "demonetization"),
    ("drought", "drought"), ("dry season", "drought"), ("water crisis", "drought"),
]


def resolve_column(df: DataFrame, key: str) -> str | None:
    """Exact name first, else the first column whose lower-case name contains the key."""
    if key in df.columns:
        return key
    for c in df.columns:
        if key.lower() in c.lower():
            return c
    return None


def scenario_exprs(df: DataFrame, s: Scenario, where: Column | None = None) -> dict[str, Column]:
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    cur: dict[str, Column] = {}
    for key, m in s.multipliers.items():
        c = resolve_column(df, key)
        if c in numeric:
            cur[c] = cur.get(c, F.col(c)) * F.lit(float(m))
    for key, a in s.shifts.items():
        c = resolve_column(df, key)
        if c in numeric:
            cur[c] = cur.get(c, F.col(c)) + F.lit(float(a))
    out = {}
    for c, e in cur.items():
        t = df.schema[c].dataType
        e = F.round(e).cast(t) if isinstance(t, T.IntegralType) else e.cast(t)
        out[c] = F.when(where, e).otherwise(F.col(c)) if where is not None else e
    return out


def apply(df: DataFrame, s: Scenario, where: Column | None = None) -> DataFrame:
    """One projection; an unknown scenario (no ops) is the identity plan. ``where`` limits the rows."""
    sel = scenario_exprs(df, s, where)
    return df.withColumns(sel) if sel else df


def template(name: str) -> Scenario | None:
    return TEMPLATES.get(name.lower())


def match_scenario(text: Column) -> Column:
    """Template name for a free text: exact name, else first keyword contained, else null (identity)."""
    low = F.lower(F.trim(text))
    out = F.lit(None).cast("string")
    for kw, name in reversed(KEYWORDS):
        out = F.when(F.contains(low, F.lit(kw)), F.lit(name)).otherwise(out)
    exact = F.lit(None).cast("string")
    for name in TEMPLATES:
        exact = F.when(low == F.lit(name), F.lit(name)).otherwise(exact)
    return F.coalesce(exact, out)


def compare(df: DataFrame, scenarios: list[Scenario], measures: list[str], group_cols: list[str] = ()) -> DataFrame:
    """Each scenario applied to the same base table, then summed per scenario (and group).

    Every row of the base table carries all scenarios as an array, so the base is scanned once; the
    sums are map-side combined.
    """
    base = df.select(*group_cols, *measures)
    each = []
    for s in [Scenario("baseline")] + list(scenarios):
        new = scenario_exprs(base, s, None)
        each.append(F.struct(F.lit(s.name).alias("scenario"), *[new.get(m, F.col(m)).alias(m) for m in measures]))
    u = base.select(*group_cols, F.explode(F.array(*each)).alias("_s")).select(*group_cols, "_s.*")
    return u.groupBy("scenario", *group_cols).agg(*[F.sum(m).alias(f"sum_{m}") for m in measures],
                                                  F.count(F.lit(1)).alias("n_rows"))
