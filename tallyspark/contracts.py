"""Table contracts: exact columns and types, keys, nulls, finite numbers, blank strings. Violations raise.

All row checks of a table are one aggregate; the key check is one grouped count. Messages name the table, the
rule and the first few offenders. Nothing is filled, dropped, renamed or cast.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.lineage import small


class ContractError(ValueError):
    """A table breaks its contract."""


@dataclass(frozen=True)
class TableContract:
    name: str
    columns: dict[str, str]
    keys: tuple[str, ...]
    nullable: frozenset[str] = field(default_factory=frozenset)
    nonempty: bool = False
    positive: frozenset[str] = field(default_factory=frozenset)

    def check(self, df: DataFrame) -> DataFrame:
        """``df`` with its columns in contract order, or ContractError."""
        if not isinstance(df, DataFrame):
            raise ContractError(f"{self.name} must be a DataFrame")
        have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        if have != self.columns:
            raise ContractError(f"{self.name} schema must be exactly {self.columns}, got {have}")
        aggs = [F.count("*").alias("rows")]
        for c, kind in self.columns.items():
            if c not in self.nullable:
                aggs.append(F.count_if(F.col(c).isNull()).alias(f"null {c}"))
            if kind == "double":
                aggs.append(F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"nonfinite {c}"))
            if kind == "string":
                aggs.append(F.count_if(F.trim(F.col(c)) == "").alias(f"blank {c}"))
            if c in self.positive:
                aggs.append(F.count_if(F.col(c) <= 0).alias(f"nonpositive {c}"))
        found = df.agg(*aggs).first().asDict()
        rows = found.pop("rows")
        if self.nonempty and not rows:
            raise ContractError(f"{self.name} must not be empty")
        if bad := [f"{k}: {n}" for k, n in found.items() if n]:
            raise ContractError(f"{self.name} has invalid values ({', '.join(bad)})")
        if self.keys and (twice := [tuple(r)[:-1] for r in df.groupBy(*self.keys).count().where("count > 1").limit(5).collect()]):
            raise ContractError(f"{self.name} keys {self.keys} must be unique, got {twice}")
        return df.select(*self.columns)


PRICES = TableContract(
    "prices", {"session": "date", "asset": "string", "close": "double"}, ("session", "asset"), nonempty=True,
    positive=frozenset({"close"}),
)
SESSIONS = TableContract("sessions", {"session": "date", "close_at": "timestamp"}, ("session",), nonempty=True)
SPLITS = TableContract(
    "splits", {"action_id": "string", "asset": "string", "effective_session": "date", "ratio": "double"}, ("action_id",),
    positive=frozenset({"ratio"}),
)
DIVIDENDS = TableContract(
    "dividends",
    {"action_id": "string", "asset": "string", "ex_session": "date", "pay_date": "date", "cash_per_share": "double"},
    ("action_id",),
)
INTERVALS = TableContract("returns", {"period_start": "date", "session": "date", "simple_return": "double"}, ("session",), nonempty=True)
SIGNALS = TableContract("signals", {"signal_date": "date", "asset": "string", "signal": "double"}, ("signal_date", "asset"), nonempty=True)
OUTCOMES = TableContract(
    "outcomes",
    {"signal_date": "date", "asset": "string", "period_start": "date", "period_end": "date", "forward_return": "double"},
    ("signal_date", "asset"),
)


def key_differences(left: DataFrame, right: DataFrame, keys: tuple[str, ...], labels=("missing", "unexpected")) -> DataFrame:
    """Rows of (keys, problem): keys of ``left`` that ``right`` lacks, and the reverse."""
    parts = [a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti").withColumn("problem", F.lit(label)) for a, b, label in ((left, right, labels[0]), (right, left, labels[1]))]
    return reduce(DataFrame.unionByName, parts)


def panel_completeness(prices: DataFrame, sessions: DataFrame, assets: DataFrame) -> DataFrame:
    """(session, asset, problem): cells a full panel of sessions by assets lacks, and prices outside it."""
    days, names, have = sessions.select("session").distinct(), assets.select("asset").distinct(), prices.select("session", "asset").distinct()
    inside = have.join(days, "session", "left_semi").join(names, "asset", "left_semi")
    full = days.agg(F.count("*").alias("all"))
    counted = names.join(inside.groupBy("asset").agg(F.count("*").alias("n")), "asset", "left").join(F.broadcast(full))  # one row
    lacking = counted.where(F.coalesce("n", F.lit(0)) < F.col("all")).select("asset")
    # Only assets that lack a session meet the calendar; their cells are what is looked for, or nearly so.
    missing = lacking.join(small(days)).join(inside, ["session", "asset"], "left_anti").select("session", "asset", F.lit("missing").alias("problem"))
    off = have.join(days, "session", "left_anti").unionByName(have.join(days, "session", "left_semi").join(names, "asset", "left_anti"))
    return missing.unionByName(off.select("session", "asset", F.lit("unexpected").alias("problem")))


def check_panel(prices: DataFrame, sessions: DataFrame, splits: DataFrame, dividends: DataFrame, timezone: str = "UTC") -> None:
    """All rules of a market panel: contracts, completeness, increasing closes on their local day, known actions."""
    prices, sessions, splits, dividends = PRICES.check(prices), SESSIONS.check(sessions), SPLITS.check(splits), DIVIDENDS.check(dividends)
    off = panel_completeness(prices, sessions, prices.select("asset")).limit(5).collect()
    if off:
        raise ContractError(f"prices must hold every session and asset once, first offenders {[tuple(r) for r in off]}")
    if sessions.where(F.to_date(F.from_utc_timestamp("close_at", timezone)) != F.col("session")).limit(1).count():
        raise ContractError("close_at must fall on its session in the exchange's time zone")
    from pyspark.sql import Window

    before = F.lag("close_at").over(Window.partitionBy(F.lit(0)).orderBy("session"))
    if sessions.withColumn("before", before).where("close_at <= before").limit(1).count():
        raise ContractError("close_at must increase with the session")
    ids = splits.select("action_id").unionByName(dividends.select("action_id")).groupBy("action_id").count().where("count > 1")
    if ids.limit(1).count():
        raise ContractError("action ids must be unique across tables")
    if splits.groupBy("asset", "effective_session").count().where("count > 1").limit(1).count():
        raise ContractError("one split for each asset and session")
    if dividends.where("pay_date < ex_session or cash_per_share < 0").limit(1).count():
        raise ContractError("dividends need pay_date >= ex_session and cash_per_share >= 0")
    for table, day in ((splits, "effective_session"), (dividends, "ex_session")):
        known = table.join(prices, (table["asset"] == prices["asset"]) & (table[day] == prices["session"]), "left_anti")
        if known.limit(1).count():
            raise ContractError(f"{day} and asset of every action must be in the panel")
