"""Portfolio research as Spark plans: market panels, returns, reports, signals, allocation and ledgers."""
