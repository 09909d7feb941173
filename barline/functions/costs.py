"""Transaction costs as expressions."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Costs:
    spread_bps: float = 2.0
    slippage_bps: float = 1.0
    commission: float = 1.0
    commission_pct: float = 0.0005

    def column(self, price: Column, shares: Column, volume: Column) -> Column:
        """Spread, slippage by the root of participation, and commission."""
        n = F.abs(shares)
        notional = n * price
        adv = F.when(volume > 0, volume).otherwise(1_000_000.0)
        return self.spread_bps / 1e4 * notional + self.slippage_bps / 1e4 * notional * F.sqrt(n / adv) + F.greatest(F.lit(self.commission), self.commission_pct * notional)

    def values(self) -> dict:
        return asdict(self)


# Fixed values of the presets.
ZERO = Costs(0.0, 0.0, 0.0, 0.0)
LIQUID_EQUITY = Costs(2.0, 1.0, 1.0, 0.0005)
SMALL_CAP = Costs(10.0, 5.0, 1.0, 0.0010)
