"""Model specification (G1-G3): one dataclass for both reference model families (trend + Fourier
seasonality + linear regressors, additive or multiplicative)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from statistics import NormalDist

HOURS_PER_DAY = 24.0
# Seasonal periods in hours and the default Fourier orders (yearly 10, weekly 3, daily 4).
YEAR_HOURS = 365.25 * 24.0
WEEK_HOURS = 7.0 * 24.0
DAY_HOURS = 24.0


@dataclass(frozen=True)
class ForecastSpec:
    mode: str = "additive"  # or "multiplicative"
    n_changepoints: int = 25
    changepoint_range: float = 0.8
    # Prior-scale penalties (MAP with Gaussian / Laplace priors); None = unpenalised.
    changepoint_prior_scale: float | None = 0.05
    seasonality_prior_scale: float | None = 10.0
    regressor_prior_scale: float | None = 10.0
    trend_prior_scale: float | None = 5.0
    # Direct regularisation strengths on the mean squared error (the second family's style); when set they
    # replace the prior-scale penalties of the corresponding block.
    trend_reg: float | None = None
    seasonality_reg: float | None = None
    yearly: int = 0
    weekly: int = 3
    daily: int = 4
    regressors: tuple[str, ...] = ()
    scope: str = "local"  # "local": one model per series; "global": pooled over series
    interval_width: float = 0.8
    max_rounds: int = 20
    tol: float = 1e-6
    seasonalities: tuple[tuple[str, float, int], ...] = field(default=())

    def seasonal_terms(self) -> list[tuple[str, float, int]]:
        """(name, period hours, order) of every active seasonality."""
        out = list(self.seasonalities)
        if self.yearly:
            out.append(("yearly", YEAR_HOURS, int(self.yearly)))
        if self.weekly:
            out.append(("weekly", WEEK_HOURS, int(self.weekly)))
        if self.daily:
            out.append(("daily", DAY_HOURS, int(self.daily)))
        return out

    def with_regressors(self, cols) -> "ForecastSpec":
        """Register every given column as a linear regressor."""
        return replace(self, regressors=tuple(cols))

    def term_names(self) -> list[str]:
        names = ["trend_m", "trend_k"] + [f"cp_{j + 1}" for j in range(self.n_changepoints)]
        for name, _, order in self.seasonal_terms():
            for i in range(1, order + 1):
                names += [f"{name}_sin_{i}", f"{name}_cos_{i}"]
        names += [f"reg_{r}" for r in self.regressors]
        return names

    def blocks(self) -> tuple[int, int, int]:
        """Sizes of the (trend, seasonal, regressor) blocks of the design vector."""
        n_trend = 2 + self.n_changepoints
        n_seas = sum(2 * o for _, _, o in self.seasonal_terms())
        return n_trend, n_seas, len(self.regressors)

    def z(self) -> float:
        """Two-sided normal quantile of the interval width."""
        return NormalDist().inv_cdf(0.5 + self.interval_width / 2.0)


# G1: the first family's configuration (multiplicative, changepoints over all of the history).
CONFIG_A = ForecastSpec(mode="multiplicative", changepoint_prior_scale=1.5, seasonality_prior_scale=15.0,
                        changepoint_range=1.0, yearly=10, weekly=3, daily=4)
# The second family's configuration (additive, 40 changepoints over the first 95 %, L1 trend reg 0.1,
# seasonality reg 0.1, pooled normalisation).  ``local`` variant: fit per series.
CONFIG_B = ForecastSpec(mode="additive", n_changepoints=40, changepoint_range=0.95, trend_reg=0.1,
                        seasonality_reg=0.1, yearly=10, weekly=3, daily=4, scope="global")
CONFIG_B_LOCAL = replace(CONFIG_B, scope="local")
