"""Normal distribution and Black-Scholes prices as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: W. J. Cody's rational approximations of erf and erfc (1969)
ERF_SMALL_NUM = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
ERF_SMALL_DEN = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
ERFC_MID_NUM = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
                1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
ERFC_MID_DEN = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03,
                4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
ERFC_FAR_NUM = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4,
                1.63153871373020978e-2)
ERFC_FAR_DEN = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
INV_SQRT_PI = 0.56418958354775628695


def _horner(x, coefficients, start):
    value = start
    for c in coefficients:
        value = value * x + c
    return value


def bound(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; keeps long formulas from repeating their argument."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def erf(value: Column) -> Column:
    """Error function, accurate to about 1e-15."""
    return bound(value, _erf)


def _erf(x: Column) -> Column:
    y = F.abs(x)
    s = x * x
    # coefficients run from the leading one to the constant; the last listed is the leading one of each numerator
    small = x * _horner(s, ERF_SMALL_NUM[:4], F.lit(ERF_SMALL_NUM[4])) / _horner(s, ERF_SMALL_DEN, F.lit(1.0))
    mid = F.exp(-s) * _horner(y, ERFC_MID_NUM[:8], F.lit(ERFC_MID_NUM[8])) / _horner(y, ERFC_MID_DEN, F.lit(1.0))
    z = 1.0 / F.nullif(s, F.lit(0.0))
    tail = z * _horner(z, ERFC_FAR_NUM[:5], F.lit(ERFC_FAR_NUM[5])) / _horner(z, ERFC_FAR_DEN, F.lit(1.0))
    far = F.exp(-s) * (INV_SQRT_PI - tail) / F.nullif(y, F.lit(0.0))
    return F.when(y <= 0.46875, small).otherwise(
        F.signum(x) * (1.0 - F.when(y <= 4.0, mid).when(y < 26.0, far).otherwise(0.0))
    )


def norm_cdf(x: Column) -> Column:
    return 0.5 * (1.0 + erf(x / 1.4142135623730951))


def bs_price(S: Column, K: Column, T: Column, r: Column, sigma: Column, kind: str | Column) -> Column:
    """European call (``CE``) or put (``PE``); intrinsic value where time or volatility is not positive.

    ``kind`` may be a column of +1 (call) and -1 (put), so that one expression prices every leg of a structure.
    """
    side = F.lit(1.0 if kind == "CE" else -1.0) if isinstance(kind, str) else kind
    vol = sigma * F.sqrt(T)
    d1 = (F.ln(S / K) + (r + 0.5 * sigma * sigma) * T) / vol
    discounted = K * F.exp(-r * T)
    # both distribution values come from one copy of the approximation
    cdfs = F.transform(F.array(side * d1, side * (d1 - vol)), norm_cdf)
    value = bound(cdfs, lambda n: side * (S * F.get(n, F.lit(0)) - discounted * F.get(n, F.lit(1))))
    zero = F.lit(0.0)
    return (
        F.when((S <= 0) | (K <= 0), zero)
        .when((T <= 0) | (sigma <= 0), F.greatest(zero, side * (S - K)))
        .otherwise(F.greatest(zero, value))
    )


def leg_prices(S: Column, legs: list[tuple[Column, str]], T: Column, r: Column, sigma: Column) -> Column:
    """Array of prices of several (strike, kind) legs on the same spot."""
    items = F.array(*[F.struct(k.alias("k"), F.lit(1.0 if kind == "CE" else -1.0).alias("side")) for k, kind in legs])
    return F.transform(items, lambda leg: bs_price(S, leg.k, T, r, sigma, leg.side))


def implied_vol(price: Column, S: Column, K: Column, T: Column, r: Column, kind: str, low: float = 1e-4, high: float = 5.0, steps: int = 60) -> Column:
    """Volatility whose Black-Scholes price is ``price``: a fixed number of bisections inside one expression."""
    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))

    def halve(state, _):
        mid = (state.lo + state.hi) / 2.0
        below = bs_price(S, K, T, r, mid, kind) < price
        return F.struct(
            F.when(below, mid).otherwise(state.lo).alias("lo"), F.when(below, state.hi).otherwise(mid).alias("hi")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s.lo + s.hi) / 2.0)


def round_strike(value: Column, step: float, direction: str) -> Column:
    """Round to a multiple of ``step``: up, down, or half to even."""
    if step <= 0:
        return value.cast("double")
    units = value / step
    if direction == "up":
        units = F.ceil(units)
    elif direction == "down":
        units = F.floor(units)
    else:
        units = F.bround(units)
    return (units * F.lit(step)).cast("double")
