"""Association and keyness measures as column expressions.  An undefined number is NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column | float) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("double")


def _xlogx(o: Column, e: Column) -> Column:
    return F.when((o > 0) & (e > 0), o * F.ln(F.when((o > 0) & (e > 0), o / F.nullif(e, F.lit(0.0))))).otherwise(F.lit(0.0))


def g2_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Log likelihood of a 2x2 table; cells or expectations of 0 add nothing."""
    a, b, c, d = map(_d, (a, b, c, d))
    n = F.nullif(a + b + c + d, F.lit(0.0))
    cells = [(a, (a + b) * (a + c) / n), (b, (a + b) * (b + d) / n), (c, (c + d) * (a + c) / n), (d, (c + d) * (b + d) / n)]
    return F.when(n > 0, 2 * sum((_xlogx(o, e) for o, e in cells[1:]), _xlogx(*cells[0])))


def expected(fn: Column, fc: Column, n: Column, w: Column) -> Column:
    return F.when(n > 0, _d(fn) * _d(fc) * _d(w) / F.nullif(_d(n), F.lit(0.0)))


def association(o: Column, fn: Column, fc: Column, n: Column, w: Column) -> dict[str, Column]:
    """expected, mi, t, log_dice, g2 of a node and a collocate.

    The span around all nodes holds fn * w places, o of them taken by the collocate."""
    o, fn, fc, n, w = map(_d, (o, fn, fc, n, w))
    e = expected(fn, fc, n, w)
    b = F.greatest(fc - o, F.lit(0.0))
    c = F.greatest(fn * w - o, F.lit(0.0))
    return {
        "expected": e,
        "mi": F.when((o > 0) & (e > 0), F.log2(F.when(e > 0, o / F.nullif(e, F.lit(0.0))))),
        "t": F.when(o > 0, (o - e) / F.sqrt(F.nullif(o, F.lit(0.0)))),
        "log_dice": log_dice(o, fn, fc),
        "g2": g2_2x2(o, b, c, F.greatest(n - o - b - c, F.lit(0.0))),
    }


def log_dice(o: Column, fa: Column, fb: Column) -> Column:
    o, total = _d(o), _d(fa) + _d(fb)
    return F.when((o > 0) & (total > 0), 14 + F.log2(2 * o / F.nullif(total, F.lit(0.0))))


def g2_keyness(fa: Column, fb: Column, na: Column, nb: Column) -> Column:
    """Two corpora; 0 where there is nothing to compare."""
    fa, fb, na, nb = map(_d, (fa, fb, na, nb))
    share = (fa + fb) / F.nullif(na + nb, F.lit(0.0))
    return F.when((na + nb > 0) & (fa + fb > 0), 2 * (_xlogx(fa, na * share) + _xlogx(fb, nb * share))).otherwise(F.lit(0.0))


def log_ratio(fa: Column, fb: Column, na: Column, nb: Column) -> Column:
    """Half an occurrence is added to both counts where one is 0."""
    add = F.when((fa == 0) | (fb == 0), F.lit(0.5)).otherwise(F.lit(0.0))
    return F.log2(((_d(fa) + add) / _d(na)) / ((_d(fb) + add) / _d(nb)))


def odds_ratio(fa: Column, fb: Column, na: Column, nb: Column) -> Column:
    """NULL where a count is 0 or a word fills its group."""
    fa, fb, na, nb = map(_d, (fa, fb, na, nb))
    ok = (fa > 0) & (fb > 0) & (na > fa) & (nb > fb)
    return F.when(ok, F.try_divide(F.try_divide(fa, na - fa), F.try_divide(fb, nb - fb)))


# --- fixed values: rational approximations of the error function in three ranges (Cody 1969), numerator and denominator
_NEAR = ((1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_FAR = ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4), (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3))


def _polynomial(x: Column, terms: tuple[float, ...]) -> Column:
    out = F.lit(terms[0])
    for c in terms[1:]:
        out = out * x + c
    return out


def _quotient(x: Column, pair: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    return _polynomial(x, pair[0]) / _polynomial(x, pair[1])


def p_value(g2: Column | str) -> Column:
    """Upper tail of the chi-squared distribution with one degree of freedom, erfc(sqrt(g2 / 2)).  Neither erf nor
    erfc is built in; quotients of polynomials are compiled with the rest of the plan.  NULL where g2 is NULL or not a number."""
    x = F.col(g2) if isinstance(g2, str) else g2
    half = F.greatest(x, F.lit(0.0)) / 2
    z = F.sqrt(half)
    far = F.lit(1.0) / F.greatest(half, F.lit(1.0))
    tail = F.exp(-half) * F.when(z <= 4, _quotient(z, _MIDDLE)).otherwise((1 / math.sqrt(math.pi) - far * _quotient(far, _FAR)) / F.greatest(z, F.lit(1.0)))
    p = F.when(z <= 0.46875, 1 - z * _quotient(half, _NEAR)).otherwise(tail)
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.lit(1.0), p))
