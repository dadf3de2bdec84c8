"""Normal distribution and related small numeric helpers for use inside tasks."""

from __future__ import annotations

import math

import numpy as np

# Fixed coefficients of Wichura's AS 241 (PPND16) rational approximations, lowest order first.
_CENTRE_NUM = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
               4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
_CENTRE_DEN = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4,
               3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
_NEAR_NUM = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
             1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
_NEAR_DEN = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1,
             1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
_FAR_NUM = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
            2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
_FAR_DEN = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4,
            1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _ratio(num, den, x):
    return np.polynomial.polynomial.polyval(x, num) / np.polynomial.polynomial.polyval(x, den)


def inverse_normal(p: np.ndarray) -> np.ndarray:
    """Quantile of the standard normal for 0 < p < 1."""
    p = np.asarray(p, dtype="float64")
    q = p - 0.5
    r = np.sqrt(-np.log(np.minimum(p, 1 - p)))
    centre = q * _ratio(_CENTRE_NUM, _CENTRE_DEN, 0.180625 - q * q)
    tail = np.where(r <= 5, _ratio(_NEAR_NUM, _NEAR_DEN, r - 1.6), _ratio(_FAR_NUM, _FAR_DEN, r - 5))
    return np.where(np.abs(q) <= 0.425, centre, np.sign(q) * tail)


_erf = np.frompyfunc(math.erf, 1, 1)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(z, dtype="float64") / math.sqrt(2)).astype("float64"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def pearson_p(r: float, n: int) -> float:
    """Two-sided p value of a Pearson correlation."""
    if n < 3 or r is None:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    return incomplete_beta((n - 2) / 2, 0.5, 1 - r * r)


def kolmogorov_p(d: float, n: float) -> float:
    """Asymptotic p value of a Kolmogorov–Smirnov distance with effective size ``n``."""
    x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if x < 0.2:
        return 1.0
    total = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
    return min(1.0, max(0.0, total))
