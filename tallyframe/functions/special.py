"""Distribution functions for results on the driver, in plain Python: normal, t, F, chi-square, beta, binomial, Poisson."""

from __future__ import annotations

import math
from collections.abc import Callable

INF = math.inf


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if math.isinf(x):
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return min(1.0, scale * total)
    return max(0.0, 1 - scale * _gamma_fraction(a, x))


def gamma_q(a: float, x: float) -> float:
    """1 - gamma_p, without loss of digits in the tail."""
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    return 1 - gamma_p(a, x) if x < a + 1 else math.exp(a * math.log(x) - x - math.lgamma(a)) * _gamma_fraction(a, x)


def _lentz(term: Callable[[int], tuple[float, float]], first: float) -> float:
    """Value of first + a1/(b1 + a2/(b2 + ...)) for term(k) = (ak, bk)."""
    tiny = 1e-300
    f = c = first or tiny
    d = 0.0
    for k in range(1, 100_000):
        a, b = term(k)
        d = b + a * d or tiny
        c = b + a / c or tiny
        d = 1 / d
        f *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return f


def _gamma_fraction(a: float, x: float) -> float:
    return 1 / _lentz(lambda k: (-k * (k - a), x + 2 * k + 1 - a), x + 1 - a)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a

    def term(k: int) -> tuple[float, float]:
        m = k // 2
        if k % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    return scale / _lentz(term, 1.0)


def inverse(cdf: Callable[[float], float], p: float, low: float, high: float) -> float:
    """The point where an increasing function reaches p, by bisection from a bracket that grows where it is open."""
    if math.isnan(p) or p < 0 or p > 1:
        return math.nan
    if p == 0:
        return low
    if p == 1:
        return high
    a = low if not math.isinf(low) else -1.0
    b = high if not math.isinf(high) else max(1.0, a + 1)
    while math.isinf(low) and cdf(a) > p:
        a *= 2
    while math.isinf(high) and cdf(b) < p:
        b = b * 2 if b > 0 else 1.0
    for _ in range(400):
        m = (a + b) / 2
        if m in (a, b):
            break
        if cdf(m) < p:
            a = m
        else:
            b = m
    return (a + b) / 2


def norm_cdf(x: float, mean: float = 0, sd: float = 1) -> float:
    return 0.5 * math.erfc(-(x - mean) / sd / math.sqrt(2))


def norm_pdf(x: float, mean: float = 0, sd: float = 1) -> float:
    return math.exp(-(((x - mean) / sd) ** 2) / 2) / (sd * math.sqrt(2 * math.pi))


def norm_ppf(p: float, mean: float = 0, sd: float = 1) -> float:
    if p > 0.5:  # the lower tail keeps its digits
        return 2 * mean - norm_ppf(1 - p, mean, sd)
    return mean + sd * inverse(norm_cdf, p, -INF, INF)


def t_cdf(x: float, df: float) -> float:
    if math.isinf(x):
        return float(x > 0)
    tail = beta_i(df / 2, 0.5, df / (df + x * x)) / 2
    return 1 - tail if x > 0 else tail


def t_sf(x: float, df: float) -> float:
    return t_cdf(-x, df)


def t_ppf(p: float, df: float) -> float:
    if p > 0.5:
        return -t_ppf(1 - p, df)
    return inverse(lambda x: t_cdf(x, df), p, -INF, INF)


def f_cdf(x: float, d1: float, d2: float) -> float:
    return 0.0 if x <= 0 else 1.0 if math.isinf(x) else beta_i(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2))


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else 0.0 if math.isinf(x) else beta_i(d2 / 2, d1 / 2, d2 / (d1 * x + d2))


def f_ppf(p: float, d1: float, d2: float) -> float:
    return inverse(lambda x: f_cdf(x, d1, d2), p, 0.0, INF)


def chisq_cdf(x: float, df: float) -> float:
    return gamma_p(df / 2, x / 2)


def chisq_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def chisq_ppf(p: float, df: float) -> float:
    return inverse(lambda x: chisq_cdf(x, df), p, 0.0, INF)


def beta_ppf(p: float, a: float, b: float) -> float:
    return inverse(lambda x: beta_i(a, b, x), p, 0.0, 1.0)


def binom_pmf(k: int, n: int, p: float) -> float:
    if k < 0 or k > n:
        return 0.0
    if p in (0, 1):
        return float(k == n * p)
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))


def binom_cdf(k: float, n: int, p: float) -> float:
    k = math.floor(k)
    return 0.0 if k < 0 else 1.0 if k >= n else beta_i(n - k, k + 1, 1 - p)


def _least(cdf: Callable[[int], float], q: float, high: float) -> int:
    """The least whole number at which cdf reaches q."""
    a, b = -1, 1
    while b < high and cdf(b) < q:
        b *= 2
    b = int(min(b, high)) if not math.isinf(high) else b
    while b - a > 1:
        m = (a + b) // 2
        a, b = (a, m) if cdf(m) >= q - 1e-12 else (m, b)
    return b


def binom_ppf(q: float, n: int, p: float) -> int:
    return _least(lambda k: binom_cdf(k, n, p), q, n)


def pois_pmf(k: int, lamb: float) -> float:
    return 0.0 if k < 0 else math.exp(k * math.log(lamb) - lamb - math.lgamma(k + 1))


def pois_cdf(k: float, lamb: float) -> float:
    return 0.0 if k < 0 else gamma_q(math.floor(k) + 1, lamb)


def pois_ppf(q: float, lamb: float) -> int:
    return _least(lambda k: pois_cdf(k, lamb), q, INF)


def binom_test(k: int, n: int, p: float, alternative: str = "two-sided") -> float:
    """Exact p-value; two-sided: the probability of all outcomes no likelier than k."""
    if alternative == "less":
        return binom_cdf(k, n, p)
    if alternative == "greater":
        return 1 - binom_cdf(k - 1, n, p)
    limit = binom_pmf(k, n, p) * (1 + 1e-7)
    mode = min(n, int((n + 1) * p))

    def tail(low: bool) -> float:
        # pmf rises to the mode and falls after it, so either tail is an interval
        a, b = (-1, mode) if low else (mode, n + 1)
        while b - a > 1:
            m = (a + b) // 2
            inside = binom_pmf(m, n, p) <= limit
            a, b = ((m, b) if inside else (a, m)) if low else ((a, m) if inside else (m, b))
        return binom_cdf(a, n, p) if low else 1 - binom_cdf(b - 1, n, p)

    if binom_pmf(mode, n, p) <= limit:
        return 1.0
    return min(1.0, tail(True) + tail(False))


def p_adjust(p: list[float], method: str | None) -> list[float]:
    """Adjusted p-values: bonferroni, sidak, holm, fdr_bh, fdr_by; None leaves them."""
    n = len(p)
    if method is None or n == 0:
        return list(p)
    if method == "bonferroni":
        return [min(1.0, x * n) for x in p]
    if method == "sidak":
        return [1 - (1 - x) ** n for x in p]
    order = sorted(range(n), key=lambda i: p[i])
    out = [0.0] * n
    if method == "holm":
        high = 0.0
        for k, i in enumerate(order):
            high = max(high, min(1.0, p[i] * (n - k)))
            out[i] = high
        return out
    if method in ("fdr_bh", "fdr_by"):
        factor = sum(1 / k for k in range(1, n + 1)) if method == "fdr_by" else 1
        low = 1.0
        for k in range(n, 0, -1):
            low = min(low, p[order[k - 1]] * n * factor / k)
            out[order[k - 1]] = low
        return out
    raise ValueError(f"Unknown adjustment: {method}")
