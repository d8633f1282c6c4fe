"""Distribution functions as native Spark SQL expressions.

Spark has no ``erf``, Student-t or chi-square CDF. These recipes use only
``aggregate(sequence(...))`` higher-order functions, so they stay inside
Catalyst and whole-stage codegen, evaluate per row and need no UDF.

Every builder takes SQL text for its arguments and returns SQL text; the
``*_col`` wrappers return Columns. Lambda variable names carry a suffix so
the expressions nest safely inside each other.
"""

from __future__ import annotations

import itertools

_ids = itertools.count()


def _sfx() -> str:
    return f"x{next(_ids)}"


def _int_range(lo: str, hi: str) -> str:
    """``sequence(lo, hi)`` that is empty when hi < lo (sequence counts down)."""
    return (f"IF(CAST({hi} AS INT) >= CAST({lo} AS INT), sequence(CAST({lo} AS INT), CAST({hi} AS INT)), "
            f"CAST(array() AS ARRAY<INT>))")


def erfc(z: str) -> str:
    """Complementary error function for z >= 0.

    z < 2.5: Maclaurin series of erf with 81 terms; otherwise the backward
    continued fraction of Laplace with 200 levels. Relative error ~1e-12.
    """
    s = _sfx()
    zz = f"CAST(({z}) AS DOUBLE)"
    series = (f"(1D - 2D / sqrt(pi()) * aggregate(sequence(0, 80), named_struct('t', {zz}, 's', 0D), "
              f"(a{s}, k{s}) -> named_struct('t', -a{s}.t * {zz} * {zz} / (k{s} + 1), "
              f"'s', a{s}.s + a{s}.t / (2 * k{s} + 1)), a{s} -> a{s}.s))")
    fraction = (f"(exp(-{zz} * {zz}) / sqrt(pi()) / aggregate(sequence(200, 1, -1), {zz}, "
                f"(b{s}, j{s}) -> {zz} + (j{s} / 2D) / b{s}))")
    return f"(CASE WHEN {zz} IS NULL THEN NULL WHEN {zz} < 2.5D THEN {series} ELSE {fraction} END)"


def normal_sf2(z: str) -> str:
    """Two-sided normal tail probability P(|Z| >= |z|) = erfc(|z| / sqrt 2)."""
    return erfc(f"abs({z}) / sqrt(2D)")


def _ln_gamma(z: str) -> str:
    """log Gamma(z) for z > 0: Stirling's series at z + 12, brought back by the product of the steps between."""
    y = f"(({z}) + 12D)"
    steps = " * ".join(f"(({z}) + {i}D)" for i in range(12))
    # Bernoulli numbers over 2k (2k - 1)
    series = " + ".join(f"({c}) / pow({y}, {p})" for c, p in (("1D / 12D", 1), ("-1D / 360D", 3), ("1D / 1260D", 5), ("-1D / 1680D", 7), ("1D / 1188D", 9)))
    return f"(({y} - 0.5D) * ln({y}) - {y} + 0.5D * ln(2D * pi()) + {series} - ln({steps}))"


def _beta_inc(x: str, a: str, b: str) -> str:
    """Regularised incomplete beta I_x(a, b) by its continued fraction, evaluated from the far end.

    Meant for x below (a + 1) / (a + b + 2), where about sqrt(max(a, b)) terms
    reach double precision.
    """
    s = _sfx()
    terms = f"CAST(60 + 4 * ceil(sqrt(greatest({a}, {b}))) AS INT)"
    m = f"(k{s} div 2)"
    even = f"({m} * (({b}) - {m}) * ({x}) / ((({a}) + 2 * {m} - 1) * (({a}) + 2 * {m})))"
    odd = f"(-(({a}) + {m}) * (({a}) + ({b}) + {m}) * ({x}) / ((({a}) + 2 * {m}) * (({a}) + 2 * {m} + 1)))"
    fraction = f"aggregate(sequence({terms}, 1, -1), 1D, (f{s}, k{s}) -> 1D + IF(k{s} % 2 = 0, {even}, {odd}) / f{s})"
    front = f"exp(({a}) * ln({x}) + ({b}) * ln(1D - ({x})) + {_ln_gamma(f'({a}) + ({b})')} - {_ln_gamma(a)} - {_ln_gamma(b)})"
    return f"({front} / ({a}) / {fraction})"


def _t_tail(t2: str, n: str) -> str:
    """Two-sided tail of Student's t with n degrees of freedom, given t squared.

    I_x(n/2, 1/2) at x = n / (n + t^2): the tail itself, so small p-values keep
    their digits; for x near 1 the complement, which is then no small number.
    """
    a, b = f"(CAST(({n}) AS DOUBLE) / 2D)", "0.5D"
    x, rest = f"(({n}) / (({n}) + {t2}))", f"({t2} / (({n}) + {t2}))"
    return (f"(CASE WHEN {t2} = 0D THEN 1D WHEN {x} <= 0D THEN 0D WHEN {x} < ({a} + 1D) / ({a} + 2.5D) "
            f"THEN {_beta_inc(x, a, b)} ELSE 1D - {_beta_inc(rest, b, a)} END)")


def t_sf2(t: str, n: str) -> str:
    """Two-sided p-value of a Student-t statistic with n >= 1 degrees of freedom."""
    t2 = f"pow(CAST(({t}) AS DOUBLE), 2)"
    return f"(CASE WHEN ({t}) IS NULL OR ({n}) IS NULL OR ({n}) < 1 THEN NULL ELSE {_t_tail(t2, n)} END)"


def t_quantile2(alpha: str, n: str, steps: int = 64) -> str:
    """Critical value t* with two-sided tail alpha, i.e. ppf(1 - alpha/2).

    Bisection in the angle atan(t / sqrt n); 64 halvings reach the double
    resolution. Costs ``steps`` tails: callers evaluate it once for each
    distinct number of degrees of freedom.
    """
    s = _sfx()
    mid = f"((q{s}.lo + q{s}.hi) / 2D)"
    tail = _t_tail(f"(CAST(({n}) AS DOUBLE) * pow(tan({mid}), 2))", n)
    return (f"aggregate(sequence(1, {steps}), named_struct('lo', 0D, 'hi', pi() / 2D), "
            f"(q{s}, r{s}) -> IF({tail} > ({alpha}), named_struct('lo', {mid}, 'hi', q{s}.hi), "
            f"named_struct('lo', q{s}.lo, 'hi', {mid})), "
            f"q{s} -> sqrt(CAST(({n}) AS DOUBLE)) * tan((q{s}.lo + q{s}.hi) / 2D))")


def chi2_sf(x: str, df: str) -> str:
    """Upper tail of the chi-square distribution, integer df >= 1.

    even df: exp(-x/2) * sum_{j < df/2} (x/2)^j / j!
    odd df:  erfc(sqrt(x/2)) + exp(-x/2) * sum_{j=1..(df-1)/2} (x/2)^(j-1/2) / Gamma(j+1/2)
    """
    s = _sfx()
    xx = f"CAST(({x}) AS DOUBLE)"
    even = (f"exp(-{xx} / 2D) * aggregate({_int_range('1', f'({df}) div 2 - 1')}, named_struct('t', 1D, 's', 1D), "
            f"(c{s}, j{s}) -> named_struct('t', c{s}.t * ({xx} / 2D) / j{s}, 's', c{s}.s + c{s}.t * ({xx} / 2D) / j{s}), "
            f"c{s} -> c{s}.s)")
    odd_tail = (f"exp(-{xx} / 2D) * aggregate({_int_range('1', f'(({df}) - 1) div 2')}, "
                f"named_struct('t', sqrt({xx} / 2D) / (sqrt(pi()) / 2D), 's', 0D), "
                f"(d{s}, k{s}) -> named_struct('t', d{s}.t * ({xx} / 2D) / (k{s} + 0.5D), 's', d{s}.s + d{s}.t), "
                f"d{s} -> d{s}.s)")
    odd = f"({erfc(f'sqrt({xx} / 2D)')} + {odd_tail})"
    return (f"(CASE WHEN {xx} IS NULL OR ({df}) IS NULL THEN NULL WHEN {xx} <= 0D THEN 1D "
            f"WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END)")


def signed_rank_exact_p(w: str, n: str) -> str:
    """Exact two-sided p of the Wilcoxon signed-rank statistic W = min(W+, W-).

    Counts of subset sums of the ranks 1..n are built by the recurrence
    c'[s] = c[s] + c[s - r]; p = min(1, 2 * sum_{s <= W} c[s] / 2^n).
    Valid without ties and zeros; n <= 62 keeps the counts inside BIGINT.
    """
    s = _sfx()
    counts = (f"aggregate(sequence(1, CAST(({n}) AS INT)), "
              f"concat(array(1L), array_repeat(0L, CAST(({n}) * (({n}) + 1) div 2 AS INT))), "
              f"(w{s}, r{s}) -> transform(w{s}, (v{s}, i{s}) -> v{s} + IF(i{s} >= r{s}, w{s}[i{s} - r{s}], 0L)))")
    cdf = (f"aggregate(slice({counts}, 1, CAST(floor({w}) AS INT) + 1), 0L, (u{s}, y{s}) -> u{s} + y{s})")
    return f"(CASE WHEN ({n}) IS NULL OR ({n}) < 1 THEN NULL ELSE least(1D, 2D * {cdf} / pow(2D, ({n}))) END)"


def signed_rank_normal_p(w: str, n: str, tie_term: str) -> str:
    """Normal approximation of the signed-rank test with tie correction.

    tie_term = sum over tie groups of (t^3 - t); no continuity correction.
    """
    nn = f"CAST(({n}) AS DOUBLE)"
    mean = f"({nn} * ({nn} + 1D) / 4D)"
    se = f"sqrt(({nn} * ({nn} + 1D) * (2D * {nn} + 1D) - 0.5D * ({tie_term})) / 24D)"
    return f"(CASE WHEN ({n}) IS NULL OR ({n}) < 1 THEN NULL ELSE {normal_sf2(f'(({w}) - {mean}) / {se}')} END)"
