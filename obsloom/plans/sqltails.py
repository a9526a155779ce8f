"""Tail probabilities as SQL expressions (Simpson sums), for engines without erf or beta."""


def _simpson(f, width, n):
    w = f"(CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"({width}) / {3 * n}.0::DOUBLE * list_sum(list_transform(range(0, {n + 1}), lambda i: {w} * ({f})))"


def norm_two_sided(z):
    return f"(1 - sqrt(2 / pi()) * " + _simpson(f"exp(-power(abs({z}) * i / 400.0::DOUBLE, 2) / 2)", f"abs({z})", 400) + ")"


def f_sf(f, d1, d2):
    """Upper tail of F through the angle form of the beta integral."""
    at = f"atan(sqrt({d1} * ({f}) / ({d2})))"
    width = f"least(pi() / 2 - {at}, 20 / sqrt({d1} + {d2}))"
    th = f"({at} + {width} * i / 2000.0::DOUBLE)"
    norm = f"lgamma((({d1}) + ({d2})) / 2.0::DOUBLE) - lgamma(({d1}) / 2.0::DOUBLE) - lgamma(({d2}) / 2.0::DOUBLE) + ln(2)"
    sin_part = "0" if str(d1) == "1" else f"(({d1}) - 1) * ln(greatest(sin({th}), 1e-300))"
    return _simpson(f"exp({sin_part} + (({d2}) - 1) * ln(greatest(cos({th}), 1e-300)) + {norm})", width, 2000)
