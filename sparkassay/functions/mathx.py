"""Normal distribution functions and response arithmetic as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cody's rational approximations of erf, highest power first.
_A = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
_B = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
_C = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
_D = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
# Wichura's algorithm AS 241 for the normal quantile, lowest power first.
_QA = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
_QB = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
_QC = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
_QD = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
_QE = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
_QF = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def polynomial(x: Column, high_first: tuple[float, ...]) -> Column:
    out = F.lit(high_first[0])
    for c in high_first[1:]:
        out = out * x + F.lit(c)
    return out


def erf(z: Column) -> Column:
    """Error function; relative error of about 1e-16 up to |z| = 4, absolute error under 2e-16 beyond 6."""
    a, s = F.abs(z), z * z
    near = z * polynomial(s, _A) / polynomial(s, _B)
    far = F.signum(z) * (F.lit(1.0) - F.exp(-s) * polynomial(a, _C) / polynomial(a, _D))
    return F.when(a <= 0.46875, near).when(a <= 6.0, far).otherwise(F.signum(z))


def normal_cdf(z: Column) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(z / F.lit(2.0**0.5)))


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function for 0 < p < 1."""
    return once(p, _quantile)


def _quantile(p: Column) -> Column:
    rational = lambda x, top, below: polynomial(x, top[::-1]) / polynomial(x, below[::-1])
    q = p - F.lit(0.5)
    middle = q * rational(F.lit(0.180625) - q * q, _QA, _QB)
    r = F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p)))
    tail = F.when(r <= 5.0, rational(r - 1.6, _QC, _QD)).otherwise(rational(r - 5.0, _QE, _QF))
    return F.when(F.abs(q) <= 0.425, middle).otherwise(F.signum(q) * tail)


def vector(text: Column, delimiter: str = ",") -> Column:
    """Numbers of a delimited string; a part that is no number is null."""
    import re

    return F.transform(F.split(text, re.escape(delimiter)), lambda x: F.trim(x).try_cast("double"))


def qualified_number(text: Column) -> Column:
    """A number with < or > stripped; null if it is none."""
    return F.regexp_replace(text.cast("string"), "[<>]", "").try_cast("double")


def boolean(value: Column) -> Column:
    """1 and 0 of the accepted spellings, else null."""
    s = F.lower(value.cast("string"))
    exact = value.cast("string")
    return F.when(exact.isin("True", "true", "1", "1.0"), 1).when(exact.isin("False", "false", "0", "0.0"), 0).when(s.isNull(), None).cast("int")


def ellipsis(text: Column, size: int = 100) -> Column:
    return F.when(F.length(text) > size - 3, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text)


def without_reaction_arrow(key: Column) -> Column:
    return F.replace(key, F.lit(">>"), F.lit("."))


def hashed(seed: int, *keys: Column) -> Column:
    """Deterministic order key: MD5 of seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))
