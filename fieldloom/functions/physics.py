"""Physical quantities as columns of any table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: W / (m^2 K^4), a fixed value.
STEFAN_BOLTZMANN = 5.67e-8


def von_mises(sx: Column, sy: Column, sxy: Column, sz: Column | None = None, syz: Column | None = None, szx: Column | None = None) -> Column:
    """Equivalent stress of three (plane) or six components."""
    if sz is None:
        return F.sqrt(sx * sx - sx * sy + sy * sy + 3 * sxy * sxy)
    return F.sqrt(0.5 * ((sx - sy) ** 2 + (sy - sz) ** 2 + (sz - sx) ** 2) + 3 * (sxy * sxy + syz * syz + szx * szx))


def principal_stresses(sx: Column, sy: Column, sxy: Column) -> tuple[Column, Column, Column]:
    """Larger and smaller principal stress and the angle of the first."""
    mid, r = (sx + sy) / 2, F.sqrt(((sx - sy) / 2) ** 2 + sxy * sxy)
    return mid + r, mid - r, 0.5 * F.atan2(2 * sxy, sx - sy)


def principal_stresses_3d(sx: Column, sy: Column, sz: Column, sxy: Column, syz: Column, szx: Column) -> tuple[Column, Column, Column]:
    """Principal stresses, largest first: the roots of the characteristic cubic in closed form."""
    mid = (sx + sy + sz) / 3
    a, b, c = sx - mid, sy - mid, sz - mid
    p = F.sqrt((a * a + b * b + c * c + 2 * (sxy * sxy + syz * syz + szx * szx)) / 6)
    det = a * (b * c - syz * syz) - sxy * (sxy * c - syz * szx) + szx * (sxy * syz - b * szx)
    r = F.when(p > 0, det / (2 * p * p * p)).otherwise(0.0)
    angle = F.acos(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))) / 3
    first, last = mid + 2 * p * F.cos(angle), mid + 2 * p * F.cos(angle + 2 * math.pi / 3)
    return first, 3 * mid - first - last, last


def lame_lambda(e: Column, nu: Column) -> Column:
    return e * nu / ((1 + nu) * (1 - 2 * nu))


def shear_modulus(e: Column, nu: Column) -> Column:
    return e / (2 * (1 + nu))


def bulk_modulus(e: Column, nu: Column) -> Column:
    return e / (3 * (1 - 2 * nu))


def hooke_stress(strain: Sequence[Column], e: Column, nu: Column, kind: str = "plane_stress") -> tuple[Column, ...]:
    """Stress components of strains (x, y, shear), or of six in Voigt order (x, y, z, xy, yz, zx) for ``3d``."""
    if kind == "plane_stress":
        x, y, g = strain
        f = e / (1 - nu * nu)
        return f * (x + nu * y), f * (nu * x + y), f * (1 - nu) / 2 * g
    f = e / ((1 + nu) * (1 - 2 * nu))
    if kind == "plane_strain":
        x, y, g = strain
        return f * ((1 - nu) * x + nu * y), f * (nu * x + (1 - nu) * y), f * (1 - 2 * nu) / 2 * g
    if kind != "3d":
        raise ValueError(f"no law {kind}")
    x, y, z, *shear = strain
    normal = [f * ((1 - nu) * a + nu * (b + c)) for a, b, c in ((x, y, z), (y, z, x), (z, x, y))]
    return (*normal, *[f * (1 - 2 * nu) / 2 * g for g in shear])


def thermal_diffusivity(k: Column, rho: Column, cp: Column) -> Column:
    return k / (rho * cp)


def radiative_flux(t: Column, ambient: Column, emissivity: Column) -> Column:
    return emissivity * STEFAN_BOLTZMANN * (t**4 - ambient**4)


def radiation_coefficient(t: Column, ambient: Column, emissivity: Column) -> Column:
    """Coefficient of the flux linearised at the mean of both temperatures."""
    return 4 * emissivity * STEFAN_BOLTZMANN * ((t + ambient) / 2) ** 3


def contact_flux(hot: Column, cold: Column, resistance: Column) -> Column:
    return (hot - cold) / resistance


def kinematic_viscosity(mu: Column, rho: Column) -> Column:
    return mu / rho


def reynolds_number(rho: Column, u: Column, length: Column, mu: Column) -> Column:
    return rho * u * length / mu


def euler_pressure(rho: Column, mx: Column, my: Column, energy: Column, gamma: float = 1.4) -> Column:
    return (gamma - 1) * (energy - 0.5 * (mx * mx + my * my) / rho)


def sound_speed(p: Column, rho: Column, gamma: float = 1.4) -> Column:
    return F.sqrt(gamma * p / rho)


def euler_flux(rho: Column, mx: Column, my: Column, energy: Column, direction: int, gamma: float = 1.4) -> tuple[Column, Column, Column, Column]:
    """Fluxes of mass, both momenta and energy along x (0) or y (1)."""
    m = (mx, my)[direction]
    u, p = m / rho, euler_pressure(rho, mx, my, energy, gamma)
    return m, mx * u + (p if direction == 0 else 0), my * u + (p if direction == 1 else 0), (energy + p) * u


def wave_speed(rho: Column, mx: Column, my: Column, energy: Column, gamma: float = 1.4) -> Column:
    """Flow speed plus sound speed, or null where the pressure is negative."""
    p = euler_pressure(rho, mx, my, energy, gamma)
    return F.when(p >= 0, F.sqrt(mx * mx + my * my) / rho + sound_speed(p, rho, gamma))


def pressure_coefficient(p: Column, p_inf: float, rho_inf: float, u_inf: float) -> Column:
    return (p - p_inf) / (0.5 * rho_inf * u_inf**2)


def conserve_sum(x: Column, y: Column) -> Column:
    """The array ``y`` shifted evenly so that it sums to the sum of ``x``."""
    s = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
    return F.transform(y, lambda v: v + (s(x) - s(y)) / F.size(y))

