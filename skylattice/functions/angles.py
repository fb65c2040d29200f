"""Angles, unit vectors and separations as Column expressions.

Angles are radians unless a name says degrees.  `theta` is the colatitude and `phi` the longitude of the
sphere the pixels live on.  Catalogue longitudes are mirrored by default (`phi = 360 - ra`), which leaves
separations alone but decides pixel ids; `mirror=False` gives `phi = ra`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def theta_of_dec(dec: Column) -> Column:
    return F.radians(F.lit(90.0) - dec)


def phi_of_ra(ra: Column, mirror: bool = True) -> Column:
    return F.radians(F.lit(360.0) - ra) if mirror else F.radians(ra)


def dec_of_theta(theta: Column) -> Column:
    return F.lit(90.0) - F.degrees(theta)


def ra_of_phi(phi: Column, mirror: bool = True) -> Column:
    return F.lit(360.0) - F.degrees(phi) if mirror else F.degrees(phi)


def with_angles(df: DataFrame, ra: str = "ra", dec: str = "dec", mirror: bool = True) -> DataFrame:
    """Add `theta`, `phi` from degrees."""
    return df.withColumns({"theta": theta_of_dec(F.col(dec)), "phi": phi_of_ra(F.col(ra), mirror)})


def with_degrees(df: DataFrame, theta: str = "theta", phi: str = "phi", mirror: bool = True) -> DataFrame:
    """Add `ra`, `dec` in degrees from angles."""
    return df.withColumns({"ra": ra_of_phi(F.col(phi), mirror), "dec": dec_of_theta(F.col(theta))})


def with_vector(df: DataFrame, theta: str = "theta", phi: str = "phi") -> DataFrame:
    """Add the unit vector `x`, `y`, `z` of the angles."""
    sine = F.sin(F.col(theta))
    return df.withColumns({"x": sine * F.cos(F.col(phi)), "y": sine * F.sin(F.col(phi)), "z": F.cos(F.col(theta))})


def vector_of_zphi(z: Column, phi: Column) -> tuple[Column, Column, Column]:
    sine = F.sqrt((1.0 - z) * (1.0 + z))
    return sine * F.cos(phi), sine * F.sin(phi), z


def angles_of_vector(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(theta, phi) of a vector of any length, phi in [0, 2 pi)."""
    return F.atan2(F.sqrt(x * x + y * y), z), wrap(F.atan2(y, x))


def zphi_of_vector(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return z / length(x, y, z), F.atan2(y, x)


def zphi_of_angles(theta: Column, phi: Column) -> tuple[Column, Column]:
    return F.cos(theta), phi


def angles_of_zphi(z: Column, phi: Column) -> tuple[Column, Column]:
    return F.atan2(F.sqrt((1.0 - z) * (1.0 + z)), z), phi


def wrap(angle: Column) -> Column:
    """An angle brought to [0, 2 pi)."""
    return F.pmod(angle, F.lit(TWO_PI))


def normalised(theta: Column, phi: Column) -> tuple[Column, Column]:
    """Any (theta, phi) brought to theta in [0, pi], phi in [0, 2 pi): going over a pole turns phi by pi."""
    turned = wrap(theta)
    over = turned > F.lit(math.pi)
    return (
        F.when(over, F.lit(TWO_PI) - turned).otherwise(turned),
        wrap(F.when(over, phi + F.lit(math.pi)).otherwise(phi)),
    )


Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def add(a: Vector, b: Vector) -> Vector:
    return (a[0] + b[0], a[1] + b[1], a[2] + b[2])


def sub(a: Vector, b: Vector) -> Vector:
    return (a[0] - b[0], a[1] - b[1], a[2] - b[2])


def scale(a: Vector, factor: Column | float) -> Vector:
    return (a[0] * factor, a[1] * factor, a[2] * factor)


def flip(a: Vector) -> Vector:
    return (-a[0], -a[1], -a[2])


def length(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def unit(a: Vector) -> Vector:
    """The vector at length one; NULL for the zero vector."""
    size = length(*a)
    return tuple(F.try_divide(part, size) for part in a)


def angle(a: Vector, b: Vector) -> Column:
    """Angle between two directions, accurate for small and for nearly opposite ones."""
    return F.atan2(length(*cross(a, b)), dot(a, b))


def haversine(theta1: Column, phi1: Column, theta2: Column, phi2: Column) -> Column:
    half_theta, half_phi = F.sin((theta1 - theta2) / 2.0), F.sin((phi2 - phi1) / 2.0)
    inner = half_theta * half_theta + half_phi * half_phi * F.sin(theta1) * F.sin(theta2)
    return 2.0 * F.asin(F.least(F.lit(1.0), F.sqrt(inner)))


def chord2(a: Vector, b: Vector) -> Column:
    """Squared straight-line distance; for unit vectors 4 sin^2(separation / 2)."""
    delta = sub(a, b)
    return dot(delta, delta)


def cos_distance(z1: Column, phi1: Column, z2: Column, phi2: Column) -> Column:
    """Cosine of the separation of two points given as (z, phi)."""
    return z1 * z2 + F.cos(phi1 - phi2) * F.sqrt((1.0 - z1 * z1) * (1.0 - z2 * z2))


def separation_of_chord2(d2: Column) -> Column:
    return 2.0 * F.asin(F.least(F.lit(1.0), F.sqrt(d2) / 2.0))


def chord_of(separation: float) -> float:
    """Chord of a separation, both plain numbers."""
    return 2.0 * math.sin(0.5 * separation)
