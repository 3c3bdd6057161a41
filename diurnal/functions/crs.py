"""Coordinate reference systems: a layer's description becomes projection expressions.

Formulas are those of Snyder (1987). Inverse projections solve for the latitude by a fixed number of Newton
steps inside one expression, so no row leaves the JVM.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .nulls import ColumnLike, as_col
from .shapes import point

#: Newton steps of an inverse: more than doubles need from a spherical start.
STEPS = 5
# Names of projections in layer descriptions -> kind.
KINDS = {
    "albers": "albers",
    "albers_conic_equal_area": "albers",
    "lambert_conformal_conic": "lambert",
    "lambert_conformal_conic_2sp": "lambert",
    "mercator": "mercator",
    "mercator_1sp": "mercator",
    "mercator_2sp": "mercator",
}


def _newton(start: Column, step: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.array(*[F.lit(0)] * STEPS), start, lambda phi, _: step(phi))


@dataclass(frozen=True)
class Crs:
    """A geographic or projected system; angles in degrees, ``unit`` metres per map unit."""

    kind: str
    axis: float = 6378137.0
    e2: float = 0.0
    lat1: float = 0.0
    lat2: float = 0.0
    lat0: float = 0.0
    lon0: float = 0.0
    scale: float = 1.0
    east0: float = 0.0
    north0: float = 0.0
    unit: float = 1.0

    @property
    def ecc(self) -> float:
        return math.sqrt(self.e2)

    def _m(self, phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - self.e2 * math.sin(phi) ** 2)

    def _q(self, s, ln):
        """Authalic term of a sine of latitude, for numbers or columns."""
        e = self.ecc
        return 2 * s if not e else (1 - self.e2) * (s / (1 - self.e2 * s * s) - 1 / (2 * e) * ln((1 - e * s) / (1 + e * s)))

    def _psi(self, s, ln):
        """Isometric latitude of a sine of latitude."""
        e = self.ecc
        return ln((1 + s) / (1 - s)) / 2 - e / 2 * ln((1 + e * s) / (1 - e * s))

    def _cone(self) -> tuple[float, float, float]:
        """Cone constant, and the terms that give the radius of a latitude and of the origin."""
        p1, p2, p0 = (math.radians(v) for v in (self.lat1, self.lat2, self.lat0))
        s1, s2, s0 = math.sin(p1), math.sin(p2), math.sin(p0)
        m1, m2 = self._m(p1), self._m(p2)
        if self.kind == "albers":
            q1, q2 = self._q(s1, math.log), self._q(s2, math.log)
            n = (m1**2 - m2**2) / (q2 - q1) if p1 != p2 else s1
            c = m1**2 + n * q1
            return n, c, self.axis * math.sqrt(c - n * self._q(s0, math.log)) / n
        psi1, psi2 = self._psi(s1, math.log), self._psi(s2, math.log)
        n = math.log(m1 / m2) / (psi2 - psi1) if p1 != p2 else s1
        f = m1 * math.exp(n * psi1) / n
        return n, f, self.axis * self.scale * f * math.exp(-n * self._psi(s0, math.log))

    def _mercator_scale(self) -> float:
        return self.axis * (self._m(math.radians(self.lat1)) if self.lat1 else self.scale)

    def forward(self, lon: ColumnLike, lat: ColumnLike) -> Column:
        """Point in map units of a place in degrees."""
        lon, lat = as_col(lon), as_col(lat)
        if self.kind == "geographic":
            return point(lon, lat)
        s, turn = F.sin(F.radians(lat)), F.radians(lon - self.lon0)
        if self.kind == "mercator":
            k = self._mercator_scale()
            x, y = k * turn, k * self._psi(s, F.ln)
        else:
            n, c, rho0 = self._cone()
            rho = self.axis * F.sqrt(c - n * self._q(s, F.ln)) / n if self.kind == "albers" else self.axis * self.scale * c * F.exp(-n * self._psi(s, F.ln))
            x, y = rho * F.sin(n * turn), rho0 - rho * F.cos(n * turn)
        return point((x + self.east0) / self.unit, (y + self.north0) / self.unit)

    def inverse(self, x: ColumnLike, y: ColumnLike) -> Column:
        """Place in degrees (x is the longitude) of a point in map units."""
        x, y = as_col(x), as_col(y)
        if self.kind == "geographic":
            return point(x, y)
        x, y = x * self.unit - self.east0, y * self.unit - self.north0
        if self.kind == "mercator":
            k = self._mercator_scale()
            return point(F.degrees(x / k) + self.lon0, F.degrees(self._of_psi(y / k)))
        n, c, rho0 = self._cone()
        sign = 1 if n > 0 else -1
        rho = sign * F.sqrt(x * x + (rho0 - y) * (rho0 - y))
        turn = F.atan2(sign * x, sign * (rho0 - y)) / n
        if self.kind == "albers":
            phi = self._of_q((c - (rho * n / self.axis) * (rho * n / self.axis)) / n)
        else:
            phi = self._of_psi(-F.ln(rho / (self.axis * self.scale * c)) / n)
        return point(F.degrees(turn) + self.lon0, F.degrees(phi))

    def _of_q(self, q: Column) -> Column:
        def step(phi: Column) -> Column:
            s = F.sin(phi)
            flat = 1 - self.e2 * s * s
            return phi + flat * flat / (2 * F.cos(phi)) * (q - self._q(s, F.ln)) / (1 - self.e2)

        return _newton(F.asin(q / 2), step)

    def _of_psi(self, psi: Column) -> Column:
        def step(phi: Column) -> Column:
            s = F.sin(phi)
            slope = (1 - self.e2) / ((1 - self.e2 * s * s) * F.cos(phi))
            return phi + (psi - self._psi(s, F.ln)) / slope

        return _newton(2 * F.atan(F.exp(psi)) - math.pi / 2, step)


_PARAMETERS = {  # fixed values: parameter names of layer descriptions -> field
    "standard_parallel_1": "lat1",
    "standard_parallel_2": "lat2",
    "latitude_of_origin": "lat0",
    "latitude_of_center": "lat0",
    "central_meridian": "lon0",
    "longitude_of_center": "lon0",
    "scale_factor": "scale",
    "false_easting": "east0",
    "false_northing": "north0",
}


def read_crs(description: str) -> Crs:
    """System from the text of a layer's description (the ``.prj`` file of a boundary layer).

    A projection or parameter that is not known here is an error, not a guess.
    """
    number = r"(-?[\d.]+(?:[eE][-+]?\d+)?)"
    spheroid = re.search(rf'(?:SPHEROID|ELLIPSOID)\s*\[\s*"[^"]*"\s*,\s*{number}\s*,\s*{number}', description, re.I)
    if not spheroid:
        raise ValueError("the description names no spheroid")
    axis, flattening = float(spheroid[1]), float(spheroid[2])
    f = 1 / flattening if flattening else 0.0
    named = re.search(r'PROJECTION\s*\[\s*"([^"]*)"', description, re.I)
    shape = {"axis": axis, "e2": f * (2 - f)}
    if not named:
        return Crs("geographic", **shape)
    kind = KINDS.get(named[1].lower().replace(" ", "_"))
    if kind is None:
        raise ValueError(f"projection {named[1]!r} is not known")
    given = {}
    for name, value in re.findall(rf'PARAMETER\s*\[\s*"([^"]*)"\s*,\s*{number}', description, re.I):
        field = _PARAMETERS.get(name.lower().replace(" ", "_"))
        if field is None:
            raise ValueError(f"parameter {name!r} of {named[1]} is not known")
        given[field] = float(value)
    # the last unit is the map's; offsets are given in it
    unit = float(re.findall(rf'UNIT\s*\[\s*"[^"]*"\s*,\s*{number}', description, re.I)[-1])
    for field in ("east0", "north0"):
        given[field] = given.get(field, 0.0) * unit
    if kind == "lambert" and "lat2" not in given:
        given["lat1"] = given["lat2"] = given.get("lat1", given.get("lat0", 0.0))
    return Crs(kind, **shape, **given, unit=unit)


def layer_crs(spark: SparkSession, path: str) -> Crs:
    """System of the layer whose ``.prj`` file lies at ``path``, wherever Spark reads from: a few hundred bytes."""
    return read_crs(spark.read.text(path, wholetext=True).first()["value"])
