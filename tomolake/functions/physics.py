"""Column expressions: units, geometry, rock physics, relaxation, vectors and text."""

from __future__ import annotations

from math import cos, pi, radians, sin

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLIDARCY = 9.869233e-13


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def adjust(gray: Column, black: float, white: float, brightness: float, contrast: float) -> Column:
    """Brightness and contrast of a byte: stretched between black and white, contrast in percent about the middle."""
    v = clamp((gray - black) / (white - black), 0, 1) if white > black else F.lit(0.0)
    v = clamp((v - 0.5) * (contrast / 100) + 0.5, 0, 1)
    return clamp(F.floor(v * 255 + 1e-9) + brightness, 0, 255).cast("long")


def grayscale(r: Column, g: Column, b: Column) -> Column:
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b + 1e-9).cast("long")


def sphere_radius(volume: Column) -> Column:
    return F.cbrt(3 * volume / (4 * pi))


def disc_radius(area: Column) -> Column:
    return F.sqrt(area / pi)


def throat_conductance(radius: Column, length: Column, viscosity: float) -> Column:
    return pi * F.pow(radius, F.lit(4.0)) / (8 * viscosity * length)


def darcy_permeability(flow: Column, viscosity: float, length: Column, area: Column, drop: Column) -> Column:
    return flow * viscosity * length / (area * drop) / MILLIDARCY


def forchheimer_velocity(gradient: Column, permeability: Column, viscosity: float, density: float, beta: Column) -> Column:
    """The positive root v of gradient = (viscosity / k) v + beta density v2."""
    a, b = beta * density, viscosity / permeability
    return F.when(a > 0, (F.sqrt(b * b + 4 * a * gradient) - b) / (2 * a)).otherwise(gradient / b)


def vp_vs_from_poisson(nu: Column) -> Column:
    return F.sqrt(2 * (1 - nu) / (1 - 2 * nu))


def poisson_from_vp_vs(ratio: Column) -> Column:
    r2 = ratio * ratio
    return (r2 - 2) / (2 * (r2 - 1))


def p_velocity(youngs: Column, nu: Column, density: Column) -> Column:
    lam, mu = youngs * nu / ((1 + nu) * (1 - 2 * nu)), youngs / (2 * (1 + nu))
    return F.sqrt((lam + 2 * mu) / density)


def s_velocity(youngs: Column, nu: Column, density: Column) -> Column:
    return F.sqrt(youngs / (2 * (1 + nu)) / density)


def time_step(pixel_size: float, v_max: Column, frequency: float) -> Column:
    return F.greatest(F.lit(1e-8), F.least(0.2 * pixel_size / v_max, F.lit(1 / (20 * frequency))))


def strained_porosity(phi: Column, strain: Column) -> Column:
    return clamp(phi * (1 - strain), 0.01, 0.5)


def permeability_ratio(phi: Column, phi0: Column) -> Column:
    k = lambda p: F.pow(p, F.lit(3.0)) / F.pow(1 - p, F.lit(2.0))
    return k(phi) / k(phi0)


def elastic_energy(stress: Column, strain: Column, yield_stress: Column, youngs: Column) -> Column:
    s = F.least(stress, yield_stress)
    return F.when(stress <= yield_stress, 0.5 * stress * strain).otherwise(0.5 * s * s / youngs)


def plastic_energy(stress: Column, strain: Column, yield_stress: Column, youngs: Column) -> Column:
    """The trapezoid under the curve beyond the yield strain; 0 up to it."""
    beyond = strain - yield_stress / youngs
    return F.when(beyond > 0, (yield_stress + stress) * 0.5 * beyond).otherwise(0.0)


def mohr_coulomb_fails(s1: Column, s3: Column, cohesion: float, friction_degrees: float, tensile: float) -> Column:
    phi = radians(friction_degrees)
    return (s1 - s3 >= 2 * cohesion * cos(phi) + (s1 + s3) * sin(phi)) | (s3 <= -tensile)


def failure_angle(friction_degrees: Column) -> Column:
    return 45 + friction_degrees / 2


def decay(amplitude: Column, t: Column, t2: Column) -> Column:
    return amplitude * F.exp(-t / t2)


def calibrated_t2(t2: Column, slope: Column, intercept: Column) -> Column:
    return F.pow(F.lit(10.0), slope * F.log10(t2) + intercept)


def spread_density(gray: Column, low: Column, high: Column, mean: float) -> Column:
    """Mean density within 20 % by gray between the material's least and greatest."""
    return F.when(high > low, mean * (0.8 + 0.4 * (gray - low) / (high - low))).otherwise(mean)


def kinetic_energy(density: Column, vx: Column, vy: Column, vz: Column) -> Column:
    return 0.5 * density * (vx * vx + vy * vy + vz * vz)


def strain_energy(stress: dict[str, Column], mu: Column) -> Column:
    """Energy of the deviatoric stress (xx, yy, zz, xy, xz, yz) under a shear modulus, already lowered by any damage."""
    mean = (stress["xx"] + stress["yy"] + stress["zz"]) / 3
    normal = sum(((stress[k] - mean) * (stress[k] - mean) for k in ("xx", "yy", "zz")), F.lit(0.0))
    shear = sum((stress[k] * stress[k] for k in ("xy", "xz", "yz")), F.lit(0.0))
    return (0.5 * normal + shear) / (2 * mu)


def velocity_from_density(density: Column, mean: Column, vp: float, dims: tuple[int, int, int]) -> Column:
    """Vp scaled by the root of the density over the mean, falling by up to 10 % from the volume's centre to its corners."""
    half = [n / 2 for n in dims]
    far = F.sqrt(sum(((F.col(a) - h) * (F.col(a) - h) for a, h in zip("xyz", half, strict=True)), F.lit(0.0))) / sum(h * h for h in half) ** 0.5
    return vp * F.sqrt(density / mean) * (1 - 0.1 * far)


def chart_units(strain: Column, stress: Column) -> tuple[Column, Column]:
    """Strain in thousandths and stress in tenths, truncated to whole numbers."""
    return (strain * 1000).cast("long"), (stress * 10).cast("long")


def total_mass(width: Column, height: Column, depth: Column, pixel_mm: Column, density: Column) -> tuple[Column, Column]:
    """Volume (m3) and mass (kg) of a whole volume with pixels in mm."""
    m = pixel_mm / 1000
    volume = width * height * depth * m * m * m
    return volume, volume * density


#: Name, category and density (kg/m3) of common materials.
DENSITIES = [
    ("Air", "Gas", 1.225), ("Water", "Liquid", 1000.0), ("Seawater", "Liquid", 1025.0), ("Oil (light)", "Liquid", 850.0),
    ("Wood (light)", "Organic", 300.0), ("Wood (dense)", "Organic", 900.0), ("PLA", "Plastic", 1250.0), ("ABS", "Plastic", 1050.0),
    ("PVC", "Plastic", 1400.0), ("Quartz", "Mineral", 2650.0), ("Calcite", "Mineral", 2710.0), ("Feldspar", "Mineral", 2600.0),
    ("Clay", "Mineral", 1800.0), ("Limestone", "Rock", 2500.0), ("Sandstone", "Rock", 2350.0), ("Granite", "Rock", 2700.0),
    ("Basalt", "Rock", 3000.0), ("Aluminum", "Metal", 2700.0), ("Iron", "Metal", 7850.0), ("Steel", "Metal", 7800.0),
    ("Copper", "Metal", 8960.0), ("Gold", "Metal", 19300.0), ("Diamond", "Dense Mineral", 3510.0), ("Pyrite", "Dense Mineral", 5000.0),
    ("Hematite", "Dense Mineral", 5300.0),
]

#: Rock names, the density each line starts from, then start and slope of Young's modulus (from 0), Poisson's
#: ratio, cohesion, friction angle and tensile strength. None: any other rock.
ROCKS = [
    (("limestone", "calcite"), 2500.0, (40000.0, 0.02), (0.25, 0.0001), (7.0, 0.012), (35.0, 0.005), (5.0, 0.005)),
    (("sandstone", "quartz"), 2000.0, (15000.0, 0.015), (0.2, 0.0001), (3.0, 0.01), (30.0, 0.005), (2.0, 0.005)),
    (("granite",), 2700.0, (50000.0, 0.02), (0.25, 0.0001), (15.0, 0.015), (45.0, 0.005), (8.0, 0.006)),
    (("shale", "clay"), 2200.0, (8000.0, 0.012), (0.3, 0.0001), (1.5, 0.01), (20.0, 0.005), (0.8, 0.005)),
    (None, 0.0, (25000.0, 0.015), (0.25, 0.0), (8.0, 0.003), (30.0, 0.001), (4.0, 0.001)),
]


def rock_properties(name: Column, density: Column) -> dict[str, Column]:
    """youngs, poisson, cohesion, friction_angle and tensile (MPa, degrees) by a rock's name and density."""
    out = {}
    for i, k in enumerate(("youngs", "poisson", "cohesion", "friction_angle", "tensile")):
        lines = {names: row[i] + (density - (0.0 if k == "youngs" else base)) * row[i + 5] for names, base, *pairs in ROCKS for row in [[p[0] for p in pairs] + [p[1] for p in pairs]]}
        value = lines[None]
        for names, line in lines.items():
            if names:
                value = F.when(F.lower(name).isin(*names), line).otherwise(value)
        out[k] = value
    return out | {"poisson": clamp(out["poisson"], 0.05, 0.45), "friction_angle": clamp(out["friction_angle"], 10, 60)}


def measured_distance(x1: Column, y1: Column, x2: Column, y2: Column, pixel_size: float) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) * pixel_size


def distance_text(metres: Column) -> Column:
    return F.when(metres < 1e-3, F.format_string("%.2f um", metres * 1e6)).when(metres < 1, F.format_string("%.2f mm", metres * 1e3)).otherwise(F.format_string("%.3f m", metres))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def intersection(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: F.least(u, v).cast("double")), F.lit(0.0), lambda s, x: s + x)


def direction(text: Column) -> Column:
    """Unit vector of an axis name or of three numbers; empty text is z."""
    t = F.regexp_replace(F.lower(F.trim(text)), r"[ \-_]", "")
    named = F.when(t.isin("x", "xaxis", "axisx"), F.array(*map(F.lit, (1.0, 0.0, 0.0)))).when(t.isin("y", "yaxis", "axisy"), F.array(*map(F.lit, (0.0, 1.0, 0.0)))).when(t.isin("", "z", "zaxis", "axisz") | text.isNull(), F.array(*map(F.lit, (0.0, 0.0, 1.0))))
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    size = F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x * x))
    numbers = F.when((F.size(parts) == 3) & (size > 0), F.transform(parts, lambda x: x / size))
    return F.coalesce(named, numbers)


def number_in_name(name: Column) -> Column:
    return F.coalesce(F.regexp_replace(name, "[^0-9]", "").try_cast("long"), F.lit(0).cast("long"))


def blend(a: Column, b: Column, share: float) -> Column:
    return F.floor(a * (1 - share) + b * share + 1e-9).cast("long")


def complementary(c: Column) -> Column:
    return (255 - c).cast("long")


def progress(point: dict[str, Column], start: tuple[float, ...], end: tuple[float, ...]) -> Column:
    length2 = sum((b - a) ** 2 for a, b in zip(start, end, strict=True))
    return clamp(sum(((point[c] - a) * (b - a) for c, a, b in zip("xyz", start, end, strict=True)), F.lit(0.0)) / length2, 0, 1)


def near_segment(px: float, py: float, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment."""
    l2 = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    t = F.when(l2 > 0, clamp(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / l2, 0, 1)).otherwise(0.0)
    dx, dy = px - (x1 + t * (x2 - x1)), py - (y1 + t * (y2 - y1))
    return F.sqrt(dx * dx + dy * dy)


def estimated_t2(radius_um: Column, porosity: Column) -> Column:
    return clamp(2 * radius_um / 3 * (1 + porosity / 2), 1, 5000)


def relaxation_strength(connections: Column) -> Column:
    return F.when(connections < 3, 0.6).when(connections < 6, 1.0).otherwise(1.5)


def volumetric_strain(axial: Column, nu: Column) -> Column:
    return axial * (1 - 2 * nu)


def biot(bulk_mpa: Column, grain_mpa: float = 36000.0) -> Column:
    return F.when(bulk_mpa < 0.01, 0.9).otherwise(clamp(1 - bulk_mpa / grain_mpa, 0.5, 1))


def skempton_b(porosity: Column, bulk_mpa: Column, fluid_mpa: float = 2200.0) -> Column:
    return clamp(1 / (1 + porosity * fluid_mpa / bulk_mpa), 0.01, 0.99)


def pore_pressure(axial: Column, nu: Column, bulk_mpa: Column, porosity: Column, permeability: Column, initial: float = 0.1) -> Column:
    """MPa, never below 0: what volumetric strain adds where the rock doesn't drain."""
    undrained = 1 - clamp(permeability * 10, 0.01, 1)
    change = -volumetric_strain(axial, nu) * bulk_mpa * skempton_b(porosity, bulk_mpa) * undrained
    return F.greatest(F.lit(0.0), initial + change)


#: Ratio of differential stress to its threshold, and the probability of a fracture; straight between.
FRACTURE_KNOTS = [(0.0, 0.0), (0.4, 0.01), (0.7, 0.1), (0.9, 0.5), (1.0, 0.9), (1.5, 1.0)]


def fracture_probability(s1: Column, s3: Column, cohesion: float, friction_degrees: float) -> Column:
    """From the Mohr-Coulomb threshold, lowered by up to 30 % under tension. The first piece also holds below 0."""
    s, c = sin(radians(friction_degrees)), cos(radians(friction_degrees))
    tension = F.least(F.lit(1.0), F.abs(s3) / (0.5 * cohesion))
    threshold = F.when(s3 < 0, 2 * cohesion * c * (1 - 0.3 * tension)).otherwise(2 * cohesion * c + (s1 + s3) * s) / (1 - s)
    ratio, out = (s1 - s3) / threshold, F.lit(FRACTURE_KNOTS[-1][1])
    for (a, p), (b, q) in reversed(list(zip(FRACTURE_KNOTS, FRACTURE_KNOTS[1:], strict=False))):
        out = F.when(ratio < b, p + (ratio - a) * ((q - p) / (b - a))).otherwise(out)
    return out


def strain_from_pressure(pressure: Column, youngs: Column, tensile: float) -> Column:
    """Strain in three pieces: elastic up to 0.6 of the tensile strength, transition up to 1.5 of it, hardening beyond.

    Never below pressure / modulus; strength counts as 1 at least, the modulus as 1000.
    """
    strength, e = max(tensile, 1.0), F.greatest(youngs, F.lit(1000.0))
    knee, top, soft = 0.6 * strength, 1.5 * strength, 0.15 * e
    over = (pressure - knee) / max(strength - knee, 0.1)
    elastic = pressure / e * (1 + 0.2 * pressure / knee)
    transition = knee / e + (pressure - knee) / soft * (1 + 1.05 * over * over)
    beyond = pressure - top
    hardening = beyond / (soft * (1 + 0.2 * F.sqrt(F.greatest(beyond / strength, F.lit(0.001)))))
    plastic = knee / e + (top - knee) / soft * 2.05 + hardening
    return F.greatest(pressure / e, F.when(pressure <= knee, elastic).when(pressure <= top, transition).otherwise(plastic))
