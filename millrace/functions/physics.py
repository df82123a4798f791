"""Published physics of hot deformation and hydraulics as column expressions. All constants are parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GAS_CONSTANT = 8.314462618  # J / (mol K)


def zener_hollomon(strain_rate: Column, activation_energy: float, kelvin: Column) -> Column:
    """Z = rate exp(Q / RT), as its logarithm, which does not overflow."""
    return F.log(strain_rate) + activation_energy / (GAS_CONSTANT * kelvin)


def flow_stress(log_z: Column, alpha: float, log_a: float, n: float) -> Column:
    """Sellars and Tegart 1966: (1 / alpha) asinh((Z / A)^(1 / n)); for large Z the logarithm of twice the argument."""
    u = (log_z - log_a) / n
    return F.when(u > 20, (u + math.log(2)) / alpha).otherwise(F.asinh(F.exp(u)) / alpha)


def mean_strain_rate(speed: Column, bore: Column, ratio: Column, angle: float = math.pi / 4) -> Column:
    """Feltham's mean rate in extrusion: 6 v D^2 tan(angle) ln(R) / (D^3 - d^3), with d^2 = D^2 / R."""
    d = bore / F.sqrt(ratio)
    return 6 * speed * bore * bore * math.tan(angle) * F.log(ratio) / (F.pow(bore, F.lit(3)) - F.pow(d, F.lit(3)))


def cylinder_force(p_cap: Column, p_rod: Column, bore: float, rod: float) -> Column:
    """Net force of a hydraulic cylinder (pressures in pascal, lengths in metres)."""
    cap = math.pi * bore**2 / 4
    return p_cap * cap - p_rod * (cap - math.pi * rod**2 / 4)


def remaining(length: Column, position: Column) -> Column:
    return length - position


def viscosity(celsius: Column, a: float, b: float) -> Column:
    """Walther: log10 log10(nu + 0.7) = a - b log10(T)."""
    return F.pow(F.lit(10.0), F.pow(F.lit(10.0), a - b * F.log10(celsius + 273.15))) - 0.7
