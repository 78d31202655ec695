"""Thresholds of the trackers; the defaults are the published ones."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class General:
    dt: float = 6.0


@dataclass(frozen=True)
class Z500:
    small_km: float = 100.0
    background_h: float = 78.0
    background_km: float = 3000.0
    cyclone: float = -80.0
    anticyclone: float = 70.0
    life_h: float = 12.0
    gaussian_sigma: float | None = None


@dataclass(frozen=True)
class Slp:
    small_km: float = 100.0
    background_h: float = 78.0
    background_km: float = 3000.0
    cyclone: float = -5.0
    anticyclone: float = 12.0
    life_h: float = 12.0
    watershed: bool = True
    peak_km: float = 1000.0
    peak_threshold: float = 1.0
    window_h: float = 12.0
    window_km: float = 750.0
    claim: str = "largest"


@dataclass(frozen=True)
class Jet:
    small_km: float = 500.0
    background_h: float = 78.0
    background_km: float = 5000.0
    speed: float = 24.0
    life_h: float = 24.0
    watershed: bool = False
    peak_km: float = 5000.0
    #: Of the smoothing before the flood.
    window_km: float = Slp.window_km
    window_h: float = Slp.window_h


@dataclass(frozen=True)
class River:
    flux: float = 0.13
    ivt: float = 500.0
    life_h: float = 9.0
    area_km2: float = 100_000.0


@dataclass(frozen=True)
class Front:
    diag: float = 0.5
    area_km2: float = 50_000.0


@dataclass(frozen=True)
class CutOff:
    split_km: float = 500.0
    buffer_km: float = 600.0
    ring_km: float = 600.0
    ring_rise: float = 60.0
    ring_share: float = 0.90
    life_h: float = 24.0
    height: float = 9999.0
    region: tuple[float, float, float, float] = (-15.0, 10.0, 30.0, 45.0)
    lat: tuple[float, float] = (25.0, 60.0)
    lon: tuple[float, float] = (-29.0, 19.0)
    centre_lat: tuple[float, float] = (20.0, 70.0)
    pole: float = 88.0


@dataclass(frozen=True)
class Mcs:
    sigma_pr: float = 0.0
    sigma_bt: float = 0.0
    pr: float = 5.0
    pr_h: float = 3.0
    pr_km2: float = 500.0
    bt: float = 241.0
    bt_h: float = 5.0
    bt_km2: float = 1000.0
    cloud_km2: float = 1000.0
    low_bt: float = 225.0
    rain_km2: float = 500.0
    peak: float = 15.0
    life_h: float = 5.0


@dataclass(frozen=True)
class Tropical:
    genesis_lat: float = 30.0
    warm: float = 2.0
    core: float = 273.15
    pressure: float = 980.0
    max_lat: float = 60.0
    life_h: float = 48.0
    keep_h: float = 24.0
