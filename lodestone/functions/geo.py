"""Places and great-circle distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in metres. A fixed value.
EARTH = 6371008.8


def valid(lat: Column, lng: Column) -> Column:
    """Whether two numbers are a place: in range and not the null island."""
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180) & ~((lat == 0) & (lng == 0)), F.lit(False))


def place(lat: Column, lng: Column) -> Column:
    """struct(lat, lng), or null if that isn't a place."""
    lat, lng = lat.try_cast("double"), lng.try_cast("double")
    return F.when(valid(lat, lng), F.struct(lat.alias("lat"), lng.alias("lng")))


def parse_place(text: Column) -> Column:
    """The place of a string `lat,lng`."""
    parts = F.split(text, ",", 2)
    return place(F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1))))


def distance(point: Column, lat: float, lng: float) -> Column:
    """Haversine distance in whole metres from a place (struct) to a point; null without a place."""
    a, b = F.radians(point["lat"]), F.radians(F.lit(float(lat)))
    dlat, dlng = (b - a) / 2, F.radians(F.lit(float(lng)) - point["lng"]) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(dlng), 2)
    return F.round(F.lit(2 * EARTH) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))).cast("bigint")


def box(point: Column, lat: float, lng: float, radius: int) -> list[Column]:
    """Bounds of latitude and longitude that all places within `radius` metres keep; comparisons that a reader skips rows by.

    None beyond a quarter of the globe. Around a pole there is no bound of longitude; across the date line it is one of two.
    """
    angle, slack = (radius + 1) / EARTH, 1e-6  # distances are rounded to metres; the slack is 0.1 m
    if abs(lat) > 90 or angle >= math.pi / 2:
        return []
    high = math.degrees(angle) + slack
    out = [point["lat"] >= lat - high, point["lat"] <= lat + high]
    if abs(lat) + high < 90:
        wide = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat))))) + slack
        lng = (lng + 180) % 360 - 180
        low, up = lng - wide, lng + wide
        if low < -180:
            out.append((point["lng"] >= low + 360) | (point["lng"] <= up))
        elif up > 180:
            out.append((point["lng"] >= low) | (point["lng"] <= up - 360))
        else:
            out += [point["lng"] >= low, point["lng"] <= up]
    return out


def cells(point: Column) -> list[Column]:
    """An order in which near places are near: bands of half a degree of latitude, by longitude; no place comes first."""
    return [F.floor(point["lat"] * 2), point["lng"]]
