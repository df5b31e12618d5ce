"""Per-pixel radiometry as Column expressions. Casts to integers truncate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quality words of Landsat 8 scenes by class.
QA_CLOUD = [2800, 2804, 2808, 2812, 6896, 6900, 6904, 6908]
QA_SHADOW = [2976, 2980, 2984, 2988, 3008, 3012, 3016, 3020, 7072, 7076, 7080, 7084, 7104, 7108, 7112, 7116]
QA_CIRRUS = [6816, 6820, 6824, 6828, 6848, 6852, 6856, 6860, 6896, 6900, 6904, 6908, 7072, 7076, 7080, 7084, 7104, 7108, 7112, 7116, 7840, 7844, 7848, 7852, 7872, 7876, 7880, 7884]

# MODIS emissive bands with central wavenumber (1/cm), temperature slope and intercept (K).
MODIS_BANDS = {
    "20": (2.641775e3, 9.993411e-1, 4.770532e-1), "21": (2.505277e3, 9.998646e-1, 9.262664e-2), "22": (2.518028e3, 9.998584e-1, 9.757996e-2), "23": (2.465428e3, 9.998682e-1, 8.929242e-2),
    "24": (2.235815e3, 9.998819e-1, 7.310901e-2), "25": (2.200346e3, 9.998845e-1, 7.060415e-2), "27": (1.477967e3, 9.994877e-1, 2.204921e-1), "28": (1.362737e3, 9.994918e-1, 2.046087e-1),
    "29": (1.173190e3, 9.995495e-1, 1.599191e-1), "30": (1.027715e3, 9.997398e-1, 8.253401e-2), "31": (9.080884e2, 9.995608e-1, 1.302699e-1), "32": (8.315399e2, 9.997256e-1, 7.181833e-2),
    "33": (7.483394e2, 9.999160e-1, 1.972608e-2), "34": (7.308963e2, 9.999167e-1, 1.913568e-2), "35": (7.188681e2, 9.999191e-1, 1.817817e-2), "36": (7.045367e2, 9.999281e-1, 1.583042e-2),
}
PLANCK, LIGHT, BOLTZMANN = 6.6260755e-34, 2.9979246e8, 1.380658e-23
C1, C2 = 2 * PLANCK * LIGHT * LIGHT, PLANCK * LIGHT / BOLTZMANN


def number(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def double(x) -> Column:
    return number(x).cast("double")


def truncated(x: Column, kind: str = "int") -> Column:
    return x.cast(kind)


def gamma(v: Column, g) -> Column:
    """trunc((v / 256) ** (1 / g) * 255) of a byte value; g must be positive."""
    if not isinstance(g, Column) and not g > 0:
        raise ValueError("gamma must be a positive number")
    return truncated(F.pow(v.cast("double") / 256.0, 1.0 / double(g)) * 255.0)


def byte_scale(v: Column, low, high, nodata=None, top: int = 255) -> Column:
    """Linear stretch of [low, high] to 0..top. What lies below or above is 0 or top, before nodata is looked at."""
    if not isinstance(low, Column) and not isinstance(high, Column) and high <= low:
        raise ValueError("high must exceed low")
    low, high = double(low), double(high)
    scaled = truncated((v - low) * float(top) / (high - low))
    out = F.when(v.isNull(), F.lit(None)).when(v < low, 0).when(v > high, top)
    return (out if nodata is None else out.when(v == number(nodata), 0)).otherwise(scaled)


def cira_stretch(v: Column) -> Column:
    """Logarithmic stretch of a reflectance; 0 where the value isn't positive."""
    floor = F.log10(F.lit(0.0223))
    return F.when(v <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), (F.log10(F.when(v > 0, v)) - floor) / ((1 - floor) * 0.75)))


def green_boost(green: Column, infrared: Column, ratio: float = 0.1) -> Column:
    """Mixes infrared into green; whole numbers stay whole by truncation."""
    return truncated(green * (1 - ratio) + infrared * ratio)


def luma(r: Column, g: Column, b: Column, weights=(0.2125, 0.7154, 0.0721)) -> Column:
    return truncated(r * weights[0] + g * weights[1] + b * weights[2])


def brovey_ratio(r: Column, g: Column, b: Column, pan: Column, weight: float = 0.2) -> Column:
    return F.try_divide(pan.cast("double"), (r + g + b * weight) / (2 + weight))


def brovey(band: Column, ratio: Column, most: int = 255) -> Column:
    return truncated(F.least(F.greatest(ratio * band, F.lit(0.0)), F.lit(float(most))))


def auto_gamma(mean: Column, target: float = 0.45) -> Column:
    """The gamma that brings a mean byte value to `target`."""
    return 1.0 / (F.log10(F.lit(target)) / F.log10(mean / 256.0))


def cloud_class(qa: Column) -> Column:
    """1 cloud, 2 shadow, 3 cirrus, 0 else; cloud wins over shadow, shadow over cirrus."""
    return F.when(qa.isin(QA_CLOUD), 1).when(qa.isin(QA_SHADOW), 2).when(qa.isin(QA_CIRRUS), 3).otherwise(0)


def cloud_recode(c: Column) -> Column:
    """Classes of a cloud mask to shown (0) and masked (1): 0 and 1 pass as 5 and 1, 2 and 3 are clear."""
    return F.when(c.isin(2, 3), 0).otherwise(1)


def modis_band(band: str) -> tuple[float, float, float]:
    """Central wavelength (m), temperature slope and intercept of an emissive band."""
    if band not in MODIS_BANDS:
        raise ValueError(f"{band} is no emissive band")
    wavenumber, slope, intercept = MODIS_BANDS[band]
    return 1.0 / (wavenumber * 100), slope, intercept


def brightness_temperature(radiance: Column, band: str) -> Column:
    length, slope, intercept = modis_band(band)
    good = F.when(radiance > 0, radiance)
    return (C2 / (length * F.log(C1 / (1e6 * good * length**5) + 1.0)) - intercept) / slope


def emissive_radiance(temperature: Column, band: str) -> Column:
    """The inverse of brightness_temperature."""
    length, slope, intercept = modis_band(band)
    return C1 / (1e6 * length**5 * (F.exp(C2 / (length * (temperature * slope + intercept))) - 1.0))


def calibrated(dn: Column, band: Column, names: Column, scales: Column, offsets: Column) -> Column:
    """(dn - offset) * scale at the place of the band in a comma list of band names; null for another band."""
    at = F.array_position(F.split(names, ","), band).cast("int")
    return F.when(at > 0, (dn - F.try_element_at(offsets, at)) * F.try_element_at(scales, at))


def symbol_class(v: Column, nodata: int = -3000) -> Column:
    """Class 0..99 of a value from -2000 to 10000 by equal steps; 255 for nodata."""
    return F.when(v == nodata, 255).otherwise(F.floor((v + 2000) / F.lit(120.000001)).cast("int"))


def finite(v: Column) -> Column:
    """0 for null, NaN and infinities."""
    return F.when(v.isNull() | F.isnan(v) | v.isin(float("inf"), float("-inf")), 0.0).otherwise(v)


def safe_log10(v: Column) -> Column:
    return finite(F.log10(F.when(v > 0, v)))


def decibel(v: Column) -> Column:
    return F.log10(F.when(v > 0, v))


def fix_bit_depth(v: Column, depth: Column) -> Column:
    """Samples of 8 and 16 bits as they are, of 15 bits halved, others refused."""
    return F.when(depth.isin(8, 16), v).when(depth == 15, F.shiftright(v, 1)).otherwise(F.raise_error(F.lit("bit depth must be 8, 15 or 16")))


def to_byte(v: Column, nodata: int = 255) -> Column:
    """16 bits to 8: values beyond 255 are nodata, and what was nodata is one less."""
    return F.when(v == nodata, nodata - 1).when(v > nodata, nodata).otherwise(v)


def recolour(v: Column) -> tuple[Column, Column, Column]:
    """A class raster as red, green and blue: 255 is black, 1 is red."""
    plain = F.when(v == 255, 0).otherwise(v)
    return F.when(plain == 1, 255).otherwise(plain), F.when(plain == 1, 1).otherwise(plain), F.when(plain == 1, 1).otherwise(plain)


def sea_surface(b1: Column, b2: Column) -> Column:
    return (b1 > b2) & (b1 < 0.2) & (b2 < 0.2)


def high_cloud(bt: Column, b1: Column, b2: Column) -> Column:
    return (bt < 273) & (b1 > 0.55) & (b2 > 0.55)


def fog_index(radiance20: Column, radiance31_at_20: Column, reflectance18: Column) -> Column:
    return F.try_divide(radiance20 - radiance31_at_20, reflectance18)
