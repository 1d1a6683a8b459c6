"""Sentinels, calendar facts and weights of the raster time-series model.

Rasters live in long form: one row per pixel, band and epoch. Missing data are fill values at rest and NULL in
computations; Spark's aggregates skip NULL as the algorithms want it, so NaN is never used.
"""

from __future__ import annotations

# Fixed values of the data products.
DATA_FILL, QUALITY_FILL = 32767, 255
VALID_LOW, VALID_HIGH = 0, 9999
EPOCH_DAYS, EPOCHS_PER_YEAR = 8, 46
FIRST_EPOCH, LAST_EPOCH = "2000-02-26", "2020-04-14"
SPHERE_RADIUS, PIXEL_SIZE = 6371007.18, 463.31271652750013
WINDOW, HALF = 15, 7

#: Weights by quality code 0..3 of the fitting pipelines.
WEIGHTS = {
    "poly_lin": (1.0, 0.5, 0.01, 0.01),
    "lin_poly": (1.0, 0.5, 0.25, 0.01),
    "sg_fft_poly": (1.0, 0.5, 0.01, 0.01),
    "dft": (1.0, 0.5, 0.25, 0.01),
    "poly": (1.0, 0.5, 0.01, 0.01),
    "fourier7": (0.99, 0.5, 0.01, 0.01),
}
