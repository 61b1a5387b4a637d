"""PySpark-native analytics for periodic signals in long Fourier spectra."""

__version__ = "0.1.0"
