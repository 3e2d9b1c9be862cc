"""Named kernels as SQL functions of a session: detectors, RR sources, blocks, window scalars."""

from __future__ import annotations

from pyspark.sql import SparkSession

from pulsegrid.functions import udfs
from pulsegrid.functions.detectors import DETECTORS
from pulsegrid.functions.rr import RR_SOURCES
from pulsegrid.functions.window_features import SQI_BANDS


def register(spark: SparkSession, fs: float, prefix: str = "pg_") -> list[str]:
    """Registers every kernel for signals of a rate and returns the names: <prefix>peaks_<detector>(array) array<int>, <prefix>rr_<source>(array)
    array<double>, <prefix>sqi_<kind>(array) and <prefix>signal_<source>(array) structs, <prefix><scalar>(array) double."""
    found = {f"peaks_{n}": udfs.peaks(n, fs) for n in DETECTORS}
    found |= {f"rr_{n}": udfs.rr_of(n, fs) for n in RR_SOURCES}
    found |= {f"sqi_{k}": udfs.sqi(fs, k) for k in SQI_BANDS}
    found |= {f"signal_{n}": udfs.signal_features(fs, n) for n in RR_SOURCES}
    found |= {n: udfs.scalar(n, fs) for n in udfs.SCALARS}
    found |= {"bcg": udfs.bcg_features(fs), "af": udfs.af_features(), "reference_quality": udfs.reference_quality(fs), "summary": udfs.summary()}
    for name, f in found.items():
        spark.udf.register(prefix + name, f)
    return [prefix + n for n in found]
