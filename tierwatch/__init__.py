"""Tiered anomaly detection on wide numeric tables, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from tierwatch.plans.detection import Detection, detect
from tierwatch.plans.taxonomy import Taxonomy

__all__ = ["Detection", "Taxonomy", "detect"]

# Task functions travel with their code, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
