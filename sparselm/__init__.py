"""sparselm: sparse linear models (L1-penalised regression by consensus
ADMM) and the table preparation around them, written as PySpark jobs."""

from __future__ import annotations

import sys


def _ship_by_value() -> None:
    # Functions of this package run inside Python workers (mapInArrow,
    # applyInPandas). Pickling them by value means executors need no copy of
    # the package installed or shipped with --py-files.
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle
        pass


_ship_by_value()

__version__ = "0.1.0"
