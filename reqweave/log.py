"""Logging of jobs, and the counts they report."""

from __future__ import annotations

import logging
import sys
from logging.handlers import RotatingFileHandler

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

FORMAT, DATES = "%(asctime)s - %(name)s - %(levelname)s - %(message)s", "%Y-%m-%d %H:%M:%S"
#: A log file's size, and how many older ones stay (fixed values).
SIZE, OLDER = 5_000_000, 3


def logger(name: str = "reqweave", path: str | None = "reqweave.log", level: int = logging.INFO) -> logging.Logger:
    """A logger to standard output and, if ``path`` is given, to a rotating file of the driver. Asked again, it gets no second handlers."""
    log = logging.getLogger(name)
    log.setLevel(level)
    kinds = {type(h) for h in log.handlers}
    new = [] if logging.StreamHandler in kinds else [logging.StreamHandler(sys.stdout)]
    if path and RotatingFileHandler not in kinds:
        new.append(RotatingFileHandler(path, maxBytes=SIZE, backupCount=OLDER, encoding="utf-8"))
    for handler in new:
        handler.setFormatter(logging.Formatter(FORMAT, DATES))
        log.addHandler(handler)
    return log


def counted(table: DataFrame, name: str, **conditions: str) -> tuple[DataFrame, Observation]:
    """``table``, and what is observed while it is written: its rows and, for each name, the rows for which a SQL condition holds. No job of its own."""
    seen = Observation(name)
    return table.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.expr(c)).alias(k) for k, c in conditions.items()]), seen
