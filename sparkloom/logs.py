"""Log lines on the console and, if a folder is given, in a file of the run (IO24)."""

from __future__ import annotations

import logging
from datetime import datetime
from pathlib import Path


def run_logger(name: str, level: str = "INFO", folder: str | Path | None = None) -> logging.Logger:
    """A logger that writes each line once, however often it is asked for."""
    logger = logging.getLogger(f"sparkloom.{name}")
    logger.setLevel(level)
    logger.propagate = False
    for handler in list(logger.handlers):
        logger.removeHandler(handler)
        handler.close()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(Path(folder) / f"{name}_{datetime.now():%Y%m%d_%H%M%S}.log", encoding="utf-8"))
    for handler in handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        logger.addHandler(handler)
    return logger
