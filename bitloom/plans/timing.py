"""Log and time steps; BITLOOM_TIMING=1 turns the times on, BITLOOM_LOG sets the level."""

from __future__ import annotations

import logging
import os
import time
from contextlib import contextmanager

log = logging.getLogger("bitloom")


def setup() -> logging.Logger:
    """The package's logger at the level of BITLOOM_LOG (warning unless set)."""
    logging.basicConfig()
    log.setLevel(os.environ.get("BITLOOM_LOG", "WARNING").upper())
    return log


@contextmanager
def timed(name: str, sink=None):
    """Report how long a block took (to ``sink``, or the log) if timing is on or a sink is given."""
    start = time.perf_counter()
    try:
        yield
    finally:
        seconds = time.perf_counter() - start
        if sink is not None:
            sink(name, seconds)
        elif os.environ.get("BITLOOM_TIMING") == "1":
            log.warning("%s: %.3f s", name, seconds)
