"""Every query on the driver's tables, by name, with its SQL."""

from . import core, extra, knowledge, resolution, services, texts  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
