"""All queries of the engine and their SQL."""

from .queries import syn01_synthesis  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
from . import cells, files, geometry, kernels, nodes, ocean, regions, systems  # noqa: F401, isort: skip
