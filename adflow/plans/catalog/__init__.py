"""The query catalogue: importing this package registers every query."""

from ..registry import REGISTRY  # noqa: F401
from . import attribution, stats, spend, inventory, quality, reports  # noqa: F401  (registration order = CTE deps)
from . import auction, training, functions, ingest, streaming  # noqa: F401
