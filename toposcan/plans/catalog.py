"""All catalogue queries; importing the modules registers them."""

from toposcan.plans import catalog_flows, catalog_grid, catalog_metrics, catalog_names, catalog_space, catalog_trials, catalog_words  # noqa: F401
from toposcan.plans.registry import ORACLES, QUERIES  # noqa: F401
