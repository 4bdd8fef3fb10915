"""All registered queries; importing a module registers its queries."""

from tilth.catalog import cleaning, modelling, statistics, summaries
from tilth.catalog.modelling import flagship
from tilth.catalog.registry import INVENTORY, ORACLES, QUERIES

__all__ = ["INVENTORY", "ORACLES", "QUERIES", "cleaning", "flagship", "modelling", "statistics", "summaries"]
