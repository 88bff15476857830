"""The registered queries. Importing the modules fills the registry."""

from lapforge.catalog import (  # noqa: F401
    aggregates, features, filters, joins, models, quality, scalars, sources, streams, validation, windows,
)
from lapforge.catalog.registry import ORACLES, QUERIES  # noqa: F401
