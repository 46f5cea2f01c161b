"""All queries of the reference's operators; importing the modules registers them."""

from . import domain, exchange, places, relational, reports, scalars  # noqa: F401
from .views import ORACLES, QUERIES  # noqa: F401
