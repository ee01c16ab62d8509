"""All registered queries but those of the training-data subpackage."""

from geoloom.queries import distance, enhance, filters, hydro, image, local, more, overlay, points, relief, routing, stats, survey, terrain, vector  # noqa: F401
from geoloom.queries.base import REGISTERED

__all__ = ["REGISTERED"]
