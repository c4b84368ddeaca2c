"""Query catalogs; importing the package registers the queries of every module."""

from gridloom.plans import catalog, exact, images, scans, shapes

__all__ = ["catalog", "exact", "images", "scans", "shapes"]
