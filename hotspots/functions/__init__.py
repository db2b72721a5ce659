from hotspots.functions import calendar, display, geo, scoring  # noqa: F401
