"""Time-series preparation, analysis and forecasting for many series on Spark."""

from tidemark.plans.series import Series, series
from tidemark.session import configure, get_session

__all__ = ["Series", "configure", "get_session", "series"]
