"""Record audit and measurement reduction as Spark DataFrame jobs."""

from recordaudit.session import get_session

__all__ = ["get_session"]
__version__ = "0.1.0"
