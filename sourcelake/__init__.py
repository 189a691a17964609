"""Source-code and text corpus analytics as Spark jobs."""

from sourcelake.session import get_session

__all__ = ["get_session"]
