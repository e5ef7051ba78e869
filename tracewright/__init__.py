"""tracewright: the data side of reasoning-model post-training as Spark DataFrame operators."""

from tracewright.session import build_session

__all__ = ["build_session"]
