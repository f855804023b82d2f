"""Training-coverage analytics on Spark DataFrames."""

from traincover.session import build_session, configure

__all__ = ["build_session", "configure"]
