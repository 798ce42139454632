"""Contract, fleet and cost analytics expressed as Spark DataFrame plans."""

from fleetledger.session import build_session

__all__ = ["build_session"]
