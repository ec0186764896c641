"""undertow: behavioural-drift analytics for labelled event flows, written as Spark DataFrame operators."""

from undertow.spec import CATALOG, FlowSpec

__all__ = ["CATALOG", "FlowSpec"]
