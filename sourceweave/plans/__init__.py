from sourceweave.plans import graphs, history, insight, inventory, mining, retrieval, streams, symbols  # noqa: F401
from sourceweave.plans.registry import PLANS

__all__ = ["PLANS"]
