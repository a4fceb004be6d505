"""tillscope: retail analytics expressed as lazy Spark DataFrame / SQL plans.

Operators are functions ``(DataFrame, ...params) -> DataFrame`` of built-in
expressions, without wall clock or Python row functions, so Catalyst and
adaptive execution optimise each pipeline as one plan. Most run no action. The
ones whose input would otherwise be evaluated several times write it once below
the shared folder when called (RFM scores and the customer view, full rankings,
exact quantiles, best and worst products; see the README), and the dictionary
reports and the churn model collect a few rows. ``tillscope.api`` offers the
same operators behind the original class/method names; ``tillscope.llm`` has the
operators for training data.
"""

from tillscope.settings import Settings

__all__ = ["Settings", "DataLoader", "DataValidator", "CustomerAnalytics", "SalesAnalytics"]
__version__ = "0.1.0"


def __getattr__(name):
    # the class API is imported on first use (keeps ``import tillscope`` light)
    if name in ("DataLoader", "DataValidator", "CustomerAnalytics", "SalesAnalytics"):
        from tillscope import api
        return getattr(api, name)
    raise AttributeError(name)
