"""One consistent answer: every part of a dashboard from tables of one version."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import store
from . import prices as P, quotas as K, summaries as R
from .query import Query, select_activities, select_events


def answer(tables: dict[str, DataFrame], q: Query, rates: DataFrame, aliases: DataFrame, usd_cny: float) -> dict[str, DataFrame]:
    """The eight groupings, tool counts, the board of quotas and credits, credits by model, and scan status where it is kept.

    ``tables`` are those of one published version (``sinks.exports.read_tables``): events, source_files, activities, quota,
    credits and, if there is one, status. As a version's files are never overwritten, a refresh that is
    published while the parts are read changes none of them.
    """
    priced = P.price(select_events(tables["events"], q), rates, aliases, usd_cny)
    out = R.dashboard(store(R.dashboard_all(priced, tables["source_files"], q), "dashboard"), q)
    out["tools"] = R.tool_counts(select_activities(tables["activities"], tables["events"], q))
    requests = K.credit_requests(tables["credits"], q)
    out["board"] = K.quota_board(K.latest_quotas(tables["quota"], q), K.credit_by_session(requests))
    out["credits"] = K.credit_by_model(requests)
    if "status" in tables:
        out["status"] = tables["status"]
    return out
