"""Alert de-duplication on a stream of deals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairtag.operators.alerts import ALERT_KEY, with_alert_key
from fairtag.params import Params


def fresh_deals_stream(deals: DataFrame, params: Params = Params(), forget_after: str | None = None) -> DataFrame:
    """Good deals once per (listing, price).

    Exact by default, with state that grows with the alerts sent. With
    ``forget_after`` (needs an event-time column ``seen_ts``) a deal may be alerted
    again once that long has passed, and the state stays bounded.
    """
    good = with_alert_key(deals).filter(F.col("score") >= params.alert_min_score)
    if forget_after is None:
        return good.dropDuplicates(ALERT_KEY)
    return good.withWatermark("seen_ts", forget_after).dropDuplicatesWithinWatermark(ALERT_KEY)
