"""Quotes with gaps that arrive as a stream: missing prices are filled with the item's last one, whatever the order of arrival."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "item_id string, ms long, price double, price_imputed double, imputation string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CarryForward(StatefulProcessor):
    """Of each item the quotes that wait for the watermark, and the last price that has left.

    A quote waits under its period until a timer says that the watermark has passed it, so that no earlier one can
    still come. Then what waits up to there leaves in order of period, and missing prices take the last one. Of
    several quotes of a period the greatest price counts, in whatever order they come.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getMapState("waiting", "ms long", "price double")
        self._last = handle.getValueState("last", "price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for ms, price in zip(pdf["ms"].tolist(), pdf["price"].tolist(), strict=True):
                price = math.nan if price is None else float(price)
                if self._waiting.containsKey((ms,)):
                    old = self._waiting.getValue((ms,))[0]
                    price = old if math.isnan(price) else price if math.isnan(old) else max(old, price)
                self._waiting.updateValue((ms,), (price,))
                self._handle.registerTimer(ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = sorted((k[0], v[0]) for k, v in self._waiting.iterator() if k[0] <= passed)
        last = self._last.get()[0] if self._last.exists() else math.nan
        out = []
        for ms, price in due:
            known = not math.isnan(price)
            last = price if known else last
            filled = not known and not math.isnan(last)
            out.append((key[0], ms, price if known else None, None if math.isnan(last) else last, "carry_forward" if filled else None))
            self._waiting.removeKey((ms,))
        if not math.isnan(last):
            self._last.update((last,))
        return iter([pd.DataFrame(out, columns=["item_id", "ms", "price", "price_imputed", "imputation"]).astype({"ms": "int64"})] if out else [])

    def close(self) -> None:
        pass


def carry_forward_stream(quotes: DataFrame, late: str = "31 days") -> DataFrame:
    """item_id, period, price, price_imputed, imputation of a stream of quotes (item_id, period timestamp, price).

    The stream gives what the batch fill gives on all quotes, each once the watermark, `late` behind the newest period
    seen, has passed its period; quotes that come later than that are dropped. State is one row for each quote that
    waits and one price an item. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    q = quotes.select("item_id", "period", F.unix_millis("period").alias("ms"), "price").withWatermark("period", late)
    out = q.groupBy("item_id").transformWithStateInPandas(CarryForward(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
    return out.select("item_id", F.timestamp_millis("ms").alias("period"), "price", "price_imputed", "imputation")


def replayed(spark: SparkSession, folder: str, shared: str, late: str = "31 days") -> DataFrame:
    """What carry_forward_stream() gives of the Parquet files of a folder, a file a batch in order of time, run to their end.

    Output and checkpoint stand in the shared folder; a restart after a lost driver goes on from there.
    """
    schema = "item_id string, period timestamp, price double"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    at = f"{shared}/stream-{uuid.uuid4().hex}"
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        run = carry_forward_stream(stream, late).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema("item_id string, period timestamp, price double, price_imputed double, imputation string").parquet(f"{at}/out")
