"""Streams without clocks of their own: passage cuts with ordered release, rolling windows, suppression, ingestion."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_BREAKS = ".!?؟。\n"


def cut_passage(buffer: str, least: int, final: bool = False) -> tuple[str, str]:
    """CHK11: (passage, rest): the first sentence end from least on, else a blank from twice that; all at the end."""
    for k in range(max(0, least - 1), len(buffer)):
        if buffer[k] in _BREAKS:
            return buffer[: k + 1], buffer[k + 1 :]
    if len(buffer) >= 2 * least:
        at = buffer.find(" ", 2 * least - 1)
        if at >= 0:
            return buffer[: at + 1], buffer[at + 1 :]
    return (buffer, "") if final else ("", buffer)


class Passages(StatefulProcessor):
    """STR2: an answer's deltas in sequence order become passages; a gap waits, the end flushes."""

    def __init__(self, least: int):
        self.least = least

    def init(self, handle) -> None:
        self.state = handle.getValueState("answer", "data string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0]) if self.state.exists() else {"next": 0, "buffer": "", "wait": {}, "out": 0}
        for frame in rows:
            for seq, kind, text in zip(frame["seq"], frame["type"], frame["text"]):
                held["wait"][str(int(seq))] = [kind, text or ""]
        out = []
        while (item := held["wait"].pop(str(held["next"]), None)) is not None:
            held["next"] += 1
            kind, text = item
            held["buffer"] += text if kind == "delta" else ""
            while True:
                passage, held["buffer"] = cut_passage(held["buffer"], self.least, kind == "done")
                if not passage:
                    break
                out.append((key[0], held["out"], passage))
                held["out"] += 1
        self.state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["answer_id", "passage_no", "passage"])

    def close(self) -> None:
        pass


def passages_of(events: DataFrame, least: int = 60) -> DataFrame:
    """STR2 over events(answer_id, seq, type, text)."""
    return events.groupBy("answer_id").transformWithStateInPandas(Passages(least), "answer_id string, passage_no int, passage string", "Append", "None")


def rolling_stream(events: DataFrame, width: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """STR10 with a watermark, so that closed windows leave the state."""
    from textquarry.operators.logs import rolling

    return rolling(events.withWatermark("ts", late), width, slide)


def suppressed_stream(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """STR11: one of equal calls inside the watermark."""
    return calls.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fingerprint"])


def ingested(files: DataFrame) -> DataFrame:
    """STR13: passages with vectors of a stream (or table) of files(path, text)."""
    from textquarry.operators.chunking import passages
    from textquarry.operators.vectors import hashed_embedding

    chunks = passages(files.where(F.length("text") > 0).select("path", "text"), ["path"])
    return chunks.withColumn("embedding", hashed_embedding(F.col("content")))
