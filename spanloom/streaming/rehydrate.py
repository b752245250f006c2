"""Streaming rehydration: chunks of replies by conversation, any chunking giving what the batch gives."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.vault import Rehydrator

OUT = "conv_id long, seq long, text string"


def rehydrated(chunks: DataFrame, back: dict[int, dict[str, str]] | None = None) -> DataFrame:
    """chunks (conv_id, seq, text, done, vault) of a stream, ordered by seq within a micro-batch; ``vault`` is JSON of
    surrogate to real. State is one short text a conversation and is dropped at its end mark."""
    from pyspark.sql.streaming.state import GroupState

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carry, pending, vault = state.get if state.exists else ("", "", "{}")
        rows, over = [], False
        every = pd.concat(list(frames)).sort_values("seq")
        for r in every.itertuples(index=False):
            vault = r.vault or vault
            h = Rehydrator(json.loads(vault), carry, pending)
            text = h.push(r.text or "")
            if r.done:
                text, over = text + h.finish(), True
            carry, pending = h.carry, h.pending
            rows.append((key[0], r.seq, text))
        if over:
            state.remove()
        else:
            state.update((carry, pending, vault))
        yield pd.DataFrame(rows, columns=["conv_id", "seq", "text"])

    return chunks.groupBy("conv_id").applyInPandasWithState(run, OUT, "carry string, pending string, vault string", "append", "NoTimeout")


def frames_of(buffer: str, chunk: str) -> tuple[str, list[str], bool]:
    """(rest, data payloads, done) of server-sent events: frames end at a blank line, ``[DONE]`` ends the stream."""
    text = (buffer + chunk).replace("\r\n", "\n")
    *whole, rest = text.split("\n\n")
    out, done = [], False
    for frame in whole:
        data = "\n".join(x[5:].lstrip() for x in frame.split("\n") if x.startswith("data:"))
        if data == "[DONE]":
            done = True
            break
        if data:
            out.append(data)
    return rest, out, done
