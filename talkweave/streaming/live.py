"""Live operators on Structured Streaming: endpointing, sliding windows, online identities.

The same functions run on a batch DataFrame where no state is needed; stateful ones replay a key's
rows in order of time within each micro-batch, with a watermark that bounds the state.
"""

from __future__ import annotations

import pickle

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talkweave.operators.sequential import Centroids


def sliding_totals(events: DataFrame, late: str = "10 minutes", size: str = "10 minutes", step: str = "5 minutes") -> DataFrame:
    """Count and total of each type in sliding windows; on a stream, rows later than ``late`` go."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    return stream.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def utterances(events: DataFrame, late: str = "1 minute", pause: str = "600 milliseconds", pause_after_number: str = "1500 milliseconds") -> DataFrame:
    """Sessions of a speaker's tokens: an utterance ends after a pause, a longer one after a number."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    gap = F.when(F.col("token").rlike("[0-9]$"), pause_after_number).otherwise(pause)
    return stream.groupBy("speaker", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_tokens")).select("speaker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_tokens")


def once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event_id once: copies are known as long as they come within ``late`` of the first by their
    own time, which is what bounds the state; a batch has no such limit."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def finalised(utterances: DataFrame, frame_s: float, least_s: float, silence_s: float, decode_s: Column) -> DataFrame:
    """session, start, end (seconds), reason, latency of utterances (session, start, end, reason by
    frames) of ``least_s`` or more: the text is out after decoding and, where a pause ended the
    utterance, after that pause."""
    u = utterances.withColumns({"start": F.col("start") * frame_s, "end": (F.col("end") + 1) * frame_s})
    latency = decode_s + F.when(F.col("reason") == "pause", silence_s).otherwise(0.0)
    return u.where(F.round(F.col("end") - F.col("start"), 6) >= least_s).select("session", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), "reason", F.round(latency, 2).alias("latency"))


class Endpointer:
    """Frames of a voice detector to utterances: opens at p >= on, closes after ``quiet`` frames
    below it or at ``longest`` frames, with ``before`` frames of run-up; shorter than ``least``
    voiced frames goes."""

    def __init__(self, on: float = 0.5, quiet: int = 18, longest: int = 780, before: int = 8, least: int = 12):
        self.on, self.quiet, self.longest, self.before, self.least = on, quiet, longest, before, least
        self.open, self.voiced, self.silent, self.closed, self.latest = None, 0, 0, -1, -1

    def feed(self, frame: int, p: float):
        """(start, end, reason) of an utterance that this frame closes, or None."""
        self.latest, speech = frame, p >= self.on
        if self.open is None:
            if not speech:
                return None
            self.open, self.voiced, self.silent = max(self.closed + 1, frame - self.before), 0, 0
        self.voiced += speech
        self.silent = 0 if speech else self.silent + 1
        if self.silent < self.quiet and frame - self.open + 1 < self.longest:
            return None
        return self.finish(frame, "pause" if self.silent >= self.quiet else "length")

    def finish(self, frame: int, reason: str = "end"):
        if self.open is None:
            return None
        out = (self.open, frame, reason) if self.voiced >= self.least else None
        self.open, self.closed = None, frame
        return out


#: After this long without a row a session is over, and its state goes. A query that is to end by
#: itself (trigger availableNow) takes None instead: Spark keeps waiting for timeouts otherwise.
IDLE_MS = 10 * 60 * 1000


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def endpoints(frames: DataFrame, idle_ms: int | None = IDLE_MS, **options) -> DataFrame:
    """Utterances (session, start, end, reason) of a stream of frames (session, frame, p). A session
    that stays idle gives its open utterance out and is forgotten."""

    def run(key, batches, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            point = pickle.loads(state.get[0])
            state.remove()
            last = point.finish(point.latest)
            yield pd.DataFrame([(key[0], *x) for x in ([last] if last else [])], columns=["session", "start", "end", "reason"])
            return
        point = pickle.loads(state.get[0]) if state.exists else Endpointer(**options)
        rows = pd.concat(list(batches)).sort_values("frame")
        found = [x for x in (point.feed(int(f), float(p)) for f, p in zip(rows["frame"], rows["p"])) if x]
        state.update((pickle.dumps(point),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *x) for x in found], columns=["session", "start", "end", "reason"])

    return frames.groupBy("session").applyInPandasWithState(run, "session string, start long, end long, reason string", "state binary", "append", _timeout(idle_ms))


def replayed_endpoints(frames: DataFrame, **options) -> DataFrame:
    """What endpoints gives, from frames that are all there; an open utterance ends with its session."""

    def run(pdf):
        import pandas as pd

        pdf, point = pdf.sort_values("frame"), Endpointer(**options)
        found = [x for x in (point.feed(int(f), float(p)) for f, p in zip(pdf["frame"], pdf["p"])) if x]
        if last := point.finish(point.latest):
            found.append(last)
        return pd.DataFrame([(pdf["session"].iloc[0], *x) for x in found], columns=["session", "start", "end", "reason"])

    return frames.groupBy("session").applyInPandas(run, "session string, start long, end long, reason string")


def live_identities(vectors: DataFrame, least: float, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """(session, seq, identity) of a stream of vectors (session, seq, embedding). A session that
    stays idle is forgotten."""

    def run(key, batches, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=["session", "seq", "identity"])
            return
        known = pickle.loads(state.get[0]) if state.exists else Centroids(least)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = [(key[0], int(s), known.match(v)) for s, v in zip(rows["seq"], rows["embedding"])]
        state.update((pickle.dumps(known),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session", "seq", "identity"])

    return vectors.groupBy("session").applyInPandasWithState(run, "session string, seq long, identity int", "state binary", "append", _timeout(idle_ms))
