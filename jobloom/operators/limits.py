"""Request limits per key: exact sliding admission, token buckets, rolling counts."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.sources.tables import stored


def admit(times: list[int], limit: int, window: int, held: list[int]) -> list[bool]:
    """Whether each event (in order, microseconds) is let in: fewer than limit were let in within the window before
    it. held: the last ones let in, at most limit; it is updated. Refused events are passed over, not visited."""
    out, i = [False] * len(times), 0
    while i < len(times) and limit > 0:
        if len(held) >= limit:
            i = bisect_left(times, held[0] + window, i)
            if i == len(times):
                break
            held.pop(0)
        out[i] = True
        held.append(times[i])
        i += 1
    return out


def take(times: list[int], capacity: int, period: int, state: list[int]) -> list[bool]:
    """Token bucket with greedy refill: capacity tokens come back evenly over period. state: tokens in parts of a
    period and the time at which they were counted, so that all is in whole numbers; empty for a full bucket. Refused
    events are passed over, since they take nothing."""
    out, i = [False] * len(times), 0
    while i < len(times) and capacity > 0:
        tokens, last = state or (capacity * period, times[i])
        i = bisect_left(times, last - (tokens - period) // capacity, i)
        if i == len(times):
            break
        tokens = min(capacity * period, tokens + (times[i] - last) * capacity)
        out[i] = True
        state[:] = [tokens - period, times[i]]
        i += 1
    return out


@dataclass
class Limiter:
    """step(times, state) folds events in order and updates state, which is empty at first and again after a silence
    of window; a run of at most `most` events from there is let in whole. seen(state, t) is what of the state matters
    from time t on."""

    step: Callable[[list[int], list[int]], list[bool]]
    seen: Callable[[list[int], int], list[int]]
    window: int
    most: int


def sliding(limit: int, window: int) -> Limiter:
    return Limiter(lambda times, held: admit(times, limit, window, held), lambda held, t: [x for x in held if x > t - window], window, limit)


def bucket(capacity: int, period: int) -> Limiter:
    def seen(state: list[int], t: int) -> list[int]:
        left = min(capacity * period, state[0] + (t - state[1]) * capacity) if state else capacity * period
        return [] if left == capacity * period else [left]

    return Limiter(lambda times, state: take(times, capacity, period, state), seen, period, capacity)


def _keys(pdf: pd.DataFrame) -> np.ndarray:
    """Where a batch, sorted by key, begins a key."""
    key = pdf["_key"].to_numpy(object)
    new = np.ones(len(key), bool)
    new[1:] = [a is not b and a != b for a, b in zip(key[1:], key[:-1], strict=True)]
    return new


def _fold(pdf: pd.DataFrame, limiter: Limiter, key, state: list[int]) -> tuple[np.ndarray, object, list[int]]:
    """admitted of a sorted batch that follows events of key in that state, the last key and its state. Only runs
    between silences that pass `most` are folded, the first and the last of the batch besides."""
    times = pdf["_t"].to_numpy(np.int64)
    new = _keys(pdf)
    new[1:] |= np.diff(times) >= limiter.window
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(times))
    names = pdf["_key"].to_numpy(object)
    out = np.ones(len(times), bool)
    fold = end - begin > limiter.most
    fold[[0, -1]] = True
    for a, b in zip(begin[fold].tolist(), end[fold].tolist(), strict=True):
        if a or names[0] is not key and names[0] != key:
            key, state = names[a], []
        out[a:b] = limiter.step(times[a:b].tolist(), state)
    return out, key, state


_STATE = "_part int, first string, last string, whole boolean, met boolean, state array<long>"


def _limited(events: DataFrame, limiter: Limiter) -> DataFrame:
    """events (key, id, ts) with admitted. They are sorted by ranges of key, time and id, so that a key with most of
    the events is spread over many parts. What an event meets depends on all before it; so each part is first folded
    as if nothing came before. A part that begins in the middle of a key's run is folded again from the state in which
    the part before it ended, but only until both folds are in the same state, after which they agree; where a run
    passes a whole part without that, its end has changed and the next part follows. After `rounds` of this, runs that
    still differ (a key that never rests can keep its phase for ever) are passed through once, for the states between
    parts alone. At last all parts are folded from their right states at once. Only states reach the driver, one a
    part."""
    rounds = 3
    spark, names = events.sparkSession, events.columns
    sort = ["_key", "_t", "id"]
    timed = events.withColumns({"_t": F.unix_micros(F.col("ts").cast("timestamp")), "_key": F.col("key").cast("string")})
    parts = stored(spark, timed.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_part", F.spark_partition_id()), "limited")

    def runs(df: DataFrame) -> DataFrame:
        return df.repartition("_part").sortWithinPartitions("_part", *sort)

    def states(starts: dict[int, list[int]], old: dict[int, list[int]] | None, chain: bool = False):
        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part, first, key, t, state, was, whole, met = None, None, None, None, [], None, True, False
            rows = []
            for pdf in batches:
                for p, own in pdf.groupby("_part", sort=True):
                    if p != part:
                        if part is not None:
                            rows.append((part, first, key, whole, met, state))
                        state = list(state) if chain and part is not None else list(starts.get(p, []))
                        was = list(old[p]) if old is not None else None
                        first = key = own["_key"].iloc[0]
                        part, t, whole, met = int(p), None, True, False
                    if met:
                        continue  # both folds agree from here on
                    times = own["_t"].to_numpy(np.int64)
                    gaps = np.diff(times, prepend=times[0] if t is None else t)
                    whole = whole and own["_key"].iloc[0] == key and not _keys(own)[1:].any() and not (gaps >= limiter.window).any()
                    t = int(times[-1])
                    if was is not None:
                        _, _, was = _fold(own, limiter, key, was)
                    _, key, state = _fold(own, limiter, key, state)
                    met = was is not None and limiter.seen(state, t) == limiter.seen(was, t)
            if part is not None:
                rows.append((part, first, key, whole, met, state))
            yield pd.DataFrame(rows, columns=["_part", "first", "last", "whole", "met", "state"])

        return task

    keyed = parts.select("_part", *sort)
    found = {r["_part"]: r for r in runs(keyed).mapInPandas(states({}, None), _STATE).collect()}
    order = sorted(found)
    ends = {p: list(found[p]["state"]) for p in order}
    # Parts whose first run goes on from the part before.
    follows = {p: q for q, p in zip(order[:-1], order[1:], strict=True) if found[q]["last"] == found[p]["first"]}
    behind = {q: p for p, q in follows.items()}
    used: dict[int, list[int]] = {}
    for n in range(rounds + 1):
        # A part whose run does not fill it ends as it did, whatever came before.
        change = [p for p in follows if found[p]["whole"] and ends[follows[p]] != used.get(p, [])]
        if not change:
            break
        starts = {p: ends[follows[p]] for p in change}
        if n < rounds:
            task = states(starts, {p: used.get(p, []) for p in change})
            for r in runs(keyed.where(F.col("_part").isin(change))).mapInPandas(task, _STATE).collect():
                if not r["met"]:  # else it ends as before
                    ends[r["_part"]] = list(r["state"])
            used |= starts
            continue
        # What has not settled: each run's parts, one after the other.
        for p in sorted(change):
            if ends[follows[p]] == used.get(p, []):
                continue
            chain = [p]
            while (after := behind.get(chain[-1])) is not None and found[after]["whole"]:
                chain.append(after)
            task = states({p: ends[follows[p]]}, None, chain=True)
            before = ends[follows[p]]
            for r in sorted(keyed.where(F.col("_part").isin(chain)).coalesce(1).sortWithinPartitions("_part", *sort).mapInPandas(task, _STATE).collect(), key=lambda r: r["_part"]):
                used[r["_part"]], before = before, list(r["state"])
                ends[r["_part"]] = before
    right = {p: ends[q] for p, q in follows.items()}

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, key, state = None, None, []
        for pdf in batches:
            for p, own in pdf.groupby("_part", sort=True):
                if p != part:
                    part, key, state = p, own["_key"].iloc[0], list(right.get(p, []))
                admitted, key, state = _fold(own, limiter, key, state)
                yield own.assign(admitted=admitted)[[*names, "admitted"]]

    return runs(parts).mapInPandas(final, events.withColumn("admitted", F.lit(True)).schema)


def sliding_admission(events: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """events (key, id, ts) with admitted: let in if fewer than limit of their key were within the window before."""
    return _limited(events, sliding(limit, window_seconds * 1_000_000))


def token_bucket(events: DataFrame, capacity: int, period_seconds: int) -> DataFrame:
    """events (key, id, ts) with admitted, by a bucket per key."""
    return _limited(events, bucket(capacity, period_seconds * 1_000_000))


#: Requests a minute by kind of endpoint.
TIER_LIMITS = {"login": 10, "refresh": 30, "public": 120}


def tier_admission(requests: DataFrame, limits: dict[str, int] | None = None, window_seconds: int = 60) -> DataFrame:
    """requests (tier, ip, id, ts) with admitted: each tier's limit holds for each ip and window."""
    keyed = requests.withColumn("key", F.concat_ws("|", "tier", "ip"))
    admitted = [sliding_admission(keyed.where(F.col("tier") == tier), limit, window_seconds) for tier, limit in (limits or TIER_LIMITS).items()]
    return reduce(DataFrame.unionByName, admitted).drop("key")


def sliding_count(key: str, ts: str, window_seconds: int) -> Column:
    """Events of the key in the window that ends with each event; one exactly a window ago is outside."""
    millis = F.unix_millis(F.col(ts).cast("timestamp"))
    return F.count("*").over(Window.partitionBy(key).orderBy(millis).rangeBetween(-window_seconds * 1000 + 1, 0))
