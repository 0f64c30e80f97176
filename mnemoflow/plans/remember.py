"""Facts kept in a store, batch after batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import facts
from ..sources.store import MemoryStore


def remember(store: MemoryStore, events: DataFrame, transaction: str) -> bool:
    """Consolidate a batch of events (shard_id, event_id, ordinal, content) into the store, once for a ``transaction``;
    False if it was done before. Batches come in the order of their ordinals."""
    if store.published(transaction):
        return False
    rows, tails = facts.consolidate(events, store.read("facts", facts.FACT), store.read("fact_tails", facts.TAIL))
    return store.publish(transaction, {"facts": rows, "fact_tails": tails})


def recall(store: MemoryStore) -> DataFrame:
    return facts.memories(store.read("facts", facts.FACT))
