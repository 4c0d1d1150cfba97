"""Events of an entity as commands, and the messages of a log as events again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions import names


def to_commands(events: DataFrame, component: Column, entity_id: Column, event: Column, body: Column, expected: Column, seq: str = "seq", metadata: Column | None = None) -> DataFrame:
    """One command an event: its stream is the entity's, its type the event's name, its data the body as JSON.

    A null ``body`` is an event without one, whose data is empty. ``expected`` is the entity's version, the position
    of its last message (null: none yet). The id is made from ``seq``, so a command sent again has the same one.
    """
    empty = F.lit("") if metadata is None else metadata
    return events.select(
        F.col(seq).alias("seq"), names.encode_id(F.col(seq)).alias("id"), names.build(component, entity_id).alias("stream_name"), event.alias("message_type"),
        F.coalesce(F.to_json(body), F.lit("")).alias("data"), empty.alias("metadata"), expected.cast("long").alias("expected"), F.lit("sequential").alias("kind"),
    )
