"""What becomes of a delivered event: consent, contract, identity, receipts, and a client's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.text import mask_kinds, masked
from passagework.sources.intake import MOST_BYTES
from passagework.streaming.events import event_key

#: The one kind of event that is taken, and how texts begin that no person wrote.
EVENT, MACHINE = "UserPromptSubmit", ("<task-notification>", "<agent-message")
#: What an owner can do about a state.
REMEDIES = {
    "not_configured": "Name a writable source for this client and opt in.",
    "paused": "Resume the client.",
    "opt_in_required": "Opt in to whole prompts.",
    "no_receipt": "Restart the client and send a test prompt.",
    "payload_too_large": "Send a smaller prompt.",
    "invalid_payload": "Check the event's JSON.",
    "unsupported_event": "Connect only the event of a submitted prompt.",
    "missing_event_identity": "Upgrade the client: it must send a session and an id.",
    "event_identity_conflict": "One id came with two texts: look into the client before trying again.",
    "failed": "Check the destination and deliver the event again.",
}


def _text(at: str) -> Column:
    """A field of the payload if it is a string, else null."""
    value = F.try_variant_get("payload", f"$.{at}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get("payload", f"$.{at}", "string"))


def _identity(value: Column) -> Column:
    return F.coalesce((F.trim(value) != "") & (F.length(value) <= 512), F.lit(False))


def judged(raw: DataFrame, clients: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(name, client, state, event_id, digest, content, masked) of raw events (name, client, size, body), one row each.

    clients has a row a client: client, opt_in, paused, capability, id_field. The state is the first that holds of:
    not_configured, paused, opt_in_required, the client's capability if it isn't 'supported', payload_too_large,
    invalid_payload, unsupported_event, missing_event_identity, invalid_payload (no prompt), harness_event; else captured.
    Only captured rows have an event_id, the masked content and its digest. Works on streams too.
    """
    known = clients.select("client", "opt_in", "paused", F.coalesce("capability", F.lit("client_unavailable")).alias("capability"), "id_field", F.lit(True).alias("known"))
    rows = raw.select("name", "client", "size", F.try_parse_json("body").alias("payload")).join(known, "client", "left")
    native = F.when(F.col("id_field") == "turn_id", _text("turn_id")).otherwise(_text("prompt_id"))
    read = rows.select("*", _text("session_id").alias("session"), native.alias("native"), _text("prompt").alias("prompt"), _text("hook_event_name").alias("event"))
    object_ = F.coalesce(F.schema_of_variant("payload").startswith("OBJECT"), F.lit(False))
    machine = F.lit(False)
    for start in MACHINE:
        machine = machine | F.ltrim("prompt").startswith(start)
    state = (
        F.when(F.col("known").isNull(), "not_configured").when(F.coalesce("paused", F.lit(False)), "paused").when(~F.coalesce("opt_in", F.lit(False)), "opt_in_required")
        .when(F.col("capability") != "supported", F.col("capability")).when(F.col("size") > most, "payload_too_large").when(~object_, "invalid_payload")
        .when(F.coalesce("event", F.lit("")) != EVENT, "unsupported_event").when(~_identity(F.col("session")) | ~_identity(F.col("native")), "missing_event_identity")
        .when(F.trim(F.coalesce("prompt", F.lit(""))) == "", "invalid_payload").when(machine, "harness_event").otherwise("captured")
    )
    told = read.withColumn("state", state)
    taken = F.col("state") == "captured"
    content = F.when(taken, masked(F.col("prompt")))
    key = F.when(taken, F.concat(F.lit("evt_"), event_key(F.col("client"), F.col("session"), F.col("native"))))
    return told.select("name", "client", "state", key.alias("event_id"), F.sha2(content, 256).alias("digest"), content.alias("content"), F.when(taken, mask_kinds(F.col("prompt"))).alias("masked"))


def identified(receipts: DataFrame) -> DataFrame:
    """receipts (name, client, state, event_id, digest ...) where only the first of an event, by name, is captured: equal ones after it are duplicates, others conflict.

    Firsts are found by a partial aggregate, so an event that is delivered very often meets in no one task but as its first.
    """
    taken = F.col("state") == "captured"
    first = receipts.where(taken).groupBy(F.col("event_id").alias("_key")).agg(F.min(F.struct("name", "digest")).alias("first"))
    # receipts without an event are spread over all tasks by a key that no event has
    met = receipts.withColumn("_key", F.coalesce("event_id", F.concat(F.lit("\x00"), "name"))).join(first, "_key", "left")
    again = F.when(F.col("first.name") == F.col("name"), "captured").when(F.col("first.digest") == F.col("digest"), "duplicate").otherwise("event_identity_conflict")
    return met.withColumn("state", F.when(taken, again).otherwise(F.col("state"))).select(*receipts.columns)


def status(receipts: DataFrame, clients: DataFrame) -> DataFrame:
    """(client, state, last_success, receipts, action) of every configured client, by its settings and its last receipt by name."""
    last = receipts.groupBy("client").agg(
        F.max_by("state", "name").alias("latest"), F.max(F.when(F.col("state").isin("captured", "duplicate"), F.col("name"))).alias("last_success"), F.count(F.lit(1)).alias("receipts"))
    met = clients.join(last, "client", "left")
    capability = F.coalesce("capability", F.lit("client_unavailable"))
    state = F.when(F.coalesce("paused", F.lit(False)), "paused").when(capability != "supported", capability).otherwise(F.coalesce("latest", F.lit("no_receipt")))
    action = F.element_at(F.create_map(*(F.lit(x) for pair in REMEDIES.items() for x in pair)), F.col("state"))
    return met.select("client", state.alias("state"), "last_success", F.coalesce("receipts", F.lit(0)).alias("receipts")).withColumn("action", action)


def overall(states: DataFrame) -> DataFrame:
    """One row, state: that of all clients if they share one, else mixed; not_configured without clients."""
    n = F.count_distinct("state")
    return states.agg(F.when(n == 0, "not_configured").when(n == 1, F.min("state")).otherwise("mixed").alias("state"))
