"""Agents, their properties, states and channels, and chats, as table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("running", "paused", "stopped")


def with_template(requests: DataFrame, templates: DataFrame, key: str = "template") -> DataFrame:
    """Requests' properties over their template's defaults; a request wins where both have a key."""
    joined = requests.join(templates.select(key, F.col("properties").alias("defaults")), key, "left")
    return joined.withColumn("properties", overridden(F.col("defaults"), F.col("properties"))).drop("defaults")


def overridden(defaults: Column, own: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    d, o = F.coalesce(defaults, empty), F.coalesce(own, empty)
    return F.map_concat(F.map_filter(d, lambda k, v: ~F.map_contains_key(o, k)), o)


def set_property(properties: Column, key: str, value: str) -> Column:
    return overridden(properties, F.create_map(F.lit(key), F.lit(value)))


def drop_property(properties: Column, key: str) -> Column:
    return F.map_filter(properties, lambda k, v: k != key)


def create(agents: DataFrame, new: DataFrame, key: str = "agent_id") -> DataFrame:
    """agents and the new ones; an id that is there is an error when the rows are read."""
    both = agents.unionByName(new).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in agents.columns if c != key))
    return both.filter(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("agent exists: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).select(agents.columns)


def changed(agents: DataFrame, key: str, ids: list, status: str) -> DataFrame:
    if status not in STATES:
        raise ValueError(f"no such status: {status}")
    return agents.withColumn("status", F.when(F.col(key).isin(ids), status).otherwise(F.col("status")))


def one(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row of one agent, channel or task; reading it is an error if there is none."""
    found = rows.filter(F.col(key) == F.lit(value)).agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in rows.columns))
    return found.filter(F.when(F.col("_n") == 0, F.raise_error(F.lit(f"not found: {value}")).cast("boolean")).otherwise(True)).select(rows.columns)


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """rows less those that `gone` (key) names; a name that is not there is an error when the rows are read."""
    marked = rows.join(gone.select(F.col(key).alias("_gone")).distinct(), F.col(key) == F.col("_gone"), "full")
    missing = F.raise_error(F.concat(F.lit("not found: "), F.col("_gone").cast("string"))).cast("boolean")
    return marked.filter(F.when(F.col(key).isNull() & F.col("_gone").isNotNull(), missing).otherwise(F.col("_gone").isNull())).select(rows.columns)


#: A channel belongs to an agent and carries its messages.
CHANNELS = "channel_id string, agent_id string, kind string"


def open_channels(channels: DataFrame, new: DataFrame, agents: DataFrame) -> DataFrame:
    """channels and the new ones; a channel that is there, or one of an unknown agent, is an error when the rows are read."""
    known = new.join(agents.select(F.col("agent_id").alias("_known")), F.col("agent_id") == F.col("_known"), "left")
    checked = known.filter(F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("not found: "), F.col("agent_id"))).cast("boolean")).otherwise(True)).select(new.columns)
    return create(channels, checked, "channel_id")


#: Tasks of the crawl service.
TASKS = "task_id bigint, name string, state string, submitted_at bigint"


def submit(tasks: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """tasks and a queued one for each request (task_id, name); a task that is there is an error when the rows are read."""
    return create(tasks, requests.select("task_id", "name", F.lit("queued").alias("state"), F.lit(now_ms).cast("bigint").alias("submitted_at")), "task_id")


def chat(messages: DataFrame, chat_id: str = "conv_id", order: str = "turn", fields: tuple[str, ...] = ("role", "text")) -> DataFrame:
    """One row for each chat with its messages in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order), *(F.col(f) for f in fields))))
    return messages.groupBy(chat_id).agg(listed.alias("messages"), F.count(F.lit(1)).alias("n_messages"))


def listed(tasks: DataFrame, terms: str | None = None, state: str | None = None, offset: int = 0, page_size: int = 50) -> DataFrame:
    """A page of tasks by id, filtered by words of their name and state."""
    if terms:
        tasks = tasks.filter(F.contains(F.lower("name"), F.lit(terms.lower())))
    if state:
        tasks = tasks.filter(F.col("state") == state)
    return tasks.orderBy("task_id").offset(offset).limit(page_size)
