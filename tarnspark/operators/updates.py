"""Changes that messages about activities ask for: titles, sports, visibility, removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_public
from ..schemas import EVENT
from .ledger import delete_cascade

#: Sports without a climb of one's own.
SKIPPED_SPORTS = ("AlpineSki", "Snowboard", "Sail", "Windsurf", "Kitesurf", "VirtualRide", "VirtualRun", "Golf", "Velomobile")


def counted_sport(sport: Column) -> Column:
    """Whether activities of a sport count; an unknown one does."""
    return F.coalesce(~sport.isin(*SKIPPED_SPORTS), F.lit(True))


def patches(messages: DataFrame, column: str = "json_data") -> DataFrame:
    """activity_id, title, sport, is_public of update messages (id, created, payload): each field by the last message that has it.

    A field that a message lacks, or whose JSON type isn't the expected one, stays null: nothing is asked of it.
    """
    event = F.from_json(column, EVENT)
    text = lambda k: F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(column), f"$.updates.{k}", "variant")) == "STRING", event["updates"][k])
    private = event["updates"]["private"]
    rows = messages.select(F.struct("created", "id").alias("_at"), event["object_id"].alias("activity_id"), text("title").alias("title"), text("type").alias("sport"), F.when(private.isNotNull(), is_public(private)).alias("is_public"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c)
    return rows.where(F.coalesce("activity_id", F.lit(0)) != 0).groupBy("activity_id").agg(*map(last, ("title", "sport", "is_public")))


def apply_updates(activities: DataFrame, asked: DataFrame, titled: str | None = None) -> DataFrame:
    """activities (activity_id, title, sport, is_public) after patches; a row marked in ``titled`` keeps its own title."""
    joined = activities.join(asked.select("activity_id", *[F.col(c).alias(f"_{c}") for c in ("title", "sport", "is_public")]), "activity_id", "left")
    title = F.coalesce("_title", "title")
    changed = {"title": F.when(F.coalesce(F.col(titled), F.lit(False)), F.col("title")).otherwise(title) if titled else title, "sport": F.coalesce("_sport", "sport"), "is_public": F.coalesce("_is_public", "is_public")}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in activities.columns])


def spread_visibility(tables: dict[str, DataFrame], asked: DataFrame) -> dict[str, DataFrame]:
    """Every table (activity_id, is_public) with the visibility that was asked for its activities."""
    known = asked.where(F.col("is_public").isNotNull()).select("activity_id", F.col("is_public").alias("_public"))
    return {name: df.join(known, "activity_id", "left").withColumn("is_public", F.coalesce("_public", "is_public")).select(*df.columns) for name, df in tables.items()}


def apply_deletes(tables: dict[str, DataFrame], gone: DataFrame, manual: str | None = None) -> dict[str, DataFrame]:
    """Tables without the gone activities' rows; the one named ``manual`` keeps its rows, without their activity."""
    ids = gone.select(F.col("activity_id").alias("_gone")).distinct()
    left = delete_cascade({n: (df, ["activity_id"]) for n, df in tables.items() if n != manual}, ids)
    if manual:
        df = tables[manual]
        kept = df.join(ids, F.col("activity_id") == F.col("_gone"), "left").withColumn("activity_id", F.when(F.col("_gone").isNull(), F.col("activity_id")))
        left[manual] = kept.select(*df.columns)
    return left
