"""Situations from event sequences: row patterns as forward windows and running counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeflow.config import ReasoningThresholds
from wakeflow.functions import exprs as X
from wakeflow.operators.clean import integer, number, require

#: from the thresholds, a struct of :func:`situation` for each prepared event, or null where the rule finds nothing
Rule = Callable[[ReasoningThresholds], Column]
DWELL = ("ANCHOR", "LOITER", "REPEATED_CROSSING")
_EVENT = ["event_type", "event_timestamp", "mmsi", "start_timestamp", "end_timestamp", "duration_minutes", "details"]


def prepare(events: DataFrame) -> DataFrame:
    """Events as their vessel's sequence, with what rules look ahead to.

    seq: the number in the sequence; as_event: the event as a struct; dwells: running
    count of dwelling events; exit: the next EXIT (as_event, dwells); zone: the kind of
    the next EXIT or ENTRY; loiters: of an ENTRY, the LOITER events before that one.
    """
    require(events, ["event_type", "event_timestamp", "mmsi"], "events")
    rows = events
    for c, other in (("start_timestamp", "event_timestamp"), ("end_timestamp", "event_timestamp")):
        rows = rows.withColumn(c, F.coalesce(c, other)) if c in rows.columns else rows.withColumn(c, F.col(other))
    rows = rows.withColumn("duration_minutes", F.coalesce(number("duration_minutes"), F.lit(0.0)) if "duration_minutes" in rows.columns else F.lit(0.0))
    if "details" not in rows.columns:
        rows = rows.withColumn("details", F.lit(None).cast("struct<crossing_count:bigint>"))
    rows = rows.withColumn("event_type", F.upper("event_type")).withColumn("mmsi", integer("mmsi")).dropna(subset=["event_type", "event_timestamp", "mmsi"])
    kind, crosses = F.col("event_type"), F.col("event_type").isin("ENTRY", "EXIT")
    order = Window.partitionBy("mmsi").orderBy("event_timestamp", "event_type", "start_timestamp", "end_timestamp")
    till = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "as_event": F.struct(*_EVENT), "seq": F.row_number().over(order),
        "dwells": F.sum(kind.isin(*DWELL).cast("int")).over(till), "visit": F.sum(crosses.cast("int")).over(till),
    })
    # what follows a row is what comes before it in the order turned round
    back = Window.partitionBy("mmsi").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"exit": F.last(F.when(kind == "EXIT", F.struct("as_event", "dwells")), ignorenulls=True).over(back), "zone": F.last(F.when(crosses, kind), ignorenulls=True).over(back)})
    visit = Window.partitionBy("mmsi", "visit").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("loiters", F.when(kind == "ENTRY", F.collect_list(F.when(kind == "LOITER", F.col("as_event"))).over(visit)))


def situation(name: str, confidence: float, support: Column, explanation: str) -> Column:
    """A situation from its supporting events, in order."""
    return F.struct(F.lit(name).alias("situation"), F.lit(float(confidence)).alias("confidence"), support.alias("supporting_events"), F.lit(explanation).alias("explanation"))


def _single(kind: str, name: str, confidence: str, explanation: str, keep: Callable | None = None) -> Rule:
    def rule(t: ReasoningThresholds) -> Column:
        on = F.col("event_type") == kind
        return F.when(on & keep(t) if keep else on, situation(name, getattr(t, confidence), F.array("as_event"), explanation))

    return rule


def prolonged_presence(t: ReasoningThresholds) -> Column:
    """ENTRY with loitering before the next EXIT or ENTRY; support: ENTRY, the loiters, the EXIT if it comes first."""
    end = F.when(F.col("zone") == "EXIT", F.array("exit.as_event")).otherwise(F.slice(F.array("as_event"), 1, 0))
    found = situation("Prolonged Boundary Presence", t.prolonged_presence_confidence, F.concat(F.array("as_event"), F.col("loiters"), end), "Entry followed by loitering before the next exit")
    return F.when((F.col("event_type") == "ENTRY") & (F.size("loiters") >= max(1, t.prolonged_presence_min_loiter_events)), found)


def boundary_crossing(t: ReasoningThresholds) -> Column:
    """Every ENTRY, with the next EXIT anywhere later if there is one."""
    support = F.when(F.col("exit").isNull(), F.array("as_event")).otherwise(F.array("as_event", "exit.as_event"))
    return F.when(F.col("event_type") == "ENTRY", situation("Boundary Crossing", t.boundary_crossing_confidence, support, "Entry into the zone, with the exit that follows"))


def transit(t: ReasoningThresholds) -> Column:
    """ENTRY to the next EXIT within the hours, nothing that dwells between."""
    soon = X.hours_between("exit.as_event.event_timestamp", "event_timestamp") <= t.transit_max_trip_hours
    found = situation("Transit", t.transit_confidence, F.array("as_event", "exit.as_event"), "Entry and exit without dwelling between them")
    return F.when((F.col("event_type") == "ENTRY") & (F.col("exit.dwells") == F.col("dwells")) & soon, found)


#: in the order that decides between equals
DEFAULT_RULES: Sequence[Rule] = (
    _single("ANCHOR", "Anchorage", "anchorage_confidence", "Anchored for long", lambda t: F.col("duration_minutes") >= t.anchorage_min_duration_minutes),
    prolonged_presence,
    _single("REPEATED_CROSSING", "Repeated Crossing", "repeated_crossing_base_confidence", "Many crossings in a short time"),
    boundary_crossing,
    _single("MANEUVERING", "Maneuvering", "maneuvering_confidence", "Headings scatter"),
    transit,
)


def reason(events: DataFrame, t: ReasoningThresholds | None = None, rules: Sequence[Rule] | None = None) -> DataFrame:
    """situation, confidence, mmsi, start_timestamp, end_timestamp (of the first and last support), extent_start, extent_end, supporting_events, explanation.

    Of equal (situation, vessel, start, end) the most confident stays, the earlier rule on
    ties. All rules are read off each event in one pass: events are shuffled once, by vessel.
    """
    t = t or ReasoningThresholds()
    found = F.array(*[F.when(x.isNotNull(), F.struct(F.lit(i).alias("rule_order"), x.alias("of"))) for i, x in enumerate(rule(t) for rule in rules or DEFAULT_RULES)])
    rows = prepare(events).select("mmsi", "seq", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("mmsi", "seq", "x.rule_order", "x.of.*")
    support = F.col("supporting_events")
    rows = rows.select(
        "situation", "confidence", "mmsi", F.get(support, F.lit(0))["event_timestamp"].alias("start_timestamp"), F.get(support, F.size(support) - 1)["event_timestamp"].alias("end_timestamp"),
        F.array_min(F.transform(support, lambda e: e["start_timestamp"])).alias("extent_start"), F.array_max(F.transform(support, lambda e: e["end_timestamp"])).alias("extent_end"),
        "supporting_events", "explanation", "rule_order", "seq",
    )
    best = Window.partitionBy("situation", "mmsi", "start_timestamp", "end_timestamp").orderBy(F.desc("confidence"), "rule_order", "seq")
    return rows.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "rule_order", "seq")


def ordered(situations: DataFrame) -> DataFrame:
    """By start, vessel and name."""
    return situations.orderBy(F.coalesce(X.iso("start_timestamp"), F.lit("")), F.coalesce("mmsi", F.lit(0)), "situation")
