"""DuckDB SQL of the registered queries, composed of the same named parts."""

from __future__ import annotations

from wakeflow.plans.shapes import sides

R = 6371.0088
POINTS = """points as (
 select user_id as mmsi, ts as t, 54 + (k % 10) * cast(0.2 as double) as lat, 8 + floor(k / 10) * cast(0.4 as double) as lon, value / 10 as v, k * cast(3.6 as double) as h
 from (select *, cast(regexp_extract(props, '[0-9]+', 0) as bigint) as k from events) e)"""
INSIDE = "(lat > 54.5 and lat < 55.5 and lon > 9.0 and lon < 11.1)"
BOUNDARY = f"""boundary as (
 select case when i then 'EEZ entry' else 'EEZ exit' end as event_type, t as event_timestamp, mmsi
 from (select *, lag(i) over (partition by mmsi order by t) as p from (select *, {INSIDE} as i from points) a) b where p is not null and p <> i)"""


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"2 * {R} * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))"


def runs(name: str, knots: float) -> str:
    return f"""{name} as (
 select mmsi, r, t, lat, lon, v from (select *, sum(n) over (partition by mmsi order by t rows unbounded preceding) as r from (
  select *, case when s <> lag(s, 1, false) over w or coalesce(epoch_us(t) - epoch_us(lag(t) over w) > 1440::bigint * 60000000, false) then 1 else 0 end as n
  from (select *, coalesce(v < {knots}, false) as s from points) a window w as (partition by mmsi order by t)) b) c where s)"""


NULLS = {"mean_speed_knots": "null::double", "number_of_points": "0::bigint", "observed_radius_km": "null::double", "heading_circular_variance": "null::double", "point_coverage_ratio": "null::double", "crossing_count": "0::bigint"}


def event(kind: str, at: str, s: str, e: str, **values: str) -> str:
    rest = ", ".join(f"{values.get(k, x)} as {k}" for k, x in NULLS.items())
    return f"'{kind}' as event_type, {at} as event_timestamp, mmsi, {s} as start_timestamp, {e} as end_timestamp, round((epoch_us({e}) - epoch_us({s})) / 6e7 + 3.7e-10, 6) as duration_minutes, {rest}"


ANCHORS = runs("slow_a", 2.0) + f""", anchors as (
 select {event('ANCHOR', 's', 's', 'e', mean_speed_knots='round(v + 3.7e-10, 6)', number_of_points='n')}
 from (select mmsi, r, min(t) as s, max(t) as e, avg(v) as v, count(*) as n from slow_a group by 1, 2) x where epoch_us(e) - epoch_us(s) > 60 * 60000000::bigint)"""
LOITERS = runs("slow_l", 4.0) + f""", loiters as (
 select {event('LOITER', 's', 's', 'e', mean_speed_knots='round(v + 3.7e-10, 6)', number_of_points='n', observed_radius_km='round(km + 3.7e-10, 6)')}
 from (select mmsi, r, min(t) as s, max(t) as e, avg(v) as v, count(*) as n, max({hav('clat', 'clon', 'lat', 'lon')}) as km
       from (select *, avg(lat) over (partition by mmsi, r) as clat, avg(lon) over (partition by mmsi, r) as clon from slow_l) y group by 1, 2) x
 where epoch_us(e) - epoch_us(s) > 120 * 60000000::bigint and km <= 100
   and not exists (select 1 from anchors a where a.mmsi = x.mmsi and a.start_timestamp <= x.e and x.s <= a.end_timestamp))"""
MANEUVERS = f"""maneuvers as (
 select {event('MANEUVERING', 's', 's', 'e', number_of_points='n', heading_circular_variance='round(cv + 3.7e-10, 6)', point_coverage_ratio='round(cov + 3.7e-10, 6)')}
 from (select mmsi, min(t) as s, max(t) as e, count(*) as n, 1 - sqrt(pow(avg(sin(radians(h % 360))), 2) + pow(avg(cos(radians(h % 360))), 2)) as cv,
              least(1.0, (epoch_us(max(t)) - epoch_us(min(t))) / 6e7 / 10080, count(*) / 10.0) as cov
       from (select *, (epoch_us(t) - epoch_us(min(t) over (partition by mmsi))) // (10080::bigint * 60000000) as w from points where h is not null) a group by mmsi, w) x
 where n >= 10 and cov >= 0.5 and cv >= 0.5)"""
REPEATED = f"""repeated as (
 select {event('REPEATED_CROSSING', 'e', 's', 'e', crossing_count='n')}
 from (select mmsi, e, arg_min(n, rn) as n, min(s) as s from (
   select mmsi, e, rn, rn - min(rn) over w + 1 as n, min(e) over w as s from (
     select mmsi, event_timestamp as e, epoch_us(event_timestamp) as us, row_number() over (partition by mmsi order by event_timestamp, event_type) as rn from boundary) b
   window w as (partition by mmsi order by us range between 86400000000 preceding and current row)) c where n > 3 group by 1, 2) x)"""
CROSSINGS = "crossings as (select case when event_type = 'EEZ entry' then 'ENTRY' else 'EXIT' end as event_type, " + event("X", "event_timestamp", "event_timestamp", "event_timestamp").split(",", 1)[1] + " from boundary)"
SEQUENCE = ",\n".join([POINTS, BOUNDARY, ANCHORS, LOITERS, MANEUVERS, REPEATED, CROSSINGS]) + """,
 sequence as (select * from crossings union all select * from anchors union all select * from loiters union all select * from maneuvers union all select * from repeated)"""


def segments(windows: str, least: int, track: str) -> str:
    return f"""segpoints as (
 select *, printf('%d_%s_%dmin_%06d_%s', mmsi, strftime(o, '%Y%m%d'), w, i, strftime(s, '%Y%m%dT%H%M%SZ')) as segment_id, (epoch_us(e) - epoch_us(s)) / 1e6 as secs
 from (select *, count(*) over g as n, min(t) over g as s, max(t) over g as e from (
   select *, (epoch_us(t) - epoch_us(o)) // (w * 60000000::bigint) as i from (
     select p.*, w, strftime(t, '%Y-%m-%d') as d, min(t) over (partition by {track}) as o from points p, (select unnest([{windows}]) as w) x) a) b
   window g as (partition by {track}, w, i)) c where n >= {least}),
 segs as (select segment_id, any_value(mmsi) as mmsi, any_value(w) as w, any_value(s) as s, any_value(e) as e, any_value(secs) as secs, any_value(n) as n, avg(v) as avg_v from segpoints group by 1)"""


SEGS = segments("10080, 20160", 10, "mmsi, w")
MOTION = f"""steps as (
 select *, coalesce({hav('plat', 'plon', 'lat', 'lon')}, 0) as step, least(abs(h - ph), 360 - abs(h - ph)) as turn
 from (select *, lag(lat) over q as plat, lag(lon) over q as plon, lag(h) over q as ph from segpoints window q as (partition by segment_id order by t)) a),
 base as (select segment_id, any_value(mmsi) as mmsi, any_value(w) as w, any_value(s) as s, any_value(e) as e, any_value(secs) as secs, count(*) as n, avg(v) as avg_speed, max(v) as max_speed,
   greatest(avg(v * v) - avg(v) * avg(v), 0) as speed_variance, sum(step) as path, var_samp(h) as heading_variance, avg(turn) as mean_turn, coalesce(sum(turn), 0) / 360 as loops,
   sum((turn > 30)::int) as turns, avg(case when v < 1.0 then 1.0 else 0.0 end) as stationary, avg(lat) as clat, avg(lon) as clon,
   arg_min(lat, t) as a1, arg_min(lon, t) as o1, arg_max(lat, t) as a2, arg_max(lon, t) as o2 from steps group by 1),
 motion as (select *, {hav('a1', 'o1', 'a2', 'o2')} as disp from base)"""
CURVE = "case when disp = 0 then 0 else path / disp end"
COUNTS = "xcount as (select g.segment_id, count(b.mmsi) as crossing_count from segs g left join boundary b on b.mmsi = g.mmsi and b.event_timestamp between g.s and g.e group by 1)"
OVERLAP = """overlap as (select g.segment_id,
  coalesce(sum(case when q.event_type = 'ANCHOR' then greatest(0, least(epoch_us(g.e), epoch_us(q.end_timestamp)) - greatest(epoch_us(g.s), epoch_us(q.start_timestamp))) / 6e7 end), 0) as anchor_duration,
  coalesce(sum(case when q.event_type = 'LOITER' then greatest(0, least(epoch_us(g.e), epoch_us(q.end_timestamp)) - greatest(epoch_us(g.s), epoch_us(q.start_timestamp))) / 6e7 end), 0) as loiter_duration
  from segs g left join sequence q on q.mmsi = g.mmsi and q.event_type in ('ANCHOR', 'LOITER') and q.start_timestamp <= g.e and g.s <= q.end_timestamp group by 1)"""
_M = "6378137.0 * radians({0})"
_N = "6378137.0 * ln(tan(0.7853981633974483 + radians({0}) / 2))"
DISTANCE = f"""edge as (select {_M.format('x1')} as x1, {_N.format('y1')} as y1, {_M.format('x2')} as x2, {_N.format('y2')} as y2
   from (values (9.0::double, 54.5::double, 11.1::double, 54.5::double), (11.1, 54.5, 11.1, 55.5), (11.1, 55.5, 9.0, 55.5), (9.0, 55.5, 9.0, 54.5)) v(x1, y1, x2, y2)),
 dist as (select segment_id, min(sqrt(pow(px - (x1 + u * (x2 - x1)), 2) + pow(py - (y1 + u * (y2 - y1)), 2))) / 1000 as distance_to_boundary
   from (select *, greatest(0.0, least(1.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) as u
         from (select segment_id, {_M.format('clon')} as px, {_N.format('clat')} as py from motion) p, edge) z group by 1)"""
SIDES = "side as (select * from (values " + ", ".join(f"({i}, {j}, {', '.join(f'{v}::double' for v in xy)})" for i, j, *xy in sides()) + ") v(zone, part, x1, y1, x2, y2))"
IN_ZONES = f"""{SIDES},
 place as (select distinct lat, lon from points),
 part as (select lat, lon, zone, part, sum(case when (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) / (y2 - y1) * (lat - y1) + x1 then 1 else 0 end) % 2 = 1 as i,
   bool_or((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) = 0 and lon between least(x1, x2) and greatest(x1, x2) and lat between least(y1, y2) and greatest(y1, y2)) as on_side from place, side group by all),
 inside as (select lat, lon, bool_or(i and not on_side) as i from part group by all),
 crossed as (select mmsi, t, i, lag(i) over (partition by mmsi order by t) as p from points join inside using (lat, lon))"""
ZONE_DISTANCE = DISTANCE.replace(DISTANCE[DISTANCE.index("(values") : DISTANCE.index(" v(x1, y1, x2, y2)")], "side").replace(" v(x1, y1, x2, y2)", "")
FEATURES = ",\n".join([SEQUENCE, SEGS, MOTION, COUNTS, OVERLAP, DISTANCE]) + f""",
 feats as (select segment_id, m.mmsi, m.w, m.s, m.e, m.secs, m.n, avg_speed, max_speed, speed_variance, path, disp, {CURVE} as curve, heading_variance, mean_turn, loops,
   case when path = 0 then 0 else turns / path end as density, stationary, crossing_count, distance_to_boundary, anchor_duration, loiter_duration
   from motion m join xcount using (segment_id) join overlap using (segment_id) left join dist using (segment_id))"""
EFFORT = "effort as (select user_id as mmsi, date_trunc('day', ts)::timestamp as d, round(sum(value), 6) / 100 as hours from events group by 1, 2)"
LABELLED = FEATURES + f""", {EFFORT},
 labelled as (select segment_id, mmsi, s as segment_start, e as segment_end,
   case when exists (select 1 from effort x where x.hours >= 3.0 and x.mmsi = f.mmsi and x.d <= f.e and f.s <= x.d + interval 1 day) then 'Fishing'
        when anchor_duration >= 600 then 'Anchorage' when distance_to_boundary <= 400 and loiter_duration >= 600 then 'Prolonged Boundary Presence'
        when crossing_count >= 6 then 'Boundary Crossing'
        when avg_speed >= 5 and speed_variance <= 8 and curve <= 30 and crossing_count = 0 and anchor_duration = 0 and loiter_duration = 0 then 'Transit' else 'Unknown' end as situation_label from feats f)"""
SITUATIONS = SEQUENCE + """,
 sq as (select *, row_number() over (partition by mmsi order by event_timestamp, event_type, start_timestamp, end_timestamp) as q from sequence),
 nx as (select *, (select min(b.q) from sq b where b.mmsi = a.mmsi and b.q > a.q and b.event_type = 'EXIT') as xq, (select min(b.q) from sq b where b.mmsi = a.mmsi and b.q > a.q and b.event_type = 'ENTRY') as nq from sq a),
 en as (select n.*, x.event_timestamp as xt, x.end_timestamp as xe, x.start_timestamp as xs,
   (select count(*) from sq l where l.mmsi = n.mmsi and l.event_type = 'LOITER' and l.q > n.q and l.q < coalesce(least(xq, nq), 9e15)) as nl,
   (select max(l.event_timestamp) from sq l where l.mmsi = n.mmsi and l.event_type = 'LOITER' and l.q > n.q and l.q < coalesce(least(xq, nq), 9e15)) as lt,
   (select max(l.end_timestamp) from sq l where l.mmsi = n.mmsi and l.event_type = 'LOITER' and l.q > n.q and l.q < coalesce(least(xq, nq), 9e15)) as le,
   (select count(*) from sq l where l.mmsi = n.mmsi and l.event_type in ('ANCHOR', 'LOITER', 'REPEATED_CROSSING') and l.q > n.q and l.q < xq) as nd,
   xq is not null and (nq is null or xq < nq) as xf
   from nx n left join sq x on x.mmsi = n.mmsi and x.q = n.xq where n.event_type = 'ENTRY'),
 found as (
  select 'Anchorage' as situation, 0.90::double as confidence, mmsi, event_timestamp as a, event_timestamp as b, start_timestamp as xa, end_timestamp as xb, 1::bigint as n, q from sq where event_type = 'ANCHOR' and duration_minutes >= 600
  union all select 'Repeated Crossing', 0.90, mmsi, event_timestamp, event_timestamp, start_timestamp, end_timestamp, 1, q from sq where event_type = 'REPEATED_CROSSING'
  union all select 'Maneuvering', 0.65, mmsi, event_timestamp, event_timestamp, start_timestamp, end_timestamp, 1, q from sq where event_type = 'MANEUVERING'
  union all select 'Boundary Crossing', 0.75, mmsi, event_timestamp, coalesce(xt, event_timestamp), start_timestamp, coalesce(xe, end_timestamp), case when xq is null then 1 else 2 end, q from en
  union all select 'Transit', 0.70, mmsi, event_timestamp, xt, start_timestamp, xe, 2, q from en where xq is not null and nd = 0 and (epoch_us(xt) - epoch_us(event_timestamp)) / 3.6e9 <= 12
  union all select 'Prolonged Boundary Presence', 0.85, mmsi, event_timestamp, case when xf then xt else lt end, start_timestamp, greatest(le, case when xf then xe else end_timestamp end), 1 + nl + xf::int, q from en where nl >= 1),
 situ as (select * exclude (rk) from (select *, row_number() over (partition by situation, mmsi, a, b order by confidence desc, q) as rk from found) f where rk = 1)"""
PREDICTIONS = """pred as (select o_orderpriority as t, case when o_totalprice % 3 < 1 then o_orderpriority when o_totalprice % 3 < 2 then '2-HIGH' else '5-LOW' end as p from orders),
 cls as (select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) as class),
 per as (select class, (select count(*) from pred where t = class and p = class) as tp, (select count(*) from pred where t = class) as support, (select count(*) from pred where p = class) as said from cls),
 met as (select *, case when said = 0 then 0 else tp / said end as pr, case when support = 0 then 0 else tp / support end as re from per),
 fin as (select *, case when pr + re = 0 then 0 else 2 * pr * re / (pr + re) end as f1 from met)"""


AUDIT = LABELLED + ", " + SITUATIONS.removeprefix(SEQUENCE + ",").strip() + """,
 best as (select segment_id, situation from (select l.segment_id, s.situation, row_number() over (partition by l.segment_id order by s.confidence desc, s.a, s.situation) as rk
   from labelled l join situ s on s.mmsi = l.mmsi and s.situation in ('Boundary Crossing', 'Prolonged Boundary Presence', 'Repeated Crossing') and s.a - interval 15 minutes <= l.segment_end and l.segment_start <= s.b + interval 15 minutes) z where rk = 1),
 audit as (select segment_id, mmsi, situation_label, situation_label as ground_truth, case when situation_label = 'Anchorage' then 'Anchorage' else 'Transit' end as ground_truth_activity,
   case when situation_label in ('Boundary Crossing', 'Prolonged Boundary Presence') then situation_label else 'None' end as ground_truth_situation, p as rf_predicted_activity,
   coalesce(situation, p) as proposed_predictions, coalesce(situation, 'None') as proposed_context_prediction
   from (select *, case when substr(segment_id, length(segment_id) - 2, 1) < '5' then 'Transit' else 'Anchorage' end as p from labelled left join best using (segment_id)) y)"""


def iso(t: str) -> str:
    return f"strftime({t}, '%Y-%m-%dT%H:%M:%S') || case when epoch_us({t}) % 1000000 = 0 then '' else strftime({t}, '.%f') end || '+00:00'"


def with_(parts: str, select: str) -> str:
    return f"with {parts}\n{select}"


def rounded(columns: str, digits: int = 6) -> str:
    """'name=expression' pairs as rounded columns."""
    return ", ".join(f"round({e} + 3.7e-10, {digits}) as {n}" for n, e in (c.strip().split("=", 1) if "=" in c else (c.strip(), c.strip()) for c in columns.split(";")))


_F5 = lambda c: rounded(c, 5)

ORACLE_SQL = {
    "clean_points": with_(POINTS, "select mmsi as \"MMSI\", t as \"timestamp\", " + rounded("latitude=lat; longitude=lon; speed=v; heading=h") + ", strftime(t, '%Y-%m-%d') as trajectory_date from points"),
    "cleaning_stats": with_(POINTS, "select (select count(*) from points) + (select count(*) from points where lat > 55.5) + (select count(*) from points where lon > 11) as raw_rows, (select count(*) from points) as cleaned_rows, (select count(*) from points where lon > 11) as invalid_coordinate_rows, (select count(*) from points where lat > 55.5) as duplicate_timestamp_rows, (select count(distinct mmsi) from points) as vessel_count"),
    "segments": with_(f"{POINTS}, {SEGS}", "select segment_id, mmsi as \"MMSI\", w as window_minutes, s as segment_start, e as segment_end, round(secs, 6) as duration_seconds, n as number_of_points, round(avg_v + 3.7e-10, 6) as avg_speed from segs"),
    "segment_points": with_(f"{POINTS}, {segments('720', 2, 'mmsi, d')}", "select segment_id, mmsi as \"MMSI\", t as \"timestamp\", w as window_minutes, s as segment_start, e as segment_end, round(secs, 6) as duration_seconds, n as number_of_points, d as trajectory_date from segpoints"),
    "boundary_events": with_(f"{POINTS}, {BOUNDARY}", "select * from boundary"),
    "anchor_events": with_(f"{POINTS}, {ANCHORS}", "select * from anchors"),
    "loiter_events": with_(f"{POINTS}, {ANCHORS}, {LOITERS}", "select * from loiters"),
    "maneuver_events": with_(f"{POINTS}, {MANEUVERS}", "select * from maneuvers"),
    "repeated_crossings": with_(f"{POINTS}, {BOUNDARY}, {REPEATED}", "select * from repeated"),
    "event_sequence": with_(SEQUENCE, "select * from sequence"),
    "streamed_event_sequence": with_(SEQUENCE, "select * from sequence"),
    "segment_motion_features": with_(f"{POINTS}, {SEGS}, {MOTION}", "select segment_id, mmsi, n as number_of_points, " + _F5("avg_speed; max_speed; speed_variance; path_length=path; displacement=disp; heading_variance; mean_heading_change=mean_turn; loop_count=loops; turn_density=case when path = 0 then 0 else turns / path end; stationary_ratio=stationary") + " from motion"),
    "crossing_counts": with_(f"{POINTS}, {BOUNDARY}, {SEGS}, {COUNTS}", "select * from xcount"),
    "event_overlap_minutes": with_(f"{SEQUENCE}, {SEGS}, {OVERLAP}", "select segment_id, " + rounded("anchor_duration; loiter_duration") + " from overlap"),
    "distance_to_boundary": with_(f"{POINTS}, {SEGS}, {MOTION}, {DISTANCE}", "select segment_id, round(distance_to_boundary + 3.7e-10, 5) as distance_to_boundary from dist"),
    "segment_features": with_(FEATURES, "select segment_id, mmsi, w as window_minutes, s as segment_start, e as segment_end, n as number_of_points, crossing_count, round(secs, 6) as duration_seconds, " + _F5("avg_speed; max_speed; speed_variance; path_length=path; displacement=disp; trajectory_curvature=curve; path_tortuosity=curve; heading_variance; mean_heading_change=mean_turn; loop_count=loops; turn_density=density; stationary_ratio=stationary; distance_to_boundary; anchor_duration; loiter_duration") + " from feats"),
    "fishing_intervals": with_(EFFORT, "select mmsi, d as start_timestamp, d + interval 1 day as end_timestamp, true as is_fishing, round(hours, 9) as fishing_hours, round(least(0.95, 0.70 + greatest(0, least(6, hours)) / 6 * 0.25), 9) as label_confidence from effort where hours >= 0.5"),
    "situation_labels": with_(LABELLED, "select segment_id, mmsi, segment_start, segment_end, situation_label, case situation_label when 'Fishing' then 0.95 when 'Anchorage' then 0.9 when 'Prolonged Boundary Presence' then 0.85 when 'Boundary Crossing' then 0.8 when 'Transit' then 0.75 else 0.25 end::double as label_confidence, case situation_label when 'Fishing' then 'fishing_label' when 'Unknown' then 'default' else 'rule' end as label_source from labelled"),
    "label_counts": with_(LABELLED, "select situation_label, count(*) as n from labelled group by 1"),
    "reasoned_situations": with_(SITUATIONS, "select situation, confidence, mmsi, a as start_timestamp, b as end_timestamp, xa as extent_start, xb as extent_end, n as n_support from situ"),
    "event_distribution": with_(SEQUENCE, "select event_type, n, round(100.0 * n / sum(n) over (), 6) as percent from (select x.event_type, (select count(*) from sequence q where q.event_type = x.event_type) as n from (select unnest(['ENTRY', 'EXIT', 'ANCHOR', 'LOITER', 'MANEUVERING', 'REPEATED_CROSSING']) as event_type) x) y"),
    "event_reduction": with_(SEQUENCE, "select p as points, e as events, round(100 * (p - e) / p, 6) as reduction_percent, round(1000 * e / p, 6) as events_per_1000 from (select (select count(*) from points) as p, (select count(*) from sequence) as e) x"),
    "segment_compression": with_(f"{POINTS}, {SEGS}", "select count(*) as points, count(distinct segment_id) as segments, round(1 - 2 * count(distinct segment_id) / count(*), 6) as compression_ratio from segpoints"),
    "top_vessels": with_(POINTS, "select mmsi as \"MMSI\", n, (rk - 1)::int as rank, ((rk - 1) % 10)::int as palette_index from (select mmsi, count(*) as n, row_number() over (order by count(*) desc, mmsi) as rk from points group by 1) x where rk <= 10"),
    "track_bounds": with_(POINTS, "select " + rounded("min_latitude=min(lat); max_latitude=max(lat); mean_latitude=avg(lat); min_longitude=min(lon); max_longitude=max(lon); mean_longitude=avg(lon)") + " from points"),
    "track_downsample": with_(POINTS, "select mmsi as \"MMSI\", t as \"timestamp\", " + rounded("latitude=lat; longitude=lon; speed=v; heading=h") + " from (select *, row_number() over (partition by mmsi order by t) - 1 as i, greatest(1, count(*) over (partition by mmsi) // 20) as step from points) x where i % step = 0"),
    "nearest_point_asof": with_(POINTS, "select event_id, mmsi, event_timestamp, t as point_timestamp, " + rounded("latitude=lat; longitude=lon") + " from (select o_orderkey as event_id, p.mmsi, o_orderdate as event_timestamp, t, lat, lon, row_number() over (partition by o_orderkey order by abs(epoch_us(o_orderdate) // 1000000 - epoch_us(t) // 1000000), t) as rk from orders join points p on p.mmsi = o_custkey) x where rk = 1"),
    "segment_best_situation": with_(f"{SITUATIONS}, {SEGS}", "select g.segment_id, s.situation, s.confidence from segs g left join (select segment_id, situation, confidence, row_number() over (partition by segment_id order by confidence desc, a, situation) as rk from segs g2 join situ on situ.mmsi = g2.mmsi and situation in ('Anchorage', 'Repeated Crossing', 'Prolonged Boundary Presence') and a - interval 15 minutes <= g2.e and g2.s <= b + interval 15 minutes) s on s.segment_id = g.segment_id and s.rk = 1"),
    "class_metrics": with_(PREDICTIONS, "select class, support, " + rounded("precision=pr; recall=re; f1") + " from fin"),
    "confusion_metrics": with_(PREDICTIONS + ", tot as (select count(*)::double as n, sum((t = p)::int)::double as r from pred), s as (select sum(support::double * said) as st, sum(support::double * support) as tt, sum(said::double * said) as ss, avg(pr) as mp, avg(re) as mr, avg(f1) as mf, sum(pr * support) / sum(support) as wp, sum(re * support) / sum(support) as wr, sum(f1 * support) / sum(support) as wf, avg(case when support > 0 then re end) as ba from fin)", "select " + rounded("accuracy=r / n; balanced_accuracy=ba; macro_precision=mp; macro_recall=mr; macro_f1=mf; weighted_precision=wp; weighted_recall=wr; weighted_f1=wf; cohen_kappa=(n * r - st) / (n * n - st); mcc=(n * r - st) / sqrt((n * n - tt) * (n * n - ss))") + " from tot, s"),
    "confusion_matrix": with_(PREDICTIONS, "select t as truth, count(*) filter (p = '1-URGENT') as n1, count(*) filter (p = '2-HIGH') as n2, count(*) filter (p = '3-MEDIUM') as n3, count(*) filter (p = '4-NOT SPECIFIED') as n4, count(*) filter (p = '5-LOW') as n5 from pred group by 1"),
    "chord_deviation": with_(f"{POINTS}, {SEGS}, ab as (select *, arg_min(lat, t) over q as la, arg_min(lon, t) over q as oa, arg_max(lat, t) over q as lb, arg_max(lon, t) over q as ob from segpoints window q as (partition by segment_id)), xy as (select *, (ob - oa) * cos(radians(lat)) * 111.32 as dx, (lb - la) * 110.57 as dy, (lon - oa) * cos(radians(lat)) * 111.32 as px, (lat - la) * 110.57 as py from ab), tu as (select *, case when dx * dx + dy * dy > 0 then greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) else 0 end as tt, coalesce((epoch_us(t) - epoch_us(s)) / nullif(epoch_us(e) - epoch_us(s), 0), 0) as uu from xy)", "select segment_id, " + _F5("mean_spatial_km=avg(sqrt(pow(px - tt * dx, 2) + pow(py - tt * dy, 2))); max_spatial_km=max(sqrt(pow(px - tt * dx, 2) + pow(py - tt * dy, 2))); mean_temporal_km=avg(sqrt(pow(px - uu * dx, 2) + pow(py - uu * dy, 2))); max_temporal_km=max(sqrt(pow(px - uu * dx, 2) + pow(py - uu * dy, 2)))") + " from tu group by 1"),
    "vessel_paths": with_(POINTS, "select mmsi as \"MMSI\", row_number() over (partition by mmsi order by t, lon, lat) - 1 as i, " + rounded("latitude=lat; longitude=lon") + " from points"),
    "top_vessel_tracks": with_(POINTS, "select mmsi as \"MMSI\", t as \"timestamp\", " + rounded("latitude=lat; longitude=lon") + ", rank from (select *, row_number() over (partition by mmsi order by t) - 1 as i, greatest(1, count(*) over (partition by mmsi) // 20) as step from points join (select mmsi, (row_number() over (order by count(*) desc, mmsi) - 1)::int as rank from points group by 1 qualify rank < 5) top using (mmsi)) x where i % step = 0"),
    "segment_endpoints": with_(f"{POINTS}, {SEGS}", "select mmsi as \"MMSI\", segment_id, s as first_timestamp, e as last_timestamp, " + rounded("first_latitude=la; first_longitude=oa; last_latitude=lb; last_longitude=ob") + ", (row_number() over (partition by mmsi order by s, segment_id))::int as number from (select segment_id, any_value(mmsi) as mmsi, min(t) as s, max(t) as e, arg_min(lat, t) as la, arg_min(lon, t) as oa, arg_max(lat, t) as lb, arg_max(lon, t) as ob from segpoints group by 1) x"),
    "irregular_zone_crossings": with_(f"{POINTS}, {IN_ZONES}", "select case when i then 'EEZ entry' else 'EEZ exit' end as event_type, t as event_timestamp, mmsi from crossed where p is not null and p <> i"),
    "irregular_zone_distance": with_(f"{POINTS}, {SEGS}, {MOTION}, {SIDES}, {ZONE_DISTANCE}", "select segment_id, round(distance_to_boundary + 3.7e-10, 5) as distance_to_boundary from dist"),
    "inside_zone": with_(POINTS, f"select {INSIDE} as inside_eez, not {INSIDE} as outside_eez, count(*) as n from points group by 1, 2"),
    "stratified_split": "with k as (select o_orderkey as id, o_orderpriority as label, o_custkey as mmsi, (row_number() over (partition by o_orderpriority order by md5('42:' || o_orderkey), o_orderkey) - 0.5) / count(*) over (partition by o_orderpriority) as q from orders) select id, label, mmsi, case when q <= 0.7 then 'train' when q <= 0.7::double + 0.15::double then 'validation' else 'test' end as split from k",
    "vessel_split": "with v as (select distinct o_custkey as mmsi from orders), r as (select mmsi, row_number() over (order by md5('42:' || mmsi), mmsi) as n, greatest(1, floor(count(*) over () * 0.15::double)::bigint) as t from v) select mmsi, case when n <= t then 'test' else 'train' end as split from r",
    "group_sample": "select id, label, mmsi from (select o_orderkey as id, o_orderpriority as label, o_custkey as mmsi, row_number() over (partition by o_orderpriority order by md5('42:' || o_orderkey), o_orderkey) as n from orders) x where n <= 500 or label not in ('1-URGENT', '2-HIGH', '3-MEDIUM')",
    "label_remaps": with_(SITUATIONS, "select situation, case situation when 'Repeated Crossing' then 'Boundary Crossing' when 'Maneuvering' then 'Transit' else situation end as class, case situation when 'Anchorage' then 'Anchorage' when 'Maneuvering' then null else 'Transit' end as activity, case when situation in ('Boundary Crossing', 'Prolonged Boundary Presence') then situation else 'None' end as target, count(*) as n from situ group by 1"),
    "speed_without_speeds": with_(f"{POINTS}, {SEGS}, {MOTION}", "select segment_id, " + _F5("avg_speed=case when secs = 0 then 0 else path / 1.852 / (secs / 3600) end; max_speed=case when secs = 0 then 0 else path / 1.852 / (secs / 3600) end; speed_variance=0.0::double") + " from motion"),
    "feature_profile": with_(f"{POINTS}, {SEGS}, {MOTION}, long as (select 'avg_speed' as c, avg_speed as x from motion union all select 'path_length', path from motion union all select 'number_of_points', n from motion)", "select c as \"column\", count(x) as \"count\", " + rounded("mean=avg(x); std=stddev_samp(x); min=min(x); p25=quantile_cont(x, 0.25); p50=quantile_cont(x, 0.5); p75=quantile_cont(x, 0.75); max=max(x)", 4) + " from long group by 1"),
    "rule_hits": with_(FEATURES, "select 'avg_speed >= 5' as rule, count(*) filter (avg_speed >= 5) as hits from feats union all select 'anchor_duration >= 600', count(*) filter (anchor_duration >= 600) from feats union all select 'loiter_duration >= 600', count(*) filter (loiter_duration >= 600) from feats union all select 'crossing_count >= 6', count(*) filter (crossing_count >= 6) from feats union all select 'distance_to_boundary <= 400', count(*) filter (distance_to_boundary <= 400) from feats"),
    "rule_details": with_(LABELLED, "select segment_id, " + rounded("avg_speed=case when situation_label = 'Transit' then avg_speed end; speed_variance=case when situation_label = 'Transit' then speed_variance end; trajectory_curvature=case when situation_label = 'Transit' then curve end; crossing_count=case when situation_label = 'Boundary Crossing' then crossing_count::double end; distance_to_boundary=case when situation_label = 'Prolonged Boundary Presence' then distance_to_boundary end; anchor_duration=case when situation_label = 'Anchorage' then anchor_duration end; loiter_duration=case when situation_label = 'Prolonged Boundary Presence' then loiter_duration end", 4) + " from labelled join feats using (segment_id)"),
    "predictions_audit": with_(AUDIT, "select * from audit"),
    "context_metrics": with_(AUDIT, "select count(*) as total_test_segments, count(*) filter (proposed_context_prediction <> 'None') as enriched_segments, " + rounded("context_coverage_ratio=count(*) filter (proposed_context_prediction <> 'None') / count(*)") + ", count(*) filter (proposed_context_prediction = 'Boundary Crossing') as boundary_crossing_situations_detected, count(*) filter (proposed_context_prediction = 'Prolonged Boundary Presence') as prolonged_presence_situations_detected, count(*) filter (proposed_context_prediction = 'Repeated Crossing') as repeated_crossing_situations_detected from audit"),
    "comparison_table": with_(SEQUENCE, "select 'prior work' as system, 338000000::bigint as points, 53000000::bigint as events, 84.0::double as reduction_percent union all select 'this system', p, e, round(100 * (p - e) / p, 2) from (select (select count(*) from points) as p, (select count(*) from sequence) as e) x"),
    "event_json": with_(SEQUENCE, f"select event_type, {iso('event_timestamp')} as event_timestamp, mmsi, {iso('start_timestamp')} as start_timestamp, {iso('end_timestamp')} as end_timestamp, duration_minutes, crossing_count from sequence"),
    "points_written": with_(POINTS, "select mmsi as \"MMSI\", t as \"timestamp\", " + rounded("latitude=lat; longitude=lon") + " from points where mmsi between 1 and 39"),
    "boundary_written": with_(f"{POINTS}, {BOUNDARY}", "select * from boundary"),
    "human_numbers": with_(POINTS, "select mmsi as \"MMSI\", case when n >= 1e6 then printf('%.1fM', n / 1e6) when n >= 1e3 then printf('%.1fK', n / 1e3) else printf('%.0f', n) end as text from (select mmsi, (count(*) * 100)::double as n, row_number() over (order by count(*) desc, mmsi) as rk from points group by 1) x where rk <= 20"),
    "carried_state": with_(f"{POINTS}, {BOUNDARY}", "select * from boundary"),
}
