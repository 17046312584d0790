"""The engine's queries over the driver tables, with SQL for each that has an equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .config import Breaks, ExampleConfig, Grid, LayoutConfig, Pieces, StopConfig
from .fixture import EPOCH_US, POS_SQL, TRK_SQL, positions, tracks
from .functions import dates, geo, text
from .operators import activity, epochs, events, gaps, layout, metrics, paths, ports, proximity, rasters, relational, selection, stops, voyages
from .plans import materialize, scratch_root
from .sources import dataset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EXTENT, BINS = (125.0, 142.0, 30.0, 45.0), (60, 60)
STOPS = StopConfig(speed_max=30, min_sec=600, gap_sec=3600, clip_sec=600, extent=EXTENT, bins=BINS)
PORTS = Grid(EXTENT, BINS)
FRAGS = Pieces(cut=(1500, 200_000.0), fixes=4)
VOYAGES = Breaks(silence=((2400, -1.0), (1200, 150_000.0)), turn=(600, 50_000.0), rest=(60_000.0, 900))
EXAMPLE = ExampleConfig(size=32, cell_m=10_000.0, ends=1, gap_fixes=(1, 3))
A, B = (33.5, 128.5), (33.5, 128.5)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _distance(a: str, b: str, c: str, d: str) -> str:
    h = f"pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2)"
    return f"(12742000.0*asin(case when {h}>1 then 1.0 else sqrt({h}) end))"


def _flat(lat: str, lon: str, lat0: float, lon0: float) -> str:
    return f"sqrt(pow(({lon}-{lon0})*111320.0*cos(radians({lat0})),2)+pow(({lat}-{lat0})*111320.0,2))"


def _rounded(df: DataFrame, places: int = 3, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


POS, TRK = f"with recursive {POS_SQL}", f"with recursive {POS_SQL}, {TRK_SQL}"
_STEPS = f"""st as (select *, "timestamp"-lag("timestamp") over w dt_, {_distance("lag(lat) over w", "lag(lon) over w", "lat", "lon")} dist_ from pos where track_id>=0 window w as (partition by track_id order by "timestamp", seq))"""


@query(f"""{POS}, a as (select *, "timestamp"-lag("timestamp") over (partition by ship_id order by seq) d from pos),
b as (select *, case when d is null or d>3600 then 0 else least(d,600) end dts, coalesce(d>3600,false) gap, speed<=30 stp from a where d is null or d>0),
g as (select *, sum(case when not stp or gap then 1 else 0 end) over (partition by ship_id order by seq rows between unbounded preceding and current row) isl from b),
e as (select ship_id, isl, sum(dts) dur, avg(lat) la, avg(lon) lo from g where stp group by ship_id, isl having sum(dts)>=600),
h as (select cast(floor((lo-125)/17*60) as int) x, cast(floor((la-30)/15*60) as int) y, dur from e)
select x, y, cast(sum(dur) as bigint) stop_sec from h where x between 0 and 59 and y between 0 and 59 group by x, y""")
def stop_heatmap(spark, sf_dir):
    return stops.stop_heatmap(positions(spark, sf_dir), STOPS)


_STATS = "s as (select ship_id, count(*) total_points, count(*) filter (where greatest(0,least(speed,800))>=10) moving_points, cast(max(greatest(0,least(speed,800))) as bigint) max_speed from pos group by ship_id)"


@query(f"{POS}, {_STATS} select * from s")
def ship_stats(spark, sf_dir):
    return activity.ship_stats(positions(spark, sf_dir))


@query(f"{POS}, {_STATS} select * from s where total_points>=50 and moving_points>=5 and max_speed>=20")
def activity_filter(spark, sf_dir):
    return activity.active_ships(positions(spark, sf_dir))


@query(f"{POS}, {_STATS} select seq, ship_id, speed from pos where ship_id in (select ship_id from s where total_points>=50 and moving_points>=5 and max_speed>=20)")
def kept_positions(spark, sf_dir):
    rows = positions(spark, sf_dir)
    return activity.keep_ships(rows, activity.active_ships(rows)).select("seq", "ship_id", "speed")


@query(f"""{POS}, {_STEPS} select track_id, count(*) points_seen, cast(coalesce(max(case when dt_ is not null then greatest(0,dt_) end),0) as bigint) max_gap_sec, round(cast(cast(coalesce(max(dist_),0.0) as float) as double)) max_gap_dist_m from st group by track_id""")
def gap_metrics(spark, sf_dir):
    found = gaps.gap_metrics(positions(spark, sf_dir).where("track_id >= 0"))
    return found.select("track_id", "points_seen", "max_gap_sec", F.round("max_gap_dist_m").alias("max_gap_dist_m"))


@query(f"""{POS}, n as (select track_id, seq, "timestamp", lat, lon, lead("timestamp") over w nt, lead(lat) over w nlat, lead(lon) over w nlon from pos where track_id>=0 window w as (partition by track_id order by "timestamp", seq))
select track_id, seq, cast(nt-"timestamp" as bigint) gap_sec, round({_distance("lat", "lon", "nlat", "nlon")},3) gap_m from n where nt-"timestamp">=900 or {_distance("lat", "lon", "nlat", "nlon")}>=90000""")
def gap_list(spark, sf_dir):
    found = gaps.gap_list(positions(spark, sf_dir).where("track_id >= 0"), 900, 90_000)
    return _rounded(found.select("track_id", "seq", "gap_sec", "gap_m"), 3, "gap_m")


@query(f"{POS}, {_STEPS} select track_id, count(*) filter (where dt_>900 or dist_>90000) gaps, cast(max(dt_) as bigint) longest_sec, count(*) filter (where dt_>900 or dist_>90000)=0 good from st group by track_id")
def gap_quality(spark, sf_dir):
    return gaps.gap_quality(positions(spark, sf_dir).where("track_id >= 0"), 900, 90_000).select("track_id", "gaps", "longest_sec", "good")


_GAPS = f"{_STEPS}, gp as (select dt_ gap_sec from st where dt_ is not null)"


@query(f"""{POS}, {_GAPS}, hh as (select cast(least(floor(least(greatest(gap_sec,0),3000)/60.0),49) as int) bin, count(*) n_rows from gp group by 1)
select bin, n_rows, bin=(select bin from hh order by n_rows desc, bin limit 1) peak from hh""")
def gap_histogram(spark, sf_dir):
    found = gaps.steps(positions(spark, sf_dir).where("track_id >= 0")).where("dt is not null")
    return events.histogram(found.select(F.col("dt").alias("gap_sec")), "gap_sec", 0, 3000, 50)


@query(f"{POS}, {_GAPS} select count(gap_sec) n_rows, round(avg(gap_sec),6) mean, min(gap_sec) low, max(gap_sec) high, quantile_cont(gap_sec,0.5) p50, quantile_cont(gap_sec,0.9) p90, quantile_cont(gap_sec,0.95) p95, quantile_cont(gap_sec,0.99) p99 from gp")
def gap_distribution(spark, sf_dir):
    found = gaps.steps(positions(spark, sf_dir).where("track_id >= 0")).where("dt is not null")
    return _rounded(events.distribution(found.select(F.col("dt").alias("gap_sec")), "gap_sec"), 6, "mean")


_SEG = """sg as (select *, sum(case when dt_>1500 or dist_>200000 then 1 else 0 end) over (partition by track_id order by "timestamp", seq rows between unbounded preceding and current row) segment, row_number() over (partition by track_id order by "timestamp", seq)-1 place from st)"""


@query(f"{POS}, {_STEPS}, {_SEG} select track_id, seq, cast(segment as bigint) segment, cast(place as int) place from sg")
def track_segments(spark, sf_dir):
    found = gaps.segments(positions(spark, sf_dir).where("track_id >= 0"), *FRAGS.cut)
    return found.select("track_id", "seq", "segment", "place")


_FRAG = f"""{_SEG}, fa as (select *, {_distance("first(lat) over w2", "first(lon) over w2", "lat", "lon")} away from sg window w2 as (partition by track_id, segment order by "timestamp", seq rows between unbounded preceding and current row)),
fr as (select track_id, cast(min(place) as int) s, cast(max(place)+1 as int) e, cast(count(*) as int) points, cast(min("timestamp") as bigint) t0, cast(max("timestamp") as bigint) t1, min(lat) min_lat, min(lon) min_lon, max(lat) max_lat, max(lon) max_lon from fa group by track_id, segment having count(*)>=4 and max(away)>=10000)"""


@query(f"{POS}, {_STEPS}, {_FRAG} select * from fr")
def track_fragments(spark, sf_dir):
    return gaps.fragments(positions(spark, sf_dir).where("track_id >= 0"), FRAGS)


@query(f'{POS}, {_STEPS}, {_FRAG} select sh "share", (select quantile_cont(points, 0.1) from fr) points, (select quantile_cont(t1-t0, 0.1) from fr) "seconds" from (values (0.1::double)) v(sh) union all select 0.5, (select quantile_cont(points, 0.5) from fr), (select quantile_cont(t1-t0, 0.5) from fr) union all select 0.9, (select quantile_cont(points, 0.9) from fr), (select quantile_cont(t1-t0, 0.9) from fr)')
def fragment_stats(spark, sf_dir):
    return gaps.fragment_stats(track_fragments(spark, sf_dir), (0.1, 0.5, 0.9))


@query(f"{POS}, {_STEPS}, {_FRAG} select track_id, s, e, case when cast('0x'||md5(concat('42:', track_id))[1:8] as bigint)/4294967296.0 < 0.1 then 'val' else 'train' end split from fr")
def fragment_split(spark, sf_dir):
    return gaps.split_fragments(track_fragments(spark, sf_dir), 0.1).select("track_id", "s", "e", "split")


_EPOCH = "select {0} epoch, track_id, s, place, (place*4) // (select count(*) from fr) shard from ({1})"
_NUMBERED = "nr as (select track_id, s, row_number() over (order by track_id, s)-1 number from fr)"


@query(f"{POS}, {_STEPS}, {_FRAG}, {_NUMBERED} " + " union all ".join(_EPOCH.format(e, epochs.place_sql("nr", "select count(*) from fr", 42, e, "track_id, s")) for e in (0, 1)))
def epoch_places(spark, sf_dir):
    """Two epochs of all fragments, each in an order of its own and dealt to four workers."""
    rows = materialize(epochs.numbered(track_fragments(spark, sf_dir).select("track_id", "s"), ["track_id", "s"]), "numbered")
    n = rows.count()
    both = [epochs.epoch(rows, n, 42, e, 4).select(F.lit(e).alias("epoch"), "track_id", "s", "place", "shard") for e in (0, 1)]
    return both[0].unionByName(both[1])


@query(f"{POS}, {_STEPS}, {_FRAG} select sg.track_id, fr.s, fr.e, sg.seq, cast(sg.place as int) place from sg join fr on sg.track_id=fr.track_id and sg.place>=fr.s and sg.place<fr.e")
def fragment_points(spark, sf_dir):
    rows = positions(spark, sf_dir).where("track_id >= 0")
    return gaps.slice_of(rows, gaps.fragments(rows, FRAGS)).select("track_id", "s", "e", "seq", "place")


@query(f"""{POS}, iv as (select ship_id, "timestamp" a, "timestamp"+speed b from pos), c as (select *, case when a>max(b) over (partition by ship_id order by a, b rows between unbounded preceding and 1 preceding) then 1 else 0 end cut from iv),
p as (select *, sum(cut) over (partition by ship_id order by a, b rows between unbounded preceding and current row) part from c) select ship_id, cast(min(a) as bigint) a, cast(max(b) as bigint) b from p group by ship_id, part""")
def merged_intervals(spark, sf_dir):
    rows = positions(spark, sf_dir).select("ship_id", F.col("timestamp").alias("a"), (F.col("timestamp") + F.col("speed")).alias("b"))
    return gaps.merged_intervals(rows, ["ship_id"], "a", "b")


_CELLS = """dc as (select cast(least(floor((lat-30.0)*(60/15.0)),59) as int) iy, cast(least(floor((lon-125.0)*(60/17.0)),59) as int) ix, count(*) cnt from pos where lon>=125 and lon<142 and lat>=30 and lat<45 group by 1,2)"""


@query(f"{POS}, {_CELLS} select * from dc")
def density_cells(spark, sf_dir):
    return rasters.density(positions(spark, sf_dir), EXTENT, *BINS)


@query(f"""{POS}, lv as (select unnest(range(0, 6)) "level"), c as (select cast(floor("timestamp"/1440) as bigint) span_no, cast(least(floor((lat-30.0)*(256/15.0)),255) as int) iy, cast(least(floor((lon-125.0)*(256/17.0)),255) as int) ix from pos where lon>=125 and lon<142 and lat>=30 and lat<45)
select cast("level" as int) "level", span_no, iy >> cast("level" as int) iy, ix >> cast("level" as int) ix, count(*) cnt from c, lv group by 1, 2, 3, 4""")
def density_pyramid(spark, sf_dir):
    return rasters.pyramid(positions(spark, sf_dir), EXTENT, 256, 256, 6, "timestamp", 1440)


@query(f"{POS} select cast(least(floor((lat-30.0)*(150/15.0)),149) as int) iy, cast(least(floor((lon-125.0)*(170/17.0)),169) as int) ix, count(*) cnt from pos where lon>=125 and lon<142 and lat>=30 and lat<45 group by 1,2")
def density_fixed_step(spark, sf_dir):
    return rasters.step_density(positions(spark, sf_dir), EXTENT, 0.1)


@query(f"""{POS}, k as (select 5000.0/111320.0 dlat, 5000.0/greatest(1e-6,111320.0*cos(radians(37.5))) dlon)
select greatest(0,least(cast(floor((lat-30.0)/dlat) as int), cast(ceil(15.0/dlat) as int)-1)) iy, greatest(0,least(cast(floor((lon-125.0)/dlon) as int), cast(ceil(17.0/dlon) as int)-1)) ix, count(*) cnt from pos, k where lon between 125 and 142 and lat between 30 and 45 group by 1,2""")
def density_metric_cells(spark, sf_dir):
    return rasters.metric_density(positions(spark, sf_dir), EXTENT, 5000.0)


_HEAT = """ends as (select start_lat lat, start_lon lon, 1 s, 0 e from trk union all select end_lat, end_lon, 0, 1 from trk),
ht as (select greatest(0,least(59,cast(floor((lat-30.0)*(60/15.0)) as int))) iy, greatest(0,least(59,cast(floor((lon-125.0)*(60/17.0)) as int))) ix, cast(sum(s) as bigint) cnt_start, cast(sum(e) as bigint) cnt_end, count(*) cnt from ends where lon between 125 and 142 and lat between 30 and 45 group by 1,2)"""


@query(f"{TRK}, {_HEAT} select * from ht")
def start_end_heatmap(spark, sf_dir):
    return rasters.start_end_heatmap(tracks(spark, sf_dir), EXTENT, BINS)


_DENSE = f"{_HEAT}, dn as (select *, (select quantile_cont(cnt,0.6) from ht) threshold from ht where cnt>=(select quantile_cont(cnt,0.6) from ht))"


@query(f"{TRK}, {_DENSE} select iy, ix, cnt, threshold from dn")
def dense_mask(spark, sf_dir):
    return rasters.dense_cells(rasters.start_end_heatmap(tracks(spark, sf_dir), EXTENT, BINS), "percentile", 60.0).select("iy", "ix", "cnt", "threshold")


_COMP = f"""{_DENSE}, rc(iy, ix, ry, rx) as (select iy, ix, iy, ix from dn union select d.iy, d.ix, r.ry, r.rx from rc r join dn d on abs(d.iy-r.iy)<=1 and abs(d.ix-r.ix)<=1),
cl as (select iy, ix, min(ry*100000+rx) root from rc group by iy, ix), cs as (select root, count(*) cells_count, row_number() over (order by root)-1 poi_id from cl group by root having count(*)>=2),
lb as (select cl.iy, cl.ix, cast(cs.poi_id as int) poi_id, cs.cells_count from cl join cs using (root))"""


def _labelled(spark, sf_dir):
    heat = materialize(rasters.start_end_heatmap(tracks(spark, sf_dir), EXTENT, BINS), "heat")
    return heat, rasters.components(rasters.dense_cells(heat, "percentile", 60.0), 2)


@query(f"{TRK}, {_COMP} select * from lb")
def poi_components(spark, sf_dir):
    return _labelled(spark, sf_dir)[1]


@query(ORACLE_SQL["poi_components"])
def poi_components_by_tiles(spark, sf_dir):
    """Tiles of 8 cells, so that nearly every component crosses some."""
    heat = materialize(rasters.start_end_heatmap(tracks(spark, sf_dir), EXTENT, BINS), "heat")
    return rasters.components(rasters.dense_cells(heat, "percentile", 60.0), 2, 8)


_SUMMARY = """pm as (select poi_id, round(sum((30.0+(iy+0.5)*0.25)*cnt)/sum(cnt),6) center_lat, round(sum((125.0+(ix+0.5)*(17.0/60))*cnt)/sum(cnt),6) center_lon, round(125.0+min(ix)*(17.0/60),6) min_lon, round(30.0+min(iy)*0.25,6) min_lat, round(125.0+(max(ix)+1)*(17.0/60),6) max_lon, round(30.0+(max(iy)+1)*0.25,6) max_lat,
 count(*) cells_count, cast(sum(cnt_start) as bigint) count_start, cast(sum(cnt_end) as bigint) count_end, cast(sum(cnt) as bigint) count_total from lb join ht using (iy, ix) group by poi_id)"""


@query(f"{TRK}, {_COMP}, {_SUMMARY} select * from pm")
def poi_summary(spark, sf_dir):
    heat, labelled = _labelled(spark, sf_dir)
    return _rounded(ports.summarise(labelled, heat, EXTENT, BINS), 6, "center_lat", "center_lon", "min_lon", "min_lat", "max_lon", "max_lat")


@query(f"{TRK}, {_COMP}, {_SUMMARY} select poi_id, count_total, cast(row_number() over (order by count_total desc, poi_id)-1 as int) rank_id from pm")
def poi_by_popularity(spark, sf_dir):
    return ports.by_popularity(poi_summary(spark, sf_dir)).select("poi_id", "count_total", "rank_id")


_ASSIGN = """cc as (select track_id, track_ord, greatest(0,least(59,cast(floor((start_lat-30.0)*4.0) as int))) sy, greatest(0,least(59,cast(floor((start_lon-125.0)*(60/17.0)) as int))) sx, greatest(0,least(59,cast(floor((end_lat-30.0)*4.0) as int))) ey, greatest(0,least(59,cast(floor((end_lon-125.0)*(60/17.0)) as int))) ex from trk where start_lon between 125 and 142 and start_lat between 30 and 45 and end_lon between 125 and 142 and end_lat between 30 and 45),
asg as (select track_id, track_ord, coalesce(a.poi_id,-1) start_poi, coalesce(b.poi_id,-1) end_poi from cc left join lb a on a.iy=sy and a.ix=sx left join lb b on b.iy=ey and b.ix=ex)"""


@query(f"{TRK}, {_COMP}, {_ASSIGN} select track_id, start_poi, end_poi from asg where start_poi>=0 and end_poi>=0 and start_poi<>end_poi")
def track_pois(spark, sf_dir):
    return ports.assign(tracks(spark, sf_dir), _labelled(spark, sf_dir)[1], PORTS).select("track_id", "start_poi", "end_poi")


@query(f"{TRK}, {_COMP}, {_ASSIGN} select concat(start_poi,'->',end_poi) pair, start_poi, end_poi, count(*) tracks_count, string_agg(cast(track_id as varchar), ',' order by track_ord, track_id) track_ids from asg where start_poi>=0 and end_poi>=0 and start_poi<>end_poi group by start_poi, end_poi")
def od_pairs(spark, sf_dir):
    found = ports.pairs(ports.assign(tracks(spark, sf_dir), _labelled(spark, sf_dir)[1], PORTS))
    return found.withColumn("track_ids", F.array_join(F.col("track_ids").cast("array<string>"), ","))


@query(f"{TRK}, {_COMP}, {_ASSIGN} select start_poi, end_poi, count(*) tracks_count from asg where start_poi>=0 and end_poi>=0 and start_poi<>end_poi group by start_poi, end_poi order by tracks_count desc, start_poi, end_poi limit 10")
def top_pairs(spark, sf_dir):
    found = ports.pair_counts(ports.assign(tracks(spark, sf_dir), _labelled(spark, sf_dir)[1], PORTS))
    return found.select("start_poi", "end_poi", "tracks_count").orderBy(F.desc("tracks_count"), "start_poi", "end_poi").limit(10)


@query(f"""{POS} select track_id, arg_max(destination, "timestamp"*1000000000-seq) destination from pos where track_id>=0 group by track_id""")
def last_destination(spark, sf_dir):
    return ports.last_destination(positions(spark, sf_dir).where("track_id >= 0"))


@query(f"""{TRK}, {_COMP}, {_ASSIGN}, ld as (select track_id, arg_max(destination, "timestamp"*1000000000-seq) destination from pos where track_id>=0 group by track_id),
ct as (select end_poi, upper(destination) "name", count(*) "count", min(track_ord) fo from asg join ld using (track_id) where start_poi>=0 and end_poi>=0 and start_poi<>end_poi group by 1,2),
rk as (select *, row_number() over (partition by end_poi order by "count" desc, fo, "name") place from ct) select end_poi, "name", "count", cast(place as int) place from rk where place<=3""")
def destination_topn(spark, sf_dir):
    assigned = materialize(ports.assign(tracks(spark, sf_dir), _labelled(spark, sf_dir)[1], PORTS), "assigned")
    fixes = positions(spark, sf_dir).join(assigned.select("track_id"), "track_id", "left_semi")
    counts = ports.destinations(assigned, ports.last_destination(fixes))
    return ports.top_destinations(counts, 3).select("end_poi", "name", "count", "place")


@query(f"{TRK} select track_id, points_count from trk where {_flat('start_lat', 'start_lon', *A)}<=150000 and {_flat('end_lat', 'end_lon', 33.4, 128.6)}<=150000")
def tracks_a_to_b(spark, sf_dir):
    return selection.from_to(tracks(spark, sf_dir), A, (33.4, 128.6), 150_000).select("track_id", "points_count")


@query(f"{TRK}, w as (select track_id, start_timestamp t0, end_timestamp t1, {_flat('start_lat', 'start_lon', *A)}<=120000 and {_flat('end_lat', 'end_lon', 33.3, 128.9)}<=120000 ab, {_flat('start_lat', 'start_lon', 33.3, 128.9)}<=120000 and {_flat('end_lat', 'end_lon', *A)}<=120000 ba from trk), d as (select track_id, 'AB' direction, t0, t1 from w where ab union all select track_id, 'BA', t0, t1 from w where ba) select track_id, direction, cast(min(t0) over () as bigint) min_ts, cast(max(t1) over () as bigint) max_ts from d")
def ab_ba_tracks(spark, sf_dir):
    return selection.both_ways(tracks(spark, sf_dir), A, (33.3, 128.9), 120_000).select("track_id", "direction", "min_ts", "max_ts")


@query(f"{TRK} select track_id, points_count, round({_distance('start_lat', 'start_lon', '33.5', '128.5')},3) start_m, round({_distance('end_lat', 'end_lon', '33.5', '128.5')},3) end_m from trk where {_distance('start_lat', 'start_lon', '33.5', '128.5')}<=200000 and {_distance('end_lat', 'end_lon', '33.5', '128.5')}<=200000")
def radius_tracks(spark, sf_dir):
    return _rounded(selection.within_radius(tracks(spark, sf_dir), A, A, 200_000).select("track_id", "points_count", "start_m", "end_m"), 3, "start_m", "end_m")


@query(f"{TRK}, pt as (select * from (values ('P0', 31.0, 127.0), ('P1', 36.0, 133.0), ('P2', 44.0, 141.0)) v(port, plat, plon)) select track_id, port from trk, pt where sqrt(pow((start_lon-plon)*111320.0*cos(radians(plat)),2)+pow((start_lat-plat)*111320.0,2))<=200000")
def port_starts(spark, sf_dir):
    places = spark.createDataFrame([("P0", 31.0, 127.0), ("P1", 36.0, 133.0), ("P2", 44.0, 141.0)], "port string, lat double, lon double")
    return selection.to_ports(tracks(spark, sf_dir), places, 200_000).select("track_id", "port")


_HARBOURS = "pt as (select s_suppkey port, 30.0+((s_suppkey*7919)%15000)/1000.0 plat, 125.0+((s_suppkey*104729)%17000)/1000.0 plon from supplier)"


def _harbours(spark, sf_dir):
    """A place for every supplier."""
    at = lambda base, by, n: (base + (F.col("s_suppkey") * by % n) / F.lit(1000.0))
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("port"), at(30.0, 7919, 15_000).alias("lat"), at(125.0, 104_729, 17_000).alias("lon"))


@query(f"{TRK}, {_HARBOURS} select track_id, port, round(sqrt(pow((start_lon-plon)*111320.0*cos(radians(plat)),2)+pow((start_lat-plat)*111320.0,2)),3) start_m from trk, pt where sqrt(pow((start_lon-plon)*111320.0*cos(radians(plat)),2)+pow((start_lat-plat)*111320.0,2))<=40000")
def harbour_starts(spark, sf_dir):
    return _rounded(selection.to_ports(tracks(spark, sf_dir), _harbours(spark, sf_dir), 40_000).select("track_id", "port", "start_m"), 3, "start_m")


@query(f"{POS}, {_HARBOURS} select seq, port, round({_distance('lat', 'lon', 'plat', 'plon')},3) metres from pos, pt where {_distance('lat', 'lon', 'plat', 'plon')}<=15000")
def fixes_near_harbours(spark, sf_dir):
    """All fixes with all places within 15 km on a round earth."""
    return _rounded(proximity.near(positions(spark, sf_dir), _harbours(spark, sf_dir), 15_000).select("seq", "port", "metres"), 3, "metres")


@query(f"{TRK} select cast(min(start_timestamp) as bigint) min_ts, cast(max(end_timestamp) as bigint) max_ts from trk")
def time_range(spark, sf_dir):
    return selection.time_range(tracks(spark, sf_dir))


@query(f"""{POS}, {_STEPS}, q as (select track_id, count(*) points_seen, coalesce(max(case when dt_ is not null then greatest(0,dt_) end),0) g, coalesce(max(dist_),0.0) d from st group by track_id) select track_id, points_seen from q where g<=2500 and d<=150000 order by points_seen desc, track_id limit 40""")
def good_tracks(spark, sf_dir):
    return selection.good_tracks(gaps.gap_metrics(positions(spark, sf_dir).where("track_id >= 0")), 2500, 150_000.0, 40).select("track_id", "points_seen")


@query(f"{TRK} select track_id, cast(start_timestamp as bigint) start_timestamp from trk where ship_id=7")
def ship_tracks(spark, sf_dir):
    return selection.of_ship(tracks(spark, sf_dir), 7).select("track_id", "start_timestamp")


@query(f"{TRK}, h as (select * from trk order by track_ord limit 50), p as (select track_id, 0 r, points_count, track_ord from h where points_count between 5 and 12 union all select track_id, 1, points_count, track_ord from trk) select track_id from p order by r, points_count desc, track_ord limit 1")
def representative_track(spark, sf_dir):
    return selection.representative(tracks(spark, sf_dir), 50, 5, 12)


@query(f"""{POS}, l as (select ship_id, seq, "timestamp", track_id, lag(track_id) over (partition by ship_id order by seq) b from pos)
select ship_id, seq, cast("timestamp" as bigint) "timestamp", case when b<0 and track_id>=0 then 'start' when b>=0 and track_id<0 then 'end' else 'switch' end kind from l where b is not null and b<>track_id""")
def switch_events(spark, sf_dir):
    return events.switch_events(positions(spark, sf_dir)).select("ship_id", "seq", "timestamp", "kind")


@query(f"{POS}, r as (select *, row_number() over (partition by ship_id order by tile_z desc, seq) n, min(seq) over (partition by ship_id) first_seq from pos) select ship_id, seq, tile_z, first_seq from r where n=1")
def dedup_max_zoom(spark, sf_dir):
    return events.keep_max_zoom(positions(spark, sf_dir).select("ship_id", "seq", "tile_z"))


@query(f"{POS} select ship_id, seq, count(*) over w n_rows, round(avg(speed) over w,6) mean_speed from pos window w as (partition by ship_id order by seq rows between 9 preceding and current row)")
def last_n_rows(spark, sf_dir):
    return _rounded(events.last_rows(positions(spark, sf_dir), 10), 6, "mean_speed")


@query(f"""{POS}, fr as (select unnest(range(0, 40)) f) select cast(f as bigint) frame, count(*) n_rows, count(distinct ship_id) ships from fr join pos on "timestamp">=greatest(f*1000-3000,0) and "timestamp"<least(f*1000+1000,40000) group by f""")
def sliding_frames(spark, sf_dir):
    found = events.frames(positions(spark, sf_dir), 0, 40_000, 1000, 3000)
    return found.groupBy("frame").agg(F.count("*").alias("n_rows"), F.count_distinct("ship_id").alias("ships"))


@query(f"""{POS}, n as (select ship_id, seq, cast("timestamp" as double) t, lat, lon, cast(lead("timestamp") over w as double) nt, lead(lat) over w nlat, lead(lon) over w nlon from pos window w as (partition by ship_id order by "timestamp", seq))
select ship_id, seq, cast(k as int) step, round(t+(nt-t)*k/4,6) "timestamp", round(lat+(nlat-lat)*k/4,6) lat, round(lon+(nlon-lon)*k/4,6) lon from n, (select unnest(range(0,4)) k) where nlat is not null""")
def interpolated(spark, sf_dir):
    return _rounded(events.interpolate(positions(spark, sf_dir), 4), 6, "timestamp", "lat", "lon")


@query("select cast(floor(datediff('day', date '2024-01-01', cast(ts as date))/4.0) as bigint) part, count(*) n_rows, cast(min(cast(ts as date)) as varchar) first_day, cast(max(cast(ts as date)) as varchar) last_day from events group by 1")
def tumbling_days(spark, sf_dir):
    found = events.tumbling_days(_table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "day", "2024-01-01", 4)
    return found.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("select cast(cast(ts as date) as varchar) dt, count(*) n_rows from events group by 1")
def positions_per_day(spark, sf_dir):
    return positions(spark, sf_dir).groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count("*").alias("n_rows"))


@query("select event_type, count(*) n_rows from events group by 1")
def rows_by_type(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n_rows"))


@query(f"{POS} select ship_id, arg_max(speed, seq) last_speed, arg_max(heading, seq) last_heading, arg_max(course, seq) last_course, arg_max(rot, seq) last_rot, arg_max(destination, seq) last_destination, round(avg(speed),6) mean_speed, min(speed) min_speed, max(speed) max_speed from pos group by ship_id")
def slice_stats(spark, sf_dir):
    return _rounded(events.slice_stats(positions(spark, sf_dir)), 6, "mean_speed")


@query("select event_id, event_type from events where cast(ts as date) between date '2024-01-05' and date '2024-01-07'")
def pruned_range(spark, sf_dir):
    start, end = 1704412800 + 3600, 1704585600 + 7200
    rows = _table(spark, sf_dir, "events").withColumn("dt", F.to_date("ts"))
    return rows.where(F.col("dt").between(dates.utc_day(F.lit(start)), dates.utc_day(F.lit(end)))).select("event_id", "event_type")


def _stored(spark, sf_dir):
    """The fixes, at their real times, in a dataset's folders by day in the shared folder."""
    path = f"{scratch_root(spark)}/dataset-{uuid.uuid4().hex[:12]}"
    rows = positions(spark, sf_dir).withColumns({"timestamp": F.col("timestamp") * 60 + EPOCH_US // 1_000_000, "elapsed": F.lit(0), "file_id": F.lit(0), "ord_in_file": F.col("seq")})
    rows = rows.withColumn("dt", dates.utc_day("timestamp"))
    dataset.write(rows.select(*(F.col(f.name).cast(f.dataType) for f in schema.POSITIONS)), path, "positions")
    return dataset.read(spark, path, "positions")


@query("select event_id ord_in_file, user_id ship_id from events where cast(ts as date) between date '2024-01-05' and date '2024-01-07'")
def pruned_days(spark, sf_dir):
    """A written dataset, of which three folders are read."""
    return dataset.positions_between(_stored(spark, sf_dir), 1704412800 + 3600, 1704585600 + 7200).select(F.col("ord_in_file").cast("long").alias("ord_in_file"), "ship_id")


def _early_voyages(rows):
    """Voyages of enough fixes that are over by the fifth day."""
    found = rows.where("track_id >= 0").groupBy("track_id").agg(F.min("timestamp").alias("start_timestamp"), F.max("timestamp").alias("end_timestamp"), F.count("*").alias("n"))
    return found.where((F.col("n") >= 3) & (F.col("end_timestamp") < EPOCH_US // 1_000_000 + 5 * 86_400))


@query(f"""{POS}, v as (select track_id from pos where track_id>=0 group by track_id having count(*)>=3 and max("timestamp")<5*1440) select seq ord_in_file, ship_id, track_id from pos where track_id in (select track_id from v)""")
def positions_of_voyages(spark, sf_dir):
    """Folders pruned by another table: the days of the wanted voyages."""
    rows = _stored(spark, sf_dir)
    wanted = materialize(_early_voyages(rows), "wanted")
    return dataset.positions_of(rows, wanted).select(F.col("ord_in_file").cast("long").alias("ord_in_file"), "ship_id", "track_id")


def _laid_out(spark, sf_dir):
    """The fixes of all voyages in an indexed layout in the shared folder."""
    path = f"{scratch_root(spark)}/layout-{uuid.uuid4().hex[:12]}"
    layout.write_track_sorted(positions(spark, sf_dir).where("track_id >= 0"), path, config=LayoutConfig(group=1000, parts=10))
    layout.index_layout(spark, path)
    return path


@query(f"""{POS} select track_id, seq, row_number() over (partition by track_id order by "timestamp", seq)-1 place from pos where track_id>=0""")
def layout_places(spark, sf_dir):
    """Places of all fixes in their voyage, by the row numbers of the files and the index."""
    path = _laid_out(spark, sf_dir)
    return layout.points_of(spark, path, layout.offsets(spark, path)).select("track_id", "seq", "place")


@query(f"""{POS}, r as (select track_id, seq, row_number() over (partition by track_id order by "timestamp", seq)-1 place from pos where track_id>=0) select * from r where track_id%7=3 and place between 1 and 3""")
def layout_slices(spark, sf_dir):
    """The second to fourth fix of every voyage whose id leaves 3 by 7, from the files that hold these."""
    path = _laid_out(spark, sf_dir)
    wanted = layout.offsets(spark, path).where("track_id % 7 = 3").select("track_id", F.lit(1).alias("s"), F.lit(4).alias("e"))
    return layout.points_of(spark, path, wanted).select("track_id", "seq", "place")


@query(f"{POS}, b as (select track_id, cast(floor(track_id/100.0)*100 as bigint) g from pos) select track_id, g track_group, cast(g+floor((track_id-g)/10.0)*10 as bigint) subrange, count(*) n_rows from b group by 1,2,3")
def track_buckets(spark, sf_dir):
    made = layout.buckets(LayoutConfig(group=100, parts=10))
    rows = positions(spark, sf_dir).select("track_id", made["track_group"].alias("track_group"), made["subrange"].alias("subrange"))
    return rows.groupBy("track_id", "track_group", "subrange").agg(F.count("*").alias("n_rows"))


@query(f"""{TRK}, {_COMP}, {_ASSIGN} select track_id, seq, cast("timestamp" as bigint) "timestamp" from pos where track_id in (select track_id from asg where start_poi>=0 and end_poi>=0 and start_poi<>end_poi)""")
def track_sorted_layout(spark, sf_dir):
    return layout.track_sorted(positions(spark, sf_dir), track_pois(spark, sf_dir)).select("track_id", "seq", "timestamp")


@query(f"{POS}, c as (select cast(floor(track_id/1000.0)*1000 as bigint) leaf, track_id, count(*) n from pos where track_id>=0 group by 1,2) select track_id, cast(sum(n) over w-n as bigint) \"start\", cast(sum(n) over w as bigint) \"end\" from c window w as (partition by leaf order by track_id rows between unbounded preceding and current row)")
def track_offsets(spark, sf_dir):
    return layout.track_offsets(positions(spark, sf_dir).where("track_id >= 0")).select("track_id", "start", "end")


@query("select distinct event_type from events where event_type is not null and event_type not in (select distinct event_type from events where event_id<2)")
def missing_flags(spark, sf_dir):
    rows = _table(spark, sf_dir, "events")
    return relational.missing(rows, rows.where("event_id < 2").select("event_type").distinct(), "event_type")


@query("with k as (select n_nationkey id, n_name from nation where n_nationkey<10), a as (select distinct n_name from nation where n_name not in (select n_name from k)) select cast(id as bigint) id, n_name from k union all select cast((select max(id) from k)+row_number() over (order by n_name) as bigint), n_name from a")
def insert_missing(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")
    known = nation.where("n_nationkey < 10").select(F.col("n_nationkey").alias("id"), "n_name")
    return relational.insert_missing(nation, known, "n_name", "id")


@query("with f as (select event_type, min(event_id) o from events group by 1) select event_type, row_number() over (order by o, event_type) type_id from f")
def first_seen_ids(spark, sf_dir):
    return relational.first_seen_ids(_table(spark, sf_dir, "events"), "event_type", "event_id", "type_id")


@query(f"""{POS} select p.ship_id, c.c_name "name", cast(p."timestamp" as bigint) "timestamp", p.lat, p.lon, p.speed from pos p join customer c on c.c_custkey=p.ship_id where p.lat between 32 and 36 and p.lon between 127 and 133 and p.speed>=10 and c.c_custkey%40 between 3 and 30 and c.c_name like 'Customer%' and p."timestamp">=1000 and p."timestamp"<30000""")
def area_query(spark, sf_dir):
    ships = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ship_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 40).alias("width"))
    return relational.area_query(spark, positions(spark, sf_dir), ships, min_width=3, max_width=30, min_lat=32, max_lat=36, min_lon=127, max_lon=133, min_speed=10, name="Customer%", from_ts=1000, to_ts=30000)


@query(f"""{POS} select cast("timestamp" as bigint) "timestamp", lat, lon, speed from pos where ship_id=(select min(c_custkey) from customer where c_name='Customer#000000005')""")
def ship_query(spark, sf_dir):
    ships = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ship_id"), F.col("c_name").alias("mt_id"))
    return relational.ship_query(spark, positions(spark, sf_dir), ships, "Customer#000000005")


@query(f"{POS} select seq, lat, lon from pos where pow(lat-34.0,2)+pow(lon-130.0,2)<=4.0")
def circle_query(spark, sf_dir):
    return positions(spark, sf_dir).where(geo.in_circle_degrees("lat", "lon", 34.0, 130.0, 2.0)).select("seq", "lat", "lon")


@query(f"{POS} select seq from pos where lon>127.5 and lon<131.25 and lat>32.5 and lat<35.75")
def envelope_query(spark, sf_dir):
    return positions(spark, sf_dir).where(geo.envelope_contains("lat", "lon", 127.5, 32.5, 131.25, 35.75)).select("seq")


#: Tables with rows that break each rule of the mirror.
_MIRROR = """sh as (select c_custkey ship_id, concat('M', cast(c_custkey//2*2 as varchar)) mt_id, case when c_custkey%9>0 then 1 end ship_type, 1 gt_ship_type, c_nationkey-1 "length", c_custkey%7 width, 5 dwt from customer where c_custkey<=120),
ps as (select seq, ship_id, track_id, case when seq%50>0 then lat end lat, lon, speed, course, heading, case when seq%33=0 then -1 else 0 end elapsed from pos), tk as (select track_id, case when track_id%13=0 then ship_id+1 else ship_id end ship_id from trk)"""


@query(f"""{TRK}, {_MIRROR} select * from (
select 'ships_mt_id_unique' "rule", count(*) bad_rows from (select mt_id from sh group by 1 having count(*)>1) union all select 'ships_type_required', count(*) from sh where ship_type is null or gt_ship_type is null
union all select 'ships_sizes_positive', count(*) from sh where "length"<0 or width<0 or dwt<0 union all select 'positions_ship_known', count(*) from ps where ship_id not in (select ship_id from sh)
union all select 'positions_values_positive', count(*) from ps where speed<0 or course<0 or heading<0 or elapsed<0 union all select 'positions_place_required', count(*) from ps where lat is null or lon is null
union all select 'tracks_ship_known', count(*) from tk where ship_id not in (select ship_id from sh) union all select 'positions_track_same_ship', count(*) from ps join tk using (track_id) where track_id>=0 and ps.ship_id<>tk.ship_id)""")
def constraint_checks(spark, sf_dir):
    """Rows that break each of the eight rules; the tables are changed so that each is broken."""
    n = F.col("c_custkey")
    ships = _table(spark, sf_dir, "customer").where(n <= 120).select(
        n.alias("ship_id"), F.concat(F.lit("M"), (F.floor(n / 2) * 2).cast("string")).alias("mt_id"), F.when(n % 9 > 0, 1).alias("ship_type"), F.lit(1).alias("gt_ship_type"), (F.col("c_nationkey") - 1).alias("length"), (n % 7).alias("width"), F.lit(5).alias("dwt")
    )
    rows = positions(spark, sf_dir).withColumns({"lat": F.when(F.col("seq") % 50 > 0, F.col("lat")), "elapsed": F.when(F.col("seq") % 33 == 0, -1).otherwise(0)})
    voy = tracks(spark, sf_dir).withColumn("ship_id", F.when(F.col("track_id") % 13 == 0, F.col("ship_id") + 1).otherwise(F.col("ship_id")))
    return relational.violations(ships, rows, voy)


@query("select event_type as grp, count(*) n from events group by 1 union all select '*' , count(*) from events")
def union_all(spark, sf_dir):
    one = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("grp")).agg(F.count("*").alias("n"))
    return one.unionByName(one.agg(F.sum("n").alias("n")).select(F.lit("*").alias("grp"), "n"))


@query("select distinct ship_id from (select user_id ship_id from events where value>40 union all select user_id from events where event_type='error')")
def union_distinct(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").withColumn("ship_id", F.col("user_id"))
    return rows.where("value > 40").select("ship_id").union(rows.where("event_type = 'error'").select("ship_id")).distinct()


@query("select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
def json_props(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("select doc_id, upper(trim(regexp_replace(translate(source, '_-', '  '), '\\s+', ' ', 'g'))) dest from documents")
def normal_destinations(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.normal_destination("source").alias("dest"))


@query("select url, trim(regexp_extract(regexp_replace(url, '[^a-zA-Z0-9]+', ' ', 'g'), '^(.*?)(?:\\s+\\d+)?$', 1)) grp from pages")
def zone_groups(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("url", text.group_name(F.regexp_replace("url", "[^a-zA-Z0-9]+", " ")).alias("grp"))


@query(f"{POS} select seq, round(sin(radians(heading)),6) east, round(cos(radians(heading)),6) north from pos where heading>=0 and heading<360")
def heading_vectors(spark, sf_dir):
    east, north = geo.heading_vector("heading")
    return positions(spark, sf_dir).select("seq", F.round(east, 6).alias("east"), F.round(north, 6).alias("north")).where("east is not null")


@query(f"{POS}, {_CELLS} select iy, ix, round(ln(1+cnt)/max(ln(1+cnt)) over (), 6) \"value\" from dc")
def log_density(spark, sf_dir):
    return _rounded(rasters.log_scaled(density_cells(spark, sf_dir)).select("iy", "ix", "value"), 6, "value")


@query(f"{POS}, {_CELLS} select iy-12 iy, ix-17 ix, cnt from dc where iy>=12 and iy<20 and ix>=17 and ix<29")
def cropped_density(spark, sf_dir):
    return rasters.crop(density_cells(spark, sf_dir), (125.0, 30.0, 17 / 60, 0.25), (60, 60), (130.0, 133.0, 33.0, 35.0))


@query(f"""{POS}, {_CELLS}, g as (select y, x, greatest(0.0,least((130.0+(x+0.5)*(3.0/16)-125.0)/(17/60.0),59.0)) fx, greatest(0.0,least((33.0+(y+0.5)*(2.0/16)-30.0)/0.25,59.0)) fy from (select unnest(range(0,16)) y), (select unnest(range(0,16)) x)),
n as (select y, x, least(cast(floor(fy) as int)+dy,59) iy, least(cast(floor(fx) as int)+dx,59) ix, (case when dx=0 then 1-(fx-floor(fx)) else fx-floor(fx) end)*(case when dy=0 then 1-(fy-floor(fy)) else fy-floor(fy) end) w from g, (select unnest([0,1]) dy), (select unnest([0,1]) dx))
select cast(y as int) ty, cast(x as int) tx, round(sum(w*coalesce(cnt,0)),6) "value" from n left join dc using (iy, ix) group by 1,2""")
def resampled_density(spark, sf_dir):
    found = rasters.resample(density_cells(spark, sf_dir), (125.0, 30.0, 17 / 60, 0.25), (60, 60), (130.0, 133.0, 33.0, 35.0), (16, 16), "bilinear")
    return _rounded(found, 6, "value")


_LOGITS = "cl2 as (select ship_id%20 as \"sample\", (speed-50)/20.0 logit, case when course>240 then 1.0 else 0.0 end target from pos)"


def _logits(spark, sf_dir):
    return positions(spark, sf_dir).select((F.col("ship_id") % 20).alias("sample"), ((F.col("speed") - 50) / F.lit(20.0)).alias("logit"), F.when(F.col("course") > 240, 1.0).otherwise(0.0).alias("target"))


@query(f"""{POS}, {_LOGITS}, m as (select "sample", count(*) filter (where 1/(1+exp(-logit))>=0.5 and target>=0.5) tp, count(*) filter (where 1/(1+exp(-logit))>=0.5 and target<0.5) fp, count(*) filter (where 1/(1+exp(-logit))<0.5 and target>=0.5) fn from cl2 group by 1)
select "sample", round(tp/(tp+fp+1e-8),6) "precision", round(tp/(tp+fn+1e-8),6) recall, round(tp/(tp+fp+fn+1e-8),6) iou, round(2*tp/(2*tp+fp+fn+1e-8),6) dice from m""")
def seg_metrics(spark, sf_dir):
    return _rounded(metrics.sample_metrics(_logits(spark, sf_dir)).select("sample", "precision", "recall", "iou", "dice"), 6, "precision", "recall", "iou", "dice")


@query(f"{POS}, {_LOGITS} select round(greatest(1.0, count(*) filter (where target<0.5)/count(*) filter (where target>=0.5)),6) pos_weight from cl2")
def positive_weight(spark, sf_dir):
    return _rounded(metrics.positive_weight(_logits(spark, sf_dir)), 6, "pos_weight")


@query(f"{POS}, {_LOGITS}, p as (select *, 1/(1+exp(-logit)) pr from cl2) select \"sample\", round(avg(greatest(logit,0.0)-logit*target+ln(1+exp(-abs(logit)))),6) bce, round(1-(2*sum(pr*target)+1)/(sum(pr)+sum(target)+1),6) dice_loss from p group by 1")
def loss_values(spark, sf_dir):
    return _rounded(metrics.losses(_logits(spark, sf_dir)), 6, "bce", "dice_loss")


#: The state of each vessel, carried from fix to fix by a recursion: rest before the fix decides on destinations, rest with it on idling.
_WALK = f"""o as (select seq, ship_id, "timestamp" ts, lat, lon, speed, destination dest, row_number() over (partition by ship_id order by seq) rn from pos),
w as (select ship_id, rn, seq, ts, lat, lon, dest, 0 voyage, 0 local_no, false idle, lat ila, lon ilo, dest idest, lat ala, lon alo, speed<10 stopped, cast(0 as bigint) still from o where rn=1
union all select ship_id, rn, seq, ts, lat, lon, dest, case when act='begin' then voyage+1 else voyage end, case when act='begin' then voyage+1 when act='stay' then voyage else -1 end, act in ('rest','idle'),
  case when act='rest' then lat else ila end, case when act='rest' then lon else ilo end, case when act='rest' then dest else idest end, case when act='begin' then lat else ala2 end, case when act='begin' then lon else alo2 end, slow, case when act='begin' then 0 else still2 end
 from (select *, case when idle then case when cast(not slow as int)+cast(away>60000 as int)+cast(dest<>idest as int)>=2 then 'begin' else 'idle' end when brk then 'begin' when slow and still2>=900 then 'rest' else 'stay' end act
 from (select *, case when slow and not inside then lat else ala1 end ala2, case when slow and not inside then lon else alo1 end alo2, case when slow and inside then still1+dt else 0 end still2
 from (select *, {_distance("ala1", "alo1", "lat", "lon")}<=60000 inside, {_distance("ila", "ilo", "lat", "lon")} away, dt>2400 or (dt>1200 and far>150000) or far>250000 or (dest<>pdest and (dt>600 or far>50000 or stopped)) brk
 from (select o.*, w.voyage, w.idle, w.ila, w.ilo, w.idest, w.dest pdest, w.stopped, greatest(0, o.ts-w.ts) dt, {_distance("w.lat", "w.lon", "o.lat", "o.lon")} far, o.speed<10 slow,
  case when o.speed<10 and not w.stopped then o.lat else w.ala end ala1, case when o.speed<10 and not w.stopped then o.lon else w.alo end alo1, case when w.stopped then w.still else 0 end still1
  from w join o on o.ship_id=w.ship_id and o.rn=w.rn+1) a) b) c) d),
n as (select *, row_number() over (order by first_seq) track_id from (select ship_id, local_no, min(seq) first_seq, arg_min(ts, seq) t0, arg_max(ts, seq) t1, arg_min(lat, seq) la0, arg_min(lon, seq) lo0, arg_max(lat, seq) la1, arg_max(lon, seq) lo1, count(*) points, max(rn) last_rn from w where local_no>=0 group by ship_id, local_no))"""


@query(f"{POS}, {_WALK} select w.seq, w.ship_id, coalesce(n.track_id, -1) track_id from w left join n on n.ship_id=w.ship_id and n.local_no=w.local_no")
def voyage_positions(spark, sf_dir):
    return voyages.detect(positions(spark, sf_dir), VOYAGES)[0]


@query(f"""{POS}, {_WALK} select n.track_id, n.ship_id, cast(t0 as int) start_timestamp, cast(t1 as int) end_timestamp, round(la0,4) start_lat, round(lo0,4) start_lon, round(la1,4) end_lat, round(lo1,4) end_lon, cast(points as int) points_count,
 row_number() over (order by c.seq is null, coalesce(c.seq, f.seq), n.track_id)-1 track_ord from n left join o c on c.ship_id=n.ship_id and c.rn=n.last_rn+1 join o f on f.ship_id=n.ship_id and f.rn=1 where points>=2""")
def voyage_tracks(spark, sf_dir):
    found = voyages.detect(positions(spark, sf_dir), VOYAGES)[1]
    places = ("start_lat", "start_lon", "end_lat", "end_lon")
    return _rounded(found.withColumns({c: F.col(c).cast("double") for c in places}), 4, *places)


def _by_halves(spark, sf_dir):
    """Voyages of the first half of all fixes by arrival, then of the second, which sees the first's only through what was carried."""
    rows = positions(spark, sf_dir)
    half = rows.agg(F.max("seq")).first()[0] // 2
    first = voyages.carry_on(rows.where(F.col("seq") <= half), None, VOYAGES)
    second = voyages.carry_on(rows.where(F.col("seq") > half), first[2], VOYAGES)
    return first, second


@query(ORACLE_SQL["voyage_positions"])
def voyage_positions_by_halves(spark, sf_dir):
    (before, *_), (after, *_) = _by_halves(spark, sf_dir)
    return before.unionByName(after)


@query(ORACLE_SQL["voyage_tracks"])
def voyage_tracks_by_halves(spark, sf_dir):
    (_, before, _), (_, after, carried) = _by_halves(spark, sf_dir)
    found = before.unionByName(after).unionByName(voyages.still_open(carried))
    places = ("start_lat", "start_lon", "end_lat", "end_lon")
    return _rounded(found.withColumns({c: F.col(c).cast("double") for c in places}), 4, *places)


def _examples(spark, sf_dir, grid):
    rows = positions(spark, sf_dir).where("track_id >= 0")
    return paths.examples(gaps.slice_of(rows, gaps.fragments(rows, FRAGS)), grid)


@query()
def fragment_examples(spark, sf_dir):
    made = _examples(spark, sf_dir, EXAMPLE)
    made = paths.with_density(made, density_cells(spark, sf_dir), (EXTENT[0], EXTENT[2], 17 / 60, 0.25), BINS[::-1], EXAMPLE.size)
    return made.select("track_id", "s", "n_points", "reason", F.size("gaps").alias("n_gaps"), paths.total("known").alias("known_cells"), paths.total("target").alias("target_cells"), paths.total(paths.missing()).alias("missing_cells"), paths.total("density").alias("density_sum"))


@query()
def restored_routes(spark, sf_dir):
    size = EXAMPLE.size
    # a fragment without a gap has no route, so its map isn't scored
    made = _examples(spark, sf_dir, EXAMPLE).drop("target").withColumn("known", F.when(F.size("gaps") > 0, F.col("known")))
    made = paths.scored(made, paths.smoothing_scorer(size))
    return paths.routes(made.withColumn("idx", F.xxhash64("track_id", "s")), size, (0.05, 0.5)).withColumn("gaps", F.to_json("gaps")).drop("lat", "lon", "path", "min_lon", "max_lon", "min_lat", "max_lat")


@query(f"{TRK} select track_id, points_count from trk order by points_count desc, track_id limit 10 offset 20")
def paged_tracks(spark, sf_dir):
    rows = tracks(spark, sf_dir).select("track_id", "points_count", (-F.col("points_count")).alias("_o"))
    return selection.page(rows, ["_o", "track_id"], 20, 10).drop("_o")


@query(f"""{POS}, r as (select ship_id, seq, row_number() over (partition by ship_id order by "timestamp" desc, seq desc) place from pos) select ship_id, seq, cast(place as int) place from r where place<=3""")
def latest_per_ship(spark, sf_dir):
    return selection.latest_per(positions(spark, sf_dir).select("ship_id", "seq", "timestamp"), "ship_id", [F.desc("timestamp"), F.desc("seq")], 3).select("ship_id", "seq", "place")


@query("select c_custkey ship_id, c_name mt_id from customer where c_nationkey=7 order by c_custkey limit 1")
def find_ship(spark, sf_dir):
    ships = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ship_id"), F.col("c_name").alias("mt_id"), F.col("c_nationkey").alias("flag"))
    return selection.find_ship(ships, "flag", 7).select("ship_id", "mt_id")


@query(f"{TRK}, {_COMP}, {_SUMMARY} select poi_id, count_total from pm where count_total>=5 order by count_total desc, poi_id limit 12")
def labelled_pois(spark, sf_dir):
    return selection.labelled_top(poi_summary(spark, sf_dir), 5, 12).select("poi_id", "count_total")


@query(f"""{TRK} select track_id, min("timestamp") min_ts, max("timestamp") max_ts from pos where track_id in (select track_id from trk where points_count>=12) group by track_id""")
def semi_join_ranges(spark, sf_dir):
    wanted = tracks(spark, sf_dir).where("points_count >= 12").select("track_id")
    rows = positions(spark, sf_dir).join(wanted, "track_id", "left_semi")
    return rows.groupBy("track_id").agg(F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"))


@query(f"""{POS} select seq, cast("timestamp"-coalesce(case when rot>0 then rot end,0) as bigint) event_ts, cast(make_timestamp(cast("timestamp"*1000000 as bigint)) as date)::varchar utc_day from pos""")
def event_times(spark, sf_dir):
    rows = positions(spark, sf_dir).withColumn("elapsed", F.when(F.col("rot") > 0, F.col("rot")))
    return rows.select("seq", text.event_time("timestamp", "elapsed").alias("event_ts"), dates.utc_day("timestamp").cast("string").alias("utc_day"))


@query(f"{POS} select seq, tile_z, round(lon-coalesce(w,1.0)/2,6) min_lon, round(lat+coalesce(w,1.0)*10/32,6) max_lat from (select *, case tile_z when 8 then 3.2 when 9 then 1.6 end::double w from pos)")
def zone_rectangles(spark, sf_dir):
    from .sources.dataset import zone_rectangles as rectangles

    zones = positions(spark, sf_dir).select(F.col("seq").alias("zone_id"), "lat", "lon", F.col("tile_z").alias("zoom"), F.col("tile_z").cast("string").alias("name"))
    out = rectangles(zones, {8: 3.2, 9: 1.6})
    return out.select(F.col("zone_id").alias("seq"), F.col("name").cast("int").alias("tile_z"), F.round("min_lon", 6).alias("min_lon"), F.round("max_lat", 6).alias("max_lat"))


@query("select event_type, arg_max(cast(extract(day from ts) as int), (value, -extract(day from ts))) best_epoch from events where event_type='click' group by 1")
def best_epochs(spark, sf_dir):
    history = _table(spark, sf_dir, "events").where("event_type = 'click'").select(F.day("ts").alias("epoch"), F.col("value").alias("val_iou"))
    return metrics.best_epoch(history).select(F.lit("click").alias("event_type"), "best_epoch")


@query(f"""{POS}, {_CELLS}, e as (select a.iy, a.ix from dc a join dc b on abs(a.iy-b.iy)<=1 and abs(a.ix-b.ix)<=1 and not (a.iy=b.iy and a.ix=b.ix)), d as (select iy, ix, count(*) degree from e group by 1,2) select least(degree,3) degree_class, count(*) cells from d group by 1""")
def degree_classes(spark, sf_dir):
    return rasters.degrees(density_cells(spark, sf_dir)).groupBy(F.least("degree", F.lit(3)).cast("long").alias("degree_class")).agg(F.count("*").alias("cells"))


@query(f"""{TRK}, {_COMP}, {_ASSIGN}, g as (select * from asg where start_poi>=0 and end_poi>=0 and start_poi<>end_poi) select start_poi poi_id, 'start' port_end, track_id from g union all select end_poi, 'end', track_id from g""")
def port_tracks(spark, sf_dir):
    return ports.port_tracks(ports.assign(tracks(spark, sf_dir), _labelled(spark, sf_dir)[1], PORTS)).select("poi_id", "port_end", "track_id")


@query(f"""{TRK} select track_id, points_count from trk where points_count>=3 and start_timestamp>=5000 and end_timestamp<=30000 and end_timestamp-start_timestamp<=6000""")
def tracks_within_time(spark, sf_dir):
    return selection.within_time(tracks(spark, sf_dir), 5000, 30_000, 6000, 3).select("track_id", "points_count")


@query(f"{POS}, {_GAPS} select count(gap_sec) \"count\", round(avg(gap_sec),6) mean, round(stddev_samp(gap_sec),6) std, cast(min(gap_sec) as double) min, quantile_cont(gap_sec,0.25) q25, quantile_cont(gap_sec,0.5) q50, quantile_cont(gap_sec,0.75) q75, cast(max(gap_sec) as double) max from gp")
def gap_description(spark, sf_dir):
    found = gaps.steps(positions(spark, sf_dir).where("track_id >= 0")).where("dt is not null")
    return _rounded(events.describe(found.select(F.col("dt").alias("gap_sec")), "gap_sec"), 6, "mean", "std")


@query(f"{POS}, d as (select distinct tile_z, lon from pos), l as (select tile_z, lon-lag(lon) over (partition by tile_z order by lon) step from d) select tile_z, round(median(step),9) median_step, count(step) n_steps from l where step is not null group by tile_z")
def zoom_steps(spark, sf_dir):
    return _rounded(events.median_steps(positions(spark, sf_dir), "tile_z", "lon"), 9, "median_step")


@query(f"{POS} select distinct tile_z zoom, ship_id%16 zone_group from pos")
def zoom_groups(spark, sf_dir):
    return positions(spark, sf_dir).select(F.col("tile_z").alias("zoom"), (F.col("ship_id") % 16).alias("zone_group")).distinct()


@query(f"""{POS} select cast(min("timestamp") as bigint) parse_start, cast(max("timestamp") as bigint) parse_end, 'fixture' description from pos""")
def parse_event(spark, sf_dir):
    return relational.parse_event(positions(spark, sf_dir), "fixture")


@query(f"{POS}, {_CELLS} select iy, ix, round(least(1.0, cnt/(select quantile_cont(cnt,0.98) from dc)),9) shade from dc")
def display_density(spark, sf_dir):
    return _rounded(rasters.display_scaled(density_cells(spark, sf_dir)).select("iy", "ix", "shade"), 9, "shade")


@query(f"""{POS}, u as (select seq, concat('https://map/centerx:', round(lon,3), '/centery:', round(lat,3), '/zoom:', tile_z) url from pos where seq%3>0 union all select seq, concat('https://map/', seq) from pos where seq%3=0)
select seq, try_cast(regexp_extract(url, 'centerx:([0-9.]+)/', 1) as double) x, try_cast(regexp_extract(url, 'centery:([0-9.]+)/', 1) as double) y, try_cast(regexp_extract(url, 'zoom:([0-9]+)', 1) as int) zoom from u""")
def url_positions(spark, sf_dir):
    named = F.concat(F.lit("https://map/centerx:"), F.round("lon", 3).cast("string"), F.lit("/centery:"), F.round("lat", 3).cast("string"), F.lit("/zoom:"), F.col("tile_z").cast("string"))
    rows = positions(spark, sf_dir).withColumn("url", F.when(F.col("seq") % 3 > 0, named).otherwise(F.concat(F.lit("https://map/"), F.col("seq").cast("string"))))
    return rows.select("seq", text.url_position("url").alias("at")).select("seq", "at.x", "at.y", "at.zoom")


@query(f"""{POS}, {_STEPS}, {_FRAG}, m as (select track_id, s, (min_lat+max_lat)/2 la, (min_lon+max_lon)/2 lo, max_lat-min_lat dla, max_lon-min_lon dlo from fr), h as (select *, greatest(32*10000/2, 0.5*greatest(dla*111320.0, dlo*111320.0*cos(radians(la))))+32*10000 half from m)
select track_id, s, round(lo-half/(111320.0*cos(radians(la))),6) win_min_lon, round(lo+half/(111320.0*cos(radians(la))),6) win_max_lon, round(la-half/111320.0,6) win_min_lat, round(la+half/111320.0,6) win_max_lat from h""")
def fragment_windows(spark, sf_dir):
    made = geo.fragment_window("min_lat", "max_lat", "min_lon", "max_lon", EXAMPLE.size, EXAMPLE.cell_m)
    return track_fragments(spark, sf_dir).select("track_id", "s", *(F.round(c, 6).alias(n) for n, c in made.items()))


@query(f"{POS} select seq, round(30.0+(cast(floor((lat-30.0)*4) as int)+0.5)*0.25,9) mid_lat, round(125.0+(cast(floor((lon-125.0)*(60/17.0)) as int)+0.5)*(17/60.0),9) mid_lon from pos where lon>=125 and lon<142 and lat>=30 and lat<45")
def cell_centres(spark, sf_dir):
    rows = positions(spark, sf_dir).where("lon >= 125 and lon < 142 and lat >= 30 and lat < 45")
    middle = lambda c, low, high: F.round(geo.cell_centre(geo.grid_cell(c, low, high, 60), low, high, 60), 9)
    return rows.select("seq", middle("lat", 30.0, 45.0).alias("mid_lat"), middle("lon", 125.0, 142.0).alias("mid_lon"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_heatmap(spark, sf_dir)

