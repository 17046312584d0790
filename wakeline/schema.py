"""Tables of the vessel-movement model. The order columns fix what storage order meant at ingest."""

from __future__ import annotations

from pyspark.sql import types as T


def _of(spec: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "date": T.DateType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


#: One row per reported fix; ``track_id`` is -1 while a vessel idles. (dt, file_id, ord_in_file) is the order of arrival.
POSITIONS = _of("ship_id:long timestamp:int lat:float lon:float speed:int course:int heading:int rot:int elapsed:int destination:string tile_z:int file_id:int track_id:long dt:date ord_in_file:int")
SHIPS = _of("ship_id:long mt_id:string name:string flag:string ship_type:int gt_ship_type:int length:int width:int dwt:int")
#: ``track_ord`` is the order in which voyages were closed; ties elsewhere fall by it.
TRACKS = _of("track_id:long ship_id:long start_timestamp:int end_timestamp:int start_lat:float start_lon:float end_lat:float end_lon:float points_count:int track_ord:long")
FILES = _of("file_id:int name:string positions_count:int timestamp:int")
ZONES = _of("zone_id:long name:string lat:float lon:float zoom:int")
FRAGMENTS = _of("track_id:long s:int e:int points:int t0:long t1:long min_lat:double min_lon:double max_lat:double max_lon:double")
#: The fields that the voyage-sorted layout keeps.
LAYOUT_FIELDS = ("track_id", "ship_id", "timestamp", "lat", "lon", "speed", "course", "heading", "rot", "elapsed", "destination", "tile_z", "file_id")
