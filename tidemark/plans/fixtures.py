"""Views of the driver's tables in the shapes that the flood operators take.

One text serves both engines: it is written for DuckDB and translated to Spark by the few replacements below. Only
integer arithmetic and e-notation doubles are used, so both give the same values. ``[[x]]`` is a time of x microseconds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_events": """select event_id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') as int) as k, epoch_us(ts) as us from events""",
    "v_frames": """select event_id, user_id, k, camera_id, t_us, [[1704067200000000 + t_us]] as at, case when m <= 4 then m else 0 end as stage, (66 + k % 34) / 100e0 as confidence,
        2 + k % 3 as total_votes, case when m > 4 or m = 0 then 0 else 2 + k % 3 - case when k % 10 = 0 then 1 else 0 end end as positive_votes
        from (select *, cast((user_id * 7 + (t_us // 40000000) * 13) % 7 as int) as m, 'CAM-' || lpad(cast(user_id as varchar), 4, '0') as camera_id
        from (select event_id, user_id, k, (us - 1704067200000000) // 14400 as t_us from v_events))""",
    "v_flood": """select event_id as id, user_id, k, us, 'CAM-' || lpad(cast(user_id as varchar), 4, '0') as camera_id, 'Cam ' || cast(user_id % 40 as varchar) as camera_name,
        case when k < 60 then 0 when k < 75 then 1 when k < 87 then 2 when k < 95 then 3 else 4 end as level, (50 + k % 50) / 100e0 as confidence, ts as detected_at,
        case when event_type in ('click', 'view') then 'background' when event_type in ('purchase', 'signup') then 'foreground' else 'import-7' end as record_source,
        k % 3 <> 0 as positive_confirmed from v_events""",
    "v_env": """select event_id as id, user_id, case user_id % 3 when 0 then 'rain' when 1 then 'sewer' else 'river' end as sensor_type, 'S' || cast(user_id as varchar) as sensor_id,
        'Sensor ' || cast(k % 3 as varchar) as sensor_name, value / 10e0 as value, case when user_id % 17 = 0 then null else 3588e-2 + (user_id % 20) * 2e-2 end as lat,
        case when user_id % 17 = 0 then null else 12920e-2 + ((user_id // 20) % 9) * 5e-2 end as lon, (us // 1000000) * 1000000 as us, [[(us // 1000000) * 1000000]] as observed_at, ts as read_at from v_events""",
    "v_cams": """select c_custkey, 'CAM-' || lpad(cast(c_custkey as varchar), 4, '0') as id, 'Cam ' || cast(c_custkey % 40 as varchar) as name, c_name as address,
        case when c_custkey % 23 = 0 then null else 35883e-3 + (c_custkey % 20) * 2e-2 end as lat,
        case when c_custkey % 23 = 0 then null else 129203e-3 + ((c_custkey // 20) % 9) * 5e-2 end as lon, 'http://cam/' || cast(c_custkey as varchar) as stream_url from customer""",
    "v_minute": """select event_id as id, user_id as station, us, ts as observed_at, case when event_id % 11 = 0 then null when event_id % 13 = 0 then -99e0
        else sum(cast(floor(value) as bigint) % 7) over (partition by user_id, us // 86400000000 order by us, event_id) * 1e0 end as rain_day_mm,
        case when event_id % 5 = 0 then null else (k % 30) * 1e0 end as temperature_c, k from v_events""",
    "v_boxes": """select l_orderkey as frame, l_orderkey % 15 as cam, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_quantity, l_linenumber, l_extendedprice) as box_no,
        (l_partkey % 800) * 1e0 as x1, (l_suppkey * 7 % 400) * 1e0 as y1, (l_partkey % 800) * 1e0 + 8 + l_quantity * 4 as x2,
        (l_suppkey * 7 % 400) * 1e0 + 8 + cast(l_linenumber * l_quantity as bigint) % 200 as y2, (cast(round(l_extendedprice * 100) as bigint) % 1000) / 1000e0 as conf,
        l_linenumber % 5 as cls, l_returnflag as flag, l_discount, l_tax, l_quantity from lineitem""",
    "v_truth": """select frame, cam, box_no, x1 + 3 as x1, y1 + 3 as y1, x2 + 3 as x2, y2 + 3 as y2, cls from v_boxes where flag = 'R'""",
    "v_masks": """select p_partkey as image, case when p_partkey % 5 = 0 then 'test' else 'valid' end as split, t as conf, cast(p_size * 40 + 7 as bigint) as gt,
        cast(p_size * (30 + 5 * t) + p_partkey % 11 as bigint) as pred, cast(least(p_size * 40 + 7, p_size * (30 + 5 * t) + p_partkey % 11) * (5 + t % 3) // 8 as bigint) as inter
        from part cross join (select explode_n as t from series6)""",
    "series6": """select 1 as explode_n union all select 2 union all select 3 union all select 4 union all select 5 union all select 6""",
    "v_stripes": """select l_orderkey as frame, l_orderkey % 9 as camera, l_linenumber as stripe, (l_partkey % 100) * 1e0 as y, l_quantity / 10e0 as contrast, l_discount * 10 as noise,
        l_extendedprice / 1000e0 as pos, l_suppkey, l_partkey from lineitem""",
    "v_grid": """select source_id, r, c, (2e0 + ((r - 10) * (r - 10) + (c - 10) * (c - 10)) / 80e0 + (source_id % 10) / 10e0) as elev, c = 19 as hydro
        from (select s_suppkey as source_id from supplier) cross join (select n as r from series21) cross join (select n as c from series21)""",
    "series21": "select n from series11 union all select n + 11 from series11 where n < 10",
    "series11": "select 0 as n union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7 union all select 8 union all select 9 union all select 10",
}
TABLES = "region nation customer supplier part orders lineitem events".split()
_NAME = re.compile(r"\b(v_\w+|series\d+)\b")


def needed(sql: str) -> list[str]:
    """The views that a text uses, each after those that it uses itself."""
    out: list[str] = []
    for name in _NAME.findall(sql):
        if name in VIEWS and name not in out:
            out += [x for x in needed(VIEWS[name]) if x not in out] + [name]
    return out


def duckdb(sql: str) -> str:
    """The text with the definitions of its views before it."""
    views = ", ".join(f"{n} as ({re.sub(r'\[\[(.*?)\]\]', r'make_timestamp(\1)', VIEWS[n])})" for n in needed(sql))
    body = re.sub(r"\[\[(.*?)\]\]", r"make_timestamp(\1)", sql).strip()
    if not views:
        return body
    return f"with recursive {views}, {body[len('with recursive'):] if body.lower().startswith('with recursive') else body[4:]}" if body.lower().startswith("with") else f"with {views} {body}"


def spark_text(sql: str) -> str:
    sql = re.sub(r"\[\[(.*?)\]\]", r"cast(timestamp_micros(\1) as timestamp_ntz)", sql)
    sql = re.sub(r"epoch_us\((\w+)\)", r"unix_micros(cast(\1 as timestamp))", sql)
    return sql.replace(" // ", " div ").replace("json_extract_string", "get_json_object").replace("varchar", "string")


class Tables:
    """The driver's tables and the views above, as DataFrames by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._held = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._held:
            if name in VIEWS:
                text = spark_text(VIEWS[name])
                used = [t for t in [*TABLES, *VIEWS] if re.search(rf"\b(from|join) {t}\b", text)]
                self._held[name] = self.spark.sql(re.sub(rf"\b(from|join) ({'|'.join(used)})\b", r"\1 {\2}", text), **{t: getattr(self, t) for t in used})
            else:
                self._held[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._held[name]
