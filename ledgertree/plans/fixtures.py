"""Views that put the driver's tables into the shapes of ``schema.py``.

The texts are SQL both engines read, so queries and checks start from the same
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgertree.session import new_path

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "events", "pages", "conversations"]

VIEWS: dict[str, str] = {
    "fx_facts": """
select * from (
 select chr(67+r_regionkey)||':' as volume, cast(r_regionkey+1 as bigint) as file_id, cast(r_regionkey+1 as bigint) as parent_file_id, chr(67+r_regionkey)||':' as name, true as is_directory, cast(0 as bigint) as size, timestamp '1995-01-01 00:00:00' as created_at, timestamp '1995-01-01 00:00:00' as modified_at, 16 as attributes from region
 union all select chr(67+n_regionkey)||':', cast(100+n_nationkey as bigint), cast(n_regionkey+1 as bigint), n_name, true, cast(0 as bigint), timestamp '1995-01-01 00:00:00', timestamp '1995-01-01 00:00:00', 16 from nation
 union all select chr(67+n_regionkey)||':', cast(1000+c_custkey as bigint), cast(100+c_nationkey as bigint), c_name, true, cast(0 as bigint), timestamp '1995-01-01 00:00:00', timestamp '1995-01-01 00:00:00', 16 from customer join nation on c_nationkey=n_nationkey
 union all select chr(67+n_regionkey)||':', cast(1000000+o_orderkey as bigint), cast(1000+o_custkey as bigint), 'order_'||cast(o_orderkey as varchar(20))||case o_orderstatus when 'F' then '.log' when 'O' then '.PDF' else '.tmp' end, false, cast(floor(o_totalprice) as bigint), o_orderdate, o_orderdate, 32+case when o_orderkey%13=0 then 1 else 0 end+case when o_orderkey%7=0 then 2 else 0 end+case when o_orderkey%11=0 then 4 else 0 end from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey
) t
""",
    "fx_log": """
select cast(event_id+1 as bigint) as sequence, chr(67+n_regionkey)||':' as volume, cast(1000000+o_orderkey as bigint) as file_id,
 case when event_type='purchase' and event_id%4=0 then cast(100+c_nationkey as bigint) else cast(1000+o_custkey as bigint) end as parent_file_id,
 'order_'||cast(o_orderkey as varchar(20))||case when event_type='purchase' then '_v'||cast(event_id as varchar(20)) else '' end||case o_orderstatus when 'F' then '.log' when 'O' then '.PDF' else '.tmp' end as name,
 case event_type when 'signup' then 'Created' when 'purchase' then 'Renamed' when 'error' then 'Deleted' else 'Modified' end as kind,
 false as is_directory, case when event_type in ('purchase','error') then cast(0 as bigint) else cast(floor(value*100) as bigint) end as observed_size, ts as at, 'Watcher' as source
from events join orders on o_orderkey=user_id*10+event_id%10 join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey
""",
    "fx_names": """
select 'P:' as volume, cast(p_partkey+1 as bigint) as file_id, p_name||' '||cast(p_partkey as varchar(20))||'.'||lower(p_type) as name, cast(floor(p_retailprice) as bigint) as size, 32+case when p_partkey%7=0 then 2 else 0 end as attributes from part
""",
    "fx_raw": """
select event_id as usn, user_id as file_ref, case event_type when 'signup' then 256+4096 when 'error' then 512+256 when 'purchase' then 8192 else 1 end as reason, case when user_id%10=0 then 16 else 32 end as attributes, ts as at from events
""",
    "fx_paths": """
select page_id, regexp_replace(regexp_replace(url,'^https?://',''),'[?#].*$','') as path, cast(length(html) as bigint) as length from pages
""",
    "fx_proc": """
select cast(user_id as bigint) as pid, cast(floor(user_id/4) as bigint) as ppid, case when user_id%5=1 then 'Setup_'||cast(user_id as varchar(20))||'.exe' when user_id%11=2 then 'explorer.exe' else 'app_'||cast(user_id as varchar(20))||'.exe' end as image, min(ts) as started, max(ts) as stopped from events where event_id%10<8 group by user_id
""",
    "fx_file_ev": """
select ts, user_id as pid, case when event_type='click' then 12 else 15 end as event_id, case when event_id%3=0 then 'C:/Users/u/AppData/Local/App'||cast(user_id%9 as varchar(20))||'/f'||cast(event_id%20 as varchar(20)) else 'C:/Program Files/App'||cast(user_id%9 as varchar(20))||'/f'||cast(event_id%20 as varchar(20)) end as path from events where event_type in ('click','view')
""",
    "fx_reg_ev": """
select ts, user_id as pid, 'Software/CurrentVersion/Uninstall/x' as key_name, 'DisplayName' as value_name, 'App '||cast(user_id%9 as varchar(20)) as data from events where event_type='signup'
""",
    "fx_tool": """
select conv_id, turn, case when role='assistant' and turn%4=1 then 'call_'||cast(conv_id as varchar(20))||'_'||cast(turn as varchar(20)) end as tool_call_id_made, case when role='user' and turn%4=2 and conv_id%3<>0 then 'call_'||cast(conv_id as varchar(20))||'_'||cast(turn-1 as varchar(20)) end as tool_call_id_answered from conversations
""",
    "fx_writes": """
select user_id as thread_id, event_id as step, event_type as channel, cast(floor(value) as bigint) as value from events
""",
}

NOW = "2024-02-01 00:00:00"

_BUILT: dict[tuple[str, str], dict[str, DataFrame]] = {}


def forget() -> None:
    """Let the next query write its copies anew."""
    _BUILT.clear()


class Fixtures:
    """Lazily written copies of the views, one per session and data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables = _BUILT.setdefault((spark.sparkContext.applicationId, sf_dir), {})
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _written(self, name: str, df: DataFrame, layout: tuple[str, ...] = ()) -> DataFrame:
        path = new_path(self.spark, name)
        if layout:
            df = df.repartitionByRange(*layout).sortWithinPartitions(*layout)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def view(self, name: str) -> DataFrame:
        """The view as a query over the base tables."""
        for table in BASE_TABLES:
            self.base(table).createOrReplaceTempView(table)
        df = self.spark.sql(VIEWS[name])
        for field in df.schema.fields:
            if field.dataType.typeName() == "timestamp_ntz":
                df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
        return df

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._written(name, self.view(name), LAYOUT.get(name, ()))
        return self._tables[name]

    def keep(self, name: str, build, layout: tuple[str, ...] = ()) -> DataFrame:
        """A derived table, written on first use."""
        if name not in self._tables:
            self._tables[name] = self._written(name, build(), layout)
        return self._tables[name]

    def stored(self, name: str, build, order: tuple[str, ...]) -> DataFrame:
        """A derived table of many small rows: each task writes its rows in ``order``, none are moved."""
        if name not in self._tables:
            self._tables[name] = self._written(name, build().sortWithinPartitions(*order))
        return self._tables[name]

    def hold(self, name: str, build) -> DataFrame:
        """A derived table that its builder has written itself, in the order it needs."""
        if name not in self._tables:
            self._tables[name] = build()
        return self._tables[name]


LAYOUT = {"fx_log": ("volume", "sequence"), "fx_facts": ("volume", "file_id")}
