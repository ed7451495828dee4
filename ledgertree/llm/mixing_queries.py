"""op3: the mix's digest, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgertree.llm import mixing
from ledgertree.llm.registry import query, table


def _permutation(rows: str, x: str, n: str, seed: str, out: str, stream: int) -> str:
    text = f"select *, {x} as {out} from ({rows})"
    for key, factor, offset in mixing.round_keys(stream):
        text = f"select *, {mixing.reflected(key, out, n, seed)} as _y from ({text})"
        text = f"select * exclude ({out}, _y), {mixing.swapped(factor, offset, out, '_y', seed)} as {out} from ({text})"
    return text


def _check() -> str:
    block, epochs = mixing.BLOCK, mixing.MAX_EPOCHS
    ranks = (
        "select sid, blocks, all_slots, first_slot + r as place, r % blocks as turn, 0 as zero"
        " from (select *, unnest(range(slots)) as r from places where slots > 0)"
    )
    dealt = _permutation(ranks, "turn", "blocks", "sid", "block", 2)
    return f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0)::bigint as size from documents
), totals as (
  select source, sum(size)::bigint as source_size from sized group by source
), numbered as (
  select *, row_number() over (order by source is null, source) as sid from totals
), weighed as (
  select *, ((sid - 1) % 3 + 1)::double as weight, (source_size * {epochs})::double as cap from numbered
), levels as (
  select *, (sum(source_size) over () - coalesce({epochs} * sum(source_size) over w, 0))::double
      / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
  from weighed window w as (order by cap / weight, sid rows between unbounded preceding and 1 preceding)
), targets as (
  select *, least(cap, max(level) over () * weight) as target,
    ceil(source_size / {block})::bigint as blocks from levels
), slotted as (
  select *, case when source_size > 0 then floor(target * blocks / source_size + 0.5) else 0 end::bigint as slots
  from targets
), places as (
  select *, coalesce(sum(slots) over (order by sid rows between unbounded preceding and 1 preceding), 0)::bigint
    as first_slot, (sum(slots) over ())::bigint as all_slots from slotted
), times as (
  select sid, block, count(*) as times from ({dealt}) group by 1, 2
), placed as (
  select s.doc_id, s.size, p.sid, p.source_size, p.target,
    coalesce(sum(s.size) over (partition by p.sid order by s.doc_id, s.size
      rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from sized s join places p on s.source is not distinct from p.source
), pieces as (
  select sid, start, block, least(start + size, (block + 1) * {block}) - greatest(start, block * {block}) as words
  from (select *, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) as block from placed where size > 0)
), used as (
  select sid, start, sum(words * times) as taken from pieces join times using (sid, block) group by 1, 2
)
select doc_id, size, source_size, target, (case when size > 0 then coalesce(taken, 0) else 0 end)::bigint as taken
from placed left join used using (sid, start)
"""


@query("op3_mixing", _check())
def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.taken_words(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")
