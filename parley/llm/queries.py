"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import chats, decontaminate, exact, hamming, jaccard, mixing, periods, pitman_yor, quality, sharding, spelling, substrings, surrogates
from parley.llm.common import WORD, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


@query("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.kept_digest(substrings.remove_repeats(table(spark, folder, "documents")))


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_LINKS_SQL = rf"""
with recursive w as (select doc_id, {_WORDS} as ws from documents),
s as (select distinct doc_id, sh from (
  select doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                             when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w)),
n as (select doc_id, count(*) as n from s group by 1),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by all),
link as (select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where c * 10 >= 8 * (x.n + y.n - c)),
reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a)
select doc_id, least(doc_id, (select min(b) from reach where a = doc_id)) as class_id,
       (select count(*) from link where a = doc_id) as n_links
from documents
"""


@query("op2_jaccard_join", _LINKS_SQL)
def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard.jaccard_links(table(spark, folder, "documents"))


def _mix_sql() -> str:
    """The mix in SQL: each round sums the words of a source in the order of the ranks."""
    rounds = []
    for k in range(mixing.ROUNDS):
        was = f"r{k - 1}" if k else "base"
        rounds.append(f"""
c{k} as (select *, sum(size) over (partition by source order by rank range unbounded preceding) as upto
         from {was} where size > 0 and size <= room and extra = 0),
cut{k} as (select source, min(rank) filter (upto > room) as cut, max(upto) filter (upto <= room) as used from c{k} group by 1),
r{k} as (select b.* exclude (extra, room),
           case when b.extra = 1 or (size > 0 and size <= room and (cut is null or rank < cut) and c.source is not distinct from b.source and c.found) then 1 else 0 end as extra,
           greatest(room - coalesce(used, 0), 0) as room
         from {was} b left join (select *, true as found from cut{k}) c on c.source is not distinct from b.source)""")
    return rf"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as size from documents),
src as (select source, sum(size)::bigint as words from sized group by 1),
caps as (select *, words * 3.0::double as cap,
           [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight from src),
level as (select *, (sum(words) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
                 / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as lv from caps),
target as (select source, words, least(cap, max(lv) over () * weight) as target from level),
rate as (select *, case when words > 0 then least(floor(target / words + 1e-9), 3) else 0 end::int as whole from target),
base as (select s.doc_id, s.source, s.size, r.words as source_size, r.target, r.whole,
           greatest(r.target - r.whole * r.words, 0) as room, 0 as extra,
           (u / (1 - u)) / (p / (1 - p)) as rank
         from (select *, (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint + 0.5) / 4503599627370496.0::double as u from sized) s
         join (select *, greatest(1e-12, least(1 - 1e-12, case when words > 0 then target / words - whole else 0 end)) as p from rate) r
           on r.source is not distinct from s.source),
{",".join(rounds)}
select doc_id, size::bigint as size, source_size, target, (size * (whole + extra))::bigint as taken from r{mixing.ROUNDS - 1}
"""


@query("op5_source_mix", _mix_sql())
def op5_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mix = mixing.mixed(table(spark, folder, "documents"))
    return mix.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def _shard_sql() -> str:
    names = sharding.shard_names(sharding.SHARDS)
    owners = ", ".join(map(str, sharding.fill_table(names)))
    slot = f"(('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % {sharding.SLOTS})::int"
    return f"""
with t as (select [{owners}] as owners)
select doc_id, {slot} as slot, 'shard-' || lpad((select owners[{slot} + 1] from t)::varchar, 5, '0') as shard from documents
"""


@query("op6_shard_table", _shard_sql())
def op6_shard_table(spark: SparkSession, folder: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.placed(table(spark, folder, "documents").select("doc_id"))


_CHAT_SQL = r"""
with t as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as pos,
             floor(coalesce(turn, -1) / 1024.0) as piece from conversations where conv_id is not null),
whole as (select conv_id, list({'r': role, 't': text} order by pos) as turns, count(*) as n from t group by 1),
pre as (select distinct turns[1:k] as turns from (select turns, unnest(range(1, n)) as k from whole)),
one as (select turns, min(conv_id) as conv_id from whole group by 1),
kept as (select conv_id from one where turns not in (select turns from pre))
select conv_id, row_number() over (partition by conv_id order by piece) as part, count(*) as n_turns,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by pos) as text
from t join kept using (conv_id) group by conv_id, piece
"""


@query("op7_chat_snapshots", _CHAT_SQL)
def op7_chat_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """The maximal conversations, rendered."""
    return chats.rendered(table(spark, folder, "conversations"))


_LEAK_SQL = r"""
with item as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from benchmark),
doc as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
ish as (select item_id, len(ws) as n, unnest(range(1, len(ws) - 3)) as pos, ws from item where len(ws) >= 5),
i as (select item_id, n, array_to_string(ws[pos:pos + 4], ' ') as sh, count(*) as c from ish group by all),
dsh as (select doc_id, len(ws) as words, unnest(range(1, len(ws) - 3)) as pos, ws from doc),
d as (select doc_id, words, pos, array_to_string(ws[pos:pos + 4], ' ') as sh from dsh),
pair as (select distinct doc_id, words, item_id, n, d.pos - o as start from d join i using (sh), (select unnest(range(-70, 71)) as o) where o >= 0 and o <= n - 5),
near as (select distinct p.doc_id, p.item_id, p.n, greatest(p.start, 1) as start, least(p.start + p.n - 1, p.words) as stop from pair p),
cnt as (select near.doc_id, item_id, near.n, start, stop, sh, count(*) as c from near join d on d.doc_id = near.doc_id and d.pos between start and stop - 4 group by all),
sim as (select cnt.doc_id, cnt.item_id, start, stop, sum(least(cnt.c, i.c)) as both_, any_value(stop - start - 3) as a, any_value(cnt.n - 4) as b
        from cnt join i on i.item_id = cnt.item_id and i.sh = cnt.sh group by all),
ok as (select *, both_::double / (a + b - both_) as similarity from sim where both_::double / (a + b - both_) >= 0.8)
select doc_id, item_id, (start - 1)::bigint as start, (stop - start + 1)::bigint as n_words, similarity from ok
qualify row_number() over (partition by doc_id, item_id order by similarity desc, start, stop desc) = 1
"""


@query("op9_decontamination", _LEAK_SQL)
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The best window of each document for each benchmark item it contains."""
    return decontaminate.find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op1_quality_rff")
def op1_quality_rff(spark: SparkSession, folder: str) -> DataFrame:
    """Calibrated quality of every document."""
    return quality.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_pii_surrogates")
def op3_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its personal data replaced."""
    return surrogates.with_surrogates(table(spark, folder, "documents"), key="a key that production keeps secret")


@query("op4_pitman_yor")
def op4_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document."""
    return pitman_yor.perplexity_scores(table(spark, folder, "documents"))


@query("op8_multi_index_hashing")
def op8_multi_index_hashing(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest codes of every twentieth vector."""
    return hamming.nearest(table(spark, folder, "embeddings"))


# crc32 bit by bit: every byte of the text, followed by seven zeros for its other bits
_SPELLING_SQL = r"""
with recursive runs as (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
per as (select run, coalesce(doc_id::varchar, '') || ':' || run as tagged, count(*) as c from runs group by all),
coded as (select run, c, xor(4294967295::ubigint, list_reduce(flatten(list_transform(string_split(tagged, ''), lambda x:
    case when unicode(x) < 128 then [unicode(x), 0, 0, 0, 0, 0, 0, 0]::ubigint[]
         else [192 + (unicode(x) >> 6), 0, 0, 0, 0, 0, 0, 0, 128 + (unicode(x) & 63), 0, 0, 0, 0, 0, 0, 0]::ubigint[] end)),
    lambda acc, e: xor(xor(acc, e) >> 1, 3988292384::ubigint * (xor(acc, e) & 1)), 4294967295::ubigint)) as h from per),
slipped as (select case when h % 97 = 0 then left(run, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, c from coded),
words as (select word, sum(c)::bigint as n from slipped where length(word) >= 5 group by 1 having sum(c) >= 3),
less as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
pair as (select a.word, b.word as near, b.n as near_n from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
         union select l.word, w.word, w.n from less l join words w on l.rest = w.word
         union select w.word, l.word, l.n from less l join words w on l.rest = w.word),
best as (select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from pair group by 1),
form as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * w.n then near end as form, case when near_n >= 2 * w.n then near_n end as form_n
         from words w left join best b using (word)),
up(word, root) as (select word, word from form union all select up.word, f.form from up join form f on f.word = up.root where f.form is not null)
select f.word, f.form, u.root, f.n, f.n_near::bigint as n_near, f.form_n from form f join (
  select up.word, up.root from up join form f on f.word = up.root where f.form is null) u on u.word = f.word
"""


@query("op11_spelling_variants", _SPELLING_SQL)
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequent word with its near words and the form it is a variant of."""
    return spelling.variants(spelling.counted(table(spark, folder, "documents"), slip=97))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every document, after its words were made to repeat."""
    return periods.run_digest(periods.collapsed(periods.overlaid(table(spark, folder, "documents"))))


_EXACT_SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256,
                  max(length(coalesce(text, ''))) as n from documents group by 1, 2),
w as (select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id nulls last) as keep_id,
             count(*) over (partition by text_sha256) as group_size from d)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from w
"""


@query("op13_exact_dedup", _EXACT_SQL)
def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the one of its equals that stays."""
    return exact.deduplicated(table(spark, folder, "documents"))
