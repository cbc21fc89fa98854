"""Queries over the driver's tables, one or more for each operator, with DuckDB SQL of the same meaning."""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..files import write_bytes
from ..functions import tensor, text
from ..functions.encoder import PRESETS, Config, model_files
from ..functions.wordpiece import WordPiece, decode, encode
from ..operators.batching import embed, length_batches
from ..operators.captions import caption_chunks, caption_words
from ..operators.collapse import collapse_words
from ..operators.search import presented, search, video_link
from ..operators.windowing import sliding_chunks
from ..progress import Progress
from ..shared import scratch
from ..sources.captions import read_chunks
from ..sources.index import export_files, import_files, missing_videos, read_index, with_vectors, write_index
from ..sources.safetensors import read_safetensors, write
from ..sources.vocab import read_vocab

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(values: Column) -> Column:
    """A sum of doubles, from left to right."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


# -- Search ---------------------------------------------------------------------------------


def as_index(embeddings: DataFrame) -> DataFrame:
    """The embeddings table as an index: the label is the video, rows are 15 seconds apart."""
    return embeddings.select(F.col("vec_id").alias("chunk_idx"), F.col("label").cast("string").alias("vod_id"), (F.col("vec_id") * 15.0).alias("start"), "embedding")


def _search(k: int, min_p: float) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = as_index(table(spark, sf_dir, "embeddings"))
        query = index.filter("chunk_idx = 0").select("embedding").first()[0]
        return search(index, query, k, min_p, 60.0, digits=6)

    return run


def _search_sql(k: int, min_p: float) -> str:
    """Suppression by a recursive walk: the best remaining row is kept, its neighbours go."""
    cut = f"rn <= least({k}, a + 1)" if k else "rn <= a + 1"
    return f"""
with q as (select embedding::double[] as q from embeddings where vec_id = 0),
s as (select label::varchar as vod, vec_id as idx, vec_id * 15.0::double as begin_s, round(list_inner_product(embedding::double[], q), 6) as score from embeddings, q),
g as (select vod, list([{{'s': score, 'i': idx, 't': begin_s}}] order by score desc, idx) as xs from s group by vod),
f as (select vod, unnest(list_reduce(xs, lambda a, x: case when len(list_filter(a, lambda p: abs(p.t - x[1].t) < 60)) > 0 then a else list_concat(a, x) end)) as u from g),
n as (select *, row_number() over (order by u.s desc, u.i) as rn, sum((u.s >= {min_p})::int) over () as a from f)
select (rn - 1)::int as rank, u.i as chunk_idx, vod as vod_id, u.t as start, u.s as score from n where {cut}
"""


for _name, _k, _min_p in (("vector_search", 20, 0.2), ("vector_topk", 256, 0.05), ("min_p_cut", 256, 0.35), ("unlimited_search", 0, 0.0)):
    register(_name, _search_sql(_k, _min_p))(_search(_k, _min_p))
vector_search = QUERIES["vector_search"]


@register(
    "score_scan",
    "with q as (select embedding::double[] as q from embeddings where vec_id = 0) select vec_id, round(list_inner_product(embedding::double[], q), 6) as score from embeddings, q",
)
def score_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    query = rows.filter("vec_id = 0").select("embedding").first()[0]
    return rows.select("vec_id", F.round(tensor.dot_with(query, F.col("embedding")), 6).alias("score"))


@register(
    "result_links",
    "select event_id, 'https://youtube.com/watch?v=' || user_id || '&t=' || greatest(0, least(4294967295, floor(value)))::bigint as url, printf('%.3f', value) as shown from events",
)
def result_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", video_link(F.col("user_id").cast("string"), F.col("value")).alias("url"), F.format_string("%.3f", "value").alias("shown"))


@register(
    "search_results",
    f"select rank, printf('%.3f', score) as score, 'https://youtube.com/watch?v=' || vod_id || '&t=' || start::bigint as url, 'chunk ' || chunk_idx as text from ({_search_sql(20, 0.2)})",
)
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user gets to see of vector_search."""
    index = as_index(table(spark, sf_dir, "embeddings")).withColumn("text", F.concat(F.lit("chunk "), F.col("chunk_idx").cast("string")))
    return presented(vector_search(spark, sf_dir), index)


# -- Text -----------------------------------------------------------------------------------


@register("strip_tags", "select page_id, regexp_replace(html, '<[^>]*>?|>', '', 'g') as plain from pages")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


@register(
    "entity_decode",
    "select page_id, nfc_normalize(replace(replace(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&middot;', chr(183)), '&copy;', chr(169)), '&quot;', '\"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) as decoded from pages",
)
def entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.decode_entities(F.col("html")).alias("decoded"))


_WORD = r"[\p{L}\p{N}]"
_BASIC = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s\x{00}-\x{1f}\x{7f}-\x{9f}]"


@register("basic_tokens", f"select doc_id, regexp_extract_all(lower(text), '{_BASIC}') as tokens from documents")
def basic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.basic_tokens(F.col("text")).alias("tokens"))


@register(
    "norm_tokens",
    "select doc_id, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''), lambda t: lower(regexp_replace(t, '[^\\p{L}\\p{N}'']', '', 'g'))) as norms from documents",
)
def norm_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(text.ws_tokens(F.col("text")), text.norm_token).alias("norms"))


@register("clean_text", "select doc_id, replace(replace(replace(replace(replace(text, chr(9), ' '), chr(10), ' '), '>', ''), 'vak', 'vac'), 'vax', 'vac''s') as cleaned from documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_caption(F.col("text")).alias("cleaned"))


@register("query_nouns", "select doc_id, replace(replace(replace(lower(text), 'walf', 'wolf'), 'kerobel', 'carobel'), 'tini', 'tiny') as query from documents")
def query_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.query_nouns(F.col("text")).alias("query"))


@register(
    "merge_punct",
    r"""
with w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') as t from documents)
select doc_id, regexp_replace(t[1], '[^\p{L}\p{N}'']+$', '') || case when regexp_matches(t[-1], '[\p{L}\p{N}'']') then regexp_extract(t[-1], '[^\p{L}\p{N}'']*$') else '' end as merged
from w where len(t) > 0""",
)
def merge_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", text.ws_tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    return words.select("doc_id", text.merge_punct(F.element_at("t", 1), F.element_at("t", -1)).alias("merged"))


@register(
    "collapse_runs",
    r"""
with w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') as ts from documents),
e as (select doc_id, unnest(ts) as t, generate_subscripts(ts, 1) as i from w),
n as (select *, lower(regexp_replace(t, '[^\p{L}\p{N}'']', '', 'g')) as n from e),
b as (select *, case when n <> '' and n = lag(n) over (partition by doc_id order by i) then 0 else 1 end as new from n),
r as (select *, sum(new) over (partition by doc_id order by i) as run from b),
m as (select *, row_number() over (partition by doc_id, run order by i) as p, count(*) over (partition by doc_id, run) as size, last_value(t) over (partition by doc_id, run order by i rows between unbounded preceding and unbounded following) as tail from r),
k as (select doc_id, i, case when size > 3 and p = 3 then regexp_replace(t, '[^\p{L}\p{N}'']+$', '') || regexp_extract(tail, '[^\p{L}\p{N}'']*$') else t end as t from m where p <= 3)
select d.doc_id, coalesce(string_agg(k.t, ' ' order by k.i), '') as collapsed from documents d left join k using (doc_id) group by d.doc_id""",
)
def collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_words(table(spark, sf_dir, "documents"), "doc_id", "text", 3)


def collapse_sql(texts: str, passes: int = 5, most: int = 4, keep: int = 3) -> str:
    """The repeated collapse of runs over (id, text), as (id, collapsed): pass by pass until no row changes.

    Where a pass may cut a run is known for each word beforehand (f: the shortest n-gram whose run is long enough); the recursive
    part only follows, text by text, from the end of one cut run to the next place to cut. A text that still changes after
    the last pass is an error.
    """
    norm = r"lower(regexp_replace(t, '[^\p{L}\p{N}'']', '', 'g'))"
    steps = [
        rf"src as ({texts})",
        r"split_up as (select id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') as ts from src)",
        f"w0 as (select id, i, t, {norm} as n from (select id, unnest(ts) as t, unnest(range(len(ts))) as i from split_up))",
    ]
    ends = []
    for k in range(passes):
        same = ", ".join(f"coalesce(n = lead(n, {g}) over o, false) as e{g}" for g in range(1, most + 1))
        some = ", ".join(f"max((n <> '')::int) over (partition by id order by i rows between current row and {g - 1} following) as z{g}" for g in range(1, most + 1))
        steps.append(f"a{k} as (select *, {some}, {same} from w{k} window o as (partition by id order by i))")
        runs = ", ".join(f"coalesce(min(case when not e{g} then i end) over ahead, i) - i as r{g}" for g in range(1, most + 1))
        steps.append(f"b{k} as (select *, {runs} from a{k} window ahead as (partition by id order by i rows between current row and unbounded following))")
        found = " ".join(f"when z{g} = 1 and r{g} >= {keep * g} then {g}" for g in range(1, most + 1))
        steps.append(f"f{k} as (select id, i, g, i + g * ((case g {' '.join(f'when {g} then r{g}' for g in range(1, most + 1))} end) // g + 1) as stop from (select *, case {found} end as g from b{k}) where g is not null)")
        steps.append(f"j{k} as (select a.id, a.i, a.g, a.stop, b.i as nxt from f{k} a asof left join f{k} b on a.id = b.id and a.stop <= b.i)")
        steps.append(f"c{k} as (select id, i, g, stop, nxt from j{k} where (id, i) in (select id, min(i) from f{k} group by id) union all select j.id, j.i, j.g, j.stop, j.nxt from c{k} c join j{k} j on c.id = j.id and c.nxt = j.i)")
        steps.append(f"t{k} as (select w.id, w.i, w.t, c.i as at, c.g, c.stop from w{k} w asof left join c{k} c on w.id = c.id and w.i >= c.i)")
        cut = rf"regexp_replace(x.t, '[^\p{{L}}\p{{N}}'']+$', '') || case when regexp_matches(y.t, '[\p{{L}}\p{{N}}'']') then regexp_extract(y.t, '[^\p{{L}}\p{{N}}'']*$') else '' end"
        kept = f"select x.id, x.i, case when x.i = x.at + {keep} * x.g - 1 then {cut} else x.t end as t from t{k} x left join w{k} y on y.id = x.id and y.i = x.stop - 1 and x.i = x.at + {keep} * x.g - 1 where x.at is null or x.i < x.at + {keep} * x.g or x.i >= x.stop"
        # Only texts that changed go on to the next pass.
        steps.append(f"w{k + 1} as (select id, row_number() over (partition by id order by i) - 1 as i, t, {norm} as n from ({kept}) where id in (select id from f{k}))")
        ends.append(f"select id, string_agg(t, ' ' order by i) as collapsed from w{k} where id not in (select id from f{k}) group by id")
    ends.append(f"select id, error('a text changes still') as collapsed from w{passes} group by id")
    steps.append(f"ended as ({' union all '.join(ends)})")
    return f"with recursive {', '.join(steps)} select src.id, coalesce(collapsed, '') as collapsed from src left join ended on src.id = ended.id"


@register("collapse_full", f"select id as doc_id, collapsed from ({collapse_sql('select doc_id as id, text from documents')})")
def collapse_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.collapse(F.col("text")).alias("collapsed"))


_NORMS = r"list_transform({0}, lambda t: lower(regexp_replace(t, '[^\p{{L}}\p{{N}}'']', '', 'g')))"


@register(
    "merge_overlap_turns",
    rf"""
with p as (
  select conv_id, turn, text || ' ' || coalesce(array_to_string(list_filter(regexp_split_to_array(nxt, '\s+'), lambda t: t <> '')[1:2], ' '), '') as a, nxt as b
  from (select *, lead(text) over (partition by conv_id order by turn) as nxt from conversations) where nxt is not null),
t as (select *, list_filter(regexp_split_to_array(a, '\s+'), lambda t: t <> '') as a_t, list_filter(regexp_split_to_array(b, '\s+'), lambda t: t <> '') as b_t from p),
n as (select *, {_NORMS.format("a_t")} as an, {_NORMS.format("b_t")} as bn from t),
k as (select *, list_max(list_filter(range(2, least(len(a_t), len(b_t)) + 1), lambda k: an[len(an) - k + 1:len(an)] = bn[1:k])) as k from n)
select conv_id, turn, case when k is null then a || ' ' || b else array_to_string(list_concat(a_t, b_t[k + 1:len(b_t)]), ' ') end as merged from k""",
)
def merge_overlap_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn, prolonged by the first two words of the next one, merged with that next one."""
    rows = table(spark, sf_dir, "conversations").withColumn("b", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("b is not null")
    a = F.concat("text", F.lit(" "), F.array_join(F.slice(text.ws_tokens(F.col("b")), F.lit(1), F.lit(2)), " "))
    return rows.select("conv_id", "turn", text.merge_overlap(a, F.col("b"), 2).alias("merged"))


@register(
    "parse_timecode",
    """
with t as (select event_id, case event_id % 4 when 0 then strftime(ts, '%H:%M:%S.') || (event_id % 1000) when 1 then ' ' || strftime(ts, '%M:%S.') || '5 ' when 2 then strftime(ts, '%H:%M:%S,') || '500' else 'c.colorE5' end as code from events),
p as (select *, trim(code) as c, instr(trim(code), '.') as dot from t)
select event_id, case when event_id % 4 in (0, 1) then list_reduce(list_transform(string_split(c[1:dot - 1], ':'), lambda x: x::double), lambda a, x: a * 60 + x) + c[dot + 1:]::double / 1000 end as seconds from p""",
)
def parse_timecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 4
    code = (
        F.when(kind == 0, F.concat(F.date_format("ts", "HH:mm:ss."), (F.col("event_id") % 1000).cast("string")))
        .when(kind == 1, F.concat(F.lit(" "), F.date_format("ts", "mm:ss."), F.lit("5 ")))
        .when(kind == 2, F.concat(F.date_format("ts", "HH:mm:ss,"), F.lit("500")))
        .otherwise("c.colorE5")
    )
    return table(spark, sf_dir, "events").select("event_id", text.parse_timecode(code).alias("seconds"))


# -- Captions -------------------------------------------------------------------------------


def as_captions(conversations: DataFrame) -> DataFrame:
    """Each conversation as a caption file: a cue every ten seconds, a turn on one line, with tags and a channel mark.

    Every second cue has a blank line and a further line with a time tag and the mask of a swear word. Every third cue
    repeats the last line before it first, as captions that roll up do; every third has another first line, which isn't a repeat.
    """
    code = lambda seconds: F.format_string("%02d:%02d:%02d.000", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)
    at = F.col("turn") * 10
    line = F.translate(F.coalesce("text", F.lit("")), "\n\r\t", "   ")
    more = F.concat(F.lit("and More<"), code(at + 5), F.lit("><c> then</c> [&nbsp;__&nbsp;]"))
    even = F.col("turn") % 2 == 0
    last = F.when(even, F.lit("and More then [&nbsp;__&nbsp;]")).otherwise(F.concat(text.strip_tags(line), F.lit("&gt;&gt;")))
    rows = conversations.select("conv_id", "turn", code(at).alias("code"), line.alias("line"), more.alias("more"), even.alias("even"), F.lag(last).over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))
    first = F.when((F.col("turn") % 3 == 1) & F.col("before").isNotNull(), F.concat("before", F.lit(" \n"))).when(F.col("turn") % 3 == 2, F.lit("Note\n")).otherwise(F.lit(""))
    rest = F.when(F.col("even"), F.concat(F.lit("\n \t\n"), F.col("more"))).otherwise(F.lit(""))
    cue = F.concat("code", F.lit(" --> "), "code", F.lit("\n"), first, F.lit("<c>"), "line", F.lit("</c>&gt;&gt;"), rest)
    cues = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("cues"))
    return cues.select("conv_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join("cues.cue", "\n\n")).alias("source"))


_CAPTION_WORDS = r"""
with w as (
  select conv_id, turn, list_concat(case when turn % 3 = 2 then [{'t': 'note', 's': turn * 10.0::double}] else [] end,
    list_transform(list_filter(regexp_split_to_array(lower(translate(coalesce(text, ''), chr(10) || chr(13) || chr(9), '   ')) || '>>', '\s+'), lambda t: t <> ''), lambda t: {'t': t, 's': turn * 10.0::double}),
    case when turn % 2 = 0 then [{'t': 'and', 's': turn * 10.0::double}, {'t': 'more', 's': turn * 10.0::double}, {'t': 'then', 's': turn * 10.0::double + 5}, {'t': '[swears]', 's': turn * 10.0::double + 5}] else [] end) as ws
  from conversations),
e as (select conv_id, turn, unnest(ws) as x, generate_subscripts(ws, 1) as i from w)
select conv_id, (row_number() over (partition by conv_id order by turn, i) - 1)::int as seq, x.t as text, x.s as t from e"""


@register("caption_words", _CAPTION_WORDS)
def caption_words_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caption_words(as_captions(table(spark, sf_dir, "conversations")), "conv_id", "source")


_CAPTION_CHUNKS = rf"""
with w as ({_CAPTION_WORDS}),
s as (select conv_id, arg_min(t, seq) as t0, arg_max(t, seq) as t1 from w group by conv_id),
x as (select conv_id, unnest(range(floor((t1 - t0) / 15)::bigint + 1)) as g, t0 from s),
i as (select x.conv_id, g, seq, text, t from x join w on w.conv_id = x.conv_id and t >= t0 + g * 15.0 and t < t0 + g * 15.0 + 30.0),
c as (select conv_id, g, string_agg(text, ' ' order by seq) as text, min(t) as start, max(t) as "end" from i group by conv_id, g),
n as (select *, row_number() over (partition by conv_id order by g) - 1 as k from c),
f as (select id, collapsed from ({collapse_sql("select conv_id || '/' || k as id, replace(replace(replace(replace(replace(text, chr(9), ' '), chr(10), ' '), '>', ''), 'vak', 'vac'), 'vax', 'vac''s') as text from n")}))
select conv_id, k::int as k, collapsed as text, start, "end" from n join f on f.id = conv_id || '/' || k"""


@register("caption_chunks", _CAPTION_CHUNKS)
def caption_chunks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caption_chunks(as_captions(table(spark, sf_dir, "conversations")), "conv_id", "source")


@register("caption_files", f"select conv_id::varchar as vod_id, text, start, \"end\" from ({_CAPTION_CHUNKS})")
def caption_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chunks by way of files: <base>/<channel>/raw/<conversation>.en.vtt, beside a file that is no channel."""
    base = scratch(spark, "subs")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, source in zip(*[c.to_pylist() for c in batch.columns]):
                write_bytes(f"{base}/channel{conv % 4}/raw/{conv}.en.vtt", source.encode())
            yield batch.select(["conv_id"])

    files = as_captions(table(spark, sf_dir, "conversations"))
    if files.select("conv_id", "source").mapInArrow(save, "conv_id long").count() == 0:
        return spark.createDataFrame([], "vod_id string, text string, start double, end double")
    write_bytes(f"{base}/readme.txt", b"no channel")
    return read_chunks(spark, base).select("vod_id", "text", "start", "end")


# -- Windows, tokens, batches ---------------------------------------------------------------


@register(
    "sliding_chunks",
    """
with w as (select user_id, event_id as seq, event_type as text, epoch_us(ts) / 1000000.0 as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
s as (select user_id, min(t) as t0 from w group by user_id),
x as (select w.*, t0, unnest(range(greatest(0, floor((t - t0 - 21600) / 10800)::bigint), floor((t - t0) / 10800)::bigint + 2)) as k from w join s using (user_id)),
i as (select *, t0 + k * 10800.0 as ws from x where t >= t0 + k * 10800.0 and t < t0 + k * 10800.0 + 21600.0)
select user_id, k::int as k, string_agg(text, ' ' order by n) as text, min(t) as start, max(t) as "end" from i group by user_id, k""",
)
def sliding_chunks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour windows every three hours over each user's events."""
    in_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    words = table(spark, sf_dir, "events").select("user_id", F.row_number().over(in_time).alias("seq"), F.col("event_type").alias("text"), (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6).alias("t"))
    return sliding_chunks(words, 21600.0, 10800.0, key="user_id")


#: Whole words, pieces and signs for the WordPiece queries; real vocabularies aren't shipped.
TOY_VOCAB = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz", *[f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz"], "the", "th", "er", "on", "##th", "##er", "##on", "##ing", "and", "of", ".", ",", "|"]


@register(
    "wordpiece_encode",
    f"""
with recursive v as (select unnest({TOY_VOCAB!r}) as tok, generate_subscripts({TOY_VOCAB!r}, 1) - 1 as id),
w as (select distinct unnest(regexp_extract_all(lower(text), '{_BASIC}')) as word from documents),
p as (
  select word, 0 as done, []::int[] as ids, length(word) > 100 as bad from w
  union all
  select word, done + coalesce(n, 0), list_append(ids, id::int), n is null
  from (
    select p.*, c.n, c.id from p left join lateral (
      select length(tok) - 2 * (done > 0)::int as n, id from v
      where length(word) > done and tok not in ('[PAD]', '[UNK]', '[CLS]', '[SEP]') and (tok like '##%') = (done > 0) and starts_with(substr(word, done + 1), case when done > 0 then substr(tok, 3) else tok end)
      order by 1 desc limit 1) c on true
    where not bad and done < length(word))),
e as (select word, case when bool_or(bad) then [1] else arg_max(ids, done) end as pieces from p group by word),
o as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from (select doc_id, regexp_extract_all(lower(text), '{_BASIC}') as ws from documents)),
j as (select doc_id, flatten(list(pieces order by i)) as ids from o join e using (word) group by doc_id)
select d.doc_id, list_concat(list_concat([2], coalesce(j.ids, [])[1:254]), [3])::int[] as ids from documents d left join j using (doc_id)""",
)
def wordpiece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", encode(spark, WordPiece(TOY_VOCAB), F.col("text")).alias("ids"))


@register(
    "wordpiece_decode",
    f"select doc_id, list_transform(ids, lambda i: ({TOY_VOCAB!r})[i + 1]) as tokens from ({ORACLES['wordpiece_encode']})",
)
def wordpiece_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = WordPiece(TOY_VOCAB)
    return wordpiece_encode(spark, sf_dir).select("doc_id", decode(vocab, F.col("ids")).alias("tokens"))


@register("length_batches", "select doc_id, n_chars, ((row_number() over (order by n_chars, doc_id) - 1) // 64)::bigint as batch from documents")
def length_batches_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 64)


# -- Tensors --------------------------------------------------------------------------------


def rounded(v: Column) -> Column:
    """Six digits, with no negative zero."""
    return F.transform(v, lambda x: F.round(x, 6) + F.lit(0.0))


_R6 = "list_transform({0}, lambda x: round(x, 6) + 0.0)"
_E = "list_transform(embedding, lambda x: x::double)"
_WEIGHT = [[((r * 7 + c * 3) % 11 - 5) / 10 for c in range(64)] for r in range(4)]
_BIAS = [0.1, -0.2, 0.3, -0.4]


@register("linear_layer", f"select vec_id, {_R6.format('[' + ', '.join(f'list_inner_product({_E}, {w}::double[]) + {b}' for w, b in zip(_WEIGHT, _BIAS)) + ']')} as y from embeddings")
def linear_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(tensor.linear(F.col("embedding"), _WEIGHT, _BIAS)).alias("y"))


@register("matmul", f"select e.vec_id as row, w.col, round(list_inner_product({_E}, w.w), 6) + 0.0 as value from embeddings e, (select unnest({_WEIGHT}::double[][]) as w, unnest([0, 1, 2, 3]::int[]) as col) w")
def matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x")).select("vec_id", "k", F.col("x").cast("double").alias("x"))
    w = spark.createDataFrame([(r, c, v) for r, row in enumerate(_WEIGHT) for c, v in enumerate(row)], "col int, k int, w double")
    return tensor.matmul_t(x, w).withColumn("value", F.round("value", 6) + F.lit(0.0))


_G, _B = [1 + i / 64 for i in range(64)], [i / 100 for i in range(64)]


@register(
    "layer_norm",
    f"""
with e as (select vec_id, {_E} as v from embeddings), m as (select *, list_avg(v) as mu from e), s as (select *, list_avg(list_transform(v, lambda x: (x - mu) * (x - mu))) as var from m)
select vec_id, {_R6.format(f"list_transform(list_zip(v, {_G}::double[], {_B}::double[]), lambda z: (z[1] - mu) / sqrt(var + 1e-12) * z[2] + z[3])")} as y from s""",
)
def layer_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(tensor.layer_norm(F.col("embedding").cast("array<double>"), lit(_G), lit(_B), 1e-12)).alias("y"))


@register("softmax", f"with e as (select vec_id, {_E} as v from embeddings), x as (select vec_id, list_transform(v, lambda a: exp(a - list_max(v))) as x from e) select vec_id, {_R6.format('list_transform(x, lambda a: a / list_sum(x))')} as y from x")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(tensor.softmax(F.col("embedding"))).alias("y"))


_ERF_SQL = "(case when {z} < 0 then -1.0 else 1.0 end) * (1.0::double - (((((1.0614054::double * t({z}) - 1.4531521::double) * t({z})) + 1.4214138::double) * t({z}) - 0.28449672::double) * t({z}) + 0.2548296::double) * t({z}) * exp(-{z} * {z}))"
_GELU_SQL = "0.5 * (4 * x) * (1.0 + " + _ERF_SQL.replace("t({z})", "(1.0 / (1.0 + 0.3275911::double * abs({z})))").format(z="(4 * x / 1.4142135623730951::double)") + ")"


@register("gelu", f"select vec_id, {_R6.format(f'list_transform({_E}, lambda x: {_GELU_SQL})')} as y from embeddings")
def gelu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(tensor.map_values(F.col("embedding").cast("array<double>"), lambda x: tensor.gelu(4 * x))).alias("y"))


@register("l2_normalize", f"with e as (select vec_id, list_transform({_E}, lambda x: 3 * x) as v from embeddings) select vec_id, {_R6.format('list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12))')} as y from e")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = tensor.map_values(F.col("embedding").cast("array<double>"), lambda x: 3 * x)
    return table(spark, sf_dir, "embeddings").select("vec_id", three.alias("v")).select("vec_id", rounded(tensor.l2_normalize(F.col("v"))).alias("y"))


@register("residual_add", f"select vec_id, {_R6.format(f'list_transform(list_zip({_E}, {_B}::double[]), lambda z: z[1] + z[2])')} as y from embeddings")
def residual_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(tensor.add(F.col("embedding").cast("array<double>"), F.array(*[F.lit(x) for x in _B]))).alias("y"))


@register("mean_pool", f"with e as (select label, unnest({_E}) as x, generate_subscripts(embedding, 1) as p from embeddings), m as (select label, p, avg(x) as m from e group by label, p) select label, {_R6.format('list(m order by p)')} as pooled from m group by label")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.mean_pool(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", rounded(F.col("pooled")).alias("pooled"))


@register(
    "self_attention",
    f"""
with e as (select vec_id, label, {_E} as v from embeddings),
s as (select a.vec_id, b.vec_id as other, a.label, list_inner_product(a.v, b.v) / 8.0 as s, b.v from e a join e b using (label)),
m as (select *, max(s) over (partition by vec_id) as top from s),
x as (select *, exp(s - top) as w, sum(exp(s - top)) over (partition by vec_id) as total from m),
c as (select vec_id, w / total as w, unnest(v) as x, generate_subscripts(v, 1) as p from x),
y as (select vec_id, p, sum(w * x) as y from c group by vec_id, p)
select vec_id, {_R6.format('list(y order by p)')} as y from y group by vec_id""",
)
def self_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention of every vector among all those of its label."""
    out = tensor.self_attention(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", 8.0)
    return out.select("vec_id", rounded(F.col("y")).alias("y"))


@register(
    "half_decode",
    """
with b as (select range as bits, range >> 15 as s, (range >> 10) & 31 as e, range & 1023 as m, (range >> 7) & 255 as be, range & 127 as bm from range(65536))
select bits::int as bits, case when e = 31 then case when m = 0 then (case when s = 1 then '-' else '' end) || 'inf' else 'nan' end else 'finite' end as half_kind,
  case when e = 31 then 0.0 when e = 0 then (1 - 2 * s) * m * pow(2.0, -24) + 0.0 else (1 - 2 * s) * pow(2.0, e - 25) * (m + 1024) end as half,
  case when be = 255 then 0.0 when be = 0 then (1 - 2 * s) * bm * pow(2.0, -133) + 0.0 else (1 - 2 * s) * pow(2.0, be - 134) * (bm + 128) end as bfloat
from b""",
)
def half_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    half, brain = tensor.half_to_float(F.col("bits")), tensor.bfloat_to_float(F.col("bits"))
    finite = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x + F.lit(0.0))
    kind = F.when(F.isnan(half), "nan").when(half == float("inf"), "inf").when(half == float("-inf"), "-inf").otherwise("finite")
    return spark.range(65536).select(F.col("id").cast("int").alias("bits")).select("bits", kind.alias("half_kind"), finite(half).alias("half"), finite(brain).alias("bfloat"))


# -- Index, weights, encoder ----------------------------------------------------------------


@register("incremental_anti", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def incremental_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (as videos) that the labels (as an index) don't hold."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vod_id"), "source")
    return missing_videos(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vod_id"))).select(F.col("vod_id").alias("doc_id"), "source")


@register("index_roundtrip", "select vec_id as chunk_idx, label::varchar as vod_id, vec_id * 15.0::double as start, embedding from embeddings")
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as an index, and read again."""
    rows = as_index(table(spark, sf_dir, "embeddings"))
    chunks = rows.select("chunk_idx", "vod_id", F.lit("").alias("text"), "start", F.col("start").alias("end"))
    path = scratch(spark, "index")
    write_index(with_vectors(chunks, rows.select("chunk_idx", "embedding")), path, "toy", 64, buckets=8)
    return read_index(spark, path, "toy").select("chunk_idx", "vod_id", "start", "embedding")


TOY = Config(hidden=32, heads=2, layers=1, intermediate=64)


def _toy(rows: int, cols: int, seed: int) -> np.ndarray:
    """A matrix of sixty-fourths, which single precision holds exactly and SQL can work out again."""
    r, c = np.indices((rows, cols))
    return (((r * 7 + c * 13 + seed * 5) % 17 - 8) / 64).astype(np.float32)


def _toy_lines(config: Config, layer: int) -> list[tuple[str, str, int, int, int]]:
    """Short name, name, rows, columns and seed of a layer's matrices."""
    h, m, s = config.hidden, config.intermediate, 10 * layer
    at = f"encoder.layer.{layer}."
    return [
        ("q", f"{at}attention.self.query", h, h, s + 11),
        ("k", f"{at}attention.self.key", h, h, s + 12),
        ("v", f"{at}attention.self.value", h, h, s + 13),
        ("o", f"{at}attention.output.dense", h, h, s + 14),
        ("up", f"{at}intermediate.dense", m, h, s + 15),
        ("down", f"{at}output.dense", h, m, s + 16),
    ]


def _toy_norms(layer: int) -> list[tuple[str, int]]:
    return [(f"encoder.layer.{layer}.attention.output.LayerNorm", 10 * layer + 17), (f"encoder.layer.{layer}.output.LayerNorm", 10 * layer + 18)]


def toy_weights(config: Config, vocab: int, positions: int = 256) -> dict[str, np.ndarray]:
    """Toy weights under the names that such models use."""
    h = config.hidden
    out = {"embeddings.word_embeddings.weight": _toy(vocab, h, 1), "embeddings.position_embeddings.weight": _toy(positions, h, 2), "embeddings.token_type_embeddings.weight": _toy(2, h, 3)}
    norms = [("embeddings.LayerNorm", 4)]
    for i in range(config.layers):
        for _, name, rows, cols, seed in _toy_lines(config, i):
            out |= {f"{name}.weight": _toy(rows, cols, seed), f"{name}.bias": _toy(1, rows, seed + 100)[0]}
        norms += _toy_norms(i)
    for name, seed in norms:
        out |= {f"{name}.weight": 1 + _toy(1, h, seed)[0], f"{name}.bias": _toy(1, h, seed + 100)[0]}
    return out


def encoder_sql(ids: str, config: Config) -> str:
    """The whole forward pass over (doc_id, ids), a row a token: norms, attention by head, feed-forward, mean, unit length."""
    h, d = config.hidden, config.hidden // config.heads
    cell = lambda r, c, seed: f"(({r} * 7 + {c} * 13 + {seed * 5}) % 17 - 8) / 64::double"
    vector = lambda n, seed, plus="": f"list_transform(range({n}), lambda c: {plus}{cell('0', 'c', seed)})"
    steps = [f"tok as (select doc_id, i, ids[i + 1] as id from (select doc_id, ids, unnest(range(len(ids))) as i from ({ids})))"]
    last = "e0"
    steps.append(f"e0 as (select doc_id, i, list_transform(range({h}), lambda c: {cell('id', 'c', 1)} + {cell('i', 'c', 2)} + {cell('0', 'c', 3)}) as x from tok)")

    def normed(name: str, source: str, seed: int) -> str:
        steps.append(f"{name}a as (select doc_id, i, x, list_avg(x) as mu from {source})")
        steps.append(f"{name}b as (select *, list_avg(list_transform(x, lambda a: (a - mu) * (a - mu))) as var from {name}a)")
        scaled = f"list_transform(list_zip(x, {vector(h, seed, '1 + ')}, {vector(h, seed + 100)}), lambda z: (z[1] - mu) / sqrt(var + {config.eps!r}::double) * z[2] + z[3])"
        steps.append(f"{name} as (select doc_id, i, {scaled} as x from {name}b)")
        return name

    last = normed("n0", last, 4)
    for layer in range(config.layers):
        lines = {short: (rows, cols, seed) for short, _, rows, cols, seed in _toy_lines(config, layer)}
        first, second = (seed for _, seed in _toy_norms(layer))

        n = f"l{layer}"
        zipped = [f"list_zip(list_transform(range({rows}), lambda r: list_transform(range({cols}), lambda c: {cell('r', 'c', seed)})), {vector(rows, seed + 100)}) as w{short}" for short, (rows, cols, seed) in lines.items()]
        steps.append(f"{n}z as materialized (select {', '.join(zipped)})")  # worked out once, not for each token

        def linear(short: str, x: str) -> str:
            return f"list_transform(w{short}, lambda z: list_inner_product(z[1], {x}) + z[2])"

        steps.append(f"{n}q as (select doc_id, i, x, {linear('q', 'x')} as q, {linear('k', 'x')} as k, {linear('v', 'x')} as v from {last}, {n}z)")
        steps.append(f"{n}kv as (select doc_id, list(k order by i) as k, list(v order by i) as v from {n}q group by doc_id)")
        part = f"head * {d} + 1:head * {d} + {d}"
        steps.append(f"{n}h as (select doc_id, head, list_transform(k, lambda a: a[{part}]) as ks, list_transform(range({d}), lambda c: list_transform(v, lambda a: a[head * {d} + c + 1])) as vs from {n}kv, range({config.heads}) t(head))")
        scores = f"select q.doc_id, q.i, head, vs, list_transform(ks, lambda a: list_inner_product(a, q.q[{part}]) / sqrt({d}::double)) as s from {n}q q join {n}h h on q.doc_id = h.doc_id"
        weights = f"select doc_id, i, head, vs, list_transform(s, lambda a: exp(a - top)) as w from (select *, list_max(s) as top from ({scores} where q.doc_id % 8 = {{}}))"
        # Eight branches run side by side; together they hold all documents.
        steps.append(f"{n}t as ({' union all '.join(f'select doc_id, i, head, list_sum(w) as total, w, vs from ({weights.format(k)})' for k in range(8))})")
        steps.append(f"{n}c as (select doc_id, i, flatten(list(c order by head)) as c from (select doc_id, i, head, list_transform(vs, lambda a: list_inner_product(a, w) / total) as c from {n}t) group by doc_id, i)")
        steps.append(f"{n}o as (select q.doc_id, q.i, list_transform(list_zip({linear('o', 'c.c')}, q.x), lambda z: z[1] + z[2]) as x from {n}z, {n}q q join {n}c c on q.doc_id = c.doc_id and q.i = c.i)")
        a = normed(f"{n}n", f"{n}o", first)
        steps.append(f"{n}u as (select doc_id, i, x, list_transform({linear('up', 'x')}, lambda x: {_GELU_SQL.replace('4 * x', 'x')}) as u from {a}, {n}z)")
        steps.append(f"{n}d as (select doc_id, i, list_transform(list_zip({linear('down', 'u')}, x), lambda z: z[1] + z[2]) as x from {n}u, {n}z)")
        last = normed(f"{n}y", f"{n}d", second)
    steps.append(f"mean as (select doc_id, list(m order by p) as v from (select doc_id, p, avg(a) as m from (select doc_id, unnest(x) as a, unnest(range({h})) as p from {last}) group by doc_id, p) group by doc_id)")
    return f"with {', '.join(steps)} select doc_id, {_R6.format('list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12))')} as embedding from mean"


def toy_model(spark: SparkSession) -> str:
    path = f"{scratch(spark, 'toy')}/model.safetensors"
    write(path, toy_weights(TOY, len(TOY_VOCAB)))
    return path


@register("embed_texts", encoder_sql(ORACLES["wordpiece_encode"], TOY))
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of all documents under toy weights, in double precision and to six digits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = embed(docs, WordPiece(TOY_VOCAB), toy_model(spark), TOY, tasks=4 * spark.sparkContext.defaultParallelism, keep=["doc_id"], double=True)
    return out.select("doc_id", rounded(F.col("embedding")).alias("embedding"))


@register(
    "read_weights",
    "select 'w' || r as name, ['F32', 'F16', 'BF16'][r % 3 + 1] as dtype, [r + 1, 4]::bigint[] as shape, list_transform(range(4 * (r + 1)), lambda i: ((i - 6) / 8.0)::float) as values from range(3) t(r)",
)
def read_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three small files, one in each type, through the data source."""
    folder, parts = scratch(spark, "toy"), []
    for r, dtype in enumerate(("F32", "F16", "BF16")):
        path = f"{folder}/{r}.safetensors"
        write(path, {f"w{r}": ((np.arange(4 * (r + 1)) - 6) / 8).reshape(r + 1, 4)}, dtype)
        parts.append(read_safetensors(spark, path))
    return parts[0].union(parts[1]).union(parts[2])


@register("vocab_table", f"select unnest({TOY_VOCAB!r}) as token, (generate_subscripts({TOY_VOCAB!r}, 1) - 1)::int as id")
def vocab_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark, 'toy')}/vocab.txt"
    write_bytes(path, "\n".join(TOY_VOCAB).encode())
    return read_vocab(spark, path)


@register("index_files", "select vec_id as chunk_idx, label::varchar as vod_id, 'chunk ' || vec_id as text, vec_id * 15.0::double as start, vec_id * 15.0::double as \"end\", embedding from embeddings")
def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as vectors.f32 and meta.json, and read again."""
    rows = as_index(table(spark, sf_dir, "embeddings"))
    path = scratch(spark, "files")
    export_files(rows.withColumns({"text": F.concat(F.lit("chunk "), F.col("chunk_idx").cast("string")), "end": F.col("start")}), path)
    return import_files(spark, path, block=1 << 12)


@register(
    "model_registry",
    """
select * from (values ('mini-lm', 'models/all-MiniLM-L6-v2/model.safetensors', 'models/all-MiniLM-L6-v2/vocab.txt', 384, 12, 6, 1536), ('gte-small', 'models/gte-small/model.safetensors', 'models/gte-small/vocab.txt', 384, 12, 12, 1536),
  ('gte-base', 'models/gte-base/model.safetensors', 'models/gte-base/vocab.txt', 768, 12, 12, 3072), ('e5-large', 'models/e5-large/model.safetensors', 'models/e5-large/vocab.txt', 1024, 16, 24, 4096))
  t(model, weights, vocab, hidden, heads, layers, intermediate), (select 1e-12::double as eps, 'mean' as pooling)""",
)
def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known models: their files and shapes."""
    rows = [(name, weights, vocab, c.hidden, c.heads, c.layers, c.intermediate, c.eps, c.pooling) for name in PRESETS for weights, vocab, c in [model_files(name)]]
    return spark.createDataFrame(rows, "model string, weights string, vocab string, hidden int, heads int, layers int, intermediate int, eps double, pooling string")


@register("weight_lookup", "select * from (values ('a', [1.0, 2.0]::float[]), ('b', [3.0]::float[]), ('c', null)) t(name, values)")
def weight_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors by name, or by 'bert.' and the name where that is missing; c is in no form there."""
    path = f"{scratch(spark, 'toy')}/names.safetensors"
    write(path, {"a": np.array([1.0, 2.0]), "bert.a": np.array([9.0]), "bert.b": np.array([3.0])})
    held = read_safetensors(spark, path).select(F.col("name").alias("stored"), "values")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    exact, prefixed = held.toDF("name", "exact"), held.select(F.substring("stored", 6, 1 << 20).alias("name"), F.col("values").alias("prefixed")).join(held.select("stored").filter("stored like 'bert.%'"), F.concat(F.lit("bert."), F.col("name")) == F.col("stored")).drop("stored")
    return asked.join(exact, "name", "left").join(prefixed, "name", "left").select("name", F.coalesce("exact", "prefixed").alias("values"))


@register(
    "matrix_rows",
    f"select vec_id, i, list_transform({_E}[i * 10 + 1:i * 10 + 10], lambda x: round(x, 6) + 0.0) as row, (len(embedding) + 9) // 10 as parts, list_transform(range(3), lambda x: 0.0::double) as blank from embeddings, (values (0), (5)) t(i)",
)
def matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 0 and 5 of each vector as a flat matrix of 10 columns (the last one is short), its ceiling-divided size, and zeros."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", tensor.from_vec(F.col("embedding").cast("array<double>"), 8, 8).alias("m"))
    part = lambda i: F.struct(F.lit(i).alias("i"), tensor.row(F.col("m"), i, 10).alias("row"))
    out = rows.select("vec_id", F.inline(F.array(part(0), part(5))), tensor.div_up(F.size("m"), 10).alias("parts"))
    return out.select("vec_id", "i", rounded(F.col("row")).alias("row"), "parts", tensor.zeros(3).alias("blank"))


@register("progress_lines", "select n as done, (100 * n // 7)::int as percent from range(8) t(n)")
def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a progress line of seven items shows as they finish."""
    out = io.StringIO()
    progress = Progress("items", 7, out)
    for _ in range(7):
        progress.tick()
    shown = [int(x) for x in re.findall(r"(\d+)%", out.getvalue())]
    return spark.createDataFrame(list(enumerate(shown)), "done long, percent int")
