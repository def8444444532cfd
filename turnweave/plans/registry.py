"""Registered queries, each over its whole tables, and the same in DuckDB SQL.

The tables hold no audio: users' events are spans and levels, vectors are voiceprints, conversations are words in time.
Thresholds in seconds are scaled to events, which are hours apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.operators import activity, clustering, export, frames, gate, intervals, signal, speakers, spectral, tiles, tracks, transcript, windows
from turnweave.sources import tables
from turnweave.sources.scratch import written
from turnweave.streaming import sessions

KINDS = ("click", "error", "purchase", "signup", "view")
GAP, LEAST = 21_600.0, 1_800.0

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _with(*ctes: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n"


SPANS = """spans as (
  select user_id as rec, event_id as span_id, event_type as kind, value as level,
         list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)::int - 1 as speaker,
         epoch_us(ts) / 1000000.0::double - 1704067200 as s, epoch_us(ts) / 1000000.0::double - 1704067200 + value * 60 as e
  from events)"""


def merged_sql(source: str, gap: float, keys: str = "rec", out: str = "merged") -> str:
    return f"""{out}_f as (
  select *, case when s - max(e) over (partition by {keys} order by s, e rows between unbounded preceding and 1 preceding) <= {gap}::double then 0 else 1 end as fresh from {source}),
{out}_g as (select *, sum(fresh) over (partition by {keys} order by s, e rows unbounded preceding) as island from {out}_f),
{out} as (select {keys}, island::bigint as island, min(s) as s, max(e) as e, count(*) as n from {out}_g group by {keys}, island)"""


def spans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    return tables.event_spans(spark, sf_dir).withColumn("speaker", kind)


# intervals


@query(_with(SPANS, merged_sql("spans", GAP)) + f"select rec, island, s as start, e as end, n from merged where e - s >= {LEAST}")
def gap_merge(spark, sf_dir):
    return intervals.merge_gaps(spans_of(spark, sf_dir), GAP, least=LEAST)


@query(_with(SPANS, merged_sql("spans", 3600, "rec, kind")) + 'select rec, kind, s as start, e as "end", n from merged')
def interval_merge(spark, sf_dir):
    return intervals.merge_gaps(spans_of(spark, sf_dir), 3600.0, ("rec", "kind")).drop("island")


@query(
    _with(
        SPANS,
        "own as (select * from spans where kind in ('view', 'click'))",
        "holes as (select * from spans where kind not in ('view', 'click') and e > s)",
        merged_sql("holes", 0, out="cut"),
        """points as (
  select rec, span_id, s as p from own union select rec, span_id, e from own
  union select o.rec, span_id, c.s from own o join cut c on o.rec = c.rec and c.s > o.s and c.s < o.e
  union select o.rec, span_id, c.e from own o join cut c on o.rec = c.rec and c.e > o.s and c.e < o.e)""",
        "pieces as (select *, lead(p) over (partition by rec, span_id order by p) as q from points)",
    )
    + "select rec, span_id, p as start, q as end from pieces where q - p > 0.001::double and not exists (select 1 from cut c where c.rec = pieces.rec and c.s <= p and c.e >= q)"
)
def interval_subtract(spark, sf_dir):
    spans = spans_of(spark, sf_dir)
    own = F.col("kind").isin("view", "click")
    return intervals.subtract(spans.where(own), spans.where(~own))


GUARDS = """guards as (
  select rec, speaker, s, s + 900 as e from (select *, lag(speaker) over (partition by rec order by s, span_id) as near from spans) where near <> speaker
  union all
  select rec, speaker, e - 900, e from (select *, lead(speaker) over (partition by rec order by s, span_id) as near from spans) where near <> speaker)"""
DILATED = "dilated as (select o.rec, p.speaker, o.s - 600 as s, o.e + 600 as e from spans o join (select distinct rec, speaker from spans) p on o.rec = p.rec where o.kind = 'error')"


@query(_with(SPANS, GUARDS) + "select rec, speaker, s as start, e as end from guards")
def boundary_guards(spark, sf_dir):
    return intervals.boundary_guards(spans_of(spark, sf_dir), 900.0)


@query(_with(SPANS, DILATED) + "select rec, speaker, s as start, e as end from dilated")
def overlap_dilate(spark, sf_dir):
    spans = spans_of(spark, sf_dir)
    return intervals.dilate(spans.where("kind = 'error'"), 600.0, spans)


@query(_with(SPANS, GUARDS, DILATED, "kills as (select * from guards union all select * from dilated)", merged_sql("kills", 60, "rec, speaker")) + "select rec, speaker, island, s as start, e as end, n from merged")
def kill_union(spark, sf_dir):
    spans = spans_of(spark, sf_dir)
    return intervals.deterministic_kills(spans, spans.where("kind = 'error'"), 600.0, 900.0, 60.0)


@query(
    _with(
        SPANS,
        merged_sql("spans", GAP),
        "counted as (select rec, island, s, e, case when e - s <= 5400 then 1 else floor((e - s - 5400 + 1e-6::double) / 2700) + 1 end as k from merged)",
        "numbered as (select *, unnest(range(0, k::bigint + case when e - s > 5400 and s + k * 2700 < e - 1e-3::double then 1 else 0 end)) as win_no from counted)",
        """audio as (
  select *, greatest(3600, e - s) as need, greatest(0, (s + e) * 0.5::double - greatest(3600, e - s) / 2) as a0 from numbered)""",
    )
    + """select rec, island as span_id, win_no::int as win_no,
  case when e - s <= 5400 then s when win_no = k then greatest(s, e - 5400) else s + win_no * 2700 end as start,
  case when e - s <= 5400 or win_no = k then e else s + win_no * 2700 + 5400 end as end,
  case when e - s <= 5400 then greatest(0, a0 + need - need) when win_no = k then greatest(s, e - 5400) else s + win_no * 2700 end as audio_start,
  case when e - s <= 5400 then a0 + need when win_no = k then e else s + win_no * 2700 + 5400 end as audio_end
from audio"""
)
def sliding_windows(spark, sf_dir):
    merged = intervals.merge_gaps(spans_of(spark, sf_dir), GAP).withColumnRenamed("island", "span_id")
    return windows.sliding_windows(merged, 5400.0, 2700.0, 3600.0)


@query(
    _with(
        SPANS,
        "steps as (select *, unnest(range(0, greatest(0, ceil((e - 0.001::double - s) / 1800))::bigint)) as win_no from spans)",
        "centred as (select *, least(e, s + win_no * 1800 + 900) as c from steps)",
        "sliced as (select *, greatest(s, c - 900) as k0, least(e, c + 900) as k1, greatest(0, c - 1620) as a0 from centred)",
    )
    + "select rec, span_id, speaker, win_no::int as win_no, k0 as start, k1 as end, greatest(0, a0 + 3240 - 3240) as audio_start, a0 + 3240 as audio_end from sliced where k1 > k0"
)
def fine_windows(spark, sf_dir):
    return windows.fine_windows(spans_of(spark, sf_dir), 1800.0, 3240.0)


# frames

PRINTS = """prints as (
  select floor(vec_id / 50)::bigint as rec, vec_id % 50 as win_no, (vec_id % 50) * 0.75::double as s, (vec_id % 50) * 0.75::double + 1.5::double as e,
         list_transform(embedding, lambda x: x::double) as v, (case when label % 4 = 3 then -2 else label % 4 end)::int as label
  from embeddings)"""
VOTES = """spread as (
  select rec, label, unnest(range(greatest(0, floor(s / 0.01::double))::bigint, ceil(e / 0.01::double)::bigint)) as frame from prints),
counts as (select rec, frame, label, count(*) as votes from spread group by all),
best as (
  select rec, frame, arg_max(label, votes * 100 - label) filter (label >= 0) as speaker, coalesce(max(votes) filter (label >= 0), 0) as most,
         coalesce(max(votes) filter (label = -2), 0) as over from counts group by rec, frame),
voted as (select rec, frame, (case when over > 0 and over >= most then -2 else speaker end)::int as label from best)"""
RUNS = """grouped as (select *, frame - row_number() over (partition by rec, label order by frame) as g from voted),
runs as (select rec, label, min(frame) as first, max(frame) + 1 as past from grouped group by rec, label, g)"""
SMOOTH = """near as (
  select *, lag(past) over w = first and lag(label) over w >= 0 as l_ok, lead(first) over w = past and lead(label) over w >= 0 as r_ok,
         lag(label) over w as l, lead(label) over w as r, lag(past - first) over w as l_n, lead(past - first) over w as r_n
  from runs window w as (partition by rec order by first)),
smooth as (
  select rec, first, past, (case when label < 0 or past - first >= 90 then label
    when coalesce(l_ok, false) and (not coalesce(r_ok, false) or l_n >= r_n) then l when coalesce(r_ok, false) then r else label end)::int as label from near)"""
SEGMENTS = """flagged as (
  select *, case when lag(label) over w = label and lag(past) over w = first then 0 else 1 end as fresh from smooth window w as (partition by rec order by first)),
numbered as (select *, sum(fresh) over (partition by rec order by first rows unbounded preceding) as run from flagged),
segs as (select rec, label as speaker, min(first) * 0.01::double as s, max(past) * 0.01::double as e from numbered group by rec, run, label having label >= 0)"""
CANON = """ids as (select rec, speaker as was, row_number() over (partition by rec order by min(s), speaker) - 1 as speaker from segs group by rec, speaker),
canon as (select rec, ids.speaker::int as speaker, was, s, e from segs join ids using (rec) where segs.speaker = was)"""
ALL_FRAMES = (PRINTS, VOTES, RUNS, SMOOTH, SEGMENTS, CANON)
MIN_SEGMENT = 0.9


def prints_of(spark, sf_dir):
    label = F.when(F.col("label") % 4 == 3, -2).otherwise(F.col("label") % 4).cast("int")
    return tables.voiceprints(spark, sf_dir).withColumn("label", label)


def frames_of(spark, sf_dir):
    return frames.frame_votes(prints_of(spark, sf_dir))


def runs_of(spark, sf_dir):
    return frames.vote_runs(prints_of(spark, sf_dir))


def segments_of(spark, sf_dir):
    return frames.canonical_ids(frames.run_segments(runs_of(spark, sf_dir), MIN_SEGMENT))


@query(_with(PRINTS, VOTES) + "select rec, frame, label from voted")
def frame_vote(spark, sf_dir):
    return frames_of(spark, sf_dir)


@query(_with(PRINTS, VOTES, RUNS) + "select rec, label, first, past from runs")
def label_runs(spark, sf_dir):
    return frames.joined_runs(runs_of(spark, sf_dir))


@query(_with(PRINTS, VOTES, RUNS, SMOOTH) + "select rec, label, first, past from smooth")
def smooth_short_runs(spark, sf_dir):
    return frames.smooth_short_runs(frames.joined_runs(runs_of(spark, sf_dir)), 90)


@query(_with(*ALL_FRAMES) + "select rec, speaker, was, s as start, e as end from canon")
def canonical_segments(spark, sf_dir):
    return segments_of(spark, sf_dir).select("rec", "speaker", "was", "start", "end")


@query(_with(PRINTS, VOTES, RUNS) + "select rec, first * 0.01::double as start, past * 0.01::double as end from runs where label = -2")
def overlap_spans(spark, sf_dir):
    return frames.run_overlaps(runs_of(spark, sf_dir))


# exports


@query(_with(*ALL_FRAMES) + "select rec, speaker, round(sum(e - s), 6) as seconds, count(*) as segments from canon group by rec, speaker")
def speaker_time(spark, sf_dir):
    return rounded(export.speaker_time(segments_of(spark, sf_dir)), "seconds")


@query(
    _with(*ALL_FRAMES, "lengths as (select rec, max(e) as duration from prints group by rec)")
    + "select rec, speaker, round(sum(e - s), 6) as seconds, count(*) as segments, duration, round(100 * sum(e - s) / duration, 6) as percent from canon join lengths using (rec) group by rec, speaker, duration"
)
def speaker_share(spark, sf_dir):
    durations = prints_of(spark, sf_dir).groupBy("rec").agg(F.max("end").alias("duration"))
    return rounded(export.speaker_share(segments_of(spark, sf_dir), durations), "seconds", "percent")


@query(_with(*ALL_FRAMES) + "select rec, printf('%.3f', s) as start_sec, printf('%.3f', e) as end_sec, printf('%.3f', e - s) as duration_sec, 'SPEAKER_' || (speaker + 1) as speaker from canon")
def timeline_csv(spark, sf_dir):
    return export.csv_rows(segments_of(spark, sf_dir))


@query(_with(*ALL_FRAMES) + "select rec, s as start, 'SPEAKER ' || rec || ' 1 ' || printf('%.3f', s) || ' ' || printf('%.3f', e - s) || ' <NA> <NA> SPEAKER_' || (speaker + 1) || ' <NA> <NA>' as line from canon")
def rttm_lines(spark, sf_dir):
    return export.rttm_lines(segments_of(spark, sf_dir))


def _hms(t: str, places: int = 3) -> str:
    return f"printf('%02d:%02d:%0{places + 3}.{places}f', floor({t} / 3600)::int, floor(({t} % 3600) / 60)::int, {t} % 60)"


@query(
    _with(*ALL_FRAMES)
    + f"""select rec, 0 as part, row_number() over (partition by rec order by s, e, speaker)::int as place,
  {_hms('s')} || ' --> ' || {_hms('e')} || '  [' || printf('%7.2f', e - s) || 's]  SPEAKER_' || (speaker + 1) as line from canon
union all select rec, 1, speaker, 'SPEAKER_' || (speaker + 1) || ': ' || printf('%.2f', sum(e - s)) || 's' from canon group by rec, speaker"""
)
def timeline_text(spark, sf_dir):
    return export.timeline_lines(segments_of(spark, sf_dir))


# speakers

UNIT = "unit as (select rec, win_no, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-9::double as n from prints)"
PARTS = """parts as (select rec, label, i, avg(v[i] / n) as x from unit, range(1, 65) t(i) where label >= 0 group by rec, label, i),
cents as (select rec, label as other, list(x order by i) as c, sqrt(sum(x * x)) as cn from parts group by rec, label)"""
SIMS = "sims as (select u.rec, u.win_no, u.label, other, list_sum(list_transform(range(1, 65), lambda i: v[i] / n * c[i] / cn)) as sim from unit u join cents using (rec))"
RANKED = "ranked as (select *, row_number() over (partition by rec, win_no order by sim desc, other) as r from sims)"


@query(
    _with(PRINTS, "raw as (select rec, label, i, avg(v[i]) as x, count(*) as n from prints, range(1, 65) t(i) where label >= 0 group by rec, label, i)")
    + "select rec, label as speaker, (i - 1)::int as i, round(x / sqrt(sum(x * x) over (partition by rec, label)), 6) as x, n from raw"
)
def centroids(spark, sf_dir):
    cents = speakers.centroids(prints_of(spark, sf_dir))
    return rounded(cents.select("rec", "speaker", "n", F.posexplode("embedding").alias("i", "x")), "x")


@query(
    _with(PRINTS, UNIT, PARTS, SIMS, RANKED)
    + """select rec, win_no, label, round(max(sim) filter (r = 1), 6) as top1, round(max(sim) filter (r = 2), 6) as top2,
  round(max(sim) filter (r = 1) - max(sim) filter (r = 2), 6) as margin from ranked group by rec, win_no, label having count(*) > 1"""
)
def overlap_margin(spark, sf_dir):
    return rounded(speakers.overlap_margins(prints_of(spark, sf_dir)), "top1", "top2", "margin")


@query(
    _with(PRINTS, UNIT, PARTS, SIMS, RANKED, "near as (select rec, win_no from ranked group by rec, win_no having count(*) > 1 and max(sim) filter (r = 1) - max(sim) filter (r = 2) < 0.15::double)")
    + "select rec, win_no, case when n.win_no is not null then -2 else label end::int as label from prints p left join near n using (rec, win_no)"
)
def mark_overlaps(spark, sf_dir):
    return speakers.mark_overlaps(prints_of(spark, sf_dir), 0.15).select("rec", "win_no", "label")


@query(
    _with(PRINTS, UNIT, "sums as (select rec, i, sum(v[i] / n) as x from unit, range(1, 65) t(i) group by rec, i)", "own as (select rec, sum(list_sum(list_transform(v, lambda x: (x / n) * (x / n)))) as o, count(*) as m from unit group by rec)")
    + "select rec, round((sum(x * x) - any_value(o)) / greatest(1, any_value(m * m - m)) * 0.5::double, 6) as score from sums join own using (rec) group by rec"
)
def single_speaker_score(spark, sf_dir):
    return rounded(speakers.single_speaker_score(prints_of(spark, sf_dir)), "score")


@query(
    _with(
        PRINTS,
        UNIT,
        "d as (select a.rec, a.win_no, a.label as own, b.label as other, avg(1 - list_sum(list_transform(range(1, 65), lambda i: a.v[i] / a.n * b.v[i] / b.n))) filter (a.win_no <> b.win_no) as m, count(*) as size from unit a join unit b using (rec) group by all)",
        "ab as (select rec, win_no, max(m) filter (own = other) as a, min(m) filter (own <> other) as b, max(size) filter (own = other) as size, count(*) as k from d group by rec, win_no)",
    )
    + "select rec, round(avg(case when size = 1 then 0 else (b - a) / greatest(a, b) end), 6) as score, max(k) as k from ab group by rec"
)
def silhouette_by_label(spark, sf_dir):
    return rounded(speakers.silhouettes(prints_of(spark, sf_dir)), "score")


#: Two sources for each chunk; the chunk's lesser lead decides.
ROUTED = """raw as (select rec, label, i, avg(v[i]) as x from prints, range(1, 65) t(i) where label >= 0 group by rec, label, i),
cents as (select rec, label as other, list(x order by i) as c, sqrt(sum(x * x)) as cn from raw group by rec, label),
""" + UNIT + """,
""" + SIMS + """,
led as (select *, row_number() over w as r, lead(sim) over w as nxt from sims window w as (partition by rec, win_no order by sim desc, other)),
best as (select rec, floor(win_no / 2)::bigint as chunk, (win_no % 2)::int as source, other as best, sim - nxt as lead from led where r = 1),
judged as (select *, count(*) over w as c, min(best) over w as lo, max(best) over w as hi, min(lead) over w as least from best window w as (partition by rec, chunk)),
routed as (select rec, chunk, source, best, lead, case when c > 1 and lo = hi then 'same' when least < 0.1::double then 'low' else 'ok' end as reason from judged)"""


@query(_with(PRINTS, ROUTED) + "select rec, chunk, source, best, round(lead, 6) as lead, reason from routed")
def source_routing(spark, sf_dir):
    return rounded(routed_of(spark, sf_dir), "lead")


def routed_of(spark, sf_dir):
    prints = prints_of(spark, sf_dir)
    sources = prints.select("rec", F.floor(F.col("win_no") / 2).alias("chunk"), (F.col("win_no") % 2).cast("int").alias("source"), "embedding")
    return speakers.route_sources(sources, speakers.centroids(prints), 0.10)


@query(
    _with(PRINTS, ROUTED, "chunks as (select rec, chunk, any_value(reason) as reason, min(lead) as lead from routed group by rec, chunk)")
    + "select reason, count(*) as n, round(median(lead), 6) as median_lead, round(max(lead), 6) as max_lead from chunks group by reason"
)
def routing_reasons(spark, sf_dir):
    return rounded(gate.reasons(routed_of(spark, sf_dir)), "median_lead", "max_lead")


OWNED = """raw as (select rec, label, i, avg(v[i]) as x from prints, range(1, 65) t(i) where label >= 0 group by rec, label, i),
cents as (select rec, label as other, list(x order by i) as c, sqrt(sum(x * x)) as cn from raw group by rec, label)"""
MATCHED = """owned as (select rec, win_no, label as speaker, max(sim) filter (other = label) as me, max(sim) filter (other <> label) as them,
  arg_max(other, (sim, -other)) filter (other <> label) as other from sims where label >= 0 group by rec, win_no, label),
matched as (select * from owned where me is not null and them is not null)"""
LEAN = """lean as (select m.*, them - me * list_sum(list_transform(range(1, 65), lambda i: a.c[i] / a.cn * b.c[i] / b.cn)) as lean
  from matched m join cents a on m.rec = a.rec and a.other = speaker join cents b on m.rec = b.rec and b.other = m.other)"""


def gate_parts(spark, sf_dir):
    prints = prints_of(spark, sf_dir)
    cents = speakers.centroids(prints)
    return prints.where("label >= 0").withColumnRenamed("label", "speaker"), cents


@query(
    _with(PRINTS, UNIT, OWNED, SIMS, MATCHED, LEAN, "med as (select rec, speaker, median(lean) as med, 0.55::double * greatest(median(me), 0) as floor from lean group by rec, speaker)", "mad as (select rec, speaker, any_value(med) as med, any_value(floor) as floor, median(abs(lean - med)) as mad from lean join med using (rec, speaker) group by rec, speaker)")
    + """select rec, win_no, speaker, other, round(me, 6) as sim_self, round(them, 6) as sim_other, round(floor, 6) as floor, me - them < 0.03::double as foreign, me < floor as weak,
  lean > med + 1.5::double * 1.4826::double * (mad + 1e-6::double) as second, (me - them < 0.03::double) or me < floor or lean > med + 1.5::double * 1.4826::double * (mad + 1e-6::double) as drop
from lean join mad using (rec, speaker)"""
)
def crosstalk_gate(spark, sf_dir):
    rows, cents = gate_parts(spark, sf_dir)
    out = gate.gate(rows, cents, 0.03, 0.55, 1.5)
    return rounded(out, "sim_self", "sim_other", "floor").select("rec", "win_no", "speaker", "other", "sim_self", "sim_other", "floor", "foreign", "weak", "second", "drop")


@query(_with(PRINTS, UNIT, OWNED, SIMS, MATCHED, LEAN) + "select rec, win_no, speaker, other, round(lean, 6) as lean from lean")
def residual_lean(spark, sf_dir):
    rows, cents = gate_parts(spark, sf_dir)
    return rounded(gate.residual_lean(gate.own_and_other(rows, cents), cents), "lean").select("rec", "win_no", "speaker", "other", "lean")


@query(
    _with(SPANS, "med as (select rec, speaker, median(level) as med from spans group by rec, speaker)", "mad as (select rec, speaker, any_value(med) as med, median(abs(level - med)) as mad from spans join med using (rec, speaker) group by rec, speaker)")
    + "select rec, span_id, speaker, round(med, 6) as med, round(mad, 6) as mad, level > med + 2.5::double * 1.4826::double * (mad + 1e-6::double) as outlier from spans join mad using (rec, speaker)"
)
def mad_outliers(spark, sf_dir):
    return rounded(gate.mad_outliers(spans_of(spark, sf_dir), "level", 2.5), "med", "mad").select("rec", "span_id", "speaker", "med", "mad", "outlier")


@query(
    _with(PRINTS, UNIT, OWNED, SIMS, MATCHED, "cut as (select m.rec, m.speaker, p.s, p.e from matched m join prints p using (rec, win_no) where me - them < 0.03::double)", merged_sql("cut", 0.06, "rec, speaker"))
    + "select rec, speaker, island, s as start, e as end, n from merged"
)
def gated_spans(spark, sf_dir):
    rows, cents = gate_parts(spark, sf_dir)
    return gate.gated_spans(gate.gate(rows, cents, 0.03, -2.0), rows)


# activity

LEVELS = """leveled as (select rec, floor(s / 21600)::bigint as frame, count(*) as n, avg(level * level) as ms from spans group by all),
levels as (select rec, frame, n, sqrt(ms) as rms, 20 * log10(sqrt(ms + 1e-10::double) + 1e-10::double) as db from leveled)"""
GATED = "tops as (select rec, quantile_cont(db, 0.95) - 6 as lim from levels group by rec), gated as (select l.*, lim, db > lim as active from levels l join tops using (rec))"


@query(_with(SPANS, LEVELS) + "select rec, frame, n, round(rms, 6) as rms, round(db, 6) as db from levels")
def rms_db(spark, sf_dir):
    return rounded(activity.levels(spans_of(spark, sf_dir), GAP), "rms", "db")


@query(_with(SPANS, LEVELS, GATED) + 'select rec, frame, n, round(rms, 6) as rms, round(db, 6) as db, round(lim, 6) as "limit", active from gated')
def energy_gate(spark, sf_dir):
    return rounded(activity.energy_gate(activity.levels(spans_of(spark, sf_dir), GAP), 6.0), "rms", "db", "limit")


ACTIVE = """islands as (select rec, frame, frame - row_number() over (partition by rec order by frame) as g from gated where active),
found as (select rec, min(frame) * 21600::double as s, (max(frame) + 1) * 21600::double as e from islands group by rec, g)"""


@query(_with(SPANS, LEVELS, GATED, ACTIVE, merged_sql("found", 21600)) + "select rec, s as start, e as end from merged where e - s >= 43200")
def active_spans(spark, sf_dir):
    return activity.active_spans(activity.energy_gate(activity.levels(spans_of(spark, sf_dir), GAP), 6.0), GAP, GAP, 43_200.0)


@query(
    _with(
        SPANS, LEVELS, GATED, ACTIVE, merged_sql("found", 21600), "long as (select rec, s, e from merged where e - s >= 43200)",
        "recs as (select rec, max(e) as duration, sqrt(avg(level * level)) as rms from spans group by rec)",
        "judged as (select r.rec, duration from recs r left join long using (rec) group by r.rec, duration, rms having coalesce(sum(long.e - long.s), 0) < 200000 and rms > 0.001::double)",
    )
    + "select rec, s as start, e as end from long where rec not in (select rec from judged) union all select rec, 0, duration from judged"
)
def silence_fallback(spark, sf_dir):
    spans = spans_of(spark, sf_dir)
    recs = spans.groupBy("rec").agg(F.max("end").alias("duration"), F.sqrt(F.avg(F.col("level") * F.col("level"))).alias("rms"))
    return activity.with_fallback(active_spans(spark, sf_dir), recs, 200_000.0)


@query(_with(SPANS, "f as (select *, case when s - lag(s) over (partition by rec order by s) < 21600 then 0 else 1 end as fresh from spans)", "g as (select *, sum(fresh) over (partition by rec order by s rows unbounded preceding) as i from f)") + "select rec, to_timestamp(min(s) + 1704067200)::timestamp as start, count(*) as n, round(sum(level), 6) as level from g group by rec, i")
def event_sessions(spark, sf_dir):
    return rounded(sessions.sessions(tables.read(spark, sf_dir, "events"), "6 hours").select("rec", F.col("start").cast("timestamp_ntz").alias("start"), "n", "level"), "level")


# transcripts

WORDS = """said as (select conv_id as rec, turn, role, string_split(text, ' ') as w from conversations),
counted as (select *, coalesce(sum(len(w)) over (partition by rec order by turn rows between unbounded preceding and 1 preceding), 0) as before from said),
words as (
  select rec, turn, role, (before + i - 1)::bigint as word_no, (before + i - 1) * 0.4::double as s, (before + i - 1) * 0.4::double + 0.35::double as e, ' ' || w[i] as text
  from counted, unnest(range(1, len(w) + 1)) t(i)),
turns_ as (select rec, turn as span_id, (case when role = 'user' then 0 else 1 end)::int as speaker, min(s) + 0.9::double as s, max(e) - 0.9::double as e from words where role <> 'system' group by rec, turn, role having max(e) - min(s) > 2),
hits as (select w.rec, word_no, arg_min(speaker, (t.s, span_id)) as speaker from words w join turns_ t on w.rec = t.rec and (w.s + w.e) * 0.5::double between t.s and t.e group by w.rec, word_no),
near as (select w.rec, word_no, arg_min(speaker, (least(abs((w.s + w.e) * 0.5::double - t.s), abs((w.s + w.e) * 0.5::double - t.e)), t.s, span_id)) as speaker from words w join turns_ t on w.rec = t.rec group by w.rec, word_no),
labelled as (select w.*, coalesce(h.speaker, n.speaker, -1)::int as speaker from words w left join hits h using (rec, word_no) left join near n using (rec, word_no))"""
CUES = """walk as (
  select rec, word_no, s as at, 1 as n, e, speaker, true as new from labelled where word_no = 0
  union all
  select l.rec, l.word_no, case when l.speaker <> k.speaker or l.e - k.at > 6 or k.n >= 14 then l.s else k.at end,
         case when l.speaker <> k.speaker or l.e - k.at > 6 or k.n >= 14 then 1 else k.n + 1 end, l.e, l.speaker, l.speaker <> k.speaker or l.e - k.at > 6 or k.n >= 14
  from walk k join labelled l on l.rec = k.rec and l.word_no = k.word_no + 1),
cued as (select rec, word_no, sum(new::int) over (partition by rec order by word_no rows unbounded preceding)::bigint as cue_no from walk),
cues as (select l.rec, cue_no, min(l.s) as s, max(l.e) as e, l.speaker, trim(string_agg(text, '' order by l.word_no)) as text, count(*) as n_words from labelled l join cued using (rec, word_no) group by l.rec, cue_no, l.speaker having trim(string_agg(text, '' order by l.word_no)) <> '')"""
TURNS = """turned_f as (select *, case when lag(speaker) over (partition by rec order by cue_no) = speaker then 0 else 1 end as fresh from cues),
turned_g as (select *, sum(fresh) over (partition by rec order by cue_no rows unbounded preceding)::bigint as turn_no from turned_f),
turned as (select rec, turn_no, min(s) as s, max(e) as e, speaker, string_agg(text, ' ' order by cue_no) as text from turned_g group by rec, turn_no, speaker)"""
LABEL = "case when speaker < 0 then 'UNKNOWN' else 'SPEAKER_' || (speaker + 1) end"


def labelled_of(spark, sf_dir):
    words = tables.words(spark, sf_dir)
    segs = words.where("role != 'system'").groupBy("rec", F.col("turn").alias("span_id"), F.when(F.col("role") == "user", 0).otherwise(1).alias("speaker")).agg(F.min("start").alias("a"), F.max("end").alias("b"))
    segs = segs.where("b - a > 2").select("rec", "span_id", "speaker", (F.col("a") + 0.9).alias("start"), (F.col("b") - 0.9).alias("end"))
    return transcript.assign_words(words.select("rec", "word_no", "start", "end", "text"), written(segs, "turns"))


def cues_of(spark, sf_dir):
    return transcript.cues(labelled_of(spark, sf_dir))


@query(_with(WORDS) + "select rec, word_no, s as start, e as end, text, speaker from labelled")
def word_speaker(spark, sf_dir):
    return labelled_of(spark, sf_dir)


@query(_with(WORDS, CUES) + "select rec, cue_no, s as start, e as end, speaker, text, n_words from cues")
def greedy_cues(spark, sf_dir):
    return cues_of(spark, sf_dir)


@query(_with(WORDS, CUES, TURNS) + "select rec, turn_no, s as start, e as end, speaker, text from turned")
def turns(spark, sf_dir):
    return transcript.turns(cues_of(spark, sf_dir))


def _sub(t: str, mark: str) -> str:
    return f"printf('%02d:%02d:%02d{mark}%03d', floor({t} / 3600)::int, floor(({t} % 3600) / 60)::int, floor({t} % 60)::int, floor(({t} - floor({t})) * 1000)::int)"


@query(_with(WORDS, CUES, "n as (select *, row_number() over (partition by rec order by cue_no)::int as number from cues)") + f"select rec, number, number || chr(10) || {_sub('s', ',')} || ' --> ' || {_sub('e', ',')} || chr(10) || '[' || {LABEL} || '] ' || text || chr(10) as block from n")
def srt_blocks(spark, sf_dir):
    return export.srt_blocks(cues_of(spark, sf_dir))


@query(_with(WORDS, CUES, "n as (select *, row_number() over (partition by rec order by cue_no)::int as number from cues)") + f"select rec, number, {_sub('s', '.')} || ' --> ' || {_sub('e', '.')} || chr(10) || '<v ' || {LABEL} || '>' || text || chr(10) as block from n")
def vtt_blocks(spark, sf_dir):
    return export.vtt_blocks(cues_of(spark, sf_dir))


@query(_with(WORDS, CUES, TURNS) + f"select rec, turn_no as number, '[' || {_hms('s', 2)} || '] ' || {LABEL} || ': ' || text as line from turned")
def transcript_lines(spark, sf_dir):
    return export.transcript_lines(transcript.turns(cues_of(spark, sf_dir)))


@query(_with(WORDS) + "select rec, speaker, trim(string_agg(text, '' order by word_no)) as text from labelled where speaker >= 0 group by rec, speaker")
def speaker_texts(spark, sf_dir):
    return export.speaker_texts(labelled_of(spark, sf_dir))


# clustering: labels from the order of merges

LINKED = """unit_ as (select rec, win_no, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as u from prints),
pairs as (
  select 0 as step, a.rec, a.win_no as a, b.win_no as b, round(1 - list_sum(list_transform(range(1, 65), lambda i: a.u[i] * b.u[i])), 12) as d
  from unit_ a join unit_ b on a.rec = b.rec and a.win_no < b.win_no
  union all
  select step + 1, rec, least(x, y), greatest(x, y), max(d)
  from (select step, rec, case when a = hi then lo else a end as x, case when b = hi then lo else b end as y, d
        from (select *, first_value(a) over w as lo, first_value(b) over w as hi from pairs window w as (partition by rec order by d, a, b)))
  where x <> y group by step, rec, least(x, y), greatest(x, y)),
merges_ as (select rec, step, arg_min(a, (d, a, b)) as lo, arg_min(b, (d, a, b)) as hi from pairs group by rec, step),
sizes as (select rec, count(*) as n from prints group by rec),
wanted as (select rec, n, unnest(list_distinct([least(k, n) for k in KS])) as k from sizes),
walk_ as (
  select rec, k, n, win_no, win_no as root from wanted join unit_ using (rec)
  union all
  select w.rec, w.k, w.n, w.win_no, m.lo from walk_ w join merges_ m on m.rec = w.rec and m.hi = w.root and m.step < w.n - w.k),
labels as (select rec, k::int as k, win_no, (dense_rank() over (partition by rec, k order by min(root)) - 1)::int as label from walk_ group by rec, k, win_no)"""


@query(_with(PRINTS, LINKED.replace("KS", "[3]")) + "select rec, k, win_no, label from labels")
def agglomerative_k(spark, sf_dir):
    return clustering.agglomerative(tables.voiceprints(spark, sf_dir), [3])


@query(_with(PRINTS, LINKED.replace("KS", "[2, 5]")) + "select rec, k, win_no, label from labels")
def linkage_rounds(spark, sf_dir):
    """Recordings of over 30 windows are merged in rounds."""
    return clustering.agglomerative(tables.voiceprints(spark, sf_dir), [2, 5], limit=30)


#: Silhouettes of the clusterings for 2 to 4, half the mean likeness for 1, the best of them.
CHOSEN = """cosines as (select a.rec, a.win_no as x, b.win_no as y, list_sum(list_transform(range(1, 65), lambda i: a.v[i] / a.n * b.v[i] / b.n)) as c from unit a join unit b on a.rec = b.rec),
apart as (
  select c.rec, p.k, x, p.label as own, q.label as other, avg(1 - c) filter (x <> y) as m, count(*) as size
  from cosines c join labels p on p.rec = c.rec and p.win_no = x join labels q on q.rec = c.rec and q.win_no = y and q.k = p.k group by all),
sides as (select rec, k, x, max(m) filter (own = other) as a, min(m) filter (own <> other) as b, max(size) filter (own = other) as size, count(*) as found from apart group by rec, k, x),
scored as (
  select rec, k, case when max(found) < 2 or max(found) >= count(*) then -1 else avg(case when size = 1 then 0 else (b - a) / greatest(a, b) end) end as score from sides group by rec, k
  union all
  select rec, 1, 0.5::double * coalesce(sum(c) filter (x <> y), 0) / greatest(1, count(*) filter (x <> y)) from cosines group by rec)"""


@query(
    _with(PRINTS, LINKED.replace("KS", "[2, 3, 4]"), UNIT, CHOSEN)
    + "select rec, arg_max(k, (score, -k))::int as k, round(max(score), 6) as score from scored join sizes using (rec) where n > 1 group by rec union all select rec, 1, null from sizes where n < 2"
)
def auto_speaker_count(spark, sf_dir):
    return rounded(clustering.choose_speakers(tables.voiceprints(spark, sf_dir), 1, 4), "score")


# signals: a user's event levels in time order are samples, cut into blocks

SIGNAL = "sig as (select user_id as rec, row_number() over (partition by user_id order by epoch_us(ts), event_id) - 1 as i, (value / 500)::float::double as x, floor(value) as whole, event_type as kind from events)"
TOTAL = "total as (select rec, count(*) as total from sig group by rec)"


def samples_of(spark, sf_dir, users: int = 1):
    """rec, at, level, kind: one sample for each event; ``users`` users in a row share a recording."""
    from pyspark.sql import Window

    rows = tables.event_spans(spark, sf_dir).withColumn("rec", F.floor(F.col("rec") / users).cast("long"))
    return rows.select("rec", "level", "kind", (F.row_number().over(Window.partitionBy("rec").orderBy("start", "span_id")) - 1).alias("at"))


def blocks_of(samples: DataFrame, value, size: int = 32) -> DataFrame:
    rows = samples.select("rec", "at", value.cast("float").alias("x"), F.floor(F.col("at") / size).alias("block_no"))
    listed = rows.groupBy("rec", "block_no").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
    return listed.select("rec", F.lit(0).alias("channel"), "block_no", (F.col("block_no") * size).alias("start_sample"), F.transform("v", lambda v: v["x"]).alias("samples"))


def event_blocks(spark, sf_dir, size: int = 32):
    """Levels scaled to [-1, 1]."""
    return blocks_of(samples_of(spark, sf_dir), F.col("level") / 500, size)


def exploded(blocks: DataFrame, *keys: str) -> DataFrame:
    """keys, i, x: one row per sample."""
    rows = blocks.select(*keys, "start_sample", F.posexplode("samples").alias("j", "x"))
    return rounded(rows.select(*keys, (F.col("start_sample") + F.col("j")).alias("i"), F.col("x").cast("double").alias("x")), "x")


def _filter_sql() -> str:
    """A cascade of two sections as a walk along the samples, in transposed form."""
    (b0, b1, b2, a1, a2), (c0, c1, c2, d1, d2) = (tuple(f"({float(v)!r}::double)" for v in s) for s in signal.high_pass(1000, 80.0))
    y = f"({b0} * x + p1)"
    z = f"({c0} * {y} + q1)"
    step = f"{b1} * x - {a1} * {y} + p2 as p1, {b2} * x - {a2} * {y} as p2, {c1} * {y} - {d1} * {z} + q2 as q1, {c2} * {y} - {d2} * {z} as q2, {z} as z"
    return f"""states as (
  select rec, i, {step} from (select *, 0::double as p1, 0::double as p2, 0::double as q1, 0::double as q2 from sig where i = 0)
  union all
  select rec, i, {step} from (select s.rec, s.i, s.x, f.p1, f.p2, f.q1, f.q2 from states f join sig s on s.rec = f.rec and s.i = f.i + 1))"""


@query(_with(SIGNAL, _filter_sql()) + "select rec, (i // 32)::bigint as block_no, (i % 32)::int as i, round(z::float::double, 6) as x from states")
def signal_highpass(spark, sf_dir):
    out = signal.filter_blocks(event_blocks(spark, sf_dir), signal.high_pass(1000, 80.0))
    return rounded(out.select("rec", "block_no", F.posexplode("samples").alias("i", "x")).withColumn("x", F.col("x").cast("double")), "x")


@query(
    _with(
        SIGNAL, "hops as (select rec, i // 4 as hop, sum(x * x) / 4 as ms from sig group by all)",
        "parts as (select rec, avg(ms) over w as z, count(*) over w as n from hops window w as (partition by rec order by hop rows between 3 preceding and current row))",
        "loud as (select rec, z, -0.691::double + 10 * log10(z) as l from parts where n = 4 and z > 0 and -0.691::double + 10 * log10(z) > -70)",
        "gate as (select rec, -0.691::double + 10 * log10(avg(z)) - 10 as lim from loud group by rec)",
    )
    + "select rec, round(-0.691::double + 10 * log10(avg(z)), 6) as lufs from loud join gate using (rec) where l > lim group by rec"
)
def signal_loudness(spark, sf_dir):
    """Gated loudness of hops of four samples, without weighting by frequency."""
    return rounded(signal.loudness(signal.hop_squares(event_blocks(spark, sf_dir), 40, 0.1)), "lufs")


@query(
    _with(SIGNAL, TOTAL, "levels as (select s.rec, f as frame, avg(x * x) as ms from total t, unnest(range(0, (total - 12) // 4 + 1)) u(f) join sig s on s.rec = t.rec and s.i between 4 * f and 4 * f + 11 where total >= 12 group by s.rec, f)")
    + "select rec, 0 as channel, frame, round(20 * log10(sqrt(ms + 1e-10::double) + 1e-10::double), 6) as db from levels"
)
def signal_frames(spark, sf_dir):
    return rounded(signal.frame_levels(event_blocks(spark, sf_dir), 12, 4), "db")


#: Chunks of 20 samples that share 6; up to 25 samples are one chunk.
CHUNKED = """counted as (select rec, total, case when total <= 25 then 1 else ceil((total - 20) / 14)::bigint + 1 end as chunks from total),
parts as (select rec, total, chunks, chunk, chunk * 14 as a, case when chunks = 1 then total else least(total, chunk * 14 + 20) end as b from counted, unnest(range(0, chunks)) u(chunk))"""


@query(_with(SIGNAL, TOTAL, CHUNKED) + "select p.rec, chunk, chunks, a as start_sample, total, count(*) as n, sum(whole)::bigint as level from parts p join sig s on s.rec = p.rec and s.i >= a and s.i < b group by all")
def track_chunks(spark, sf_dir):
    parts = tiles.chunks(blocks_of(samples_of(spark, sf_dir), F.floor("level")), 20, 1.0)
    return parts.select("rec", "chunk", "chunks", "start_sample", "total", F.size("samples").cast("long").alias("n"), F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("level"))


@query(
    _with(
        SIGNAL, TOTAL, CHUNKED,
        "weighed as (select p.rec, i, x * (chunk + 1) as x, case when a > 0 and i - a < 6 then (i - a) / 5.0::double else 1 end * case when b < total and b - 1 - i < 6 then (b - 1 - i) / 5.0::double else 1 end as w from parts p join sig s on s.rec = p.rec and s.i >= a and s.i < b)",
    )
    + "select rec, i, round((sum(x::float::double * w) / case when sum(w) = 0 then 1 else sum(w) end)::float::double, 6) as x from weighed group by rec, i"
)
def chunk_crossfade(spark, sf_dir):
    """Chunks that a model has made louder by their number, faded into each other."""
    parts = tiles.chunks(event_blocks(spark, sf_dir), 20, 1.0)
    louder = F.transform("samples", lambda x: (x.cast("double") * (F.col("chunk") + 1)).cast("float"))
    return exploded(tiles.crossfaded(parts.withColumn("samples", louder), 20, 16), "rec")


#: Frames of 2 samples over 0.2; 1 sample on either side, joined over 2.
AUDIBLE = """levels as (select rec, i // 2 as no, sqrt(avg(x * x)) as rms from sig group by rec, i // 2 having count(*) = 2),
runs as (select rec, no, no - row_number() over (partition by rec order by no) as run from levels where rms > 0.2::double),
heard as (select rec, greatest(0, min(no) * 2 - 1) as s, least(any_value(total), max(no) * 2 + 3) as e from runs join total using (rec) group by rec, run),
""" + merged_sql("heard", 2, out="pieces") + """,
kept as (select rec, s, e, coalesce(sum(e - s) over (partition by rec order by s rows between unbounded preceding and 1 preceding), 0) as t,
         coalesce(e - s > 3 and lag(e - s) over w > 3, false) as rise, coalesce(e - s > 3 and lead(e - s) over w > 3, false) as fall from pieces window w as (partition by rec order by s)
         union all select rec, 0, total, 0, false, false from total where total < 2)"""


def track_of(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("speaker", F.lit(0))


@query(_with(SIGNAL, TOTAL, AUDIBLE) + "select rec, 0 as speaker, s::bigint as start, e::bigint as end from kept")
def track_audible(spark, sf_dir):
    return tracks.audible(track_of(event_blocks(spark, sf_dir)), 100, 0.2, 0.02, 0.01, 0.02).withColumns({c: F.col(c).cast("long") for c in ("start", "end")})


@query(
    _with(SIGNAL, TOTAL, AUDIBLE)
    + "select k.rec, (t + i - s)::bigint as i, round((x * case when rise and i - s < 3 then (i - s) / 2.0::double else 1 end * case when fall and e - 1 - i < 3 then (e - 1 - i) / 2.0::double else 1 end)::float::double, 6) as x from kept k join sig g on g.rec = k.rec and g.i >= s and g.i < e"
)
def track_compact(spark, sf_dir):
    out = tracks.compact(track_of(event_blocks(spark, sf_dir)), 100, 0.03, 16, least_rms=0.2, frame_sec=0.02, pad_sec=0.01, gap_sec=0.02)
    return exploded(out, "rec")


@query(
    _with(SIGNAL, "adds as (select a.rec, a.i + b.i as i, sum(b.whole) as x from sig a join sig b on a.rec = b.rec and b.i < 8 where a.kind = 'error' group by all)")
    + "select s.rec, s.i, s.whole + coalesce(a.x, 0) as x from sig s left join adds a on a.rec = s.rec and a.i = s.i"
)
def track_injected(spark, sf_dir):
    """The first eight samples of a user's track, put in again at every error."""
    samples = samples_of(spark, sf_dir)
    blocks = blocks_of(samples, F.floor("level"))
    signals = samples.where("kind = 'error'").select("rec", (F.col("at") / 10).alias("start")).join(blocks.where("block_no = 0").select("rec", F.slice("samples", 1, 8).alias("samples")), "rec")
    signals = signals.select("rec", F.lit(0).alias("speaker"), "start", F.lit(0).alias("channel"), "samples")
    return exploded(tracks.injected(track_of(blocks), signals, 10, 16), "rec")


@query(
    _with(
        "sig as (select user_id // 30 as rec, row_number() over (partition by user_id // 30 order by epoch_us(ts), event_id) - 1 as i, (value / 500)::float::double as x from events)", TOTAL,
        "framed as (select s.rec, f, s.i - f * 256 + 512 as j, x from total t, unnest(range(0, ((total + 255) // 256) + 1)) u(f) join sig s on s.rec = t.rec and s.i >= f * 256 - 512 and s.i < f * 256 + 512 where total >= 1024)",
        "wave as (select j, 0.5::double - 0.5::double * cos(2 * pi() * j / 1024) as w from range(0, 1024) r(j))",
        "turn as (select k, cos(2 * pi() * k / 1024) as c, sin(2 * pi() * k / 1024) as s from range(0, 1024) r(k))",
        "mags as (select rec, f, b as bin, sqrt(sum(x * w * c) ^ 2 + sum(x * w * s) ^ 2) / 512 as mag from framed join wave using (j), range(0, 513) r(b) join turn on turn.k = (b * j) % 1024 group by rec, f, b)",
    )
    + "select rec, 0 as channel, bin::int as bin, round(quantile_cont(mag, 0.1), 6) as floor from mags group by rec, bin"
)
def noise_floors(spark, sf_dir):
    """The tenth percentile of every bin's magnitudes; thirty users make a recording, as a frame takes 1,024 samples."""
    blocks = blocks_of(samples_of(spark, sf_dir, 30), F.col("level") / 500, 500)
    floors = spectral.noise_floors(written(spectral.tiles_of(blocks, 1024), "tiles"), 1024)
    return rounded(floors.select("rec", "channel", F.posexplode("floors").alias("bin", "floor")), "floor")
