"""Queries over video frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import frames as V
from .catalog import Tables
from .registry import query

_DIFF = lambda a, b: f"list_transform(range(1, len({a}) + 1), lambda i: abs({a}[i] - {b}[i]))"
_SHARE = lambda xs, k: f"len(list_filter({xs}, lambda x: x > {k})) / len({xs})::double"
_CLIPS = """select c.*, s.scene, round(s.k / c.n::double, 6) as stability, case when max_motion < 0.01 then 'none' when max_motion < 0.05 then 'minimal' when max_motion < 0.15 then 'low' when max_motion < 0.3 then 'moderate' when max_motion < 0.5 then 'high' else 'very_high' end as level
    from (select camera, frame // 60 as clip, count(*) as n, round(avg(motion), 6) as mean_motion, max(motion) as max_motion, bool_or(has_people) as people, bool_or(has_vehicles) as vehicles, bool_or(has_faces) as faces, max(person_count) as persons, round(avg(level) / 255, 6) as brightness from frames group by 1, 2) c
    join (select camera, clip, scene, k from (select camera, frame // 60 as clip, scene, count(*) as k, row_number() over (partition by camera, frame // 60 order by count(*) desc, scene) as rn from frames group by 1, 2, 3) where rn = 1) s on c.camera = s.camera and c.clip = s.clip"""
_SCORED = f"""select *, round((case when faces then 0.4::double when people then 0.3::double else 0 end + case when max_motion >= 0.15 then 0.25::double when max_motion >= 0.05 then 0.1::double else 0 end + case when vehicles then 0.15::double else 0 end)
    * case when brightness < 0.15 then 0.7::double else 1 end * case when not people and not vehicles then 0.5::double else 1 end, 6) as score from ({_CLIPS})"""
_ACTED = f"select *, case when score >= 0.6 then 'preserve' when score >= 0.3 then 'downsample' when score >= 0.1 then 'archive' else 'discard' end as action from ({_SCORED})"


@query("win_frame_diff", f"select camera, frame, case when before is null then 0.0::double else {_SHARE(_DIFF('vec', 'before'), 100)} end as moved from (select *, lag(vec) over (partition by camera order by frame) as before from frames)")
def _(t: Tables):
    return V.frame_diff(t.frames, 100).select("camera", "frame", "moved")


@query("win_three_frame_diff", f"select camera, frame, len(list_filter(range(1, len(vec) + 1), lambda i: least(abs(vec[i] - b[i]), abs(n[i] - vec[i])) > 100)) / len(vec)::double as moved from (select *, lag(vec) over w as b, lead(vec) over w as n from frames window w as (partition by camera order by frame)) where b is not null and n is not null")
def _(t: Tables):
    return V.three_frame_diff(t.frames, 100).select("camera", "frame", "moved")


@query("vid_motion_mask", f"select camera, frame, len(list_filter({_DIFF('vec', 'before')}, lambda x: x > 25)) as masked from (select *, lag(vec) over (partition by camera order by frame) as before from frames) where before is not null")
def _(t: Tables):
    rows = V.with_neighbour(t.frames, "vec", "before").where("before is not null")
    return rows.select("camera", "frame", F.size(F.filter(V.abs_diff(F.col("vec"), F.col("before")), lambda x: x > 25)).cast("long").alias("masked"))


@query("vid_motion_ratio", f"select camera, round(avg(moved), 9) as motion_ratio from (select camera, {_SHARE(_DIFF('vec', 'before'), 100)} as moved from (select *, lag(vec) over (partition by camera order by frame) as before from frames) where before is not null) group by 1")
def _(t: Tables):
    return V.frame_diff(t.frames, 100).where("frame > 0").groupBy("camera").agg(F.round(F.avg("moved"), 9).alias("motion_ratio"))


@query("vid_seed_change", f"select camera, frame, list_sum({_DIFF('vec', 'seed')}) > 50 * len(vec) as changed from (select *, first_value(vec) over (partition by camera order by frame) as seed from frames)")
def _(t: Tables):
    rows = t.frames.withColumn("seed", F.first("vec").over(V.by_camera()))
    total = F.aggregate(V.abs_diff(F.col("vec"), F.col("seed")), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("camera", "frame", (total > 50 * F.size("vec")).alias("changed"))


@query("bg_clipping", "select camera, frame, len(list_filter(vec, lambda x: abs(x) < 30)) / len(vec)::double as share from frames")
def _(t: Tables):
    return t.frames.select("camera", "frame", (F.size(F.filter("vec", lambda x: F.abs(x) < 30)) / F.size("vec")).alias("share"))


@query("vid_multiscale", "select camera, frame, floor(10000 * (0.5::double * list_sum(vec) / len(vec) + 0.3::double * list_sum(list_filter(vec, lambda x, i: i % 2 = 1)) / (len(vec) / 2) + 0.2::double * list_sum(list_filter(vec, lambda x, i: i % 4 = 1)) / (len(vec) / 4)) + 0.25)::bigint as blended from frames")
def _(t: Tables):
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    every = lambda k: F.filter("vec", lambda _, i: i % k == 0)
    n = F.size("vec")
    return t.frames.select("camera", "frame", F.floor(10000 * (0.5 * total(F.col("vec")) / n + 0.3 * total(every(2)) / (n / 2) + 0.2 * total(every(4)) / (n / 4)) + 0.25).cast("long").alias("blended"))


@query("vid_scene_change", "select camera, frame from frames where motion < 0.01 or motion > 0.8")
def _(t: Tables):
    return V.scene_changes(t.frames).select("camera", "frame")


@query("agg_clip", f"select * from ({_ACTED})")
def _(t: Tables):
    return V.clips(t.frames)


def _clip_policy_sql(lexical: bool) -> str:
    key = (lambda x: x) if lexical else (lambda x: f"(case {x} when 'waste' then 0 when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 end)")
    over = lambda r, p: f"case when {key(r)} > {key(p)} then {r} else {p} end"
    seen = lambda c, p: f"case when {c} and {key(p)} < {key(repr('high'))} then 'high' else {p} end"
    sql = f"select *, 'medium' as p0, case when max_motion <= 0.05 then 'low' when max_motion <= 0.3 then 'medium' when max_motion <= 0.6 then 'high' else 'critical' end as r1, case scene when 'indoor' then 'high' when 'parking' then 'low' else 'medium' end as r2 from ({_CLIPS})"
    for i, step in enumerate((over("r1", "p0"), over("r2", "p1"), "case when faces then 'critical' else p2 end", seen("people", "p3"), seen("vehicles", "p4")), 1):
        sql = f"select *, {step} as p{i} from ({sql})"
    return f"select camera, clip, p5 as priority, case when p5 in ('critical', 'high') then 'preserve_intact' when p5 = 'medium' then 'downsample' when p5 = 'low' then 'archive' else 'delete' end as action, (case when p5 in ('critical', 'high') then n * 102400 when p5 = 'medium' then floor(n * 102400 * 0.3::double) when p5 = 'low' then floor(n * 102400 * 0.05::double) else 0 end)::bigint as new_size from ({sql})"


@query("vid_policy_eval", _clip_policy_sql(True))
def _(t: Tables):
    return V.clip_policy(V.clips(t.frames))


@query("vid_policy_ranked", _clip_policy_sql(False))
def _(t: Tables):
    return V.clip_policy(V.clips(t.frames), "ranked")


@query("vid_clip_preserve", "select camera, frame // 60 as clip, bool_or(has_faces or motion > 0.9) as preserve from frames group by 1, 2")
def _(t: Tables):
    return t.frames.groupBy("camera", F.floor(F.col("frame") / 60).cast("long").alias("clip")).agg(F.bool_or(F.col("has_faces") | (F.col("motion") > 0.9)).alias("preserve"))


@query("vid_reduce", f"select camera, clip, case action when 'preserve' then n when 'downsample' then floor(n * 0.3::double)::bigint else floor(n * 0.05::double)::bigint end as kept from ({_ACTED})")
def _(t: Tables):
    n, a = F.col("n"), F.col("action")
    return V.clips(t.frames).select("camera", "clip", S.first_of([(a == "preserve", n), (a == "downsample", F.floor(n * 0.3))], F.floor(n * 0.05)).cast("long").alias("kept"))


@query("red_classify_video", f"select camera, clip, case when faces then 'preserve' when people then 'keep' when vehicles then 'downsample' when max_motion > 0.3 then 'sample' else 'archive' end as decision from ({_CLIPS})")
def _(t: Tables):
    d = S.first_of([(F.col("faces"), "preserve"), (F.col("people"), "keep"), (F.col("vehicles"), "downsample"), (F.col("max_motion") > 0.3, "sample")], "archive")
    return V.clips(t.frames).select("camera", "clip", d.alias("decision"))


@query("red_new_size", f"select camera, clip, floor(n * 102400 * case action when 'preserve' then 1.0::double when 'downsample' then 0.3::double when 'archive' then 0.05::double else 0 end)::bigint as new_size from ({_ACTED})")
def _(t: Tables):
    a = F.col("action")
    factor = S.first_of([(a == "preserve", 1.0), (a == "downsample", 0.3), (a == "archive", 0.05)], 0.0)
    return V.clips(t.frames).select("camera", "clip", F.floor(F.col("n") * 102400 * factor).cast("long").alias("new_size"))


@query("join_motion_rules", "select camera, frame, case when motion <= 0.05 then 'still' when motion <= 0.3 then 'some' else 'much' end as rule from frames")
def _(t: Tables):
    rules = t.spark.sql("select * from values (1, 0.0D, 0.05D, 'still'), (2, 0.0D, 0.3D, 'some'), (3, 0.0D, 1.0D, 'much') as r(ord, lo, hi, name)")
    met = t.frames.join(F.broadcast(rules), (F.col("motion") >= F.col("lo")) & (F.col("motion") <= F.col("hi")))  # three rows of rules
    return met.groupBy("camera", "frame").agg(F.min_by("name", "ord").alias("rule"))


@query("join_camera_policy", "select camera, frame, case camera when 0 then 'indoor' when 1 then 'parking' end as policy from frames")
def _(t: Tables):
    table = t.spark.sql("select * from values (0L, 'indoor'), (1L, 'parking') as p(camera, policy)")
    return t.frames.join(F.broadcast(table), "camera", "left").select("camera", "frame", "policy")  # two rows


@query("win_scene_stability", "select camera, frame, max(k) / 10.0::double as stability from (select a.camera, a.frame, b.scene, count(*) as k from frames a join frames b on a.camera = b.camera and b.frame between a.frame - 9 and a.frame group by 1, 2, 3) group by 1, 2")
def _(t: Tables):
    last = V.by_camera().rowsBetween(-9, 0)
    counts = [F.sum((F.col("scene") == s).cast("int")).over(last) for s in ("indoor", "parking", "street")]
    return t.frames.select("camera", "frame", (F.greatest(*counts) / 10.0).alias("stability"))


@query("win_stationary", "select camera, frame, coalesce(sd < 0.3 * mean and mean > 100 and k = 5, false) as stationary from (select camera, frame, stddev_pop(level) over w as sd, avg(level) over w as mean, count(*) over w as k from frames window w as (partition by camera order by frame rows between 4 preceding and current row))")
def _(t: Tables):
    last = V.by_camera().rowsBetween(-4, 0)
    sd, mean, k = F.stddev_pop("level").over(last), F.avg("level").over(last), F.count(F.lit(1)).over(last)
    return t.frames.select("camera", "frame", F.coalesce((sd < 0.3 * mean) & (mean > 100) & (k == 5), F.lit(False)).alias("stationary"))


@query("win_adaptive_threshold", "select camera, least(50, greatest(15, floor(avg(d) + 0.5 * stddev_pop(d))))::bigint as threshold from (select camera, frame, abs(level - lag(level) over (partition by camera order by frame)) as d from frames) where frame between 1 and 30 group by 1")
def _(t: Tables):
    rows = t.frames.withColumn("d", F.abs(F.col("level") - F.lag("level").over(V.by_camera()))).where("frame between 1 and 30")
    raw = F.floor(F.avg("d") + 0.5 * F.stddev_pop("d"))
    return rows.groupBy("camera").agg(F.least(F.lit(50), F.greatest(F.lit(15), raw)).cast("long").alias("threshold"))


@query("win_ema_background", "with recursive r as (select camera, frame, level::double as background from frames where frame = 0 union all select f.camera, f.frame, 0.95::double * r.background + 0.05::double * f.level from r join frames f on f.camera = r.camera and f.frame = r.frame + 1) select camera, frame, floor(background * 1000 + 0.371)::bigint as background from r")
def _(t: Tables):
    return V.ema(t.frames).select("camera", "frame", F.floor(F.col("background") * 1000 + 0.371).cast("long").alias("background"))


@query("win_adaptive_gop", "select camera, min(frame) as first, max(frame) as last, count(*) as n from (select *, (row_number() over (partition by camera, run order by frame) - 1) // 30 as part from (select *, sum(jump) over (partition by camera order by frame) as run from (select *, coalesce((abs(level - lag(level) over (partition by camera order by frame)) > 102)::int, 0) as jump from frames))) group by camera, run, part")
def _(t: Tables):
    return V.segments(t.frames, 102, 30).select("camera", "first", "last", "n")


@query("vid_index_cost", "select camera, count(*) * 1100 as bytes from (select camera, run from (select camera, sum(jump) over (partition by camera order by frame) as run from (select camera, frame, coalesce((abs(level - lag(level) over (partition by camera order by frame)) > 102)::int, 0) as jump from frames)) group by 1, 2) group by 1")
def _(t: Tables):
    return V.segments(t.frames, 102, 1 << 30).groupBy("camera").agg((F.count(F.lit(1)) * 1100).alias("bytes"))


@query("win_quality", "select camera, frame, round(avg(level) over (partition by camera order by frame rows between 29 preceding and current row), 6) as quality from frames")
def _(t: Tables):
    return t.frames.select("camera", "frame", F.round(F.avg("level").over(V.by_camera().rowsBetween(-29, 0)), 6).alias("quality"))


_MASKED = f"(select camera, frame, unnest(range(64)) as i, unnest(list_transform({_DIFF('vec', 'before')}, lambda x: x > 200)) as on_ from (select *, lag(vec) over (partition by camera order by frame) as before from frames) where before is not null)"


@query("topk_clusters", f"""with recursive pixels as (select camera, frame, i, i % 8 as x, i // 8 as y from {_MASKED} where on_),
    reach(camera, frame, i, low, x, y) as (select camera, frame, i, i, x, y from pixels
        union select p.camera, p.frame, p.i, r.low, p.x, p.y from reach r join pixels p on p.camera = r.camera and p.frame = r.frame and abs(p.x - r.x) <= 1 and abs(p.y - r.y) <= 1),
    owner as (select camera, frame, i, x, y, min(low) as low from reach group by all),
    boxes as (select camera, frame, min(x) as x, min(y) as y, max(x) - min(x) + 1 as width, max(y) - min(y) + 1 as height, count(*) as area from owner group by camera, frame, low)
    select * from (select camera, frame, row_number() over (partition by camera, frame order by area desc, y, x)::int as rank, x, y, width, height, area, x + width // 2 as center_x, y + height // 2 as center_y from boxes) where rank <= 10""")
def _(t: Tables):
    """The ten largest connected regions of each frame's motion mask."""
    rows = V.with_neighbour(t.frames, "vec", "before").where("before is not null")
    masks = rows.select("camera", "frame", F.transform(V.abs_diff(F.col("vec"), F.col("before")), lambda x: x > 200).alias("mask"))
    return V.regions(masks, 8, 8)


@query("vid_bg_model")
def _(t: Tables):
    """Values of each frame that are no background under a mixture that learns frame by frame."""
    return V.background_model(t.frames).select("camera", "frame", "foreground")


for _scene, _rules in V.DEFAULT_RULES.items():
    _by_hour = " ".join(f"when frame % 24 >= {a} and frame % 24 < {z} then '{p}:{r}'" for a, z, p, r in _rules)

    @query(f"vid_{_scene}_rules", f"select camera, frame, split_part(rule, ':', 1) as priority, split_part(rule, ':', 2) as reason from (select camera, frame, case {_by_hour} end as rule from frames where scene = '{_scene}')")
    def _(t: Tables, scene=_scene):
        """Frames of one kind of scene under its default rules by hour."""
        rows = t.frames.where(F.col("scene") == scene).withColumn("hour", F.col("frame") % 24)
        return V.by_hour(rows, "hour", V.DEFAULT_RULES[scene]).select("camera", "frame", "priority", "reason")


@query("vid_hour_segments", "select camera, h as hour, 104857600 as size from (select camera, max(frame) as last from frames group by 1), (select unnest(range(0, 24)) as h) where h * 60 <= last")
def _(t: Tables):
    last = t.frames.groupBy("camera").agg(F.max("frame").alias("last"))
    hours = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(23).cast("long"), F.floor(F.col("last") / 60))))
    return last.select("camera", hours.alias("hour"), F.lit(104857600).alias("size"))


@query("src_media_probe", "select camera, frame, round((level + 1) / 2.0::double, 6) as fps from frames")
def _(t: Tables):
    rate = F.split(F.concat((F.col("level") + 1).cast("string"), F.lit("/2")), "/")
    return t.frames.select("camera", "frame", F.round(rate[0].cast("double") / rate[1].cast("double"), 6).alias("fps"))


@query("m2_net_benefit", "select camera, round(1 - sum(level) / (count(*) * 255.0::double), 6) as reduction, round(1 - (sum(level) + 1100) / (count(*) * 255.0::double), 6) as net from frames group by 1")
def _(t: Tables):
    total, whole = F.sum("level"), F.count(F.lit(1)) * 255.0
    return t.frames.groupBy("camera").agg(F.round(1 - total / whole, 6).alias("reduction"), F.round(1 - (total + 1100) / whole, 6).alias("net"))


@query("quality_validate", "select camera, frame, abs(level - 128) <= 2 as valid from frames")
def _(t: Tables):
    return t.frames.select("camera", "frame", (F.abs(F.col("level") - 128) <= 2).alias("valid"))


@query("retire_eligible", f"select camera, clip from ({_SCORED}) where score >= 0.2 and (brightness > 0.3 or brightness is null)")
def _(t: Tables):
    return V.clips(t.frames).where("score >= 0.2 and (brightness > 0.3 or brightness is null)").select("camera", "clip")
