"""Queries over detections, frames and transitions, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sceneframe.functions import boxes as B
from sceneframe.functions import text as T
from sceneframe.operators import profile as P
from sceneframe.operators import slots as S
from sceneframe.operators import transitions as R
from sceneframe.operators.ordering import natural_position, total_rows
from sceneframe.plans import datasets as D
from sceneframe.plans import views as V
from sceneframe.plans.registry import query
from sceneframe.plans.scenes import raw_area, scene_slots




def cols(*names):
    return [F.col(n) for n in names]


RANKED = V.DETECTIONS + """,
ranked as (select *, row_number() over (partition by state_id
             order by (xmax-xmin)*(ymax-ymin) desc, p1, p2, p3) - 1 as slot from detections
           qualify slot < 10)"""

NAMED = RANKED + """,
named as (select *, case when count(*) over (partition by state_id, category) = 1 then category
            else category || '_' || (row_number() over (partition by state_id, category order by slot) - 1) end as name
          from ranked)"""

CANVAS = """
  cast(trunc(least(greatest(xmin*300/width, 0.0), 299.0)) as int) as cx1,
  cast(trunc(least(greatest(ymin*200/height, 0.0), 199.0)) as int) as cy1,
  cast(trunc(least(greatest(xmax*300/width, 0.0), 299.0)) as int) as cx2,
  cast(trunc(least(greatest(ymax*200/height, 0.0), 199.0)) as int) as cy2"""

BINNED = NAMED + f""",
canvas as (select state_id, slot, name, {CANVAS} from named),
binned as (select state_id, slot, name, cx1//5 as x1b, cy1//5 as y1b, cx2//5 as x2b, cy2//5 as y2b, false as is_pad
           from canvas
           union all
           select state_id, i, 'pad_' || i, 0, 0, 0, 0, true
           from (select state_id, count(*) as n from canvas group by state_id), range(10) t(i) where i >= n)"""


@query("scene_slots", f"""with {BINNED}
select state_id, cast(slot as int) as slot, name, cast(x1b as int) as x1b, cast(y1b as int) as y1b,
       cast(x2b as int) as x2b, cast(y2b as int) as y2b, is_pad from binned""")
def _scene_slots(spark, sf):
    return scene_slots(V.detections(spark, sf), order=V.ORDER)


@query("box_area", f"""with {V.DETECTIONS}
select state_id, p1, p2, p3, cast((xmax-xmin)*(ymax-ymin) as bigint) as area from detections""")
def _box_area(spark, sf):
    return V.detections(spark, sf).select(
        "state_id", *V.ORDER, raw_area().alias("area"))


# boxes shifted so that some leave the image or turn inside out
SHIFTED = V.DETECTIONS + """,
shifted as (select state_id, p1, p2, p3, xmin - 150 as xmin, ymin - 30 as ymin,
                   xmax - p1 * 60 as xmax, ymax - p1 * 4 as ymax, width, height from detections)"""


def _shifted(spark, sf):
    d = V.detections(spark, sf)
    n = F.col("p1")
    return d.select(
        "state_id", *V.ORDER,
        (F.col("xmin") - 150).alias("xmin"), (F.col("ymin") - 30).alias("ymin"),
        (F.col("xmax") - n * 60).alias("xmax"), (F.col("ymax") - n * 4).alias("ymax"), "width", "height")


@query("clamp_box", f"""with {SHIFTED},
c as (select *, cast(greatest(0, xmin) as int) as x1, cast(greatest(0, ymin) as int) as y1,
             cast(least(width, xmax) as int) as x2, cast(least(height, ymax) as int) as y2 from shifted)
select state_id, p1, p2, p3, x1, y1, x2, y2, (x2 <= x1 or y2 <= y1) as degenerate from c""")
def _clamp_box(spark, sf):
    box = B.clamp_box(*cols("xmin", "ymin", "xmax", "ymax", "width", "height"))
    return _shifted(spark, sf).withColumn("b", box).select("state_id", "p1", "p2", "p3", "b.*")


@query("scale_to_canvas", f"""with {SHIFTED} select state_id, p1, p2, p3, {CANVAS} from shifted""")
def _scale_to_canvas(spark, sf):
    box = B.canvas_box(*cols("xmin", "ymin", "xmax", "ymax", "width", "height"))
    return _shifted(spark, sf).withColumn("b", box).select("state_id", "p1", "p2", "p3", "b.*")


@query("bin_boxes", f"""with {SHIFTED}, c as (select state_id, p1, p2, p3, {CANVAS} from shifted)
select state_id, p1, p2, p3, cast(cx1//5 as int) as x1b, cast(cy1//5 as int) as y1b,
       cast(cx2//5 as int) as x2b, cast(cy2//5 as int) as y2b from c""")
def _bin_boxes(spark, sf):
    return _scale_to_canvas(spark, sf).select(
        "state_id", "p1", "p2", "p3",
        *[B.grid_bin(F.col(c)).alias(b) for c, b in zip(["cx1", "cy1", "cx2", "cy2"], ["x1b", "y1b", "x2b", "y2b"])])


@query("onehot_boxes", f"""with {SHIFTED}, c as (select state_id, p1, p2, p3, {CANVAS} from shifted)
select state_id, p1, p2, p3, cx1//5 as at1, cy1//5 as at2, cx2//5 as at3, cy2//5 as at4, 4 as ones, 200 as width from c""")
def _onehot_boxes(spark, sf):
    """Where each group has its first one, how many ones there are in all, and the length."""
    code = B.onehot_boxes(*cols("x1b", "y1b", "x2b", "y2b"))
    one = F.lit(1).cast("byte")
    at = [F.array_position(F.slice("code", start, size), one) - 1 for start, size in ((1, 60), (61, 40), (101, 60), (161, 40))]
    return _bin_boxes(spark, sf).withColumn("code", code).select(
        "state_id", "p1", "p2", "p3", *[a.cast("int").alias(f"at{i + 1}") for i, a in enumerate(at)],
        F.size(F.array_remove("code", F.lit(0).cast("byte"))).alias("ones"), F.size("code").alias("width"))


@query("decode_boxes", f"""with {SHIFTED}, c as (select state_id, p1, p2, p3, {CANVAS} from shifted),
b as (select state_id, p1, p2, p3, cx1//5*5 as x1, cy1//5*5 as y1, cx2//5*5 as x2, cy2//5*5 as y2 from c)
select state_id, p1, p2, p3, cast(x1 as int) as x1, cast(y1 as int) as y1,
       cast(greatest(x1+5, x2) as int) as x2, cast(greatest(y1+5, y2) as int) as y2 from b""")
def _decode_boxes(spark, sf):
    code = B.onehot_boxes(*cols("x1b", "y1b", "x2b", "y2b"))
    return _bin_boxes(spark, sf).withColumn("code", code).withColumn(
        "b", B.decode_boxes(F.col("code"))).select("state_id", "p1", "p2", "p3", "b.*")


@query("center_box_to_corners", f"""with {SHIFTED},
n as (select state_id, p1, p2, p3, (xmin+xmax)/1800.0::double as cx, (ymin+ymax)/1200.0::double as cy,
             (xmax-xmin)/900.0::double as w, (ymax-ymin)/600.0::double as h from shifted),
t as (select *, cast(trunc((cx-w/2)*300) as int) as a, cast(trunc((cy-h/2)*200) as int) as b,
             cast(trunc((cx+w/2)*300) as int) as c, cast(trunc((cy+h/2)*200) as int) as d from n
      where w >= 1e-6 and h >= 1e-6)
select state_id, p1, p2, p3, greatest(0, a) as x1, greatest(0, b) as y1,
       least(300, greatest(a+1, c)) as x2, least(200, greatest(b+1, d)) as y2 from t""")
def _center_box(spark, sf):
    d = _shifted(spark, sf).select(
        "state_id", "p1", "p2", "p3",
        ((F.col("xmin") + F.col("xmax")) / F.lit(1800.0)).alias("cx"), ((F.col("ymin") + F.col("ymax")) / F.lit(1200.0)).alias("cy"),
        ((F.col("xmax") - F.col("xmin")) / F.lit(900.0)).alias("w"), ((F.col("ymax") - F.col("ymin")) / F.lit(600.0)).alias("h"))
    box = d.withColumn("box", B.center_box_to_corners(*cols("cx", "cy", "w", "h"))).where(F.col("box").isNotNull())
    return box.select("state_id", "p1", "p2", "p3", "box.*")


@query("rescale_box_units", f"""with {V.DETECTIONS}
select state_id, p1, p2, p3, cast(trunc(xmin/1000.0::double*width) as int) as x1, cast(trunc(ymin/1000.0::double*height) as int) as y1,
       cast(trunc(xmax/1000.0::double*width) as int) as x2, cast(trunc(ymax/1000.0::double*height) as int) as y2 from detections""")
def _rescale(spark, sf):
    box = B.rescale_box_units(F.array(*cols("xmin", "ymin", "xmax", "ymax")), F.col("width"), F.col("height"))
    return V.detections(spark, sf).withColumn("b", box).select(
        "state_id", *V.ORDER,
        *[F.col("b")[i].alias(n) for i, n in enumerate(["x1", "y1", "x2", "y2"])])


@query("read_normalized_detections", f"""
select vec_id as image, cast(trunc(x*640) as int) as xmin, cast(trunc(y*480) as int) as ymin,
       cast(trunc((x+w)*640) as int) as xmax, cast(trunc((y+h)*480) as int) as ymax, k as pos, cast(label as varchar) as class
from (select vec_id, label, cast(k as int) as k, abs(embedding[k*4+1]::double) as x, abs(embedding[k*4+2]::double) as y,
             abs(embedding[k*4+3]::double) as w, abs(embedding[k*4+4]::double) as h
      from embeddings, range(16) t(k) where k < vec_id % 17)""")
def _normalized(spark, sf):
    from sceneframe.sources.annotations import normalized_detections
    # image i lists i mod 17 of its 16 boxes; those without any are dropped
    boxes = F.transform(
        F.slice(F.sequence(F.lit(0), F.lit(15)), F.lit(1), (F.col("vec_id") % 17).cast("int")),
        lambda k: F.struct(
            F.col("label").cast("string").alias("label"),
            F.transform(F.slice("embedding", k * 4 + 1, 4), lambda v: F.abs(v.cast("double"))).alias("bounding_box")))
    images = V.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image"), F.lit(640).alias("width"), F.lit(480).alias("height"), boxes.alias("detections"))
    return normalized_detections(images)


@query("assemble_state", f"""with {BINNED}
select b.state_id, cast(b.slot as int) as slot, cast(200 + 64 as int) as width,
  repeat('0', x1b) || '1' || repeat('0', 59 - x1b) || repeat('0', y1b) || '1' || repeat('0', 39 - y1b) ||
  repeat('0', x2b) || '1' || repeat('0', 59 - x2b) || repeat('0', y2b) || '1' || repeat('0', 39 - y2b) as code,
  coalesce(round(list_sum([x::double for x in e.embedding]), 6), 0) as patch_sum
from binned b left join embeddings e on e.vec_id = b.state_id""")
def _assemble(spark, sf):
    from sceneframe.operators.pixels import assemble_state
    patches = V.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("state_id"), F.col("embedding").cast("array<double>").alias("patch"))
    zero = F.array_repeat(F.lit(0.0), 64)  # a state without a picture
    slots = _scene_slots(spark, sf).join(patches, "state_id", "left")
    full = assemble_state(slots.withColumn("patch", F.coalesce("patch", zero)))
    parts = full.select(
        "state_id", "slot", F.size("features").alias("width"), F.slice("features", 65, 200).alias("code"),
        F.array_remove(F.slice("features", 1, 64), 0.0).alias("lit"))
    return parts.select(
        "state_id", "slot", "width", B.code_digits(F.col("code")).alias("code"),
        F.round(F.aggregate("lit", F.lit(0.0), lambda a, v: a + v), 6).alias("patch_sum"))


# ---- naming, ranking, padding

@query("name_objects", f"""with {V.DETECTIONS}, {V.SUBJECTS}, {V.CATEGORIES}
select d.state_id, p1, p2, p3, coalesce(c.category, 'obj' || d.tid) as name
from detections d left join categories c on d.video_id = c.video_id and d.tid = c.tid""")
def _name_objects(spark, sf):
    cats = S.subject_categories(V.subjects(spark, sf), order=["fid", *V.ORDER])
    d = S.name_objects(V.detections(spark, sf), cats)
    return d.select("state_id", *V.ORDER, "name")


@query("frames_present", f"""with {V.DETECTIONS}, {V.FRAMES}
select state_id, count(*) as objects from detections d
where exists (select 1 from frames f where f.fid = d.fid and f.has_jpg) group by state_id""")
def _frames_present(spark, sf):
    jpgs = V.frames(spark, sf).where("has_jpg")
    return S.frames_present(V.detections(spark, sf), jpgs, ["fid"]).groupBy("state_id").agg(F.count("*").alias("objects"))


@query("rank_slots", f"""with {RANKED}
select state_id, cast(slot as int) as slot, category, xmin, ymin, xmax, ymax from ranked""")
def _rank_slots(spark, sf):
    return S.rank_slots(V.detections(spark, sf), "state_id", raw_area(), V.ORDER).select(
        "state_id", "slot", "category", "xmin", "ymin", "xmax", "ymax")


@query("unique_names", f"with {NAMED} select state_id, cast(slot as int) as slot, name from named")
def _unique_names(spark, sf):
    ranked = S.rank_slots(V.detections(spark, sf), "state_id", raw_area(), V.ORDER)
    return S.unique_names(ranked, "state_id", "category").select("state_id", "slot", "name")


@query("pad_slots", f"""with {RANKED}
select state_id, cast(slot as int) as slot, category as name, xmin, ymin, xmax, ymax, false as is_pad from ranked
union all
select state_id, cast(i as int), 'pad_' || i, 0, 0, 0, 0, true
from (select state_id, count(*) as n from ranked group by state_id), range(10) t(i) where i >= n""")
def _pad_slots(spark, sf):
    ranked = _rank_slots(spark, sf).withColumnRenamed("category", "name")
    return S.pad_slots(ranked, "state_id", ["xmin", "ymin", "xmax", "ymax"])


@query("skip_empty", """select conv_id as image, cast(turn as bigint) as turn, len(ws) as objects from (
  select conv_id, turn, [w for w in string_split(text, ' ') if w <> ''] as ws from conversations) where len(ws) > 0""")
def _skip_empty(spark, sf):
    images = V.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("image"), "turn",
        F.filter(F.split("text", " ", -1), lambda w: w != "").alias("objects"))
    return S.skip_empty(images).select("image", "turn", F.size("objects").cast("long").alias("objects"))


@query("drop_empty_frames", """select conv_id as video_id, turn as fid, cast(i as int) as pos, ws[i+1] as word from (
  select conv_id, turn, [w for w in string_split(text, ' ') if w <> ''] as ws from conversations),
  lateral (select unnest(range(len(ws))) as i) t""")
def _drop_empty_frames(spark, sf):
    images = V.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("fid"),
        F.filter(F.split("text", " ", -1), lambda w: w != "").alias("objects"))
    return S.explode_subset(images, "objects", "pos", "word")


@query("label_subset", f"""with {V.DETECTIONS}
select category, count(*) as objects from detections where category in ('ECONOMY', 'PROMO') group by category""")
def _label_subset(spark, sf):
    return S.label_subset(V.detections(spark, sf), "category", ["ECONOMY", "PROMO"]).groupBy("category").agg(
        F.count("*").alias("objects"))


# ---- profile reports

@query("primary_category", f"""with {V.DETECTIONS}, {V.SUBJECTS}, {V.CATEGORIES}, {V.PRIMARIES}
select video_id, primary_category as "primary" from primaries""")
def _primary(spark, sf):
    return P.primary_category(V.detections(spark, sf), S.subject_categories(V.subjects(spark, sf), order=["fid", *V.ORDER]),
                              first=V.seen_first())


@query("category_filter_strict", f"""with {V.DETECTIONS}, {V.SUBJECTS}, {V.CATEGORIES}, {V.PRIMARIES}
select state_id, count(*) as objects from detections d join primaries p on d.video_id = p.video_id
where primary_category = 'ECONOMY' group by state_id""")
def _filter_strict(spark, sf):
    kept = P.category_filter(V.detections(spark, sf), "ECONOMY", primaries=_primary(spark, sf))
    return kept.groupBy("state_id").agg(F.count("*").alias("objects"))


@query("category_filter_loose", f"""with {V.FRAMES}
select video_id, count(*) as frames from frames
where video_id in (select video_id from frames where category = 'signup' and not has_jpg or category = 'purchase')
group by video_id""")
def _filter_loose(spark, sf):
    f = V.frames(spark, sf)
    subjects = f.select("video_id", "category").where("has_jpg")
    return P.category_filter(f, "purchase", subjects=subjects, strict=False).groupBy("video_id").agg(F.count("*").alias("frames"))


@query("category_video_counts", f"""with {V.FRAMES}
select category, count(distinct video_id) as videos from frames group by category""")
def _category_counts(spark, sf):
    return P.category_video_counts(V.frames(spark, sf))


VIABLE = V.FRAMES + """,
per as (select video_id, count(*) as n from frames where has_jpg group by video_id)"""


@query("viability", f"""with {VIABLE}, listed as (select distinct video_id, category from frames)
select category, count(*) as listed_videos, count(n) as videos, cast(coalesce(sum(n), 0) as bigint) as frames,
       cast(coalesce(sum(greatest(n-1, 0)), 0) as bigint) as transitions, coalesce(sum(greatest(n-1, 0)), 0) >= 5000 as viable
from listed left join per using (video_id) group by category""")
def _viability(spark, sf):
    f = V.frames(spark, sf)
    return P.viability(f, f.where("has_jpg"))


@query("viability_strict", f"""with {V.DETECTIONS}, {V.SUBJECTS}, {V.CATEGORIES}, {V.PRIMARIES},
f as (select distinct video_id, state_id from detections), per as (select video_id, count(*) as n from f group by video_id)
select primary_category as category, count(*) as listed_videos, count(n) as videos, cast(coalesce(sum(n), 0) as bigint) as frames,
       cast(coalesce(sum(greatest(n-1, 0)), 0) as bigint) as transitions, coalesce(sum(greatest(n-1, 0)), 0) >= 5000 as viable
from primaries left join per using (video_id) where primary_category is not null group by primary_category""")
def _viability_strict(spark, sf):
    """Videos count for their primary category only."""
    frames = V.detections(spark, sf).select("video_id", "state_id").distinct()
    return P.viability(V.subjects(spark, sf), frames, primaries=_primary(spark, sf))


@query("viability_total", f"""with {VIABLE}
select count(*) as videos, cast(sum(n) as bigint) as frames, cast(sum(n-1) as bigint) as transitions,
       sum(n-1) >= 5000 as viable from per""")
def _viability_total(spark, sf):
    return P.viability_total(V.frames(spark, sf).where("has_jpg"))


@query("annotation_metrics", """with w as (
  select conv_id, turn, [w for w in string_split(text, ' ') if w <> ''] as ws from conversations)
select 'images' as metric, '' as item, count(*) as value from w
union all select 'objects', '', cast(sum(len(ws)) as bigint) from w
union all select 'objects_per_image', cast(len(ws) as varchar), count(*) from w group by len(ws)
union all select 'label', u, count(*) from (select unnest(ws) as u from w) group by u""")
def _annotation_metrics(spark, sf):
    words = F.filter(F.split("text", " ", -1), lambda w: w != "")
    images = V.table(spark, sf, "conversations").select(F.transform(words, lambda w: F.struct(w.alias("class"))).alias("objects"))
    return P.annotation_metrics(images)


@query("top_labels", f"""with {V.DETECTIONS}
select category, count(*) as objects from detections group by category order by objects desc, category limit 10""")
def _top_labels(spark, sf):
    return P.top_labels(V.detections(spark, sf), "category")


@query("category_audit", f"""with {V.DETECTIONS}, {V.SUBJECTS}, {V.CATEGORIES}, {V.PRIMARIES}
select primary_category as "primary", count(*) as videos, primary_category is distinct from 'ECONOMY' as violation
from primaries group by primary_category""")
def _category_audit(spark, sf):
    return P.category_audit(_primary(spark, sf), "ECONOMY")


@query("audit_verdict", f"""with {V.DETECTIONS}, {V.SUBJECTS}, {V.CATEGORIES}, {V.PRIMARIES}
select count(*) as videos, count(*) filter (where primary_category is distinct from 'ECONOMY') as violations,
       count(*) filter (where primary_category is distinct from 'ECONOMY') = 0 as passed from primaries""")
def _audit_verdict(spark, sf):
    return P.audit_verdict(_primary(spark, sf), "ECONOMY")


@query("load_summary", f"""with {V.DETECTIONS}, {V.SUBJECTS}, {V.CATEGORIES}, {V.PRIMARIES}, {V.FRAMES},
s as (select distinct d.video_id, d.state_id from detections d
      where exists (select 1 from frames f where f.fid = d.fid and f.has_jpg))
select p.video_id, p.primary_category as "primary", count(s.state_id) as states
from primaries p left join s on p.video_id = s.video_id group by p.video_id, p.primary_category""")
def _load_summary(spark, sf):
    jpgs = V.frames(spark, sf).where("has_jpg")
    states = S.frames_present(V.detections(spark, sf), jpgs, ["fid"]).select("video_id", "state_id").distinct()
    return P.load_summary(_primary(spark, sf), states)


@query("load_totals", f"""with {V.DETECTIONS}, {V.FRAMES},
s as (select distinct d.state_id from detections d
      where exists (select 1 from frames f where f.fid = d.fid and f.has_jpg))
select (select count(distinct video_id) from detections) as num_videos, (select count(*) from s) as num_states""")
def _load_totals(spark, sf):
    return P.load_totals(_load_summary(spark, sf))


@query("manifest_guard", f"""select 'ECONOMY' as category_filter, true as strict, count(distinct l_orderkey % 50) as num_videos
from lineitem join part on l_partkey = p_partkey""")
def _manifest_guard(spark, sf):
    manifest = V.detections(spark, sf).agg(F.count_distinct("video_id").alias("num_videos")).select(
        F.lit("ECONOMY").alias("category_filter"), F.lit(True).alias("strict"), "num_videos")
    return P.manifest_guard(manifest, "ECONOMY")


@query("run_sizing_from_history", """with j as (
  select o_orderkey % 3 as d, o_orderkey % 24 as h, o_orderkey % 60 as m, (o_orderkey * 7) % 60 as s,
         o_custkey % 5000 as num, ['K','M','G','B'][o_orderkey % 4 + 1] as unit, o_orderkey from orders),
t as (select ((case when d > 0 then d else 0 end * 24 + h) * 60 + m) * 60 + s as sec,
             case when o_orderkey % 11 = 0 then null when unit = 'K' then num / 1024.0::double when unit = 'M' then num::double
                  when unit = 'G' then num * 1024.0::double else num / 1024.0::double / 1024 end as mb
      from j where o_orderkey % 13 <> 0),
x as (select count(*) as runs, max(sec) as max_seconds, cast(floor(coalesce(max(mb), 0)) as bigint) as max_mb from t)
select runs, cast(max_seconds as bigint) as max_seconds, max_mb, cast(floor(max_seconds * 5 / 4) as bigint) + 1800 as request_seconds,
       greatest(cast(floor(max_mb * 5 / 4) as bigint) + 2048, 16384) as request_mb,
       cast(ceil(greatest(cast(floor(max_mb * 5 / 4) as bigint) + 2048, 16384) / 1024) as bigint) as request_gb from x""")
def _run_sizing(spark, sf):
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    clock = F.format_string("%02d:%02d:%02d", k % 24, k % 60, (k * 7) % 60)
    days = F.when(k % 3 > 0, F.concat((k % 3).cast("string"), F.lit("-"))).otherwise("")
    unit = F.element_at(F.array(*[F.lit(u) for u in "KMGB"]), (k % 4 + 1).cast("int"))
    jobs = o.select(
        F.when(k % 13 == 0, "").otherwise(F.concat(days, clock)).alias("elapsed"),
        F.when(k % 11 == 0, "").otherwise(F.concat((F.col("o_custkey") % 5000).cast("string"), unit)).alias("max_rss"))
    return P.run_sizing_from_history(jobs)


# ---- transitions and splits

@query("sequential_in_group", f"""with {V.FRAMES}
select * from (select video_id, fid as pre, lead(fid) over (partition by video_id order by fid) as suc
               from frames where has_jpg) where suc is not null""")
def _sequential(spark, sf):
    return R.sequential_in_group(V.frames(spark, sf).where("has_jpg"), "video_id", "fid", chunk=2000)


@query("sequential_global", """select position, pre, suc from (
  select o_orderkey as pre, lead(o_orderkey) over (order by o_orderdate, o_orderkey) as suc,
         row_number() over (order by o_orderdate, o_orderkey) - 1 as position from orders) where suc is not null""")
def _sequential_global(spark, sf):
    return R.sequential_global(V.table(spark, sf, "orders"), "o_orderkey", ["o_orderdate", "o_orderkey"])


@query("pair_counts", f"""with {V.FRAMES}
select a.video_id, count(distinct a.fid) as states, count(*) as pairs
from frames a join frames b on a.video_id = b.video_id and a.fid <> b.fid group by a.video_id""")
def _pair_counts(spark, sf):
    return R.pair_counts(V.frames(spark, sf), "video_id").where("pairs > 0")


@query("gather_transitions", f"""with {V.FRAMES},
t as (select * from (select video_id, fid as pre, lead(fid) over (partition by video_id order by fid) as suc from frames)
      where suc is not null)
select t.video_id, t.pre, t.suc, a.value as pre_value, b.value as suc_value, a.event_type as pre_event_type, b.event_type as suc_event_type
from t join events a on a.event_id = t.pre join events b on b.event_id = t.suc""")
def _gather(spark, sf):
    pairs = R.sequential_in_group(V.frames(spark, sf), "video_id", "fid")
    return R.gather_transitions(pairs, V.table(spark, sf, "events"), "event_id", ["value", "event_type"]).select(
        "video_id", "pre", "suc", "pre_value", "suc_value", "pre_event_type", "suc_event_type")


PLACED = """placed as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as position from orders),
n as (select count(*) as n from orders)"""


@query("natural_position", f"with {PLACED} select o_orderkey, position from placed")
def _natural(spark, sf):
    return natural_position(V.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"),
                            ["o_orderdate", "o_orderkey"]).select("o_orderkey", "position")


@query("positional_split", f"""with {PLACED}
select o_orderkey, position, case when position < floor(n * 0.9::double) then 'train'
   when position < floor(n * 0.95::double) then 'val' else 'test' end as split from placed, n""")
def _positional_split(spark, sf):
    orders = V.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    placed = natural_position(orders, ["o_orderdate", "o_orderkey"], total="n")
    return R.positional_split(placed, rows=F.col("n")).select("o_orderkey", "position", "split")


SPLIT_END = """case when position < floor(n * 0.9::double) then 'train'
   when position < floor(n * 0.95::double) then 'val' else 'test' end as split"""
STATE_PAIRS = """pairs as (select vec_id as number, vec_id as pre, vec_id + 1 as suc from embeddings
                        where vec_id + 1 in (select vec_id from embeddings)),
c as (select count(*) as t, 2 * count(*) as n from pairs)"""


def _state_pairs(spark, sf):
    e = V.table(spark, sf, "embeddings").select("vec_id")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"))
    return e.join(nxt, "vec_id", "left_semi").select(
        F.col("vec_id").alias("number"), F.col("vec_id").alias("pre"), (F.col("vec_id") + 1).alias("suc"))


@query("endpoint_order_blocked", f"""with {STATE_PAIRS},
e as (select number as position, pre as state from pairs union all select number + t, suc from pairs, c)
select position, state, {SPLIT_END} from e, c""")
def _endpoints(spark, sf):
    pairs = _state_pairs(spark, sf)
    count = total_rows(pairs)
    return R.positional_split(R.endpoints(pairs, "number", total=count), rows=count * 2)


@query("endpoint_order_interleaved", f"""with {STATE_PAIRS},
e as (select 2 * number as position, pre as state from pairs union all select 2 * number + 1, suc from pairs)
select position, state, {SPLIT_END} from e, c""")
def _endpoints_interleaved(spark, sf):
    pairs = _state_pairs(spark, sf)
    return R.positional_split(R.endpoints(pairs, "number", interleaved=True), rows=total_rows(pairs) * 2)


def h60(expr: str, seed: int) -> str:
    """DuckDB text of the stable hash."""
    return f"('0x' || substr(md5({expr} || '|{seed}'), 1, 15))::BIGINT"


@query("split_by_group", f"""select distinct l_orderkey % 50 as video_id, case
   when {h60('(l_orderkey % 50)', 0)} / 1152921504606846976.0::double < 0.9 then 'train'
   when {h60('(l_orderkey % 50)', 0)} / 1152921504606846976.0::double < 0.95 then 'val' else 'test' end as split
from lineitem""")
def _split_by_group(spark, sf):
    videos = V.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("video_id")).distinct()
    return R.split_by_group(videos, "video_id")


SUCCESSORS = """succ as (select distinct l_suppkey as pre, l_partkey as suc from lineitem)"""


@query("one_random_successor", f"""with {SUCCESSORS}
select pre, suc from (select pre, suc, row_number() over (partition by pre order by {h60("pre || '|' || suc", 5)}, suc) as r
from succ) where r = 1""")
def _one_successor(spark, sf):
    pairs = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("pre"), F.col("l_partkey").alias("suc"))
    return R.one_random_successor(pairs, seed=5)


@query("expand_successors", """select vec_id as pre, vec_id + d * k as suc
from embeddings, range(1, 4) t(k), (values (1), (-1)) s(d)""")
def _expand(spark, sf):
    v = F.col("vec_id")
    states = V.table(spark, sf, "embeddings").select(
        "vec_id", F.array(*[v + d * k for k in (1, 2, 3) for d in (1, -1)]).alias("successors"))
    return R.expand_successors(states, "vec_id", "successors")


@query("legal_transitions", """with o as (select l_orderkey as pre, l_partkey as suc, l_linenumber as nr, l_suppkey as s from lineitem),
legal as (select distinct o_orderkey as pre, o_custkey as suc from orders
          union select distinct l_orderkey, l_partkey from lineitem where l_returnflag = 'A'),
valid as (select o_orderkey as k from orders where o_orderstatus <> 'P' union select 0)
select o.pre, o.suc, o.nr, o.s, exists (select 1 from legal l where l.pre = o.pre and l.suc = o.suc)
   and o.pre in (select k from valid) and o.suc in (select k from valid) as is_legal from o""")
def _legal(spark, sf):
    line, orders = V.table(spark, sf, "lineitem"), V.table(spark, sf, "orders")
    observed = line.select(F.col("l_orderkey").alias("pre"), F.col("l_partkey").alias("suc"),
                           F.col("l_linenumber").alias("nr"), F.col("l_suppkey").alias("s"))
    legal = orders.select(F.col("o_orderkey").alias("pre"), F.col("o_custkey").alias("suc")).unionByName(
        line.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("pre"), F.col("l_partkey").alias("suc")))
    valid = orders.where("o_orderstatus <> 'P' or o_orderkey = 0").select(F.col("o_orderkey").alias("state"))
    return R.legal_transitions(observed, legal, valid, "state")


@query("batches", f"""select event_id, position, position // 256 as batch from (
  select event_id, row_number() over (order by {h60('event_id', 3)}, event_id) - 1 as position from events)""")
def _batches(spark, sf):
    return R.batches(V.table(spark, sf, "events").select("event_id"), ["event_id"], 256, seed=3)


@query("frame_key", f"""with {V.FRAMES}
select video_id, fid, video_id || '/' || lpad(fid::varchar, greatest(6, length(fid::varchar))::int, '0') as key, video_id::varchar as video from frames""")
def _frame_key(spark, sf):
    f = V.frames(spark, sf).select("video_id", "fid")
    return f.withColumn("key", T.frame_key(F.col("video_id"), F.col("fid"))).withColumn("video", T.frame_group(F.col("key")))


@query("subsample_frames", f"with {V.FRAMES} select video_id, fid from frames where fid % 10 = 0")
def _subsample(spark, sf):
    return V.frames(spark, sf).where(T.keeps_frame(F.col("fid"), 3)).select("video_id", "fid")


# ---- dataset plans

@query("video_slots", f"""with {V.DETECTIONS}, {V.SUBJECTS}, {V.CATEGORIES}, {V.PRIMARIES}, {V.FRAMES},
loaded as (select d.*, coalesce(c.category, 'obj' || d.tid) as name from detections d
  join primaries p on p.video_id = d.video_id and p.primary_category = 'ECONOMY'
  left join categories c on c.video_id = d.video_id and c.tid = d.tid
  where d.fid in (select fid from frames where has_jpg)),
r as (select *, row_number() over (partition by state_id order by (xmax-xmin)*(ymax-ymin) desc, p1, p2, p3) - 1 as slot from loaded qualify slot < 10),
c as (select state_id, slot, name, {CANVAS} from r)
select state_id, cast(slot as int) as slot, name, cast(cx1//5 as int) as x1b, cast(cy1//5 as int) as y1b,
       cast(cx2//5 as int) as x2b, cast(cy2//5 as int) as y2b, false as is_pad from c
union all select state_id, cast(i as int), 'pad_' || i, 0, 0, 0, 0, true
from (select state_id, count(*) as n from c group by state_id), range(10) t(i) where i >= n""")
def _video_slots(spark, sf):
    jpgs = V.frames(spark, sf).where("has_jpg")
    return D.video_slots(
        V.detections(spark, sf), V.subjects(spark, sf), jpgs, order=V.ORDER, category="ECONOMY", frame_keys=["fid"],
        subject_order=["fid", *V.ORDER], first=V.seen_first())


@query("video_splits", f"""with {V.FRAMES}, f as (select video_id, fid from frames where has_jpg),
t as (select * from (select video_id, fid as pre, lead(fid) over (partition by video_id order by fid) as suc from f) where suc is not null),
g as (select *, row_number() over (order by video_id, pre) - 1 as number from t), c as (select count(*) as t, 2 * count(*) as n from g),
e as (select video_id, number as position, pre as state from g union all select video_id, number + t, suc from g, c)
select video_id, position, state, {SPLIT_END} from e, c""")
def _video_splits(spark, sf):
    return D.video_splits(V.frames(spark, sf).where("has_jpg").select("video_id", "fid"))


RESTARTING = f"""{V.FRAMES}, f as (select video_id, row_number() over (partition by video_id order by fid) - 1 as fid from frames where has_jpg)"""


@query("video_splits_restarting", f"""with {RESTARTING},
t as (select * from (select video_id, fid as pre, lead(fid) over (partition by video_id order by fid) as suc from f) where suc is not null),
g as (select *, row_number() over (order by video_id, pre) - 1 as number from t), c as (select count(*) as t, 2 * count(*) as n from g),
e as (select video_id, number as position, pre as state from g union all select video_id, number + t, suc from g, c)
select video_id, position, state, {SPLIT_END} from e, c""")
def _video_splits_restarting(spark, sf):
    """Frame numbers start at 0 in every video."""
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("fid")) - 1
    frames = V.frames(spark, sf).where("has_jpg").select("video_id", place.alias("fid"))
    return D.video_splits(frames)
