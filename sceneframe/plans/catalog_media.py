"""Queries over texts, pixels, grids, training curves, samples, trials, scores and files."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sceneframe.functions.arrays import exploded
from sceneframe.functions import boxes as B
from sceneframe.functions import text as T
from sceneframe.operators import curves as K
from sceneframe.operators import grids as G
from sceneframe.operators import pixels as PX
from sceneframe.operators import profile as P
from sceneframe.operators import sampling as SA
from sceneframe.operators import scoring as SC
from sceneframe.operators import trials as TR
from sceneframe.operators import usage as U
from sceneframe.plans import views as V
from sceneframe.plans.catalog_codes import ATOMS, PREDICATES, THRESHOLD, bound
from sceneframe.plans.catalog_scenes import h60
from sceneframe.plans.registry import query
from sceneframe.operators import atoms as L
from sceneframe.session import scratch_path
from sceneframe.plans import datasets as DS
from sceneframe.sources import annotations as AN
from sceneframe.sources import listing as LS
from sceneframe.sources import sinks as SK
from sceneframe.sources import trials as TL

# ---- detector answers

ANSWERS = """objects as (
  select event_id as image, 0 as pos, event_type as class, (event_id % 900)::double as b0, 10::double as b1, 990::double as b2, 500::double as b3 from events
  union all select event_id, 1, 'x' || event_id, 1, 2, 3, 4 from events
  union all select event_id, 2, event_type, event_id, 2, null, null from events)"""


def _answer_rows(images):
    rows = exploded(images, "objects", "pos", "o", ["image"])
    return rows.select("image", "pos", F.col("o.class").alias("class"),
                       *[F.get("o.bbox", F.lit(i)).alias(f"b{i}") for i in range(4)])


@query("parse_vlm_objects", f"with {ANSWERS} select image, cast(pos as int) as pos, class, b0, b1, b2, b3 from objects")
def _parse(spark, sf):
    return _answer_rows(AN.labelled_from_answers(V.vlm_raw(spark, sf)))


def _arrays(rows):
    """Lines that each hold one JSON array: the values ``v`` of a ``bag``, written over several lines."""
    return rows.groupBy("bag").agg(F.to_json(F.collect_list("v"), {"pretty": "true"}).alias("value")).select("value")


@query("read_vlm_array", f"with {ANSWERS} select image::varchar as image, cast(pos as int) as pos, class, b0, b1, b2, b3 from objects")
def _read_answer_array(spark, sf):
    """The same answers from files of arrays, with brackets, quotes and braces inside their strings."""
    path = scratch_path(spark, "answers")
    raw = V.vlm_raw(spark, sf)
    _arrays(raw.select(F.floor(F.col("image") / 100).alias("bag"), F.struct("image", "output").alias("v"))).write.text(path)
    return _answer_rows(AN.labelled_from_answers(AN.read_vlm_answers(spark, path, multi_line=True)))


@query("read_vlm_answers", f"with {ANSWERS} select image::varchar as image, cast(pos as int) as pos, class, b0, b1, b2, b3 from objects")
def _read_answers(spark, sf):
    path = scratch_path(spark, "answers")
    V.vlm_raw(spark, sf).write.json(path)
    return _answer_rows(AN.labelled_from_answers(AN.read_vlm_answers(spark, path)))


@query("answer_metrics", """select 'images' as metric, '' as item, count(*) as value from events
union all select 'objects', '', 3 * count(*) from events union all select 'objects_per_image', '3', count(*) from events
union all select 'label', event_type, 2 * count(*) from events group by event_type
union all select 'label', 'x' || event_id, count(*) from events group by event_id""")
def _answer_metrics(spark, sf):
    return P.annotation_metrics(AN.labelled_from_answers(V.vlm_raw(spark, sf)))


# ---- annotation documents, one per row of the embeddings

def _docs(spark, sf):
    """Documents of 8 frames with 2 objects; frames of even fid of every third video are empty."""
    def obj(f, o):
        at = f * 8 + o * 4
        px = lambda i: F.floor(F.abs(F.col("embedding")[at + i].cast("double")) * 300).cast("int")
        return F.struct(
            F.lit(o + f % 3).alias("tid"),
            F.struct(px(0).alias("xmin"), px(1).alias("ymin"), (px(0) + px(2) + 1).alias("xmax"), (px(1) + px(3) + 1).alias("ymax")).alias("bbox"))

    frames = F.array(*[
        F.when((F.col("vec_id") % 3 == 0) & F.lit(f % 2 == 0), F.array().cast("array<struct<tid:int,bbox:struct<xmin:int,ymin:int,xmax:int,ymax:int>>>"))
        .otherwise(F.array(obj(f, 0), obj(f, 1))) for f in range(8)])
    listed = F.array(*[F.struct(F.lit(t).alias("tid"), F.concat(F.lit("c"), ((F.col("label") + t) % 7).cast("string")).alias("category")) for t in (0, 1, 2, 0)])
    return V.table(spark, sf, "embeddings").select(
        F.format_string("v%06d", "vec_id").alias("video_id"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit(8).alias("frame_count"),
        listed.alias("subject/objects"), frames.alias("trajectories"))


DOCS = """px as (select vec_id, label, f, o, (o + f % 3) as tid,
   cast(floor(abs(embedding[f*8+o*4+1]::double)*300) as int) as a, cast(floor(abs(embedding[f*8+o*4+2]::double)*300) as int) as b,
   cast(floor(abs(embedding[f*8+o*4+3]::double)*300) as int) as c, cast(floor(abs(embedding[f*8+o*4+4]::double)*300) as int) as d
  from embeddings, range(8) t(f), range(2) s(o) where not (vec_id % 3 = 0 and f % 2 = 0)),
objs as (select printf('v%06d', vec_id) as video_id, cast(f as int) as fid, cast(o as int) as pos, cast(tid as int) as tid,
   case when tid <= 2 then 'c' || ((label + tid) % 7) end as category, a as xmin, b as ymin, a + c + 1 as xmax, b + d + 1 as ymax from px)"""


@query("read_video_annotations", f"""with {DOCS}
select video_id, fid, pos, tid, coalesce(category, 'obj' || tid) as name, xmin, ymin, xmax, ymax from objs""")
def _read_videos(spark, sf):
    path = scratch_path(spark, "videos")
    _docs(spark, sf).write.json(path)
    docs = AN.read_video_annotations(spark, path, multi_line=False)
    return AN.video_detections(docs).select("video_id", "fid", "pos", "tid", "name", "xmin", "ymin", "xmax", "ymax")


def _read_docs(spark, sf):
    path = scratch_path(spark, "videos")
    _docs(spark, sf).write.json(path)
    return AN.read_video_annotations(spark, path, multi_line=False)


@query("annotation_slots", f"""with {DOCS}, r as (select *, row_number() over (partition by video_id, fid
    order by (xmax - xmin) * (ymax - ymin) desc, pos) - 1 as slot, count(*) over (partition by video_id, fid) as n from objs)
select printf('%s/%06d', video_id, fid) as state_id, cast(slot as int) as slot, coalesce(category, 'obj' || tid) as name, false as is_pad from r where slot < 10
union all select distinct printf('%s/%06d', video_id, fid), cast(i as int), 'pad_' || i, true from r, range(10) t(i) where i >= n""")
def _annotation_slots(spark, sf):
    """Files to slots; frame numbers restart in every video."""
    return DS.annotation_slots(_read_docs(spark, sf)).select("state_id", "slot", "name", "is_pad")


@query("annotation_splits", f"""with {DOCS}, f as (select distinct video_id, fid from objs),
t as (select * from (select video_id, fid as pre, lead(fid) over (partition by video_id order by fid) as suc from f) where suc is not null),
g as (select *, row_number() over (order by video_id, pre) - 1 as number from t), c as (select count(*) as t, 2 * count(*) as n from g),
e as (select video_id, number as position, pre as state from g union all select video_id, number + t, suc from g, c)
select video_id, position, state, printf('%s/%06d', video_id, state) as state_id, case when position < floor(n * 0.9::double) then 'train'
   when position < floor(n * 0.95::double) then 'val' else 'test' end as split from e, c""")
def _annotation_splits(spark, sf):
    """Files to transitions and splits, joined on video and frame."""
    return DS.annotation_splits(_read_docs(spark, sf))


@query("read_labeled_images", """select printf('img%d.jpg', vec_id) as image, cast(k as int) as pos, 'c' || ((label + k) % 5) as class,
   round(embedding[k*4+1]::double, 5) as xmin, round(embedding[k*4+2]::double, 5) as ymin, round(embedding[k*4+3]::double, 5) as xmax,
   round(embedding[k*4+4]::double, 5) as ymax
from embeddings, range(16) t(k) where k < vec_id % 17""")
def _read_images(spark, sf):
    """Files that each hold arrays of many images over many lines; an image lists up to all 16 boxes of its vector."""
    path = scratch_path(spark, "images")
    objects = F.transform(
        F.slice(F.sequence(F.lit(0), F.lit(15)), F.lit(1), (F.col("vec_id") % 17).cast("int")),
        lambda k: F.struct(F.concat(F.lit("c"), ((F.col("label") + k) % 5).cast("string")).alias("class"),
                           F.transform(F.slice("embedding", k * 4 + 1, 4), lambda v: v.cast("double")).alias("bbox")))
    image = F.struct(F.format_string("img%d.jpg", "vec_id").alias("image"), objects.alias("objects"))
    _arrays(V.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("bag"), image.alias("v"))).write.text(path)
    d = AN.image_detections(AN.read_labeled_images(spark, path))
    return d.select("image", "pos", "class", *[F.round(c, 5).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query("list_frames", "select user_id::varchar as video_id, event_id as fid from events where event_type <> 'error'")
def _list_frames(spark, sf):
    f = V.frames(spark, sf)
    ext = F.when(F.col("has_jpg"), ".jpg").otherwise(".txt")
    paths = f.select(F.concat(F.lit("file:/data/frames/"), T.frame_key(F.col("video_id"), F.col("fid")), ext).alias("path"))
    return AN.frames_from_paths(paths)


@query("list_files", "select distinct event_type as kind, event_id % 40 as bucket from events")
def _list_files(spark, sf):
    """Folders of a table that Spark writes in two levels, found again from the names of its files."""
    path = scratch_path(spark, "tree")
    rows = V.table(spark, sf, "events").select("event_type", (F.col("event_id") % 40).alias("bucket"), F.col("event_id").cast("string").alias("value"))
    rows.repartition("event_type", "bucket").write.partitionBy("event_type", "bucket").text(path)
    folder = r"/event_type=([^/]+)/bucket=([0-9]+)/[^/]+$"
    found = LS.list_files(spark, path)
    return found.where("size > 0").select(F.regexp_extract("path", folder, 1).alias("kind"), F.regexp_extract("path", folder, 2).cast("long").alias("bucket"))


@query("read_names_manifest", """select cast(vec_id as int) as ordinal, 'f' || vec_id as id,
  case when vec_id % 2 = 0 then 'new' || vec_id else 'old' end as first_name from embeddings""")
def _names_manifest(spark, sf):
    e = V.table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("ordinal"))
    states = e.select("ordinal", F.array(F.lit("old")).alias("object_names"), F.concat(F.lit("f"), F.col("ordinal").cast("string")).alias("id"))
    saved = e.where("ordinal % 2 = 0").select(
        "ordinal", F.concat(F.lit("f"), F.col("ordinal").cast("string")).alias("id"),
        F.array(F.concat(F.lit("new"), F.col("ordinal").cast("string"))).alias("object_names"))
    return AN.with_saved_names(states, saved).select("ordinal", "id", F.col("object_names")[0].alias("first_name"))


@query("read_array_archive", """select vec_id as state_id, r as row, round(list_sum([x::double for x in embedding[r*32+1:r*32+32]]), 5) as total
from embeddings, range(2) t(r)""")
def _archives(spark, sf):
    """Each state packed into an archive of a 2 x 32 array, then read back."""
    def pack(batches):
        for batch in batches:
            contents = []
            for e in batch["embedding"]:
                buffer = io.BytesIO()
                np.savez(buffer, states=np.asarray(e, dtype=np.float64).reshape(2, 32))
                contents.append(buffer.getvalue())
            yield pd.DataFrame({"path": batch["vec_id"].astype(str), "content": contents})

    files = V.table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(pack, "path string, content binary")
    rows = AN.decode_archives(files, "states array<double>")
    return rows.select(F.col("file").cast("long").alias("state_id"), "row",
                       F.round(F.aggregate("states", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


# ---- pixels

def _px(spark, sf):
    return V.pixels(spark, sf)


@query("scale_pixels", f"with {V.PIXELS} select img, y, x, round(v / 256, 9) + 0.0 as v from pixels")
def _scale(spark, sf):
    return _px(spark, sf).select("img", "y", "x", (F.round(PX.scale_pixels(F.col("v")), 9) + 0.0).alias("v"))


@query("binarize_pixels", f"with {V.PIXELS} select img, y, x, cast(round_even(abs(v) * 900 / 255, 0) as int) as v from pixels")
def _binarize(spark, sf):
    return _px(spark, sf).select("img", "y", "x", PX.binarize_pixels(F.abs(F.col("v")) * 900).alias("v"))


@query("enhance_contrast", f"with {V.PIXELS} select img, y, x, round(greatest(least((v - 0.5) * 3, 0.5), -0.5) + 0.5, 6) as v from pixels")
def _enhance(spark, sf):
    return _px(spark, sf).select("img", "y", "x", F.round(PX.enhance_contrast(F.col("v")), 6).alias("v"))


@query("normalize_pixels", f"""with {V.PIXELS}, r as (select min(v) as lo, max(v) as hi from pixels)
select img, y, x, round((v - lo) / (hi - lo), 6) as v from pixels, r""")
def _normalize(spark, sf):
    return PX.normalize_pixels(_px(spark, sf)).select("img", "y", "x", F.round("v", 6).alias("v"))


EQUALIZED = V.PIXELS + """, r as (select min(v) as lo, max(v) as hi, (max(v) - min(v)) / 256 as w from pixels),
b as (select least(255, cast(floor((v - lo) / w) as int)) as bin, count(*) as n from pixels, r group by 1),
h as (select i as bin, coalesce(n, 0) as n from range(256) t(i) left join b on b.bin = i),
cdf as (select bin, sum(n) over (order by bin) / (sum(n) over ())::double as c from h),
t as (select img, y, x, v, (v - lo) / w - 0.5 as t from pixels, r),
k as (select *, least(greatest(cast(floor(t) as int), 0), 254) as k from t),
f as (select *, least(greatest(t - k, 0.0), 1.0) as f from k),
eq as (select img, y, x, a.c * (1 - f) + z.c * f as v from f join cdf a on a.bin = f.k join cdf z on z.bin = f.k + 1)"""


@query("cdf", f"with {EQUALIZED} select cast(bin as int) as bin, round(c, 9) as cdf from cdf")
def _cdf(spark, sf):
    return PX.cdf(PX.histogram(_px(spark, sf), "v")).select("bin", F.round("cdf", 9).alias("cdf"))


@query("equalize_histogram", f"with {EQUALIZED} select img, y, x, round(v, 6) as v from eq")
def _equalize(spark, sf):
    return PX.equalize_histogram(_px(spark, sf)).select("img", "y", "x", F.round("v", 6).alias("v"))


@query("preprocess", f"""with {EQUALIZED}, s as (select min(v) as lo, max(v) as hi from eq)
select img, y, x, round(greatest(least(((v - lo) / (hi - lo) - 0.5) * 3, 0.5), -0.5) + 0.5, 6) as v from eq, s""")
def _preprocess(spark, sf):
    return PX.preprocess(_px(spark, sf)).select("img", "y", "x", F.round("v", 6).alias("v"))


@query("preprocess_patches", f"""with {EQUALIZED}, s as (select min(v) as lo, max(v) as hi from eq)
select img, y, x, round(greatest(least(((v - lo) / (hi - lo) - 0.5) * 3, 0.5), -0.5) + 0.5, 6) as v from eq, s""")
def _preprocess_patches(spark, sf):
    patches = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("img"), F.col("embedding").cast("array<double>").alias("patch"))
    p = exploded(PX.preprocess_patches(patches), "patch", "i", "v", ["img"])
    return p.select("img", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.round("v", 6).alias("v"))


@query("block_mean_downsample", f"""with {V.PIXELS}
select img, cast(y // 3 as int) as y, cast(x // 2 as int) as x, round(avg(v), 6) + 0.0 as v from pixels where y < 6 and x < 8 group by img, y // 3, x // 2""")
def _block_mean(spark, sf):
    return PX.block_mean_downsample(_px(spark, sf), 3, 2, 8, 8).withColumn("v", F.round("v", 6) + 0.0)


@query("stride_downsample", f"""with {V.PIXELS}
select img, cast(y // 2 as int) as y, cast(x // 3 as int) as x, round_even(v * 4, 0) + 0.0 as v from pixels where y % 2 = 0 and x % 3 = 0""")
def _stride(spark, sf):
    return PX.stride_downsample(_px(spark, sf).withColumn("v", F.col("v") * 4), 2, 3).withColumn("v", F.col("v") + 0.0)


@query("split_tiles", f"""with {V.PIXELS}
select img, cast((y // 2) * 3 + x // 2 as int) as tile, cast(y % 2 as int) as y, cast(x % 2 as int) as x, v from pixels where y < 8 and x < 6""")
def _split_tiles(spark, sf):
    return PX.split_tiles(_px(spark, sf), 4, 3, 8, 8)


@query("crop_resize", """with px as (select vec_id as image, [(floor(abs(v::double) * 1000) % 256)::int for v in embedding] as p, embedding as e from embeddings),
b as (select image, p, s, (floor(abs(e[4*s+1]::double) * 80) % 8)::int as x1, (floor(abs(e[4*s+2]::double) * 80) % 8)::int as y1,
   (floor(abs(e[4*s+3]::double) * 50) % 5)::int as w, (floor(abs(e[4*s+4]::double) * 50) % 5)::int as h from px, range(16) t(s)),
c as (select *, least(x1 + w, 8) - x1 as cw, least(y1 + h, 8) - y1 as ch from b),
g as (select *, greatest(least((i + 0.5::double) * ch / 8 - 0.5::double, ch - 1), 0) as ay, greatest(least((j + 0.5::double) * cw / 8 - 0.5::double, cw - 1), 0) as ax
   from c, range(8) r(i), range(8) q(j)),
k as (select *, floor(ay)::int as y0, least(floor(ay)::int + 1, ch - 1) as y2, ay - floor(ay) as fy, floor(ax)::int as x0, least(floor(ax)::int + 1, cw - 1) as x2, ax - floor(ax) as fx from g),
v as (select *, case when cw > 0 and ch > 0 then round_even((p[(y1+y0)*8+x1+x0+1] * (1 - fx) + p[(y1+y0)*8+x1+x2+1] * fx) * (1 - fy)
   + (p[(y1+y2)*8+x1+x0+1] * (1 - fx) + p[(y1+y2)*8+x1+x2+1] * fx) * fy, 0)::int else 0 end as v from k)
select image, s::int as slot, string_agg(printf('%02X', v), '' order by i, j) as patch from v group by image, s""")
def _crop_resize(spark, sf):
    """16 boxes of every 8 x 8 image; those without width or height are black."""
    e = F.col("embedding")
    digits = F.transform(e, lambda v: F.lpad(F.hex((F.floor(F.abs(v.cast("double")) * 1000) % 256).cast("int")), 2, "0"))
    at = lambda i, n: F.floor(F.abs(e[i].cast("double")) * (10 * n)) % n
    box = lambda s: F.struct(F.lit(s).alias("slot"), at(4 * s, 8).alias("x1"), at(4 * s + 1, 8).alias("y1"),
                             (at(4 * s, 8) + at(4 * s + 2, 5)).alias("x2"), (at(4 * s + 1, 8) + at(4 * s + 3, 5)).alias("y2"))
    images = V.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"),
        F.unhex(F.array_join(digits, "")).alias("data"), F.array(*[box(s) for s in range(16)]).alias("boxes"))
    return PX.crop_resize(images, 8, "image long").select("image", "slot", F.hex("patch").alias("patch"))


# ---- grids

def _tiles(spark, sf):
    """16 binary 2 x 2 tiles per image, cut inside the row."""
    e = F.col("embedding")
    cells = [F.array(*[(e[(cy * 2 + dy) * 8 + cx * 2 + dx] > 0).cast("double") for dy in (0, 1) for dx in (0, 1)])
             for cy in range(4) for cx in range(4)]
    return V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("state_id"), F.posexplode(F.array(*cells)).alias("cell", "tile"))


def _panels(spark, sf):
    """The distinct tiles as panels, numbered by their bits; the library lacks those with two set pixels."""
    t = F.col("tile")
    number = (t[0] * 8 + t[1] * 4 + t[2] * 2 + t[3]).cast("int")
    return _tiles(spark, sf).select(number.alias("panel"), F.col("tile").alias("pattern")).distinct().where("bit_count(panel) <> 2")


TILES = """bits as (select vec_id as state_id, i // 8 as y, i % 8 as x, cast(embedding[i+1] > 0 as int) as b from embeddings, range(64) t(i)),
tiles as (select state_id, (y // 2) * 4 + x // 2 as cell, string_agg(b::varchar, '' order by y, x) as tile from bits group by state_id, y // 2, x // 2),
panels as (select distinct substr(tile,1,1)::int * 8 + substr(tile,2,1)::int * 4 + substr(tile,3,1)::int * 2 + substr(tile,4,1)::int as panel, tile as pattern from tiles
   where substr(tile,1,1)::int + substr(tile,2,1)::int + substr(tile,3,1)::int + substr(tile,4,1)::int <> 2)"""
EQUAL_MATCH = TILES + """, m as (select t.state_id, t.cell, p.panel from tiles t left join panels p on p.pattern = t.tile)"""
BLOCK_MATCH = TILES + """, m as (select t.state_id, t.cell, p.panel from tiles t left join panels p on
   round_even(((substr(tile,1,1) <> substr(pattern,1,1))::int + (substr(tile,2,1) <> substr(pattern,2,1))::int
    + (substr(tile,3,1) <> substr(pattern,3,1))::int + (substr(tile,4,1) <> substr(pattern,4,1))::int) / 4.0::double, 0) <= 0.01)"""
MATCH_ROWS = """select state_id, cast(cell as int) as cell, count(panel) as n, coalesce(string_agg(panel::varchar, ',' order by panel), '') as panels from m group by state_id, cell"""


def _matches(spark, sf, rule):
    return G.match_templates(_tiles(spark, sf), _panels(spark, sf), rule, 2, 2)


def _match_rows(m):
    return m.select("state_id", "cell", F.size("panels").cast("long").alias("n"), F.array_join(F.col("panels").cast("array<string>"), ",").alias("panels"))


@query("match_templates_block", f"with {BLOCK_MATCH} {MATCH_ROWS}")
def _match_block(spark, sf):
    return _match_rows(_matches(spark, sf, "block"))


@query("match_templates_plain", f"with {EQUAL_MATCH} {MATCH_ROWS}")
def _match_plain(spark, sf):
    return _match_rows(_matches(spark, sf, "plain"))


@query("match_templates_rounded", f"with {EQUAL_MATCH} {MATCH_ROWS}")
def _match_rounded(spark, sf):
    return _match_rows(_matches(spark, sf, "rounded"))


@query("match_templates_twisted", """with bits as (select vec_id as state_id, i // 8 as y, i % 8 as x, cast(embedding[i+1] > 0 as int) as b from embeddings, range(64) t(i)),
tiles as (select state_id, (y // 3) * 2 + x // 3 as cell, sum(b << ((y % 3) * 3 + x % 3))::bigint as tile from bits where y < 6 and x < 6 group by all),
panels as (select distinct tile as panel from tiles)
select state_id, cell::int as cell, count(*) as n, min(panel)::int as first, max(panel)::int as last, sum(panel)::bigint as total
from tiles join panels on bit_count(xor(tile, panel)) <= 4 group by state_id, cell""")
def _match_twisted(spark, sf):
    """3 x 3 tiles against all distinct tiles: a mean difference of a half or less rounds to none."""
    e = F.col("embedding")
    cells = [F.array(*[(e[(cy * 3 + dy) * 8 + cx * 3 + dx] > 0).cast("double") for dy in range(3) for dx in range(3)]) for cy in range(2) for cx in range(2)]
    tiles = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("state_id"), F.posexplode(F.array(*cells)).alias("cell", "tile"))
    number = sum((F.get("tile", F.lit(i)) * (1 << i) for i in range(9)), F.lit(0.0)).cast("int")
    panels = tiles.select(number.alias("panel"), F.col("tile").alias("pattern")).distinct()
    m = G.match_templates(tiles, panels, "twisted", 3, 3)
    total = F.aggregate("panels", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return m.select("state_id", "cell", F.size("panels").cast("long").alias("n"), F.get("panels", F.lit(0)).alias("first"),
                    F.try_element_at("panels", F.lit(-1)).alias("last"), total.alias("total"))


PANELS = [p for p in range(16) if p.bit_count() != 2]


@query("configs_from_matches", f"""with {EQUAL_MATCH},
c as (select e.vec_id as state_id, p.i as panel, coalesce(sum(m.cell), 0) as pos
      from embeddings e join range(16) p(i) on bit_count(p.i) <> 2 left join m on m.state_id = e.vec_id and m.panel = p.i group by 1, 2)
select state_id, string_agg(pos::varchar, ',' order by panel) as config from c group by state_id""")
def _configs(spark, sf):
    c = G.configs_from_matches(_matches(spark, sf, "rounded"), "state_id", PANELS)
    return c.select("state_id", F.array_join(F.col("config").cast("array<string>"), ",").alias("config"))


VALID = """n as (select state_id, cell, count(panel) as n from m group by state_id, cell),
o as (select state_id, bool_and(n = 1) as panels_ok, bool_or(n = 0) as nomatch, bool_or(n > 1) as ambiguous from n group by state_id),
p as (select state_id, panel, count(*) as k from m where panel is not null group by state_id, panel),
q as (select state_id, max(k) <= 1 as c from p group by state_id),
v as (select state_id, panels_ok, nomatch, ambiguous, coalesce(c, true) as coverage_ok, panels_ok and coalesce(c, true) as valid from o left join q using (state_id))"""


@query("grid_validity", f"with {BLOCK_MATCH}, {VALID} select * from v")
def _validity(spark, sf):
    return G.grid_validity(_matches(spark, sf, "block"), "state_id", PANELS)


@query("grid_validity_exact", f"""with {EQUAL_MATCH}, c as (select state_id, cell, count(panel) as n, count(*) filter (where panel = 0) as k from m group by state_id, cell)
select state_id, bool_and(n = 1) as panels_ok, bool_or(n = 0) as nomatch, bool_or(n > 1) as ambiguous, sum(k) = 1 as coverage_ok,
  bool_and(n = 1) and sum(k) = 1 as valid from c group by state_id""")
def _validity_exact(spark, sf):
    """Panel 0 must stand in exactly one cell."""
    return G.grid_validity(_matches(spark, sf, "plain"), "state_id", [0], "exact", [1])


@query("grid_validity_free", f"""with {BLOCK_MATCH}, c as (select state_id, cell, count(panel) as n from m group by state_id, cell)
select state_id, bool_and(n = 1) as panels_ok, bool_or(n = 0) as nomatch, bool_or(n > 1) as ambiguous, true as coverage_ok, bool_and(n = 1) as valid from c group by state_id""")
def _validity_free(spark, sf):
    """No rule on how often a panel stands."""
    return G.grid_validity(_matches(spark, sf, "block"), "state_id", PANELS, None)


@query("validity_counts", f"""with {EQUAL_MATCH}, {VALID}
select count(*) filter (where not panels_ok) as panels_ng, count(*) filter (where nomatch) as nomatch, count(*) filter (where ambiguous) as ambiguous,
  count(*) filter (where panels_ok) as panels_ok, count(*) filter (where panels_ok and not coverage_ok) as duplicated, count(*) filter (where valid) as valid from v""")
def _validity_counts(spark, sf):
    return G.validity_counts(G.grid_validity(_matches(spark, sf, "plain"), "state_id", PANELS))


@query("cell_signs", """select vec_id as state_id, cast(i as int) as cell, case when embedding[i+1] > 0 then -1 else 1 end as sign from embeddings, range(64) t(i)""")
def _cell_signs(spark, sf):
    m = V.codes(spark, sf).select("state_id", F.posexplode("bits").alias("cell", "bit")).withColumn("panels", F.array("bit"))
    return G.cell_signs(m).select("state_id", "cell", "sign")


GRID_OBJECT = """cells as (select vec_id as state_id, label, i as lab, cast((vec_id + i * 2) % 9 as int) as pos from embeddings, range(9) t(i))"""


def _grid(spark, sf):
    v = F.col("vec_id")
    config = F.array(*[((v + i * 2) % 9).cast("int") for i in range(9)])
    return V.table(spark, sf, "embeddings").select(v.alias("state_id"), F.posexplode(config).alias("lab", "pos"))


@query("positions_to_objects", f"""with {GRID_OBJECT}
select state_id, cast(lab as int) as lab, repeat('0', lab::int) || '1' || repeat('0', 8 - lab::int) || repeat('0', pos % 3) || '1' || repeat('0', 2 - pos % 3)
  || repeat('0', pos // 3) || '1' || repeat('0', 2 - pos // 3) as code from cells""")
def _positions(spark, sf):
    return _grid(spark, sf).select(
        "state_id", "lab", F.array_join(B.grid_object(F.col("lab"), F.col("pos"), 3, 3).cast("array<string>"), "").alias("code"))


@query("decode_objects", f"with {GRID_OBJECT} select state_id, cast(lab as int) as label, cast(pos % 3 as int) as x, cast(pos // 3 as int) as y from cells")
def _decode_objects(spark, sf):
    code = B.grid_object(F.col("lab"), F.col("pos"), 3, 3)
    return _grid(spark, sf).select("state_id", code.alias("code")).select("state_id", B.decode_grid_object(F.col("code")).alias("o")).select("state_id", "o.*")


# ---- curves

FRAME20 = "over (partition by run order by epoch rows between 19 preceding and current row)"


def curve_oracle(condition: str, extra: str = "") -> str:
    return f"""with {V.EPOCH_LOG}, w as (select run, epoch, max(val_loss) {FRAME20} as hi, min(val_loss) {FRAME20} as lo,
  quantile_cont(val_loss, 0.5) {FRAME20} as med,
  avg(val_loss) over (partition by run order by epoch rows between 2 preceding and current row) as newest,
  avg(val_loss) over (partition by run order by epoch rows between 19 preceding and 17 preceding) as oldest from epoch_log)
select run, min(case when epoch >= 20 and {condition} then epoch end) as stop_epoch from w group by run"""


@query("plateau_stop", curve_oracle("hi - lo <= 0.6 and epoch >= 30"))
def _plateau(spark, sf):
    return K.plateau_stop(V.epoch_log(spark, sf), "run", "epoch", "val_loss", 0.6, start=30, chunk=40)


SPARSE_LOG = """epoch_log as (select event_id // 200 as run, 50 + 5 * (event_id % 200) as epoch, value/500 as val_loss from events where event_id % 3 <> 0)"""


def _sparse_log(spark, sf):
    return V.table(spark, sf, "events").where("event_id % 3 <> 0").select(
        F.floor(F.col("event_id") / 200).alias("run"), (50 + 5 * (F.col("event_id") % 200)).alias("epoch"), (F.col("value") / 500).alias("val_loss"))


for _chunk in (40, 1000):
    @query(f"high_value_stop_sparse_{_chunk}", f"""with {SPARSE_LOG}, w as (select run, epoch, quantile_cont(val_loss, 0.5) {FRAME20} as med,
      row_number() over (partition by run order by epoch) as n from epoch_log)
    select run, min(case when n > 20 and med >= 0.2 then epoch end) as stop_epoch from w group by run""")
    def _high_sparse(spark, sf, chunk=_chunk):
        """A log with gaps whose runs start late; the chunk must not matter."""
        return K.high_value_stop(_sparse_log(spark, sf), "run", "epoch", "val_loss", chunk=chunk)


@query("gradient_stop", curve_oracle("(newest - oldest) / 20 >= 0.005"))
def _gradient(spark, sf):
    return K.gradient_stop(V.epoch_log(spark, sf), "run", "epoch", "val_loss", 0.005, chunk=64)


@query("high_value_stop", curve_oracle("med >= 0.2 and epoch >= 25"))
def _high(spark, sf):
    return K.high_value_stop(V.epoch_log(spark, sf), "run", "epoch", "val_loss", start=25)


@query("linear_bound_stop", curve_oracle("med >= 0.9 + (0.0 - 0.9) / (100.0 - 10.0) * (epoch - 10) and epoch >= 10"))
def _linear_stop(spark, sf):
    return K.linear_bound_stop(V.epoch_log(spark, sf), "run", "epoch", "val_loss", 100, start=10, value_start=0.9, chunk=50)


LONG_RUNS = """with w as (select event_id // 2000 as run, event_id % 2000 as epoch, quantile_cont(value / 500, 0.5) over last as med,
  row_number() over (partition by event_id // 2000 order by event_id) as n from events
  window last as (partition by event_id // 2000 order by event_id rows between 299 preceding and current row))
select run, min(case when n > 300 and med >= {} then epoch end) as stop_epoch from w group by run"""


def _long_runs(spark, sf):
    return V.table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 2000).alias("run"), (F.col("event_id") % 2000).alias("epoch"), (F.col("value") / 500).alias("val_loss"))


@query("high_value_stop_long", LONG_RUNS.format("0.19"))
def _high_long(spark, sf):
    """A window of 300 observations, in chunks that are shorter and do not divide a run."""
    return K.high_value_stop(_long_runs(spark, sf), "run", "epoch", "val_loss", threshold=0.19, sample=300, chunk=270)


@query("linear_bound_stop_long", LONG_RUNS.format("0.3 + (0.0 - 0.3) / (2000.0 - 0.0) * epoch"))
def _linear_long(spark, sf):
    return K.linear_bound_stop(_long_runs(spark, sf), "run", "epoch", "val_loss", 2000, value_start=0.3, sample=300, chunk=700)


@query("stop_start", """select p_partkey as trial, round((greatest(p_size / 100.0::double, (p_partkey % 7) / 10.0::double) + 0.1) * 1000, 6) as start from part""")
def _stop_start(spark, sf):
    config = F.create_map(
        F.lit("zerosuppress_delay"), (F.col("p_size") / 100).cast("string"), F.lit("locality_delay"), ((F.col("p_partkey") % 7) / 10).cast("string"),
        F.lit("lr"), F.lit("5"))
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("trial"), F.round(K.stop_start(config, F.lit(1000)), 6).alias("start"))


@query("scheduled_value", """select event_id, case when e >= 50 then 2.0 when e >= 20 then 1.0 else 0.0 end::double as step,
  round(case when e >= 50 then 2.0::double when e >= 20 then 1.0 + (e - 20) / 30.0::double when e >= 5 then (e - 5) / 15.0::double else 0.0 end, 6) as linear,
  round(greatest(0.1::double, 5.0 * exp(-ln(50.0::double) / 70 * greatest(e - 10, 0))), 6) as annealed from (select event_id, event_id % 100 as e from events)""")
def _scheduled(spark, sf):
    e = F.col("epoch")
    log = V.table(spark, sf, "events").select("event_id", (F.col("event_id") % 100).alias("epoch"))
    return log.select(
        "event_id", K.step_schedule(e, {0: 0.0, 20: 1.0, 50: 2.0}).alias("step"),
        F.round(K.linear_schedule(e, {5: 0.0, 20: 1.0, 50: 2.0}), 6).alias("linear"),
        F.round(K.annealed_value(e, 0.1, 5.0, 80, 10), 6).alias("annealed"))


# ---- samples and classifiers

def _by_hash(table, key, n, seed, cols):
    return f"select {cols} from {table} order by {h60(key, seed)}, {key} limit {n}"


@query("sample_source", _by_hash("documents", "doc_id", 5000, 42, "doc_id, lang"))
def _sample_source(spark, sf):
    return SA.sample_rows(V.table(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"], 5000, 42)


@query("sample_states", _by_hash("embeddings", "vec_id", 100, 7, "vec_id, label"))
def _sample_states(spark, sf):
    return SA.sample_rows(V.table(spark, sf, "embeddings").select("vec_id", "label"), ["vec_id"], 100, 7)


@query("sample_with_replacement", f"""with r as (select vec_id, label, row_number() over (order by {h60('vec_id', 8)}, vec_id) - 1 as place from embeddings),
d as (select i as draw, ({h60('i', 9)}) % (select count(*) from r) as place from range(1000) t(i))
select draw, vec_id, label from d join r using (place)""")
def _with_replacement(spark, sf):
    return SA.sample_with_replacement(V.table(spark, sf, "embeddings").select("vec_id", "label"), ["vec_id"], 1000, 8)


def _labelled(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "n_chars")
    scored = V.table(spark, sf, "labels").join(docs, "doc_id")
    largest = docs.agg(F.max("n_chars")).scalar()
    return scored.select("doc_id", F.col("toxic").alias("label"), (F.col("n_chars") / largest).alias("score"))


LABELLED = """labelled as (select l.doc_id, toxic as label, n_chars / (select max(n_chars) from documents)::double as score
  from labels l join documents d using (doc_id))"""


@query("class_balance", f"""with {LABELLED} select sum(label)::bigint as positives, sum(1 - label)::bigint as negatives,
  round(sum(1 - label) / sum(label)::double, 6) as ratio from labelled""")
def _class_balance(spark, sf):
    return SA.class_balance(_labelled(spark, sf), "label").withColumn("ratio", F.round("ratio", 6))


@query("pu_constant", f"""with {LABELLED} select doc_id, label, round(score / (select avg(score) from labelled where label = 1), 6) as calibrated from labelled""")
def _calibrate(spark, sf):
    return SA.calibrate_scores(_labelled(spark, sf), "score", "label").select("doc_id", "label", F.round("calibrated", 6).alias("calibrated"))


@query("ensemble_vote", """select vec_id, round(m, 6) + 0.0 as mean, cast(round_even(m, 0) as int) as vote
from (select vec_id, avg(v) as m from (select vec_id, unnest(embedding)::double + 0.5 as v from embeddings) group by vec_id)""")
def _vote(spark, sf):
    scores = V.table(spark, sf, "embeddings").select("vec_id", F.explode("embedding").alias("e")).select("vec_id", (F.col("e").cast("double") + 0.5).alias("s"))
    return SA.ensemble_vote(scores, "vec_id", "s").select("vec_id", (F.round("mean", 6) + 0.0).alias("mean"), "vote")


@query("assign_bags", f"""with {LABELLED}, n as (select doc_id, label, row_number() over (order by {h60('doc_id', 11)}, doc_id) - 1 as place from labelled where label = 0),
d as (select doc_id, label, place * 4 // (select count(*) from n) as bag from n)
select doc_id, label, bag from d union all select doc_id, label, b from labelled, range(4) t(b) where label = 1""")
def _bags(spark, sf):
    return SA.assign_bags(_labelled(spark, sf).select("doc_id", "label"), ["doc_id"], "label", 4, 11)


@query("assign_bags_sparse", """with n as (select r_regionkey as id, row_number() over (order by ('0x' || substr(md5(r_regionkey || '|11'), 1, 15))::BIGINT, r_regionkey) - 1 as place
  from region where r_regionkey >= 3)
select id, 0 as label, place * 4 // (select count(*) from n) as bag from n
union all select r_regionkey, 1, b from region, range(4) t(b) where r_regionkey < 3""")
def _bags_sparse(spark, sf):
    """More bags than negatives."""
    rows = V.table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), (F.col("r_regionkey") < 3).cast("int").alias("label"))
    return SA.assign_bags(rows, ["id"], "label", 4, 11)


# ---- trials

@query("best_trial", f"""with {V.TRIALS} select eval, trial, u || ',' || a || ',' || p as config from trials order by eval, trial limit 1""")
def _best(spark, sf):
    return TR.best_trial(V.trials(spark, sf)).select("eval", "trial", F.concat_ws(",", *[F.col("config")[k] for k in "uap"]).alias("config"))


@query("config_key", f"""with {V.TRIALS} select trial, '{{"a":"' || a || '","p":"' || p || '","u":"' || u || '"}}' as key from trials""")
def _config_key(spark, sf):
    return V.trials(spark, sf).select("trial", T.config_key(F.col("config")).alias("key"))


@query("drop_known", f"""with {V.TRIALS} select trial, eval from trials t
where not exists (select 1 from trials k where k.eval > 1400 and k.u = t.u and k.a = t.a and k.p = t.p)""")
def _drop_known(spark, sf):
    t = V.trials(spark, sf)
    return TR.drop_known(t, t.where("eval > 1400")).select("trial", "eval")


def _lists(spark, sf):
    t = V.trials(spark, sf)
    return t.agg(*[F.array_sort(F.collect_set(F.col("config")[k])).alias(k) for k in "uap"])


@query("config_grid", f"""with {V.TRIALS}, us as (select distinct u from trials), xs as (select distinct a from trials), ps as (select distinct p from trials)
select u, a, p from us, xs, ps""")
def _grid_configs(spark, sf):
    return TR.config_grid(_lists(spark, sf))


@query("random_configs", f"""with {V.TRIALS}, l as (select list(distinct u order by u) as u, list(distinct a order by a) as a, list(distinct p order by p) as p from trials)
select i as trial, u[({h60("i || '|u'", 13)}) % len(u) + 1] as u, a[({h60("i || '|a'", 13)}) % len(a) + 1] as a, p[({h60("i || '|p'", 13)}) % len(p) + 1] as p
from range(500) t(i), l""")
def _random_configs(spark, sf):
    return TR.random_configs(_lists(spark, sf), 500, 13)


def _unit_sql(expr):
    return f"(({h60(expr, 17)})::double + 0.5::double) / 1152921504606846976.0::double"


@query("next_generation", f"""with {V.TRIALS}, top as (select row_number() over (order by eval, trial) - 1 as i, * from trials qualify i < 10),
opts as (select distinct 'a' as k, a as v from trials union select distinct 'p', p from trials union select distinct 'u', u from trials),
near as (select i, k, v, case when k = 'u' then v else u end as u, case when k = 'a' then v else a end as a, case when k = 'p' then v else p end as p
   from top, opts where v <> case k when 'u' then u when 'a' then a else p end),
free as (select i, list((u, a, p) order by k, v) as open from near n where not exists (select 1 from trials t where t.u = n.u and t.a = n.a and t.p = n.p) group by i),
tries as (select c, j, ({_unit_sql("c || '|' || j || '|kind'")}) < (select min(eval)::double / max(eval)::double from top) or j = 4 as mutates from range(300) r(c), range(5) q(j)),
keyed as (select c, j, mutates, t.*, row_number() over (partition by c, j order by -ln({_unit_sql("c || '|' || j || '|' || i")}) * eval::double, i) as nth from tries, top t),
pair as (select x.c, x.j, x.mutates, x.i, x.u as u1, x.a as a1, x.p as p1, y.u as u2, y.a as a2, y.p as p2 from keyed x join keyed y on x.c = y.c and x.j = y.j and x.nth = 1 and y.nth = 2),
made as (select c, j, mutates, case when mutates then open[({h60("c || '|' || j || '|near'", 17)}) % len(open) + 1] else
   (case when {_unit_sql("c || '|' || j || '|u'")} < 0.5 then u1 else u2 end, case when {_unit_sql("c || '|' || j || '|a'")} < 0.5 then a1 else a2 end,
    case when {_unit_sql("c || '|' || j || '|p'")} < 0.5 then p1 else p2 end) end as f from pair left join free using (i)),
fresh as (select * from made where f is not null and not exists (select 1 from trials t where t.u = f[1] and t.a = f[2] and t.p = f[3]) qualify row_number() over (partition by c order by j) = 1)
select c as child, case when mutates then 'mutation' else 'crossover' end as kind, f[1] as u, f[2] as a, f[3] as p from fresh qualify row_number() over (partition by f order by c) = 1""")
def _next_generation(spark, sf):
    """300 children of the ten best trials."""
    g = TR.next_generation(V.trials(spark, sf), _lists(spark, sf), 300, 10, seed=17, attempts=5)
    return g.select("child", "kind", *[F.col("config")[k].alias(k) for k in "uap"])


def _distance_task(config: dict) -> float:
    size = int(config["p"])
    if size % 7 == 0:
        raise ValueError("invalid size")
    return (size - 20) ** 2 + len(config["a"])


@query("run_trials", f"""with {V.TRIALS} select trial, r::int as repeat,
  case when cast(p as int) % 7 <> 0 then ((cast(p as int) - 20) * (cast(p as int) - 20) + length(a))::double end as eval,
  case when cast(p as int) % 7 = 0 then 'ValueError: invalid size' end as error
from trials, range(2) t(r)""")
def _run_trials(spark, sf):
    return TR.run_trials(V.trials(spark, sf), _distance_task, "trial", repeats=2)


@query("read_trial_log", f"with {V.TRIALS} select eval, u, a, p, 'radam' as optimizer from trials")
def _trial_log(spark, sf):
    path = scratch_path(spark, "trial-log")
    t = V.trials(spark, sf).withColumn("defaults", F.create_map(F.lit("optimizer"), F.lit("radam")))
    TL.append_trial_log(t, path)
    return TL.read_trial_log(spark, path).select("eval", *[F.col("config")[k].alias(k) for k in "uap"], F.col("defaults")["optimizer"].alias("optimizer"))


def _awkward_log(spark, sf):
    """A log whose strings hold brackets, quotes and backslashes and whose entries stand over several lines."""
    path = scratch_path(spark, "trial-log")
    note = F.concat(F.lit('x] [y"}\\'), F.col("config")["u"])
    t = V.trials(spark, sf).select("eval", F.to_json("config", {"pretty": "true"}).alias("c"), F.to_json(F.struct(note.alias("note"))).alias("d"))
    t.select(F.concat(F.lit("["), F.col("eval").cast("string"), F.lit(",\n"), "c", F.lit(", "), "d", F.lit("]")).alias("value")).write.text(path)
    return TL.read_trial_log(spark, path)


@query("read_trial_log_values", f"""with {V.TRIALS} select eval, u, a, p, 'x] [y"}}' || chr(92) || u as note from trials""")
def _trial_log_values(spark, sf):
    return _awkward_log(spark, sf).select("eval", *[F.col("config")[k].alias(k) for k in "uap"], F.col("defaults")["note"].alias("note"))


@query("trial_log_lines", "select count(*) as entries, 0::bigint as first, count(*) - 1 as last, count(*) as lines from part")
def _trial_log_lines(spark, sf):
    """The ordinals of the entries are dense over all files of the log."""
    return _awkward_log(spark, sf).agg(F.count("*").alias("entries"), F.min("line").alias("first"), F.max("line").alias("last"),
                                       F.count_distinct("line").alias("lines"))


def _logged(spark, sf):
    path = scratch_path(spark, "trial-log")
    TL.append_trial_log(V.trials(spark, sf).withColumn("defaults", F.create_map(F.lit("optimizer"), F.lit("radam"))), path)
    return TL.read_trial_log(spark, path)


@query("best_logged_trial", f"with {V.TRIALS} select min(eval) as eval from trials")
def _best_logged(spark, sf):
    """From the log to the best trial."""
    return TR.best_trial(_logged(spark, sf), order="line").select("eval")


@query("drop_logged", f"""with {V.TRIALS} select trial from trials t
where not exists (select 1 from trials k where k.eval <= 1400 and k.u = t.u and k.a = t.a and k.p = t.p)""")
def _drop_logged(spark, sf):
    """From the log to the configurations that are still to run."""
    return TR.drop_known(V.trials(spark, sf), _logged(spark, sf).where("eval <= 1400")).select("trial")


# ---- scores

@query("score_states", """select vec_id as state_id, array_to_string([cast(x > 0 as int) for x in embedding], '') as code from embeddings""")
def _score(spark, sf):
    states = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("state_id"), F.col("embedding").alias("x"))
    coded = SC.score_states(states, ["state_id"], "x", {"bits": (lambda m: (m > 0).astype(np.int32), "array<int>")})
    return coded.select("state_id", F.array_join(F.col("bits").cast("array<string>"), "").alias("code"))


TREE_DEPTH = 3


def _tree_sql(depth: int) -> str:
    """The levels of all trees, one after the other."""
    parts = ["""l0 as (select p, embedding as e, (embedding[p+1] * embedding[(p+8) % 64 + 1] > 0)::int as y, 1 as node from embeddings, range(64) t(p))"""]
    for d in range(depth + 1):
        parts.append(f"""h{d} as (select p, node, f, floor(e[f+1]::double * 8) as v, count(*) as n, sum(y) as k
            from l{d}, range(64) t(f) where node >= {1 << d} group by all)""")
        parts.append(f"""w{d} as (select *, sum(n) over r as ln, sum(k) over r as lk, sum(n) over g as an, sum(k) over g as ak, lead(v) over r as after
            from h{d} window r as (partition by p, node, f order by v), g as (partition by p, node, f))""")
        cost = "round(lk * (ln - lk) / ln::double + (ak - lk) * ((an - ln) - (ak - lk)) / (an - ln)::double, 9)"
        parts.append(f"""b{d} as (select p, node, max(an) as n, max(ak) as k,
            min(({cost}, f, v, after)) filter (where {d} < {depth} and after is not null and ak > 0 and ak < an) as s from w{d} group by p, node)""")
        if d < depth:
            parts.append(f"""l{d + 1} as (select l.p, e, y, case when s is null then l.node else 2 * l.node + (floor(e[s[2]+1]::double * 8) > s[3])::int end as node
                from l{d} l left join b{d} b on b.p = l.p and b.node = l.node)""")
    return "with " + ", ".join(parts) + ", trees as (" + " union all ".join(f"select {d} as d, * from b{d}" for d in range(depth + 1)) + ")"


def _trees(spark, sf):
    """64 bits of a state, each explained by all its 64 values in steps of an eighth."""
    value = lambda i: F.col("embedding")[i]
    table = V.table(spark, sf, "embeddings").select(
        *[F.floor(value(i).cast("double") * 8).alias(f"f{i}") for i in range(64)],
        *[(value(i) * value((i + 8) % 64) > 0).cast("int").alias(f"p{i}") for i in range(64)])
    return SC.predicate_trees(table, [f"f{i}" for i in range(64)], [f"p{i}" for i in range(64)], TREE_DEPTH)


@query("explain_predicates", _tree_sql(TREE_DEPTH) + """ select 'p' || p as predicate, max(d)::int as depth, count(*) as nodes,
  round(sum(case when s is null then greatest(k, n - k) else 0 end)::double / sum(case when s is null then n else 0 end)::double, 9) as accuracy from trees group by p""")
def _explain(spark, sf):
    return SC.tree_reports(_trees(spark, sf)).select("predicate", "depth", "nodes", F.round("accuracy", 9).alias("accuracy"))


@query("predicate_trees", _tree_sql(TREE_DEPTH) + """ select 'p' || p as predicate, node::bigint as node, n::bigint as n, k::bigint as n_true,
  'f' || s[2] as feature, (s[3] + s[4]) / 2 as threshold from trees""")
def _predicate_trees(spark, sf):
    return _trees(spark, sf)


@query("classify_rows_range", "select doc_id, true as in_range from labels join documents using (doc_id)")
def _classify_range(spark, sf):
    """A score for every labelled document, and none beyond 0 and 1."""
    return _classify(spark, sf).select("doc_id", F.col("score").between(0, 1).alias("in_range"))


@query("classify_rows")
def _classify(spark, sf):
    """Logistic scores of the labelled documents."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    docs = V.table(spark, sf, "documents").select("doc_id", "n_chars", F.size(F.split("text", " ")).alias("words"))
    rows = VectorAssembler(inputCols=["n_chars", "words"], outputCol="features").transform(V.table(spark, sf, "labels").join(docs, "doc_id"))
    model = LogisticRegression(labelCol="toxic", maxIter=20).fit(rows)
    return SC.classify_rows(rows, model).select("doc_id", "score")


# ---- sinks, read back

@query("write_codes_csv", f"with {V.CODES} select string_agg(bit::varchar, ' ' order by idx) as value from codes group by state_id")
def _codes_csv(spark, sf):
    path = scratch_path(spark, "codes")
    SK.write_codes_csv(V.codes(spark, sf), path)
    return spark.read.text(path)


@query("write_transition_codes_csv", f"""with {V.TRANSITION_CODES}
select string_agg(pre::varchar, ' ' order by idx) || ' ' || string_agg(suc::varchar, ' ' order by idx) || ' ' || action as value from tcodes group by pre_id, action""")
def _transition_csv(spark, sf):
    path = scratch_path(spark, "transition-codes")
    SK.write_transition_codes_csv(V.transition_codes(spark, sf), path, action="action")
    return spark.read.text(path)


TEXT_LINES = ATOMS + f""",
kept as (select *, '  ' || atom_str || '  [conf=' || printf('%.3f', conf) || ']' as line from atoms where value and conf >= {THRESHOLD}),
lines as (select state_id, line from kept union all select vec_id, 'State ' || vec_id || ':' from embeddings
  union all select vec_id, '' from embeddings union all select vec_id, '  (no active predicates)' from embeddings where vec_id not in (select state_id from kept))"""


@query("write_atoms_text", f"with {TEXT_LINES} select line as value from lines")
def _atoms_text(spark, sf):
    path = scratch_path(spark, "atoms-text")
    SK.write_atoms_text(L.state_results(bound(spark, sf), "state_id", PREDICATES, "object_names", threshold=THRESHOLD), "state_id", path)
    return spark.read.text(path)


@query("write_atoms_json", f"""with {ATOMS} select state_id, unit, p as predicate_idx, value, atom_str from atoms where conf >= {THRESHOLD}""")
def _atoms_json(spark, sf):
    path = scratch_path(spark, "atoms-json")
    results = L.state_results(bound(spark, sf), "state_id", PREDICATES, "object_names", threshold=THRESHOLD)
    SK.write_atoms_json(results, path, 4, 2, PREDICATES, 8)
    back = spark.read.schema(results.schema).json(f"{path}/states")
    return back.select("state_id", F.explode("atoms").alias("a")).select(
        "state_id", F.col("a.unit").cast("long").alias("unit"), F.col("a.predicate_idx").cast("long").alias("predicate_idx"), "a.value", "a.atom_str")


@query("write_usage_report", f"""with {V.CODES}, u as (select idx, sum(bit) / count(*)::double as r from codes group by idx)
select count(*) as matrix, count(*) filter (where r > 0.99) as num_always_on, count(*) filter (where r < 0.01) as num_always_off,
  count(*) filter (where r between 0.01 and 0.99) as num_variable, count(*) filter (where r between 0.01 and 0.99) as listed from u""")
def _usage_json(spark, sf):
    path = scratch_path(spark, "usage")
    states = V.codes(spark, sf)
    SK.write_usage_report(U.predicate_usage(states, 8), states.count(), path)
    entry = "array<struct<unit:int,predicate:int,activation_rate:double>>"
    schema = (f"total_states long, predicate_activation_rates {entry}, always_on {entry}, always_off {entry}, variable {entry}, "
              "num_always_on long, num_always_off long, num_variable long")
    r = spark.read.schema(schema).json(path)
    return r.select(F.size("predicate_activation_rates").cast("long").alias("matrix"), "num_always_on", "num_always_off", "num_variable",
                    F.size("variable").cast("long").alias("listed"))


@query("write_state_mapping", "select vec_id as state_idx, 'img' || vec_id as image, 'thing_' || vec_id as first_name from embeddings")
def _mapping(spark, sf):
    path = scratch_path(spark, "mapping")
    b = bound(spark, sf).withColumn("image", F.concat(F.lit("img"), F.col("state_id").cast("string")))
    SK.write_state_mapping(b, "state_id", "image", "object_names", path)
    back = spark.read.schema("state_idx long, image string, object_names array<string>").json(path)
    return back.select("state_idx", "image", F.col("object_names")[0].alias("first_name"))


@query("write_manifest", """select 'ECONOMY' as category_filter, true as strict, count(*) as num_videos, sum(n)::bigint as num_states, 3 as fps, 'sequential' as transition_mode
from (select l_orderkey % 50, count(distinct l_orderkey) as n from lineitem join part on l_partkey = p_partkey group by 1)""")
def _manifest(spark, sf):
    path = scratch_path(spark, "manifest")
    states = V.detections(spark, sf).select("video_id", "state_id").distinct()
    videos = states.select("video_id").distinct().withColumn("primary", F.lit("ECONOMY"))
    SK.write_manifest(P.load_summary(videos, states), states, path, "ECONOMY", True, 3, "sequential")
    return spark.read.schema("category_filter string, strict boolean, num_videos long, num_states long, fps int, transition_mode string").json(f"{path}/manifest")
