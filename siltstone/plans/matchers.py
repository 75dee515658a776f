"""Registered queries of merge rules over masks, scorers, memory banks, zoom studies and the trace stream, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import datasets, masks, reid, study, suppress, traces, vectors
from ..operators.graph import fresh_path
from ..sources import coco_split
from ..sources import fixtures as fx
from ..streaming import traces as stream
from .catalog import PROTO, REACH, _cropped, query, r6

# --- masks that are no rectangles

_OVER = """ar AS (SELECT image_id, det_id, sum(xe - xs) AS area FROM {runs} GROUP BY ALL),
ov AS (SELECT a.image_id, a.det_id, b.det_id AS other, sum(least(a.xe, b.xe) - greatest(a.xs, b.xs)) AS inter FROM {runs} a JOIN {runs} b ON a.image_id = b.image_id AND a.y = b.y AND a.det_id <> b.det_id AND a.xs < b.xe AND b.xs < a.xe GROUP BY ALL),
op AS (SELECT ov.*, inter / (a.area + b.area - inter)::DOUBLE AS iou, inter / least(a.area, b.area)::DOUBLE AS con, inter / (a.area + 1e-6) AS own FROM ov JOIN ar a ON a.image_id = ov.image_id AND a.det_id = ov.det_id JOIN ar b ON b.image_id = ov.image_id AND b.det_id = ov.other)"""
_FOLD = """nr AS (SELECT image_id, det_id, list(other) AS n FROM op WHERE {same} GROUP BY ALL), o AS (SELECT d.image_id, d.det_id, coalesce(n, []) AS n, row_number() OVER (PARTITION BY d.image_id ORDER BY score DESC, d.det_id) AS rk FROM {dets} d LEFT JOIN nr USING (image_id, det_id)),
m AS (SELECT DISTINCT image_id, 0::BIGINT AS rk, []::BIGINT[] AS kept FROM o UNION ALL SELECT o.image_id, o.rk, CASE WHEN list_has_any(m.kept, o.n) THEN m.kept ELSE list_append(m.kept, o.det_id) END FROM m JOIN o ON o.image_id = m.image_id AND o.rk = m.rk + 1),
f AS (SELECT image_id, arg_max(kept, rk) AS kept FROM m GROUP BY image_id)"""
_OVER_SHAPES = _OVER.format(runs="shapes")


def _near(s, d):
    return suppress.mask_pairs(fx.shapes(s, d))


@query("shape_overlaps", f"WITH {_OVER_SHAPES} SELECT image_id, det_id, other, inter::BIGINT AS inter, round(iou, 6) AS iou, round(con, 6) AS containment, round(own, 6) AS own FROM op WHERE iou >= 0.3", "shapes")
def _(s, d):
    return suppress.mask_overlaps(fx.shapes(s, d)).filter("iou >= 0.3").select("image_id", "det_id", "other", "inter", *[r6(c, c) for c in ("iou", "containment", "own")])


@query("nms_shapes", f"WITH {_OVER_SHAPES}, {_FOLD.format(same='iou >= 0.5 OR con >= 0.8', dets='detections')} SELECT image_id, unnest(kept) AS det_id FROM f", "shapes", recursive=True)
def _(s, d):
    return suppress.nms(fx.detections(s, d), 0.5, 0.8, _near(s, d))


@query("nms_strict_shapes", f"WITH {_OVER_SHAPES}, {_FOLD.format(same='iou > 0.5 OR own > 0.8', dets='detections')} SELECT image_id, (generate_subscripts(kept, 1) - 1)::BIGINT AS rank, unnest(kept) AS det_id FROM f", "shapes", recursive=True)
def _(s, d):
    return suppress.suppress_directional(fx.detections(s, d), 0.5, 0.8, _near(s, d))


@query("soft_nms_shapes", f"""WITH {_OVER_SHAPES}, nr AS (SELECT image_id, det_id, list({{'other': other, 'x': CASE WHEN con >= 0.9 THEN 0.0 ELSE exp(-(greatest(iou, con) * greatest(iou, con)) / 0.5) END}}) AS n FROM op GROUP BY ALL),
o AS (SELECT d.image_id, d.det_id, d.score, coalesce(n, []) AS n, row_number() OVER (PARTITION BY d.image_id ORDER BY score DESC, d.det_id) AS rk FROM detections d LEFT JOIN nr USING (image_id, det_id)),
m AS (SELECT DISTINCT image_id, 0::BIGINT AS rk, []::BIGINT[] AS kept, []::DOUBLE[] AS scores FROM o UNION ALL SELECT image_id, rk, CASE WHEN ns >= 1000 THEN list_append(kept, det_id) ELSE kept END, CASE WHEN ns >= 1000 THEN list_append(scores, ns) ELSE scores END FROM (
  SELECT o.*, m.kept, m.scores, list_reduce(list_prepend(o.score, list_transform(list_filter(o.n, lambda k: list_contains(m.kept, k.other)), lambda k: k.x)), lambda p, q: p * q) AS ns FROM m JOIN o ON o.image_id = m.image_id AND o.rk = m.rk + 1)),
f AS (SELECT image_id, arg_max(kept, rk) AS kept, arg_max(scores, rk) AS scores FROM m GROUP BY image_id) SELECT image_id, unnest(kept) AS det_id, round(unnest(scores), 4) AS score FROM f""", "shapes", recursive=True)  # fmt: skip
def _(s, d):
    return suppress.soft_nms(fx.detections(s, d), 0.5, 1000.0, 0.9, _near(s, d)).select("image_id", "det_id", F.round("score", 4).alias("score"))


#: Detections that no inner edge of their crop clips, then those of touching pieces by component, with the pieces' pixels as one mask.
_JOINED = f"""q AS (SELECT *, x0 <= 0 AS partial FROM detections WHERE NOT (y0 <= 20 OR y1 >= 90 OR x1 >= 100)), r AS (SELECT s.* FROM shapes s JOIN q USING (image_id, det_id)),
h AS (SELECT DISTINCT a.image_id, a.det_id AS a, b.det_id AS b FROM (SELECT r.*, unnest(range(r.y - 3, r.y + 4)) AS yy FROM r JOIN q USING (image_id, det_id) WHERE q.partial) a JOIN r b ON a.image_id = b.image_id AND a.yy = b.y AND a.det_id <> b.det_id AND a.xs - 3 < b.xe AND b.xs < a.xe + 3),
e AS (SELECT image_id, a, b FROM h UNION SELECT image_id, b, a FROM h), reach AS (SELECT DISTINCT image_id, a, a AS b FROM e {REACH}, roots AS (SELECT image_id, a AS det_id, min(b) AS root FROM reach GROUP BY ALL),
g AS (SELECT q.image_id, q.det_id, score, y0, y1, x0, x1, coalesce(root, q.det_id) AS root FROM q LEFT JOIN roots USING (image_id, det_id)),
c AS (SELECT image_id, root, arg_max(det_id, (score, -det_id)) AS det_id, max(score) AS score, min(y0) AS y0, max(y1) AS y1, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY ALL),
px AS (SELECT DISTINCT r.image_id, c.det_id, y, unnest(range(xs, xe)) AS x FROM r JOIN g USING (image_id, det_id) JOIN c ON c.image_id = g.image_id AND c.root = g.root), u AS (SELECT image_id, det_id, y, min(x) AS xs, max(x) + 1 AS xe FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, det_id, y ORDER BY x) AS k FROM px) GROUP BY image_id, det_id, y, k)"""


@query("merge_chain_shapes", f"WITH {_JOINED}, {_OVER.format(runs='u')}, {_FOLD.format(same='iou >= 0.5 OR con >= 0.8', dets='c')}, k AS (SELECT image_id, unnest(kept) AS det_id FROM f) SELECT image_id, det_id, y0, y1, x0, x1, round(score, 4) AS score FROM k JOIN c USING (image_id, det_id)", "shapes", recursive=True)
def _(s, d):
    out = suppress.merge_chain(_cropped(fx.detections(s, d)), "nms", drop=True, join=True, gap=3, runs=fx.shapes(s, d))
    return out.withColumn("score", F.round("score", 4))


@query("oracle_merge_shapes", """WITH gr AS (SELECT image_id, gt_id, unnest(range(y0, y1)) AS y, x0 AS xs, x1 AS xe FROM gt), i AS (SELECT s.image_id, det_id, gt_id, sum(least(s.xe, gr.xe) - greatest(s.xs, gr.xs)) AS inter FROM shapes s JOIN gr ON s.image_id = gr.image_id AND s.y = gr.y AND s.xs < gr.xe AND gr.xs < s.xe GROUP BY ALL),
a AS (SELECT image_id, det_id, sum(xe - xs) AS a FROM shapes GROUP BY ALL), b AS (SELECT image_id, gt_id, sum(xe - xs) AS b FROM gr GROUP BY ALL), o AS (SELECT i.*, inter / (a + b - inter)::DOUBLE AS iou FROM i JOIN a USING (image_id, det_id) JOIN b USING (image_id, gt_id)),
w AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, gt_id) = 1), v AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY image_id, gt_id ORDER BY iou DESC, det_id) = 1)
SELECT image_id, det_id, y0, y1, x0, x1, score FROM detections JOIN (SELECT image_id, det_id FROM v) USING (image_id, det_id)""", "shapes", "gt")  # fmt: skip
def _(s, d):
    return suppress.merge_chain(fx.detections(s, d), "oracle", runs=fx.shapes(s, d), gt_runs=masks.box_runs(fx.ground_truth(s, d), "gt_id"))


# --- vectors

@query("patch_gram", """WITH l AS (SELECT patch_id, unnest(feat) AS x, generate_subscripts(feat, 1) AS i FROM patches), m AS (SELECT i, avg(x) AS m FROM l GROUP BY 1), z AS (SELECT patch_id, i, x - m AS x FROM l JOIN m USING (i))
SELECT a.i::BIGINT AS i, b.i::BIGINT AS j, round(sum(a.x * b.x), 6) AS value FROM z a JOIN z b USING (patch_id) GROUP BY 1, 2""", "patches")
def _(s, d):
    return vectors.gram(fx.patches(s, d)).select("i", "j", r6("value", "value"))


@query("minibatch_centre", "WITH l AS (SELECT unnest(feat) AS x, generate_subscripts(feat, 1) AS i FROM patches), m AS (SELECT i, avg(x) AS x FROM l GROUP BY 1) SELECT i::BIGINT AS i, round(x / ((SELECT sqrt(sum(x * x)) FROM m) + 1e-8), 6) AS x FROM m", "patches")
def _(s, d):
    centre = reid.minibatch_kmeans(fx.patches(s, d), 1, epochs=1)  # steps of one centre over all batches end in the mean
    rows = s.createDataFrame([(c.tolist(),) for c in centre], "c array<double>").select(F.posexplode("c").alias("i", "x"))
    return rows.select((F.col("i") + 1).cast("long").alias("i"), r6("x", "x"))


@query("exemplar_stack", """SELECT DISTINCT p.image_id, p.r, p.c, round(feat[1], 6) AS first FROM patches p JOIN shapes s ON s.image_id = p.image_id AND s.det_id % 4 = 0 AND s.y = least(floor((p.r + 0.5) * 135 / 10)::BIGINT, 134) AND floor((p.c + 0.5) * 127 / 10) >= s.xs AND floor((p.c + 0.5) * 127 / 10) < s.xe""", "patches", "shapes")
def _(s, d):
    patches = fx.patches(s, d)
    images = patches.select("image_id").distinct().select("image_id", F.lit(135).cast("long").alias("height"), F.lit(127).cast("long").alias("width"))
    cells = masks.on_grid(fx.shapes(s, d).filter("det_id % 4 = 0"), "det_id", images, 10, 10)
    return vectors.stacked(patches, cells).select("image_id", "r", "c", r6(F.element_at("feat", 1), "first"))


_INSIDE = "r BETWEEN 3 AND 6 AND c BETWEEN 3 AND 6"


def _by(view: str, keys: str) -> str:
    """The normalised mean of a view's vectors by keys."""
    return PROTO.replace("FROM patches", f"FROM {view}").format(by=keys)


@query("reid_modes", f"""WITH fg AS (SELECT * FROM patches WHERE {_INSIDE}), a AS (WITH {_by('patches', 'image_id')} SELECT image_id, list(x / n ORDER BY i) AS p FROM m JOIN pn USING (image_id) GROUP BY 1), b AS (WITH {_by('fg', 'image_id')} SELECT image_id, list(x / n ORDER BY i) AS p FROM m JOIN pn USING (image_id) GROUP BY 1),
ex AS (SELECT class_id, ex_id, list_transform(feat, lambda x: x / (sqrt(list_dot_product(feat, feat)) + 1e-8)) AS u, feat FROM exemplars),
v AS (SELECT 'cls' AS mode, image_id, class_id, ex_id, round(list_dot_product(p, u), 9) AS s FROM a, ex UNION ALL SELECT 'mean', image_id, class_id, ex_id, round(list_dot_product(p, u), 9) FROM b, ex UNION ALL SELECT 'kmeans', image_id, class_id, ex_id, round(list_dot_product(p, u), 9) FROM b, ex
  UNION ALL SELECT 'full', fg.image_id, ex.class_id, ex.ex_id, avg(round(list_dot_product(fg.feat, ex.feat), 9)) FROM fg, ex GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY mode, image_id, class_id ORDER BY s DESC, ex_id) AS k FROM v) SELECT mode, image_id, class_id, round(avg(s), 6) AS g FROM k WHERE k <= 2 GROUP BY ALL""", "patches", "exemplars")  # fmt: skip
def _(s, d):
    targets, exemplars, out = fx.patches(s, d), fx.exemplars(s, d).withColumn("patch_id", F.col("ex_id")), None
    for mode in ("cls", "mean", "kmeans", "full"):
        scorer = reid.build_scorer(mode, top=2, k=1)  # with one centre, kmeans is the mean
        rows = scorer.score(targets, exemplars, F.expr(_INSIDE)).select(F.lit(mode).alias("mode"), "image_id", "class_id", r6("g", "g"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("memory_matches", f"""WITH {_by('exemplars', 'class_id')}, mem AS (SELECT class_id, list(x / n ORDER BY i) AS p FROM m JOIN pn USING (class_id) GROUP BY 1), heat AS (SELECT patches.image_id, r, c, mem.class_id, round(list_dot_product(feat, p), 9) AS s FROM patches, mem),
hot AS (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY s DESC, r, c) AS det_id FROM heat WHERE s >= 0.05 QUALIFY det_id <= 12),
bx AS (SELECT image_id, class_id, det_id, greatest(0, r - 1) AS y0, least(10, r + 2) AS y1, greatest(0, c - 1) AS x0, least(10, c + 2) AS x1 FROM hot),
sc AS (SELECT bx.*, least(1, greatest(0, (avg(s) + 1) / 2)) AS score, count(*) AS area FROM bx JOIN heat USING (image_id, class_id) WHERE r >= y0 AND r < y1 AND c >= x0 AND c < x1 GROUP BY ALL HAVING count(*) >= 6 AND (avg(s) + 1) / 2 >= 0.45),
ov AS (SELECT a.image_id, a.class_id, a.det_id, b.det_id AS other, greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) * greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS i, a.area AS aa, b.area AS ba FROM sc a JOIN sc b ON a.image_id = b.image_id AND a.class_id = b.class_id AND a.det_id <> b.det_id),
nr AS (SELECT image_id, class_id, det_id, list(other) AS n FROM ov WHERE i / (aa + ba - i)::DOUBLE > 0.3 OR i / (aa + 1e-6) > 0.5 GROUP BY ALL), o AS (SELECT sc.image_id, sc.class_id, sc.det_id, coalesce(n, []) AS n, row_number() OVER (PARTITION BY sc.image_id, sc.class_id ORDER BY score DESC, sc.det_id) AS rk FROM sc LEFT JOIN nr USING (image_id, class_id, det_id)),
w AS (SELECT DISTINCT image_id, class_id, 0::BIGINT AS rk, []::BIGINT[] AS kept FROM o UNION ALL SELECT o.image_id, o.class_id, o.rk, CASE WHEN list_has_any(w.kept, o.n) THEN w.kept ELSE list_append(w.kept, o.det_id) END FROM w JOIN o ON o.image_id = w.image_id AND o.class_id = w.class_id AND o.rk = w.rk + 1),
fk AS (SELECT image_id, class_id, arg_max(kept, rk) AS kept FROM w GROUP BY image_id, class_id), f AS (SELECT image_id, class_id, unnest(kept) AS det_id FROM fk) SELECT image_id, class_id, det_id, y0, y1, x0, x1, round(score, 6) AS score FROM f JOIN sc USING (image_id, class_id, det_id)""", "patches", "exemplars", recursive=True)  # fmt: skip
def _(s, d):
    memory = reid.build_memory(fx.exemplars(s, d).withColumn("patch_id", F.col("ex_id")), 1)
    out = reid.memory_matches(fx.patches(s, d), memory, points=12, least=0.05, least_score=0.45, iou=0.3, contain=0.5, least_area=6)
    return out.select("image_id", "class_id", "det_id", "y0", "y1", "x0", "x1", r6("score", "score"))


# --- zooms

@query("zoom_ladder", f"""WITH z AS (SELECT unnest({study.ZOOMS}::DOUBLE[]) AS zoom, generate_subscripts({study.ZOOMS}::DOUBLE[], 1) - 1 AS step), l AS (SELECT gt.*, step, zoom, round_even(greatest(y1 - y0, x1 - x0) * zoom / 2, 0)::BIGINT AS h, (y0 + y1) // 2 AS cy, (x0 + x1) // 2 AS cx FROM gt, z),
c AS (SELECT *, greatest(0, cy - h) AS a0, least(200, cy + h) AS a1, greatest(0, cx - h) AS b0, least(200, cx + h) AS b1 FROM l), i AS (SELECT *, greatest(0, least(y1, a1) - greatest(y0, a0)) * greatest(0, least(x1, b1) - greatest(x0, b0)) AS inter FROM c),
p AS (SELECT image_id, gt_id, step, zoom, CASE WHEN (a1 - a0) * (b1 - b0) > 0 THEN inter / ((a1 - a0) * (b1 - b0))::DOUBLE ELSE 0 END AS pure, inter / ((y1 - y0) * (x1 - x0))::DOUBLE AS whole FROM i),
s AS (SELECT image_id, gt_id, step, zoom, 'mean' AS scorer, round(pure, 12) AS g FROM p UNION ALL SELECT image_id, gt_id, step, zoom, 'full', round(pure * whole, 12) FROM p UNION ALL SELECT image_id, gt_id, step, zoom, 'cls', round((pure + whole) / (sqrt(2.0::DOUBLE) * sqrt(pure * pure + (1 - pure) * (1 - pure) + whole * whole)), 12) FROM p),
w AS (SELECT *, lag(g) OVER d AS was, rank() OVER (PARTITION BY scorer, image_id, gt_id ORDER BY g DESC) AS rk FROM s WINDOW d AS (PARTITION BY scorer, image_id, gt_id ORDER BY step DESC)),
v AS (SELECT *, coalesce(max((g < was - 1e-9)::INT) OVER (PARTITION BY scorer, image_id, gt_id ORDER BY step DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fallen FROM w),
t AS (SELECT scorer, image_id, gt_id, count(*) FILTER (was IS NOT NULL AND zoom >= 1) AS in_n, count(*) FILTER (g > was + 1e-9 AND zoom >= 1) AS in_up, count(*) FILTER (was IS NOT NULL AND zoom < 1) AS out_n, count(*) FILTER (g < was - 1e-9 AND zoom < 1) AS out_down,
  max(CASE WHEN zoom = 1 THEN rk END) AS rk, arg_max(zoom, (g, zoom)) AS best, (count(*) FILTER (g > was + 1e-9 AND fallen = 1) = 0)::INT AS one FROM v GROUP BY ALL)
SELECT scorer, count(*) AS targets, round(sum(in_up) / sum(in_n)::DOUBLE, 6) AS refine_rise, round(sum(out_down) / sum(out_n)::DOUBLE, 6) AS overzoom_fall, round(avg(rk), 6) AS anchor_rank, round(avg(best), 6) AS best_zoom, round(avg(one), 6) AS one_peak FROM t GROUP BY 1""", "gt")  # fmt: skip
def _(s, d):
    out = study.report(fx.ground_truth(s, d), F.lit(200), F.lit(200))
    return out.select("scorer", "targets", *[r6(c, c) for c in ("refine_rise", "overzoom_fall", "anchor_rank", "best_zoom", "one_peak")])


@query("zoom_rates", """WITH px AS (SELECT DISTINCT image_id, y, unnest(range(x0, x1)) AS x FROM (SELECT *, unnest(range(y0, y1)) AS y FROM gt)), dp AS (SELECT image_id, det_id, y, unnest(range(x0, x1)) AS x FROM (SELECT *, unnest(range(y0, y1)) AS y FROM detections)),
sp AS (SELECT image_id, det_id, y, unnest(range(xs, xe)) AS x FROM shapes), t AS (SELECT dp.image_id, dp.det_id, count(px.x) AS there FROM dp LEFT JOIN px USING (image_id, y, x) GROUP BY ALL), h AS (SELECT sp.image_id, sp.det_id, count(*) AS area, count(px.x) AS hit FROM sp LEFT JOIN px USING (image_id, y, x) GROUP BY ALL),
b AS (SELECT image_id, det_id, greatest(y1 - y0, x1 - x0) / 24.0 AS r FROM detections) SELECT CASE WHEN r >= 4 THEN 'ge4x' WHEN r >= 2 THEN '2-4x' WHEN r >= 1 THEN '1-2x' WHEN r >= 0.5 THEN '0.5-1x' ELSE 'lt0.5x' END AS size, count(*) AS n,
round(sum(hit) / sum(area)::DOUBLE, 6) AS precision, round(sum(hit) / sum(there)::DOUBLE, 6) AS recall FROM b JOIN t USING (image_id, det_id) JOIN h USING (image_id, det_id) GROUP BY 1""", "detections", "gt", "shapes")  # fmt: skip
def _(s, d):
    out = traces.zoom_rates(fx.detections(s, d), fx.shapes(s, d), masks.box_runs(fx.ground_truth(s, d), "gt_id"), 24.0)
    return out.select("size", "n", r6("precision", "precision"), r6("recall", "recall"))


# --- the trace stream

#: The events as they come: each region's children by its place in a tree of at most 500, and its depth.
EVENTS = """SELECT event_id div 500 AS image_id, event_id % 500 + 1 AS node_id, CASE WHEN event_id % 500 > 0 THEN (event_id % 500 + 1) div 2 END AS parent_id,
CAST(CASE WHEN 2 * (event_id % 500 + 1) < 500 THEN 2 WHEN 2 * (event_id % 500 + 1) = 500 THEN 1 ELSE 0 END AS int) AS n_children, CAST(floor(log2(event_id % 500 + 1)) AS int) AS depth, event_type AS kind, round(value / 500, 6) AS reid_score, CAST(ts AS timestamp) AS ts FROM {events}"""


@query("trace_stream", """WITH e AS (SELECT event_id // 500 AS image_id, event_id % 500 + 1 AS node_id, CASE WHEN event_id % 500 > 0 THEN (event_id % 500 + 1) // 2 END AS parent_id, CASE WHEN 2 * (event_id % 500 + 1) < 500 THEN 2 WHEN 2 * (event_id % 500 + 1) = 500 THEN 1 ELSE 0 END AS n,
floor(log2(event_id % 500 + 1))::INT AS depth, round(value / 500, 6) AS s FROM events), k AS (SELECT image_id, parent_id AS node_id, count(*) AS seen, max(s) AS best FROM e WHERE parent_id IS NOT NULL GROUP BY ALL),
w AS (SELECT e.*, p.s AS ps, p.depth AS pd, k.seen = p.n AS whole, k.best AS family_best, p.n AS pn, CASE WHEN k.seen <= 1 OR k.best <= p.s THEN e.s > p.s ELSE e.s > p.s OR e.s >= 0.5 END AS alive FROM e JOIN e p ON p.image_id = e.image_id AND p.node_id = e.parent_id JOIN k ON k.image_id = p.image_id AND k.node_id = p.node_id),
any_ AS (SELECT image_id, parent_id, bool_or(alive) AS kept FROM w GROUP BY ALL)
SELECT image_id, node_id, CASE WHEN alive THEN 'leaf' WHEN kept THEN 'below-floor' ELSE 'reid-worse' END AS decision, NULL::DOUBLE AS best_child, depth AS level, CASE WHEN alive THEN 1 ELSE 0 END::INT AS phase FROM w JOIN any_ USING (image_id, parent_id) WHERE whole AND n = 0
UNION ALL SELECT e.image_id, e.node_id, CASE WHEN kept THEN 'zoom' ELSE 'reid-stop' END, round(best, 6), depth + 1, 0 FROM e JOIN k USING (image_id, node_id) JOIN any_ ON any_.image_id = e.image_id AND any_.parent_id = e.node_id WHERE seen = n""")  # fmt: skip
def _(s, d):
    """The whole table as a stream, file by file, until it has come to its end; families that its end leaves open are not decided."""
    schema = fx.table(s, d, "events").schema
    raw = s.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    raw.createOrReplaceTempView("incoming_events")
    events = s.sql(EVENTS.format(events="incoming_events"))
    found = stream.decisions(events, 0.5, late="3650 days")
    return stream.drained(found, fresh_path(s, "trace-stream")).select("image_id", "node_id", "decision", r6("best_child", "best_child"), "level", "phase")


# --- sources

@query("named_items", """WITH c AS (SELECT image_id, category_id, count(*) AS n FROM annotations GROUP BY image_id, category_id QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, category_id) = 1)
SELECT image_id, category_id, n AS n_gt, CASE WHEN category_id <= 5 THEN n_name ELSE category_id::VARCHAR END AS class_name FROM c LEFT JOIN nation ON n_nationkey = category_id""", "annotations")
def _(s, d):
    """Each image's most frequent category, by name where it has one: nations stand in for the names of categories up to 5."""
    classes = fx.table(s, d, "nation").filter("n_nationkey <= 5").select(F.col("n_nationkey").cast("long").alias("category_id"), F.col("n_name").alias("class_name"))
    per = fx.annotations(s, d).groupBy("image_id", "category_id").agg(F.count("*").alias("n_gt"))
    best = per.groupBy("image_id").agg(F.max_by(F.struct("category_id", "n_gt"), F.struct("n_gt", -F.col("category_id"))).alias("b")).select("image_id", "b.category_id", "b.n_gt")
    return datasets.named(best, classes).select("image_id", "category_id", "n_gt", "class_name")


@query("coco_split_scan", "SELECT i.image_id::VARCHAR AS image_id, height, width, i.image_id::VARCHAR || '{\"}.jpg' AS file_name, count(ann_id) AS n, sum(area) AS area FROM images i LEFT JOIN annotations USING (image_id) GROUP BY ALL", "images", "annotations")
def _(s, d):
    """The tables written as COCO-style documents, and read back in pieces of 64 kB."""
    folder = fresh_path(s, "coco")
    coco_split.write_documents(fx.images(s, d), fx.annotations(s, d), folder)
    planned = coco_split.plan(s, folder, 1 << 16)
    images, ann = coco_split.images(s, folder, planned), coco_split.annotations(s, folder, planned, ())
    return images.join(ann.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("area").alias("area")), "image_id", "left").select("image_id", F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"), "file_name", F.coalesce("n", F.lit(0)).alias("n"), "area")
