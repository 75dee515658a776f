"""Registered queries of the instance-discovery operators, with their SQL.

Each runs over whole tables. Doubles are rounded so that two engines agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as a
from ..functions import geometry as g
from ..operators import clustering, datasets, grids, masks, matching, metrics, suppress, thresholds, traces, vectors, where
from ..session import ship
from ..sources import fixtures as fx
from . import sweeps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str, recursive: bool = False):
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = fx.with_views(sql, *views, recursive=recursive) if views else sql
        return f

    return register


def r6(c, name: str | None = None):
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 6)
    return out.alias(name) if name else out


def _pairs(s, d):
    return matching.tiled_pairs(fx.detections(s, d), fx.ground_truth(s, d))


def _sims(s, d):
    return vectors.similarities(fx.patches(s, d), fx.exemplars(s, d))


def _maps(s, d):
    """One score map an image: each patch's largest similarity to an exemplar of class 0."""
    return vectors.heatmap(_sims(s, d).filter("class_id = 0"))


MAPS = "maps AS (SELECT image_id, patch_id, r, c, max(s) AS s FROM sim WHERE class_id = 0 GROUP BY ALL)"

# --- overlaps and matching

MATCH = """c AS (SELECT t, image_id, det_id, score, list({{'iou': iou, 'gt_id': {gt}}} ORDER BY iou DESC, {gt} DESC) AS c FROM {pairs} GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY t, image_id ORDER BY score DESC, det_id) AS rk FROM c),
m AS (SELECT DISTINCT t, image_id, 0::BIGINT AS rk, []::BIGINT[] AS taken, NULL::BIGINT AS det_id, NULL::BIGINT AS gt_id FROM k
  UNION ALL SELECT t, image_id, rk, CASE WHEN g IS NULL THEN taken ELSE list_append(taken, g) END, det_id, g FROM (
    SELECT k.t, k.image_id, k.rk, m.taken, k.det_id, list_filter(k.c, lambda x: NOT list_contains(m.taken, x.gt_id))[1].gt_id AS g
    FROM m JOIN k ON k.t = m.t AND k.image_id = m.image_id AND k.rk = m.rk + 1)),
won AS (SELECT t, image_id, det_id, abs(gt_id) AS gt_id FROM m WHERE gt_id IS NOT NULL)"""
AT_HALF = "p AS (SELECT *, 0.5 AS t FROM iou WHERE iou >= 0.5)"


@query("box_iou_pairs", "SELECT image_id, det_id, gt_id, round(iou, 6) AS iou FROM iou WHERE iou >= 0.5", "iou")
def _(s, d):
    return matching.tiled_pairs(fx.detections(s, d), fx.ground_truth(s, d)).filter("iou >= 0.5").select("image_id", "det_id", "gt_id", r6("iou", "iou"))


@query("greedy_match", f"WITH {AT_HALF}, {MATCH.format(gt='gt_id', pairs='p')} SELECT image_id, det_id, gt_id FROM won", "iou", recursive=True)
def _(s, d):
    return matching.greedy_match(_pairs(s, d)).select("image_id", "det_id", "gt_id")


AP = """n AS (SELECT count(*) AS n FROM gt), grid AS (SELECT d.image_id, d.det_id, d.score, x.t FROM detections d, (SELECT DISTINCT t FROM p) x),
sc AS (SELECT grid.*, (won.det_id IS NOT NULL)::INT AS tp FROM grid LEFT JOIN won ON won.t = grid.t AND won.image_id = grid.image_id AND won.det_id = grid.det_id),
cum AS (SELECT t, sum(tp) OVER o AS tps, row_number() OVER o AS k FROM sc WINDOW o AS (PARTITION BY t ORDER BY score DESC, image_id, det_id ROWS UNBOUNDED PRECEDING)),
env AS (SELECT t, k, tps, max(tps / k::DOUBLE) OVER (PARTITION BY t ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM cum),
lev AS (SELECT t, l, min(k) AS k FROM env, n, range(0, 101) x(l) WHERE tps * 100 >= l * n GROUP BY t, l),
ap AS (SELECT lev.t AS threshold, sum(e) / 101 AS ap FROM lev JOIN env ON env.t = lev.t AND env.k = lev.k GROUP BY lev.t)"""
ALL_T = "p AS (SELECT iou.*, x.t FROM iou, (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::DOUBLE[]) AS t) x WHERE iou >= x.t)"


@query("box_ap50", f"WITH {AT_HALF}, {MATCH.format(gt='gt_id', pairs='p')}, {AP} SELECT round(ap, 6) AS ap50 FROM ap", "iou", recursive=True)
def _(s, d):
    return metrics.coco_ap(fx.detections(s, d), fx.ground_truth(s, d), [0.5]).select(r6("ap", "ap50"))


@query("coco_ap", f"WITH {ALL_T}, {MATCH.format(gt='gt_id', pairs='p')}, {AP} SELECT threshold::DOUBLE AS threshold, round(ap, 6) AS ap FROM ap", "iou", recursive=True)
def _(s, d):
    return metrics.coco_ap(fx.detections(s, d), fx.ground_truth(s, d)).select("threshold", r6("ap", "ap"))


@query("ap_summary", f"WITH {ALL_T}, {MATCH.format(gt='gt_id', pairs='p')}, {AP} SELECT round(avg(ap), 6) AS ap, round(max(CASE WHEN threshold = 0.5 THEN ap END), 6) AS ap50, round(max(CASE WHEN threshold = 0.75 THEN ap END), 6) AS ap75 FROM ap", "iou", recursive=True)
def _(s, d):
    return metrics.summarize(metrics.coco_ap(fx.detections(s, d), fx.ground_truth(s, d))).select(r6("ap", "ap"), r6("ap50", "ap50"), r6("ap75", "ap75"))


@query("pq_count_recovery", f"""WITH {AT_HALF}, {MATCH.format(gt='gt_id', pairs='p')},
b AS (SELECT image_id, det_id, max(iou) AS best FROM iou GROUP BY ALL), h AS (SELECT count(*) AS tp, coalesce(sum(best), 0) AS s FROM won JOIN b USING (image_id, det_id)),
per AS (SELECT coalesce(p, 0) AS p, coalesce(g, 0) AS g FROM (SELECT image_id, count(*) AS p FROM detections GROUP BY 1) FULL JOIN (SELECT image_id, count(*) AS g FROM gt GROUP BY 1) USING (image_id)),
n AS (SELECT sum(p)::BIGINT AS np, sum(g)::BIGINT AS ng, avg(abs(p - g)) AS ca, avg(abs(p - g) / greatest(g, 1)::DOUBLE) AS cr FROM per),
rec AS (SELECT avg(coalesce(x, 0)) AS recovery FROM gt LEFT JOIN (SELECT image_id, gt_id, max(iou) AS x FROM iou GROUP BY ALL) USING (image_id, gt_id))
SELECT tp, np - tp AS fp, ng - tp AS fn, round(s / (tp + (np - tp) / 2.0 + (ng - tp) / 2.0), 6)::DOUBLE AS pq, round(CASE WHEN tp > 0 THEN s / tp ELSE 0 END, 6)::DOUBLE AS sq, round((tp / (tp + (np - tp) / 2.0 + (ng - tp) / 2.0))::DOUBLE, 6) AS rq,
round(ca, 6) AS count_abs, round(cr, 6) AS count_rel, round(recovery, 6) AS recovery FROM h, n, rec""", "iou", recursive=True)  # fmt: skip
def _(s, d):
    p = metrics.panoptic(fx.detections(s, d), fx.ground_truth(s, d))
    return p.select("tp", "fp", "fn", *[r6(c, c) for c in ("pq", "sq", "rq", "count_abs", "count_rel", "recovery")])


@query("evaluation", f"""WITH {ALL_T}, {MATCH.format(gt='gt_id', pairs='p')}, {AP},
b AS (SELECT image_id, det_id, max(iou) AS best FROM iou GROUP BY ALL), h AS (SELECT count(*) AS tp, coalesce(sum(best), 0)::DOUBLE AS s FROM won JOIN b USING (image_id, det_id) WHERE t = 0.5),
per AS (SELECT coalesce(p, 0) AS p, coalesce(g, 0) AS g FROM (SELECT image_id, count(*) AS p FROM detections GROUP BY 1) FULL JOIN (SELECT image_id, count(*) AS g FROM gt GROUP BY 1) USING (image_id)),
nn AS (SELECT sum(p)::DOUBLE AS np, sum(g)::DOUBLE AS ng, avg(abs(p - g)) AS ca, avg(abs(p - g) / greatest(g, 1)::DOUBLE) AS cr FROM per),
v AS (SELECT s / ((np + ng) / 2) AS pq, s / tp AS sq, tp / ((np + ng) / 2) AS rq, ca, cr, np, ng FROM h, nn),
o AS (SELECT unnest(['pq', 'sq', 'rq', 'mean_iou', 'count_error', 'count_error_rel', 'n_pred', 'n_gt']) AS metric, unnest([pq, sq, rq, sq, ca, cr, np, ng]) AS value FROM v
  UNION ALL SELECT 'box_ap', avg(ap) FROM ap UNION ALL SELECT 'box_ap' || (threshold * 100)::INT, ap FROM ap WHERE threshold IN (0.5, 0.75) UNION ALL SELECT 'box_ap_' || printf('%.2f', threshold::DOUBLE), ap FROM ap)
SELECT metric, round(value, 6)::DOUBLE AS value FROM o""", "iou", recursive=True)  # fmt: skip
def _(s, d):
    return metrics.to_rows(metrics.evaluate(fx.detections(s, d), fx.ground_truth(s, d))).select("metric", r6("value", "value"))


@query("exemplar_recovery", "SELECT round(avg(coalesce(x, 0)), 6) AS recovery FROM gt LEFT JOIN (SELECT image_id, gt_id, max(iou) AS x FROM iou GROUP BY ALL) USING (image_id, gt_id) WHERE gt_id <= 2", "iou")
def _(s, d):
    return metrics.exemplar_recovery(_pairs(s, d), fx.ground_truth(s, d).filter("gt_id <= 2")).select(r6("recovery", "recovery"))


@query("pred_taxonomy", f"""WITH {AT_HALF}, {MATCH.format(gt='-gt_id', pairs='p')}, b AS (SELECT image_id, det_id, max(iou) AS best FROM iou GROUP BY ALL)
SELECT CASE WHEN won.det_id IS NOT NULL THEN 'matched' WHEN best >= 0.5 THEN 'duplicate' WHEN best > 0 THEN 'partial' ELSE 'background' END AS outcome, count(*) AS n
FROM detections d LEFT JOIN b USING (image_id, det_id) LEFT JOIN won USING (image_id, det_id) GROUP BY 1""", "iou", recursive=True)
def _(s, d):
    return matching.prediction_outcomes(fx.detections(s, d), _pairs(s, d)).groupBy("outcome").agg(F.count("*").alias("n"))


def _visited(dets: DataFrame) -> DataFrame:
    y0, y1, x0, x1 = g.padded(g.box(), 0.25, F.lit(200), F.lit(200))
    return dets.select("image_id", "det_id", "score", y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1"))


PADDED = """SELECT image_id, det_id, score, greatest(0, y0 - py) AS y0, least(200, y1 + py) AS y1, greatest(0, x0 - px) AS x0, least(200, x1 + px) AS x1 FROM (SELECT *, trunc((y1 - y0) * 0.25)::BIGINT AS py, trunc((x1 - x0) * 0.25)::BIGINT AS px FROM detections)"""


@query("padded_box", PADDED, "detections")
def _(s, d):
    return _visited(fx.detections(s, d))


@query("miss_taxonomy", f"""WITH pad AS ({PADDED}), v AS (SELECT d.image_id, g.gt_id, (g.y1 - g.y0) * (g.x1 - g.x0) AS ga, (d.y1 - d.y0) * (d.x1 - d.x0) AS da,
  greatest(0, least(d.y1, g.y1) - greatest(d.y0, g.y0)) * greatest(0, least(d.x1, g.x1) - greatest(d.x0, g.x0)) AS inter FROM pad d JOIN gt g USING (image_id)),
vm AS (SELECT image_id, gt_id, max(inter / (ga + da - inter)::DOUBLE) AS v, max(inter / ga::DOUBLE) AS held FROM v GROUP BY ALL),
bm AS (SELECT image_id, gt_id, max(iou) AS b, max(CASE WHEN det_id % 2 = 0 THEN iou END) AS a FROM iou GROUP BY ALL)
SELECT CASE WHEN a >= 0.5 THEN 'detected' WHEN b >= 0.5 THEN 'suppressed' WHEN v >= 0.5 THEN 'not_emitted' ELSE 'never_framed' END AS outcome, coalesce(held, 0) >= 0.9 AS seen, count(*) AS n
FROM gt LEFT JOIN vm USING (image_id, gt_id) LEFT JOIN bm USING (image_id, gt_id) GROUP BY 1, 2""", "iou")
def _(s, d):
    dets, gt = fx.detections(s, d), fx.ground_truth(s, d)
    before = matching.tiled_pairs(dets, gt)
    out = matching.miss_outcomes(gt, before.filter("det_id % 2 = 0"), before, matching.tiled_pairs(_visited(dets), gt))
    return out.groupBy("outcome", "seen").agg(F.count("*").alias("n"))


@query("oracle_merge", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, gt_id) AS k FROM iou WHERE iou > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY image_id, gt_id ORDER BY iou DESC, det_id) AS j FROM o WHERE k = 1) SELECT image_id, gt_id, det_id, round(iou, 6) AS iou FROM b WHERE j = 1""", "iou")
def _(s, d):
    return matching.oracle_merge(_pairs(s, d)).select("image_id", "gt_id", "det_id", r6("iou", "iou"))


# --- suppression

_I = "(greatest(0, least(k.y1, x.y1) - greatest(k.y0, x.y0)) * greatest(0, least(k.x1, x.x1) - greatest(k.x0, x.x0)))"
_A, _B = "((x.y1 - x.y0) * (x.x1 - x.x0))", "((k.y1 - k.y0) * (k.x1 - k.x0))"
_IOU, _CON = f"({_I} / ({_A} + {_B} - {_I})::DOUBLE)", f"({_I} / least({_A}, {_B})::DOUBLE)"
NMS = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rk FROM detections),
m AS (SELECT DISTINCT image_id, 0::BIGINT AS rk, []::STRUCT(det_id BIGINT, y0 BIGINT, y1 BIGINT, x0 BIGINT, x1 BIGINT)[] AS kept FROM o
  UNION ALL SELECT o.image_id, o.rk, CASE WHEN len(list_filter(m.kept, lambda k: {same})) > 0 THEN m.kept ELSE list_append(m.kept, {{'det_id': o.det_id, 'y0': o.y0, 'y1': o.y1, 'x0': o.x0, 'x1': o.x1}}) END
  FROM m JOIN o ON o.image_id = m.image_id AND o.rk = m.rk + 1),
f AS (SELECT image_id, arg_max(kept, rk) AS kept FROM m GROUP BY image_id), u AS (SELECT image_id, unnest(kept) AS k, generate_subscripts(kept, 1) - 1 AS rank FROM f)"""


@query("nms_box", NMS.format(same=f"{_IOU} >= 0.5 OR {_CON} >= 0.8".replace("x.y", "o.y").replace("x.x", "o.x")) + " SELECT image_id, k.det_id AS det_id FROM u", "detections", recursive=True)
def _(s, d):
    return suppress.nms(fx.detections(s, d), 0.5, 0.8)


@query("nms_strict", NMS.format(same=f"{_IOU} > 0.5 OR {_I} / ({_A} + 1e-6) > 0.8".replace("x.y", "o.y").replace("x.x", "o.x")) + " SELECT image_id, rank::BIGINT AS rank, k.det_id AS det_id FROM u", "detections", recursive=True)
def _(s, d):
    return suppress.suppress_directional(fx.detections(s, d), 0.5, 0.8)


@query("soft_nms", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rk FROM detections),
m AS (SELECT DISTINCT image_id, 0::BIGINT AS rk, []::STRUCT(det_id BIGINT, s DOUBLE, y0 BIGINT, y1 BIGINT, x0 BIGINT, x1 BIGINT)[] AS kept FROM o
  UNION ALL SELECT image_id, rk, CASE WHEN ns >= 1000 THEN list_append(kept, {'det_id': det_id, 's': ns, 'y0': y0, 'y1': y1, 'x0': x0, 'x1': x1}) ELSE kept END FROM (
    SELECT o.*, m.kept, list_reduce(list_prepend(o.score, list_transform(m.kept, lambda k: CASE WHEN CON >= 0.9 THEN 0.0 ELSE exp(-(greatest(IOU, CON) * greatest(IOU, CON)) / 0.5) END)), lambda p, q: p * q) AS ns
    FROM m JOIN o ON o.image_id = m.image_id AND o.rk = m.rk + 1)),
f AS (SELECT image_id, arg_max(kept, rk) AS kept FROM m GROUP BY image_id), u AS (SELECT image_id, unnest(kept) AS k FROM f)
SELECT image_id, k.det_id AS det_id, round(k.s, 4) AS score FROM u""".replace("CON", _CON).replace("IOU", _IOU).replace("x.y", "o.y").replace("x.x", "o.x"), "detections", recursive=True)
def _(s, d):
    return suppress.soft_nms(fx.detections(s, d), 0.5, 1000.0, 0.9).select("image_id", "det_id", F.round("score", 4).alias("score"))


def _det_runs(s, d):
    return masks.box_runs(fx.detections(s, d), "det_id")


@query("nms_mask", SQL["nms_box"])
def _(s, d):
    return suppress.nms(fx.detections(s, d), 0.5, 0.8, suppress.mask_pairs(_det_runs(s, d)))


@query("nms_strict_mask", SQL["nms_strict"])
def _(s, d):
    return suppress.suppress_directional(fx.detections(s, d), 0.5, 0.8, suppress.mask_pairs(_det_runs(s, d)))


@query("soft_nms_mask", SQL["soft_nms"])
def _(s, d):
    return suppress.soft_nms(fx.detections(s, d), 0.5, 1000.0, 0.9, suppress.mask_pairs(_det_runs(s, d))).select("image_id", "det_id", F.round("score", 4).alias("score"))


def _cropped(dets: DataFrame) -> DataFrame:
    crop = F.struct(F.lit(20).alias("y0"), F.lit(90).alias("y1"), F.lit(0).alias("x0"), F.lit(100).alias("x1"))
    return dets.withColumns({"crop": crop, "height": F.lit(135), "width": F.lit(127)})


@query("drop_clipped", "SELECT image_id, det_id FROM detections WHERE NOT (y0 <= 20 OR y1 >= 90 OR x1 >= 100)", "detections")
def _(s, d):
    return suppress.drop_clipped(_cropped(fx.detections(s, d))).select("image_id", "det_id")


@query("drop_clipped_mask", SQL["drop_clipped"])
def _(s, d):
    return suppress.drop_clipped_masks(_cropped(fx.detections(s, d)), _det_runs(s, d)).select("image_id", "det_id")


REACH = """UNION SELECT reach.image_id, reach.a, e.b FROM reach JOIN e ON e.image_id = reach.image_id AND e.a = reach.b)"""


@query("fragment_groups", f"""WITH q AS (SELECT *, score < 5000 AS partial FROM detections), h AS (SELECT a.image_id, a.det_id AS a, b.det_id AS b FROM q a JOIN q b ON a.image_id = b.image_id AND a.det_id < b.det_id AND (a.partial OR b.partial)
  AND a.y0 < b.y1 + 1 AND b.y0 < a.y1 + 1 AND a.x0 < b.x1 + 1 AND b.x0 < a.x1 + 1), e AS (SELECT image_id, a, b FROM h UNION ALL SELECT image_id, b, a FROM h),
reach AS (SELECT DISTINCT image_id, a, a AS b FROM e {REACH}, roots AS (SELECT image_id, a AS node, min(b) AS root FROM reach GROUP BY ALL)
SELECT d.image_id, coalesce(root, det_id) AS root, count(*) AS n, min(y0) AS y0, max(y1) AS y1, min(x0) AS x0, max(x1) AS x1 FROM detections d LEFT JOIN roots r ON r.image_id = d.image_id AND r.node = d.det_id GROUP BY 1, 2""", "detections", recursive=True)  # fmt: skip
def _(s, d):
    from ..operators.graph import components

    dets = fx.detections(s, d).withColumn("partial", F.col("score") < 5000)
    roots = components(suppress.fragment_pairs(dets, 1))
    own = dets.join(roots.withColumnRenamed("node", "det_id"), ["image_id", "det_id"], "left").withColumn("root", F.coalesce("root", "det_id"))
    return own.groupBy("image_id", "root").agg(F.count("*").alias("n"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@query("fragment_merge_mask", SQL["fragment_groups"].replace("SELECT d.image_id, coalesce(root, det_id) AS root, count(*) AS n,", "SELECT d.image_id, arg_max(det_id, (score, -det_id)) AS det_id, count(*) AS pieces, round(max(score), 4) AS score,").replace("GROUP BY 1, 2", "GROUP BY d.image_id, coalesce(root, det_id)"))
def _(s, d):
    dets, runs = fx.detections(s, d), _det_runs(s, d)
    merged = suppress.merge_fragments(dets, suppress.mask_fragment_pairs(runs, dets.filter("score < 5000").select("image_id", "det_id"), 1), runs)
    return merged.withColumn("score", F.round("score", 4))


# --- masks

RUNS = "dr AS (SELECT image_id, det_id, unnest(range(y0, y1)) AS y, x0 AS xs, x1 AS xe FROM detections), gr AS (SELECT image_id, gt_id, unnest(range(y0, y1)) AS y, x0 AS xs, x1 AS xe FROM gt)"


@query("mask_iou_pairs", f"""WITH {RUNS}, i AS (SELECT dr.image_id, det_id, gt_id, sum(least(dr.xe, gr.xe) - greatest(dr.xs, gr.xs)) AS inter FROM dr JOIN gr ON dr.image_id = gr.image_id AND dr.y = gr.y AND dr.xs < gr.xe AND gr.xs < dr.xe GROUP BY ALL),
a AS (SELECT image_id, det_id, sum(xe - xs) AS a FROM dr GROUP BY ALL), b AS (SELECT image_id, gt_id, sum(xe - xs) AS b FROM gr GROUP BY ALL)
SELECT image_id, det_id, gt_id, inter::BIGINT AS inter, round((inter / (a + b - inter))::DOUBLE, 6) AS iou, round((inter / least(a, b))::DOUBLE, 6) AS containment FROM i JOIN a USING (image_id, det_id) JOIN b USING (image_id, gt_id)
WHERE inter / (a + b - inter) >= 0.3""", "detections", "gt")
def _(s, d):
    o = masks.overlaps(masks.box_runs(fx.detections(s, d), "det_id"), masks.box_runs(fx.ground_truth(s, d), "gt_id"), "det_id", "gt_id")
    return o.filter("iou >= 0.3").select("image_id", "det_id", "gt_id", "inter", r6("iou", "iou"), r6("containment", "containment"))


@query("mask_union_iou", f"""WITH {RUNS}, px AS (SELECT DISTINCT image_id, y, unnest(range(xs, xe)) AS x, 1 AS d, 0 AS g FROM dr UNION SELECT DISTINCT image_id, y, unnest(range(xs, xe)) AS x, 0, 1 FROM gr),
c AS (SELECT image_id, y, x, max(d) AS d, max(g) AS g FROM px GROUP BY ALL) SELECT image_id, round(sum(d * g) / count(*)::DOUBLE, 6) AS iou FROM c GROUP BY 1""", "detections", "gt")
def _(s, d):
    out = masks.union_iou(masks.box_runs(fx.detections(s, d), "det_id"), masks.box_runs(fx.ground_truth(s, d), "gt_id"))
    return out.select("image_id", r6("iou", "iou"))


@query("mask_window", f"""WITH {RUNS}, w AS (SELECT image_id, det_id, y - 20 AS y, greatest(0, xs - 30) AS xs, least(40, xe - 30) AS xe FROM dr WHERE y BETWEEN 20 AND 69), v AS (SELECT * FROM w WHERE xe > xs)
SELECT image_id, det_id, min(y) AS y0, max(y) + 1 AS y1, min(xs) AS x0, max(xe) AS x1, sum(xe - xs)::BIGINT AS area FROM v GROUP BY 1, 2 HAVING sum(xe - xs) >= 50""", "detections", "gt")
def _(s, d):
    cut = masks.shift_into(masks.box_runs(fx.detections(s, d), "det_id"), "det_id", 20, 30, 50, 40, 50)
    return masks.tight_boxes(cut, "det_id").join(masks.areas(cut, "det_id"), ["image_id", "det_id"])


# --- boxes

@query("child_box", """SELECT image_id, det_id, greatest(0, a - round_even((b - a) * 0.08, 0)::BIGINT) AS y0, least(768, b + round_even((b - a) * 0.08, 0)::BIGINT) AS y1,
greatest(0, c - round_even((e - c) * 0.08, 0)::BIGINT) AS x0, least(768, e + round_even((e - c) * 0.08, 0)::BIGINT) AS x1 FROM (
SELECT image_id, det_id, floor(y0 * (768 / 160.0::DOUBLE))::BIGINT AS a, ceil(y1 * (768 / 160.0::DOUBLE))::BIGINT AS b, floor(x0 * (768 / 160.0::DOUBLE))::BIGINT AS c, ceil(x1 * (768 / 160.0::DOUBLE))::BIGINT AS e FROM detections)""", "detections")
def _(s, d):
    parent = (F.lit(0), F.lit(768), F.lit(0), F.lit(768))
    y0, y1, x0, x1 = g.child_box(g.box(), parent, 160, 0.08)
    return fx.detections(s, d).select("image_id", "det_id", *[c.cast("long").alias(n) for c, n in zip((y0, y1, x0, x1), ("y0", "y1", "x0", "x1"))])


@query("letterbox_box", """SELECT d.image_id, det_id, round(y0 * k, 6) AS y0, round(y1 * k, 6) AS y1, round(x0 * k, 6) AS x0, round(x1 * k, 6) AS x1 FROM (SELECT d.*, least(1.0::DOUBLE, 512.0::DOUBLE / greatest(height, width)) AS k FROM detections d JOIN images i ON i.image_id = d.image_id) d""", "detections", "images")
def _(s, d):
    joined = fx.detections(s, d).join(fx.images(s, d), "image_id")
    y0, y1, x0, x1 = g.letterbox(g.box(), F.col("height"), F.col("width"), 512)
    return joined.select("image_id", "det_id", r6(y0, "y0"), r6(y1, "y1"), r6(x0, "x0"), r6(x1, "x1"))


@query("square_crop", """SELECT image_id, det_id, greatest(0, cy - h) AS y0, least(200, cy + h) AS y1, greatest(0, cx - h) AS x0, least(200, cx + h) AS x1 FROM (SELECT image_id, det_id, round_even(greatest(y1 - y0, x1 - x0) * 0.75::DOUBLE, 0)::BIGINT AS h, (y0 + y1) // 2 AS cy, (x0 + x1) // 2 AS cx FROM detections)
WHERE least(200, cy + h) - greatest(0, cy - h) >= 16 AND least(200, cx + h) - greatest(0, cx - h) >= 16""", "detections")
def _(s, d):
    y0, y1, x0, x1 = g.square_crop(g.box(), 1.5, F.lit(200), F.lit(200))
    return fx.detections(s, d).select("image_id", "det_id", *[c.cast("long").alias(n) for c, n in zip((y0, y1, x0, x1), ("y0", "y1", "x0", "x1"))]).filter("y1 - y0 >= 16 AND x1 - x0 >= 16")


# --- vectors

_LN = "sqrt(list_dot_product(feat, feat))"


@query("l2norm", f"SELECT patch_id, round(feat[1] / ({_LN} + 1e-8), 6) AS first, round(feat[64] / ({_LN} + 1e-8), 6) AS last FROM patches", "patches")
def _(s, d):
    return fx.patches(s, d).withColumn("u", a.l2_normalize(F.col("feat"))).select("patch_id", r6(F.element_at("u", 1), "first"), r6(F.element_at("u", -1), "last"))


PROTO = "l AS (SELECT {by}, unnest(feat) AS x, generate_subscripts(feat, 1) AS i FROM patches), m AS (SELECT {by}, i, avg(x) AS x FROM l GROUP BY ALL), pn AS (SELECT {by}, sqrt(sum(x * x)) + 1e-8 AS n FROM m GROUP BY ALL)"


@query("prototype", f"WITH {PROTO.format(by='class_id')} SELECT class_id, i::BIGINT AS i, round(x / n, 6) AS x FROM m JOIN pn USING (class_id)", "patches")
def _(s, d):
    p = vectors.prototypes(fx.patches(s, d), ["class_id"])
    return p.select("class_id", F.posexplode("proto").alias("i", "x")).select("class_id", (F.col("i") + 1).cast("long").alias("i"), r6("x", "x"))


@query("bank_mean", f"WITH {PROTO.format(by='class_id, image_id')}, f AS (SELECT class_id, image_id AS ex_id, x / n AS x FROM m JOIN pn USING (class_id, image_id) WHERE i = 1) SELECT class_id, row_number() OVER (PARTITION BY class_id ORDER BY ex_id) - 1 AS place, ex_id, round(x, 6) AS first FROM f", "patches")
def _(s, d):
    b = clustering.bank(fx.patches(s, d).withColumnRenamed("image_id", "ex_id"), "mean")
    return b.select("class_id", "place", "ex_id", r6(F.element_at("feat", 1), "first"))


@query("standardize", """WITH l AS (SELECT image_id, patch_id, unnest(feat) AS x, generate_subscripts(feat, 1) AS i FROM patches), st AS (SELECT image_id, i, avg(x) AS m, coalesce(stddev_samp(x), 0) AS d FROM l GROUP BY ALL),
z AS (SELECT image_id, patch_id, i, (x - m) / (d + 1e-8) AS z FROM l JOIN st USING (image_id, i)) SELECT patch_id, round(max(CASE WHEN i = 1 THEN z END) / (sqrt(sum(z * z)) + 1e-8), 6) AS first FROM z GROUP BY 1""", "patches")
def _(s, d):
    return vectors.standardized(fx.patches(s, d)).select("patch_id", r6(F.element_at("feat", 1), "first"))


@query("bank_all", "SELECT class_id, row_number() OVER (PARTITION BY class_id ORDER BY image_id, patch_id) - 1 AS place, image_id AS ex_id, round(feat[1], 6) AS first FROM patches", "patches")
def _(s, d):
    b = clustering.bank(fx.patches(s, d).withColumnRenamed("image_id", "ex_id"), "all", 1 << 30)
    return b.select("class_id", "place", "ex_id", r6(F.element_at("feat", 1), "first"))


@query("cosine_topk", "SELECT patch_id, ex_id, round(s, 6) AS s, rank FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY s DESC, ex_id) AS rank FROM sim) WHERE rank <= 5", "sim")
def _(s, d):
    return vectors.top_k(fx.patches(s, d), fx.exemplars(s, d), 5).select("patch_id", "ex_id", r6("s", "s"), "rank")


@query("backward_nn", "SELECT image_id, patch_id, ex_id, class_id, round(s, 6) AS s FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY s DESC, ex_id) AS k FROM sim) WHERE k = 1", "sim")
def _(s, d):
    return vectors.nearest(_sims(s, d)).select("image_id", "patch_id", "ex_id", "class_id", r6("s", "s"))


@query("heatmap_points", f"WITH {MAPS} SELECT image_id, r, c, round(s, 6) AS s, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, r, c) AS rank FROM maps WHERE s >= 0) WHERE rank <= 10", "sim")
def _(s, d):
    return grids.top_points(_maps(s, d), 10, 0.0).select("image_id", "r", "c", r6("s", "s"), "rank")


REID = "t AS (SELECT image_id, class_id, ex_id, avg(s) AS s FROM sim GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY s DESC, ex_id) AS k FROM t)"


@query("reid_score_full", f"WITH {REID} SELECT image_id, class_id, round(avg(s), 6) AS g FROM k GROUP BY 1, 2", "sim")
def _(s, d):
    return vectors.reid_scores(_sims(s, d)).select("image_id", "class_id", r6("g", "g"))


@query("reid_score_top2", f"WITH {REID} SELECT image_id, class_id, round(avg(s), 6) AS g FROM k WHERE k <= 2 GROUP BY 1, 2", "sim")
def _(s, d):
    return vectors.reid_scores(_sims(s, d), 2).select("image_id", "class_id", r6("g", "g"))


@query("reid_score_mean", f"""WITH {PROTO.format(by='image_id')}, u AS (SELECT image_id, list(x / n ORDER BY i) AS p FROM m JOIN pn USING (image_id) GROUP BY 1),
v AS (SELECT image_id, class_id, ex_id, round(list_dot_product(p, feat), 9) AS s FROM u, exemplars) SELECT image_id, class_id, round(avg(s), 6) AS g FROM v GROUP BY 1, 2""", "patches", "exemplars")
def _(s, d):
    p = vectors.prototypes(fx.patches(s, d), ["image_id"]).select("image_id", F.col("image_id").alias("patch_id"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(0).alias("class_id"), F.col("proto").alias("feat"))
    return vectors.reid_scores(vectors.similarities(p, fx.exemplars(s, d))).select("image_id", "class_id", r6("g", "g"))


@query("score_modes", f"""WITH {MAPS}, f AS (SELECT *, r BETWEEN 3 AND 6 AND c BETWEEN 3 AND 6 AS fg FROM maps) SELECT image_id, round(avg(s), 6) AS mean_all, round(max(s), 6) AS max_all,
round(avg(CASE WHEN fg THEN s END), 6) AS mean_in, round(max(CASE WHEN fg THEN s END), 6) AS max_in, round(avg(fg::INT), 6) AS share_in FROM f GROUP BY 1""", "sim")
def _(s, d):
    m = vectors.score_modes(_sims(s, d).filter("class_id = 0"), F.col("r").between(3, 6) & F.col("c").between(3, 6))
    return m.select("image_id", *[r6(c, c) for c in ("mean_all", "max_all", "mean_in", "max_in", "share_in")])


BASIS = [[0.125] * 64, [0.125, -0.125] * 32]


@query("project_out_fixed_basis", f"""WITH p AS (SELECT patch_id, feat, {BASIS[0]}::DOUBLE[] AS u, {BASIS[1]}::DOUBLE[] AS v FROM patches), q AS (SELECT patch_id, v, list_transform(feat, lambda x, i: x - list_dot_product(feat, u) * u[i]) AS f FROM p),
w AS (SELECT patch_id, list_transform(f, lambda x, i: x - list_dot_product(f, v) * v[i]) AS f FROM q) SELECT patch_id, round(f[1] / (sqrt(list_dot_product(f, f)) + 1e-8), 6) AS first FROM w""", "patches")
def _(s, d):
    return fx.patches(s, d).select("patch_id", r6(F.element_at(a.project_out(F.col("feat"), BASIS), 1), "first"))


@query("cluster_aggregate", f"""WITH {PROTO.format(by='image_id, class_id')}, b AS (SELECT image_id, patch_id, max(s) AS s FROM sim WHERE class_id = 0 GROUP BY ALL),
st AS (SELECT image_id, p.class_id, count(*) AS n, avg(b.s) AS crs FROM patches p JOIN b USING (image_id, patch_id) GROUP BY ALL),
se AS (SELECT *, n / (sum(n) OVER (PARTITION BY image_id))::DOUBLE AS share, row_number() OVER (PARTITION BY image_id ORDER BY crs DESC, class_id) = 1 AS seed FROM st),
u AS (SELECT image_id, class_id, list(x / n ORDER BY i) AS p FROM m JOIN pn USING (image_id, class_id) GROUP BY ALL),
j AS (SELECT se.*, round(list_dot_product(u.p, sp.p), 9) AS intra FROM se JOIN u USING (image_id, class_id) JOIN (SELECT u.image_id, u.p FROM u JOIN se USING (image_id, class_id) WHERE seed) sp USING (image_id))
SELECT image_id, class_id, round(share, 6) AS share, round(crs, 6) AS "cross", round(intra, 6) AS intra, round(crs * intra * CASE WHEN seed THEN 1 ELSE share END, 6) AS combined, seed FROM j""", "sim")  # fmt: skip
def _(s, d):
    c = vectors.cluster_aggregate(fx.patches(s, d), _sims(s, d).filter("class_id = 0"), 0.2)
    return c.select("image_id", "class_id", *[r6(x, x) for x in ("share", "cross", "intra", "combined")], "seed")


# --- thresholds

OTSU = f"""{MAPS}, e AS (SELECT image_id, min(s) AS lo, max(s) AS hi FROM maps GROUP BY 1),
h AS (SELECT image_id, lo, hi, least(floor((s - lo) / (hi - lo) * 256), 255) AS bin, count(*) AS n FROM maps JOIN e USING (image_id) GROUP BY ALL),
z AS (SELECT *, lo + (bin + 0.5::DOUBLE) * (hi - lo) / 256 AS mid FROM h), y AS (SELECT *, sum(n) OVER a AS total, sum(n) OVER o / (sum(n) OVER a)::DOUBLE AS w, sum(n * mid) OVER o / sum(n) OVER a AS mu, sum(n * mid) OVER a / sum(n) OVER a AS mt FROM z
  WINDOW a AS (PARTITION BY image_id), o AS (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, CASE WHEN w * (1 - w) > 1e-12 THEN round((mt * w - mu) * (mt * w - mu) / (w * (1 - w)), 12) ELSE 0 END AS b FROM y),
tau AS (SELECT image_id, mid AS tau FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY b DESC, bin) AS k FROM v) WHERE k = 1)"""


@query("otsu_threshold", f"WITH {OTSU} SELECT image_id, round(tau, 6) AS tau FROM tau", "sim")
def _(s, d):
    return thresholds.otsu(_maps(s, d), ["image_id"]).select("image_id", r6("tau", "tau"))


@query("otsu_foreground", f"WITH {OTSU} SELECT image_id, patch_id, s >= tau AS fg FROM maps JOIN tau USING (image_id)", "sim")
def _(s, d):
    m = _maps(s, d)
    return thresholds.foreground(m, thresholds.otsu(m, ["image_id"]), ["image_id"]).select("image_id", "patch_id", "fg")


@query("bank_foreground", "SELECT image_id, patch_id, max(s) >= 0.3 AS fg FROM sim GROUP BY 1, 2", "sim")
def _(s, d):
    return vectors.heatmap(_sims(s, d)).select("image_id", "patch_id", (F.col("s") >= 0.3).alias("fg"))


@query("separability", f"""WITH {OTSU}, f AS (SELECT image_id, avg((s >= tau)::INT) AS w, avg(CASE WHEN s >= tau THEN s END) AS a, avg(CASE WHEN s < tau THEN s END) AS b, var_pop(s) AS v FROM maps JOIN tau USING (image_id) GROUP BY 1)
SELECT image_id, round(CASE WHEN a IS NULL OR b IS NULL OR v < 1e-12 THEN 0 ELSE least(1, w * (1 - w) * (a - b) * (a - b) / v) END, 6) AS eta FROM f""", "sim")
def _(s, d):
    m = _maps(s, d)
    return thresholds.separability(m, thresholds.otsu(m, ["image_id"]), ["image_id"]).select("image_id", r6("eta", "eta"))


@query("percentile_cut", f"WITH {MAPS} SELECT image_id, round(quantile_cont(s, 0.9), 6) AS tau FROM maps GROUP BY 1", "sim")
def _(s, d):
    return thresholds.percentile_cut(_maps(s, d), ["image_id"], 90).select("image_id", r6("tau", "tau"))


@query("gate_percentiles", "SELECT class_id, round(quantile_cont(s, 0.1), 6) AS p10, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.99), 6) AS p99, round(avg(s), 6) AS mean, round(max(s), 6) AS max, round(avg((s < 0.3)::INT), 6) AS below FROM sim GROUP BY 1", "sim")
def _(s, d):
    sims = _sims(s, d).select("class_id", "s")
    out = sims.groupBy("class_id").agg(r6(F.avg("s"), "mean"), r6(F.max("s"), "max"), r6(F.avg((F.col("s") < 0.3).cast("double")), "below"))
    for share, name in ((0.1, "p10"), (0.5, "p50"), (0.99, "p99")):
        out = out.join(metrics.exact_percentile(sims, "class_id", "s", share).select("class_id", r6("value", name)), "class_id")
    return out


MINMAX = f"{MAPS}, mm AS (SELECT image_id, patch_id, r, c, (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) AS s FROM maps WINDOW w AS (PARTITION BY image_id))"


@query("minmax_map", f"WITH {MINMAX} SELECT image_id, patch_id, round(s, 6) AS s FROM mm", "sim")
def _(s, d):
    return thresholds.minmax_map(_maps(s, d), ["image_id"]).select("image_id", "patch_id", r6("s", "s"))


EDGES8 = "(abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1 AND (p.r, p.c) <> (q.r, q.c))"
EDGES4 = "(abs(p.r - q.r) + abs(p.c - q.c) = 1)"


@query("hysteresis_fg", f"""WITH {MINMAX}, wk AS (SELECT *, r * 10 + c AS a FROM mm WHERE s >= 0.4), e AS (SELECT p.image_id, p.a, q.a AS b FROM wk p JOIN wk q ON p.image_id = q.image_id AND {EDGES8}),
reach AS (SELECT image_id, a, a AS b FROM wk {REACH} SELECT DISTINCT reach.image_id, reach.a // 10 AS r, reach.a % 10 AS c FROM reach JOIN wk ON wk.image_id = reach.image_id AND wk.a = reach.b WHERE wk.s >= 0.8""", "sim", recursive=True)
def _(s, d):
    m = thresholds.minmax_map(_maps(s, d), ["image_id"])
    return grids.hysteresis(m, 10, F.col("s") >= 0.4, F.col("s") >= 0.8).select("image_id", "r", "c")


# --- grids

def _components(connectivity: int, edges: str) -> None:
    sql = f"""WITH cl AS (SELECT image_id, r, c, class_id % 3 AS l, r * 10 + c AS a FROM patches), e AS (SELECT p.image_id, p.a, q.a AS b FROM cl p JOIN cl q ON p.image_id = q.image_id AND p.l = q.l AND {edges}),
reach AS (SELECT image_id, a, a AS b FROM cl {REACH}, m AS (SELECT image_id, a, min(b) AS root FROM reach GROUP BY ALL) SELECT image_id, a // 10 AS r, a % 10 AS c, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS component FROM m"""

    @query(f"grid_components_{connectivity}", sql, "patches", recursive=True)
    def _(s, d):
        cells = fx.patches(s, d).select("image_id", "r", "c", (F.col("class_id") % 3).alias("l"))
        return grids.connected(cells, 10, connectivity, "l").select("image_id", "r", "c", "component")


_components(4, EDGES4)
_components(8, EDGES8)


@query("region_adjacency", "SELECT p.image_id, least(p.class_id, q.class_id) AS a, greatest(p.class_id, q.class_id) AS b, count(*) AS border FROM patches p JOIN patches q ON p.image_id = q.image_id AND ((q.r = p.r + 1 AND q.c = p.c) OR (q.r = p.r AND q.c = p.c + 1)) WHERE p.class_id <> q.class_id AND p.class_id > 0 AND q.class_id > 0 GROUP BY 1, 2, 3", "patches")
def _(s, d):
    return grids.adjacency(fx.patches(s, d), "class_id")


@query("seams", f"SELECT DISTINCT p.image_id, p.r, p.c FROM patches p JOIN patches q ON p.image_id = q.image_id AND {EDGES8} WHERE p.class_id % 3 <> q.class_id % 3 AND p.class_id % 3 > 0 AND q.class_id % 3 > 0", "patches")
def _(s, d):
    return grids.seams(fx.patches(s, d).withColumn("l", F.col("class_id") % 3), "l")


BOUNDARY = f"nb AS (SELECT p.image_id, p.r, p.c, greatest(0, 1 - avg(round(list_dot_product(p.feat, q.feat), 9))) AS b FROM patches p JOIN patches q ON p.image_id = q.image_id AND {EDGES4} GROUP BY 1, 2, 3), fb AS (SELECT image_id, r, c, b / max(b) OVER (PARTITION BY image_id) AS boundary FROM nb)"


@query("feature_boundary", f"WITH {BOUNDARY} SELECT image_id, r, c, round(boundary, 6) AS boundary FROM fb", "patches")
def _(s, d):
    return grids.feature_boundary(fx.patches(s, d)).select("image_id", "r", "c", r6("boundary", "boundary"))


@query("region_merge", f"""WITH {BOUNDARY}, {PROTO.format(by='image_id, class_id')}, u AS (SELECT image_id, class_id, list(x / n ORDER BY i) AS p FROM m JOIN pn USING (image_id, class_id) GROUP BY ALL),
bd AS (SELECT p.image_id, least(p.class_id, q.class_id) AS a, greatest(p.class_id, q.class_id) AS b, avg(fb.boundary) AS mean FROM patches p JOIN patches q ON p.image_id = q.image_id AND ((q.r = p.r + 1 AND q.c = p.c) OR (q.r = p.r AND q.c = p.c + 1))
  JOIN fb ON fb.image_id = p.image_id AND fb.r = p.r AND fb.c = p.c WHERE p.class_id <> q.class_id GROUP BY 1, 2, 3),
h AS (SELECT bd.image_id, a, b FROM bd JOIN u x ON x.image_id = bd.image_id AND x.class_id = a JOIN u y ON y.image_id = bd.image_id AND y.class_id = b WHERE round(list_dot_product(x.p, y.p), 9) >= 0.1 AND mean <= 0.9),
e AS (SELECT image_id, a, b FROM h UNION ALL SELECT image_id, b, a FROM h), reach AS (SELECT DISTINCT image_id, class_id AS a, class_id AS b FROM patches {REACH}, ro AS (SELECT image_id, a AS region, min(b) AS root FROM reach GROUP BY ALL)
SELECT image_id, region, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS merged FROM ro""", "patches", recursive=True)  # fmt: skip
def _(s, d):
    return grids.merge_regions(fx.patches(s, d), "class_id", 0.1, 0.9)


@query("grid_resample_iou", """WITH k AS (SELECT image_id, r, c, class_id % 2 = 0 AS fg FROM patches), t AS (SELECT i.image_id, a.r AS tr, b.c AS tc, least(9, floor((a.r + 0.5) * 10 / 7))::BIGINT AS r, least(9, floor((b.c + 0.5) * 10 / 7))::BIGINT AS c FROM (SELECT DISTINCT image_id FROM k) i, range(0, 7) a(r), range(0, 7) b(c)),
z AS (SELECT t.image_id, tr, tc, fg, tr BETWEEN 1 AND 5 AND tc BETWEEN 1 AND 5 AS box FROM t JOIN k USING (image_id, r, c)) SELECT image_id, round(count(*) FILTER (fg AND box) / count(*) FILTER (fg OR box)::DOUBLE, 6) AS iou FROM z GROUP BY 1""", "patches")
def _(s, d):
    small = grids.resample(fx.patches(s, d).select("image_id", "r", "c", (F.col("class_id") % 2 == 0).alias("fg")), 10, 7, ["fg"])
    return grids.grid_iou(small.filter("fg"), small.filter("r BETWEEN 1 AND 5 AND c BETWEEN 1 AND 5")).select("image_id", r6("iou", "iou"))


# --- dataset preparation

@query("coco_image_scan", "SELECT image_id, height, width, count(ann_id) AS n, sum(area) AS area FROM images LEFT JOIN annotations USING (image_id) GROUP BY 1, 2, 3", "images", "annotations")
def _(s, d):
    return datasets.image_scan(fx.images(s, d), fx.annotations(s, d)).groupBy("image_id", "height", "width").agg(F.count("ann_id").alias("n"), F.sum("area").alias("area"))


@query("class_remap", "SELECT image_id, ann_id, CASE category_id WHEN 7 THEN 1 WHEN 2 THEN 2 WHEN 9 THEN 3 END::BIGINT AS class_id FROM annotations WHERE category_id IN (7, 2, 9)", "annotations")
def _(s, d):
    return datasets.of_categories(fx.annotations(s, d), [7, 2, 9]).select("image_id", "ann_id", "class_id")


@query("filtered_images", "SELECT image_id, count(ann_id) AS n FROM images LEFT JOIN (SELECT * FROM annotations WHERE category_id IN (7, 2)) USING (image_id) GROUP BY 1", "images", "annotations")
def _(s, d):
    return datasets.filtered(fx.images(s, d), fx.annotations(s, d), [7, 2]).groupBy("image_id").agg(F.count("ann_id").alias("n"))


@query("largest_exemplar", "SELECT category_id, image_id, ann_id FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY height * width DESC, image_id, area DESC, ann_id) AS k FROM annotations JOIN images USING (image_id)) WHERE k = 1", "images", "annotations")
def _(s, d):
    return datasets.largest_exemplar(fx.annotations(s, d), fx.images(s, d))


@query("min_instance_filter", "SELECT image_id, count(*) AS n FROM annotations GROUP BY 1 HAVING count(*) >= 5", "annotations")
def _(s, d):
    return datasets.with_instances(fx.annotations(s, d), 5)


PAIRS = "pr AS (SELECT image_id, category_id, n, sqrt(m) / greatest(width, height) * 768 / 16 AS patches FROM (SELECT image_id, category_id, count(*) AS n, median(area) AS m FROM annotations GROUP BY 1, 2) JOIN images USING (image_id))"


@query("lvis_pair_stats", f"WITH {PAIRS} SELECT image_id, category_id, n, round(patches, 6) AS patches FROM pr", "images", "annotations")
def _(s, d):
    return datasets.pair_stats(fx.images(s, d), fx.annotations(s, d)).select("image_id", "category_id", "n", r6("patches", "patches"))


@query("lvis_slice", f"""WITH {PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY md5(concat_ws(':', image_id, category_id, 0))) AS k FROM pr WHERE n >= 2 AND patches <= 3)
SELECT image_id, category_id, n FROM o WHERE k = 1 ORDER BY md5(concat_ws(':', image_id, 0)), image_id LIMIT 100""", "images", "annotations")
def _(s, d):
    return datasets.slice_pairs(datasets.pair_stats(fx.images(s, d), fx.annotations(s, d)), 100, 2, 3.0)


@query("slice_summary", f"WITH {PAIRS} SELECT count(DISTINCT image_id) AS n_images, sum(n)::BIGINT AS n_instances, min(n) AS least, max(n) AS most, count(DISTINCT category_id) AS n_classes FROM pr WHERE n >= 2", "images", "annotations")
def _(s, d):
    return datasets.slice_summary(datasets.pair_stats(fx.images(s, d), fx.annotations(s, d)).filter("n >= 2"))


@query("pool_split", """WITH q AS (SELECT image_id, row_number() OVER (ORDER BY md5(concat_ws(':', image_id, 0)), image_id) AS k FROM annotations GROUP BY image_id HAVING count(*) >= 2)
SELECT image_id, CASE WHEN k <= 500 THEN 'train' ELSE 'inter' END AS pool FROM q WHERE k <= 800""", "annotations")
def _(s, d):
    return datasets.pools(datasets.with_instances(fx.annotations(s, d), 2), 500, 300)


SPLIT = """q{i} AS (SELECT *, md5(concat_ws(':', image_id, ann_id, {i})) AS o FROM annotations), f{i} AS (SELECT *, row_number() OVER (PARTITION BY image_id, category_id ORDER BY o, ann_id) = 1 AS first FROM q{i}),
k{i} AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY first DESC, o, ann_id) AS rk, count(*) OVER (PARTITION BY image_id) AS n, sum(first::INT) OVER (PARTITION BY image_id) AS cl FROM f{i}),
split{i} AS (SELECT image_id, ann_id, category_id, {i} AS seed, CASE WHEN rk <= greatest(1, cl, ceil(n * 0.5)) THEN 'known' ELSE 'unknown' END AS part FROM k{i})"""


@query("pu_split", f"WITH {SPLIT.format(i=0)} SELECT image_id, ann_id, part FROM split0", "annotations")
def _(s, d):
    return datasets.pu_split(fx.annotations(s, d), 0.5)


@query("image_samples", f"WITH {SPLIT.format(i=0)} SELECT image_id, count(*) FILTER (part = 'known') AS n_known, count(*) FILTER (part = 'unknown') AS n_unknown FROM images LEFT JOIN split0 USING (image_id) GROUP BY 1", "images", "annotations")
def _(s, d):
    ann = fx.annotations(s, d)
    return datasets.samples(fx.images(s, d), ann, datasets.pu_split(ann, 0.5)).select("image_id", "n_known", "n_unknown")


@query("split_collisions", f"WITH {SPLIT.format(i=0)}, {SPLIT.format(i=1)}, {SPLIT.format(i=2)}, x AS (SELECT image_id, seed, list(ann_id ORDER BY ann_id)::VARCHAR AS l FROM (FROM split0 UNION ALL FROM split1 UNION ALL FROM split2) WHERE part = 'known' GROUP BY 1, 2) SELECT image_id, count(*) AS n_splits, count(DISTINCT l) AS n_distinct FROM x GROUP BY 1", "annotations")
def _(s, d):
    ann = fx.annotations(s, d)
    parts = [datasets.pu_split(ann, 0.5, i).withColumn("seed", F.lit(i)) for i in range(3)]
    return datasets.split_collisions(parts[0].unionByName(parts[1]).unionByName(parts[2]))


SUPPORT = """ct AS (SELECT category_id, image_id, count(*) AS n FROM kn GROUP BY 1, 2), bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY n DESC, image_id) AS k FROM ct) WHERE k = 1)"""


@query("support_best", f"WITH {SPLIT.format(i=0)}, kn AS (SELECT * FROM split0 WHERE part = 'known'), {SUPPORT} SELECT category_id, image_id, n, shot, ann_id FROM (SELECT bs.category_id, bs.image_id, bs.n, ann_id, row_number() OVER (PARTITION BY bs.category_id ORDER BY ann_id) AS shot FROM bs JOIN kn ON kn.category_id = bs.category_id AND kn.image_id = bs.image_id) WHERE shot <= 3", "annotations")
def _(s, d):
    ann = fx.annotations(s, d)
    return datasets.support_best(ann.join(datasets.pu_split(ann, 0.5).filter("part = 'known'"), ["image_id", "ann_id"]), 3)


@query("intra_items", f"WITH {SPLIT.format(i=0)}, c AS (SELECT image_id, category_id, count(*) FILTER (part = 'known') AS k, count(*) AS n FROM split0 GROUP BY 1, 2) SELECT image_id, category_id, least(k, 2) AS n_exemplars, n AS n_gt FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY k DESC, category_id) AS r FROM c WHERE k > 0) WHERE r = 1", "annotations")
def _(s, d):
    ann = fx.annotations(s, d)
    return datasets.intra_items(ann, datasets.pu_split(ann, 0.5), 2).withColumn("n_exemplars", F.col("n_exemplars").cast("long"))


@query("inter_items", f"WITH {SPLIT.format(i=0)}, kn AS (SELECT * FROM split0 WHERE part = 'known'), {SUPPORT}, c AS (SELECT image_id, category_id, count(*) AS n FROM annotations GROUP BY 1, 2) SELECT image_id, category_id, support_image_id, n_gt FROM (SELECT c.image_id, c.category_id, bs.image_id AS support_image_id, c.n AS n_gt, row_number() OVER (PARTITION BY c.image_id ORDER BY c.n DESC, c.category_id) AS r FROM c JOIN bs ON bs.category_id = c.category_id AND bs.image_id <> c.image_id) WHERE r = 1", "annotations")
def _(s, d):
    ann = fx.annotations(s, d)
    known = ann.join(datasets.pu_split(ann, 0.5).filter("part = 'known'"), ["image_id", "ann_id"])
    return datasets.inter_items(ann, datasets.support_best(known, 1))


@query("class_histogram", "SELECT category_id, count(*) AS n, count(DISTINCT image_id) AS n_images, round(avg(area), 6) AS area FROM annotations GROUP BY 1", "annotations")
def _(s, d):
    return fx.annotations(s, d).groupBy("category_id").agg(F.count("*").alias("n"), F.countDistinct("image_id").alias("n_images"), r6(F.avg("area"), "area"))


# --- traces

PATHS = "pt AS (SELECT image_id, node_id, 0::BIGINT AS depth, [node_id] AS path, [reid_score] AS scores FROM trace WHERE parent_id IS NULL UNION ALL SELECT t.image_id, t.node_id, depth + 1, list_append(path, t.node_id), list_append(scores, t.reid_score) FROM pt JOIN trace t ON t.image_id = pt.image_id AND t.parent_id = pt.node_id)"
LEAVES = "lf AS (SELECT pt.* FROM pt WHERE NOT EXISTS (SELECT 1 FROM trace t WHERE t.image_id = pt.image_id AND t.parent_id = pt.node_id))"


@query("trace_paths", f"WITH {PATHS} SELECT image_id, node_id, depth, array_to_string(path, '.') AS path FROM pt", "trace", recursive=True)
def _(s, d):
    return traces.paths(fx.trace(s, d)).select("image_id", "node_id", "depth", F.concat_ws(".", F.col("path").cast("array<string>")).alias("path"))


KIND = """CASE WHEN len(sc) = 1 THEN 'single' WHEN list_max(sc) - sc[-1] > 0.001 THEN 'overshoot' WHEN stop = 'reid-stop' THEN 'peaked' WHEN stop IN ('zoom', 'empty') THEN 'truncated' WHEN sc[-1] >= sc[-2] - 0.001 THEN 'rising' ELSE 'peaked' END"""
CHAINS = f"{PATHS}, {LEAVES}, ff AS (SELECT image_id, parent_id AS f FROM trace WHERE parent_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 2), ch AS (SELECT lf.image_id, lf.node_id, t.kind AS stop, list_filter(lf.scores, lambda x, i: i > coalesce((SELECT max(list_position(lf.path, f)) FROM ff WHERE ff.image_id = lf.image_id AND list_contains(lf.path, f)), 0)) AS sc FROM lf JOIN trace t ON t.image_id = lf.image_id AND t.node_id = lf.node_id)"


@query("trace_leaf_summary", f"""WITH {PATHS}, {LEAVES} SELECT lf.image_id, lf.node_id, len(scores) - list_position(list_reverse(scores), list_max(scores)) AS peak_index, round(list_max(scores) - scores[-1], 6) AS overshoot, {KIND.replace('sc', 'scores').replace('scoresores', 'scores')} AS kind
FROM (SELECT lf.*, t.kind AS stop FROM lf JOIN trace t ON t.image_id = lf.image_id AND t.node_id = lf.node_id) lf""", "trace", recursive=True)
def _(s, d):
    return traces.summarize_chains(traces.ended_paths(fx.trace(s, d))).select("image_id", "node_id", "peak_index", r6("overshoot", "overshoot"), "kind")


@query("trace_segments", f"WITH {PATHS}, {LEAVES}, ff AS (SELECT image_id, parent_id AS f FROM trace WHERE parent_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 2), ex AS (SELECT image_id, node_id, unnest(path) AS f, generate_subscripts(path, 1) AS i FROM lf), lastf AS (SELECT image_id, node_id, max(i) AS i FROM ex JOIN ff USING (image_id, f) GROUP BY ALL), ch AS (SELECT lf.image_id, lf.node_id, scores[coalesce(i, 0) + 1:] AS sc FROM lf LEFT JOIN lastf USING (image_id, node_id)) SELECT image_id, node_id, len(sc) AS length, round(list_max(sc), 6) AS peak FROM ch", "trace", recursive=True)
def _(s, d):
    return traces.terminal_chains(fx.trace(s, d)).select("image_id", "node_id", F.size("scores").cast("long").alias("length"), r6(F.array_max("scores"), "peak"))


SEGMENTS = f"""kd AS (SELECT p.image_id, p.node_id, count(*) AS n FROM trace p JOIN trace t ON t.image_id = p.image_id AND t.parent_id = p.node_id GROUP BY ALL),
tr AS (SELECT t.image_id, t.node_id, t.kind, t.reid_score, kd.node_id AS parent_id, n FROM trace t LEFT JOIN kd ON kd.image_id = t.image_id AND kd.node_id = t.parent_id),
dp AS (SELECT image_id, node_id, 0::BIGINT AS depth FROM tr WHERE parent_id IS NULL UNION ALL SELECT tr.image_id, tr.node_id, depth + 1 FROM dp JOIN tr ON tr.image_id = dp.image_id AND tr.parent_id = dp.node_id),
sg AS (SELECT image_id, node_id AS head, node_id, kind AS stop, [reid_score] AS sc FROM tr WHERE n IS NULL OR n >= 2 UNION ALL SELECT tr.image_id, head, tr.node_id, kind, list_append(sc, reid_score) FROM sg JOIN tr ON tr.image_id = sg.image_id AND tr.parent_id = sg.node_id AND n = 1),
cs AS (SELECT image_id, head, stop, sc, len(sc) >= 2 AS multi, {KIND} AS kind, len(sc) - list_position(list_reverse(sc), list_max(sc)) AS peak, list_max(sc) - sc[-1] AS overshoot,
  len(list_filter(sc[2:], lambda x, i: CASE WHEN i < list_position(sc, list_max(sc)) THEN NOT x - sc[i] >= -0.001 ELSE NOT x - sc[i] <= 0.001 END)) = 0 OR len(sc) <= 2 AS uni FROM sg WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.image_id = sg.image_id AND tr.parent_id = sg.node_id AND n = 1))"""


@query("trajectory_report", f"""WITH {SEGMENTS}, ct AS (SELECT image_id, kind, count(*) AS n, count(*) FILTER (multi) AS n_multi, count(*) FILTER (multi AND uni) AS n_unimodal FROM cs GROUP BY CUBE (image_id, kind))
SELECT image_id, kind, n, n_multi, n_unimodal, CASE WHEN n_multi > 0 THEN round(n_unimodal / n_multi::DOUBLE, 6) END AS share, NULL::BIGINT AS head, NULL::BIGINT AS first_depth, NULL::BIGINT AS last_depth, NULL::VARCHAR AS stop, NULL::BIGINT AS peak_depth, NULL::DOUBLE AS overshoot, NULL::BOOLEAN AS is_unimodal, NULL::VARCHAR AS curve FROM ct
UNION ALL SELECT image_id, kind, NULL, NULL, NULL, NULL, head, depth, depth + len(sc) - 1, stop, depth + peak, round(overshoot, 6), uni, array_to_string(list_transform(sc, lambda x: printf('%.6f', x)), ' -> ') FROM cs JOIN dp USING (image_id) WHERE dp.node_id = head AND multi""", "trace", recursive=True)
def _(s, d):
    curve = F.concat_ws(" -> ", F.transform("scores", lambda x: F.format_string("%.6f", x)))
    out = traces.trajectory_report(fx.trace(s, d)).withColumn("curve", F.when(F.col("head").isNotNull(), curve)).drop("scores")
    return out.withColumn("share", F.round("share", 6)).withColumn("overshoot", F.round("overshoot", 6))


@query("survivors", """WITH k AS (SELECT t.image_id, t.node_id, t.reid_score AS s, p.reid_score AS ps, count(*) OVER w AS n, max(t.reid_score) OVER w AS best FROM trace t JOIN trace p ON p.image_id = t.image_id AND p.node_id = t.parent_id WINDOW w AS (PARTITION BY t.image_id, t.parent_id))
SELECT image_id, node_id FROM k WHERE CASE WHEN n = 1 THEN s > ps ELSE best > ps AND (s > ps OR s >= 0.5) END""", "trace")
def _(s, d):
    return traces.survivors(fx.trace(s, d), 0.5)


@query("zoom_diag", """WITH i AS (SELECT d.image_id, det_id, gt_id, (g.y1 - g.y0) * (g.x1 - g.x0) AS area, greatest(0, least(d.y1, g.y1) - greatest(d.y0, g.y0)) * greatest(0, least(d.x1, g.x1) - greatest(d.x0, g.x0)) AS inter FROM detections d JOIN gt g USING (image_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY image_id, det_id ORDER BY inter DESC, gt_id) AS k, count(*) FILTER (inter / area::DOUBLE >= 0.5) OVER (PARTITION BY image_id, det_id) AS held FROM i)
SELECT image_id, count(*) AS n, count(*) FILTER (inter / area::DOUBLE < 0.95) AS over, count(*) FILTER (held >= 2) AS under FROM b WHERE k = 1 AND inter > 0 GROUP BY 1""", "detections", "gt")
def _(s, d):
    return traces.zoom_diagnostics(fx.detections(s, d), fx.ground_truth(s, d))


@query("rise_fall", "WITH n AS (SELECT *, lead(reid_score) OVER (PARTITION BY image_id ORDER BY node_id) AS a FROM trace) SELECT image_id, round(avg(CASE WHEN node_id < 250 THEN (a > reid_score)::INT END), 6) AS rise, round(avg(CASE WHEN node_id >= 250 THEN (a < reid_score)::INT END), 6) AS fall FROM n WHERE a IS NOT NULL GROUP BY 1", "trace")
def _(s, d):
    return traces.rise_and_fall(fx.trace(s, d), 250).select("image_id", r6("rise", "rise"), r6("fall", "fall"))


@query("zoom_curve", "WITH x AS (SELECT node_id, (reid_score - min(reid_score) OVER w) / (max(reid_score) OVER w - min(reid_score) OVER w) AS x FROM trace WINDOW w AS (PARTITION BY image_id)) SELECT node_id, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x) / sqrt(count(*)), 6) AS sem FROM x GROUP BY 1", "trace")
def _(s, d):
    return traces.zoom_curve(fx.trace(s, d)).select("node_id", "n", r6("mean", "mean"), r6("sem", "sem"))


@query("crop_bins", "SELECT CASE WHEN r >= 4 THEN 'ge4x' WHEN r >= 2 THEN '2-4x' WHEN r >= 1 THEN '1-2x' WHEN r >= 0.5 THEN '0.5-1x' ELSE 'lt0.5x' END AS bin, count(*) AS n FROM (SELECT greatest(y1 - y0, x1 - x0) / 16.0 AS r FROM detections) GROUP BY 1", "detections")
def _(s, d):
    side = F.greatest(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    return fx.detections(s, d).groupBy(g.size_bin(side, 16.0).alias("bin")).agg(F.count("*").alias("n"))


# --- scores

@query("auroc", "WITH k AS (SELECT s, class_id = label AS p FROM (SELECT sim.*, pa.class_id AS label FROM sim JOIN patches pa USING (patch_id))), r AS (SELECT p, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0)::DOUBLE AS r FROM k), t AS (SELECT sum(r) FILTER (p) AS rs, count(*) FILTER (p) AS np, count(*) FILTER (NOT p) AS nn FROM r) SELECT round((rs - np * (np + 1) / 2.0::DOUBLE) / np / nn, 6) AS auroc FROM t", "sim")
def _(s, d):
    own = fx.patches(s, d).select("patch_id", F.col("class_id").alias("label"))
    return metrics.auroc(_sims(s, d).join(own, "patch_id").select(F.col("s").alias("score"), (F.col("class_id") == F.col("label")).alias("positive"))).select(r6("auroc", "auroc"))


@query("runtime_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(s, d):
    e = fx.table(s, d, "events")
    own = e.groupBy("event_type").agg(F.count("value").alias("n"), r6(F.avg("value"), "mean"), r6(F.stddev_pop("value"), "std"), F.round(F.sum("value"), 4).alias("total"))
    return own.join(metrics.exact_percentile(e, "event_type", "value", 0.5).select("event_type", r6("value", "median")), "event_type")


@query("sweep_grid", "SELECT concat_ws('_', 'base__stop.tau=' || a, 'merge.rule=' || b, 'seed=' || c) AS run_name, a AS tau, b AS rule, c AS seed FROM (VALUES ('0.5'), ('0.6')) x(a), (VALUES ('nms'), ('soft'), ('none')) y(b), (VALUES ('0')) z(c)")
def _(s, d):
    return sweeps.expand(s, "base", {"stop.tau": [0.5, 0.6], "merge.rule": ["nms", "soft", "none"], "seed": 0}).select("run_name", F.col("values")["stop.tau"].alias("tau"), F.col("values")["merge.rule"].alias("rule"), F.col("values")["seed"].alias("seed"))


# --- clustering kernels: properties are tested, labels can't be said in SQL

@query("kmeans_split")
def _(s, d):
    return clustering.per_image(fx.patches(s, d), lambda x, r, c: clustering.kmeans2(x), "side")


@query("agglomerative")
def _(s, d):
    return clustering.per_image(fx.patches(s, d), lambda x, r, c: clustering.average_linkage(x, 0.2, clustering.touching(r, c)), "region")


@query("cluster_all")
def _(s, d):
    return clustering.per_image(fx.patches(s, d), lambda x, r, c: clustering.average_linkage(x, 0.3), "cluster")


@query("farthest_points", """WITH u AS (SELECT image_id, patch_id, row_number() OVER (PARTITION BY image_id ORDER BY r, c) AS i, feat, sqrt(list_dot_product(feat, feat)) + 1e-8 AS n FROM patches),
d AS (SELECT a.image_id, a.i AS a, b.i AS b, 1 - list_dot_product(a.feat, b.feat) / (a.n * b.n) AS v FROM u a JOIN u b USING (image_id)),
w AS (SELECT DISTINCT image_id, 1 AS k, [1::BIGINT] AS chosen FROM u UNION ALL SELECT image_id, k + 1, list_append(chosen, arg_max(i, near)) FROM (
  SELECT w.image_id, w.k, w.chosen, d.b AS i, min(d.v) AS near FROM w JOIN d ON d.image_id = w.image_id AND list_contains(w.chosen, d.a) WHERE w.k < 10 GROUP BY w.image_id, w.k, w.chosen, d.b) GROUP BY image_id, k, chosen),
f AS (SELECT image_id, arg_max(chosen, k) AS chosen FROM w GROUP BY image_id) SELECT image_id, patch_id, coalesce(list_position(chosen, i), 0)::BIGINT AS rank FROM u JOIN f USING (image_id)""", "patches", recursive=True)
def _(s, d):
    def order(x, r, c):
        import numpy as np

        rank = np.zeros(len(x), dtype=int)
        for k, i in enumerate(clustering.farthest_points(x, 10)):
            rank[i] = k + 1
        return rank

    return clustering.per_image(fx.patches(s, d), order, "rank")


@query("watershed")
def _(s, d):
    def flood(x, r, c):
        import numpy as np

        grid = np.zeros((r.max() + 1, c.max() + 1))
        grid[r, c] = x @ x.mean(axis=0)
        return clustering.individuate(grid > np.median(grid), 1 - grid / grid.max())[r, c]

    return clustering.per_image(fx.patches(s, d), flood, "instance")


@query("gmm2_threshold")
def _(s, d):
    return thresholds.gmm2(_maps(s, d), "image_id")


def _scenes(s, d):
    """Each image's ground-truth boxes as squares of two colours."""
    gt = fx.ground_truth(s, d)
    return gt.select("image_id", F.lit(128).alias("height"), F.lit(128).alias("width"), F.col("gt_id").alias("ann_id"), (1 + F.col("gt_id") % 2).alias("category_id"), "y0", "y1", "x0", "x1")


@query("cascade_search")
def _(s, d):
    from . import cascade

    return cascade.search_squares(_scenes(s, d), 1)[0].drop("cells")


@query("cascade_oracle")
def _(s, d):
    from . import cascade, strategies

    found, trace = cascade.search_squares(_scenes(s, d), 1, settings=strategies.Settings(extractor="oracle", stop="oracle"))
    return cascade.stats(trace, found).withColumn("level_sizes", F.concat_ws(",", F.col("level_sizes").cast("array<string>")))


# --- extractors and instance filters

MATCHED = """fw AS (SELECT image_id, patch_id, max(s) AS forward FROM sim WHERE class_id = 0 GROUP BY 1, 2), bk AS (SELECT patch_id, class_id = 0 AS back FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY s DESC, ex_id) AS k FROM sim) WHERE k = 1),
mp AS (SELECT image_id, patch_id, forward FROM fw JOIN bk USING (patch_id) WHERE forward > 0 AND back)"""


@query("matched_patches", f"WITH {MATCHED} SELECT image_id, patch_id, round(forward, 6) AS forward FROM mp", "sim")
def _(s, d):
    return where.matched_patches(_sims(s, d), 0).select("image_id", "patch_id", r6("forward", "forward"))


@query("aggregated_foreground", f"""WITH {MATCHED}, ow AS (SELECT p.* FROM patches p WHERE EXISTS (SELECT 1 FROM mp JOIN patches q ON q.patch_id = mp.patch_id WHERE q.image_id = p.image_id AND q.class_id = p.class_id)),
l AS (SELECT image_id, class_id, unnest(feat) AS x, generate_subscripts(feat, 1) AS i FROM ow), m AS (SELECT image_id, class_id, i, avg(x) AS x FROM l GROUP BY ALL), pn AS (SELECT image_id, class_id, sqrt(sum(x * x)) + 1e-8 AS n FROM m GROUP BY ALL),
st AS (SELECT ow.image_id, ow.class_id, count(*) AS n, avg(fw.forward) AS crs FROM ow JOIN fw ON fw.patch_id = ow.patch_id GROUP BY ALL),
se AS (SELECT *, n / (sum(n) OVER (PARTITION BY image_id))::DOUBLE AS share, row_number() OVER (PARTITION BY image_id ORDER BY crs DESC, class_id) = 1 AS seed FROM st),
u AS (SELECT image_id, class_id, list(x / n ORDER BY i) AS p FROM m JOIN pn USING (image_id, class_id) GROUP BY ALL),
j AS (SELECT se.*, round(list_dot_product(u.p, sp.p), 9) AS intra FROM se JOIN u USING (image_id, class_id) JOIN (SELECT u.image_id, u.p FROM u JOIN se USING (image_id, class_id) WHERE seed) sp USING (image_id))
SELECT ow.image_id, ow.patch_id, ow.r, ow.c FROM ow JOIN j USING (image_id, class_id) WHERE j.seed OR crs * intra * share > 0.02""", "sim")  # fmt: skip
def _(s, d):
    return where.aggregated_foreground(fx.patches(s, d), _sims(s, d), 0, 0.02)


@query("filter_instances", f"WITH {MAPS}, f AS (SELECT p.image_id, p.class_id AS label, count(*) AS area, avg(s) AS score FROM patches p JOIN maps USING (patch_id) WHERE p.class_id > 0 GROUP BY 1, 2 HAVING count(*) >= 8 AND avg(s) >= 0) SELECT image_id, label, area, round(score, 6) AS score, row_number() OVER (PARTITION BY image_id ORDER BY label) AS instance FROM f", "sim")
def _(s, d):
    cells = fx.patches(s, d).select("image_id", "patch_id", F.col("class_id").alias("label")).join(_maps(s, d).select("patch_id", "s"), "patch_id")
    return where.filter_instances(cells, "label", "s", 8, 0.0).select("image_id", "label", "area", r6("score", "score"), "instance")


@query("mask_scores", f"WITH {MAPS} SELECT p.image_id, p.class_id, round(least(1, greatest(0, (avg(s) + 1) / 2)), 6) AS score FROM patches p JOIN maps USING (patch_id) GROUP BY 1, 2", "sim")
def _(s, d):
    return where.mask_scores(_maps(s, d), fx.patches(s, d).select("image_id", "r", "c", "class_id"), "class_id").select("image_id", "class_id", r6("score", "score"))


@query("component_scores", "WITH a AS (SELECT image_id, det_id, (y1 - y0) * (x1 - x0) AS area, y0 <= 0 OR x0 <= 0 AS border FROM detections) SELECT image_id, det_id, round(CASE WHEN border THEN 0.9 * area / max(area) OVER (PARTITION BY image_id)::DOUBLE ELSE 0.9 END, 6) AS score FROM a", "detections")
def _(s, d):
    parts = fx.detections(s, d).withColumn("area", g.area(g.box())).withColumn("score", F.lit(0.9))
    return where.component_scores(parts, (F.col("y0") <= 0) | (F.col("x0") <= 0)).select("image_id", "det_id", r6("score", "score"))


@query("take_ratio", "SELECT image_id, ann_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, ann_id) AS k, count(*) OVER (PARTITION BY image_id) AS n FROM annotations) WHERE k <= greatest(1, ceil(n * 0.3))", "annotations")
def _(s, d):
    return where.take_ratio(fx.annotations(s, d), 0.3).select("image_id", "ann_id")


@query("dynamic_cuts", "WITH t AS (SELECT image_id, avg(s) AS g FROM (SELECT image_id, ex_id, avg(s) AS s FROM sim WHERE class_id = 0 GROUP BY 1, 2) GROUP BY 1) SELECT image_id, round(greatest(0.05, least(0.95, 1 - g)), 6) AS tau, round(greatest(0.0, least(0.95, 0.5 * g)), 6) AS keep FROM t", "sim")
def _(s, d):
    return where.dynamic_cuts(_sims(s, d), 0).select("image_id", r6("tau", "tau"), r6("keep", "keep"))


@query("densest_images", "SELECT image_id, count(*) AS n FROM annotations GROUP BY 1 ORDER BY n DESC, image_id LIMIT 50", "annotations")
def _(s, d):
    counted = datasets.with_instances(fx.annotations(s, d), 1)
    return counted.orderBy(*datasets.image_order(counted, "densest")).limit(50)


@query("background_boxes", """WITH t AS (SELECT image_id, k, md5(concat_ws(':', image_id, k, 0)) AS h FROM (SELECT DISTINCT image_id FROM gt), range(0, 5) x(k)),
n AS (SELECT image_id, k, 16 + ('0x' || substr(h, 1, 6))::BIGINT % 17 AS side, ('0x' || substr(h, 7, 6))::BIGINT % 96 AS y0, ('0x' || substr(h, 13, 6))::BIGINT % 96 AS x0 FROM t),
b AS (SELECT image_id, k, y0, y0 + side AS y1, x0, x0 + side AS x1 FROM n)
SELECT b.image_id, b.k, b.y0, b.y1, b.x0, b.x1 FROM b JOIN gt g USING (image_id) GROUP BY ALL HAVING sum(greatest(0, least(b.y1, g.y1) - greatest(b.y0, g.y0)) * greatest(0, least(b.x1, g.x1) - greatest(b.x0, g.x0))) < 0.05 * (b.y1 - b.y0) * (b.x1 - b.x0)""", "gt")
def _(s, d):
    gt = fx.ground_truth(s, d)
    return where.background_boxes(gt.select("image_id").distinct(), gt, 5, 0)


@query("touches_border", "SELECT image_id, det_id, y0 <= 10 OR y1 >= 100 OR x0 <= 10 OR x1 >= 100 AS touches FROM detections", "detections")
def _(s, d):
    crop = (F.lit(10), F.lit(100), F.lit(10), F.lit(100))
    return fx.detections(s, d).select("image_id", "det_id", g.touches(g.box(), crop).alias("touches"))


from . import matchers  # noqa: E402,F401  registers its queries
