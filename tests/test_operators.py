"""Hand-derived facts about single operators on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import arrays as a
from siltstone.functions import geometry as g
from siltstone.operators import clustering, datasets, grids, masks, matching, metrics, suppress, thresholds, traces, vectors
from siltstone.operators.graph import components
from siltstone.plans import cascade, sweeps
from siltstone.plans import strategies as st
from siltstone.sources import coco, synthetic

BOX = "image_id long, det_id long, y0 long, y1 long, x0 long, x1 long, score double"
GT = "image_id long, gt_id long, y0 long, y1 long, x0 long, x1 long"


def dets(spark, *boxes):
    return spark.createDataFrame([(1, i, *b) for i, b in enumerate(boxes)], BOX)


def truths(spark, *boxes):
    return spark.createDataFrame([(1, i, *b) for i, b in enumerate(boxes)], GT)


def test_perfect_detections_score_one(spark):
    boxes = [(0, 10, 0, 10), (20, 40, 20, 40)]
    d, t = dets(spark, *[(*b, 0.9) for b in boxes]), truths(spark, *boxes)
    assert [r.ap for r in metrics.coco_ap(d, t).collect()] == pytest.approx([1.0] * 10)
    p = metrics.panoptic(d, t).first()
    assert (p.tp, p.fp, p.fn, p.pq, p.recovery, p.count_abs) == (2, 0, 0, 1.0, 1.0, 0.0)


def test_a_loose_box_has_iou_a_quarter_and_no_ap(spark):
    d, t = dets(spark, (0, 20, 0, 20, 0.9)), truths(spark, (0, 10, 0, 10))
    assert matching.tiled_pairs(d, t).first().iou == 0.25
    assert metrics.coco_ap(d, t, [0.5]).first().ap == 0.0


def test_ties_of_iou_go_to_the_last_truth(spark):
    d, t = dets(spark, (0, 10, 0, 10, 0.9)), truths(spark, (0, 10, 0, 10), (0, 10, 0, 10))
    assert matching.greedy_match(matching.tiled_pairs(d, t)).first().gt_id == 1


def test_outcomes_of_predictions(spark):
    d = dets(spark, (10, 30, 10, 30, 0.9), (10, 30, 10, 28, 0.8), (10, 18, 10, 18, 0.7), (0, 5, 0, 5, 0.6))
    out = matching.prediction_outcomes(d, matching.tiled_pairs(d, truths(spark, (10, 30, 10, 30))))
    assert [r.outcome for r in out.orderBy("det_id").collect()] == ["matched", "duplicate", "partial", "background"]


def test_nested_boxes_are_suppressed_and_far_ones_stay(spark):
    d = dets(spark, (2, 22, 2, 22, 0.9), (7, 17, 7, 17, 0.8), (0, 4, 20, 24, 0.7))
    assert sorted(r.det_id for r in suppress.nms(d, 0.5, 0.8).collect()) == [0, 2]


def test_half_overlap_is_decayed_but_kept(spark):
    d = dets(spark, (0, 20, 0, 15, 0.9), (0, 20, 5, 20, 0.8))
    assert [r.det_id for r in suppress.nms(d, 0.5, 0.9).collect()] == [0]
    soft = {r.det_id: r.score for r in suppress.soft_nms(d, 0.5, 0.0, 0.9).collect()}
    assert soft[0] == 0.9 and soft[1] == pytest.approx(0.8 * np.exp(-((2 / 3) ** 2) / 0.5))


def test_tiled_pairs_are_all_overlapping_pairs(spark):
    rng = np.random.default_rng(1)
    box = lambda: (lambda y, x, h, w: (y, y + h, x, x + w))(*(int(v) for v in rng.integers(1, 60, 4)))
    d, t = dets(spark, *[(*box(), 0.5) for _ in range(60)]), truths(spark, *[box() for _ in range(40)])
    side = lambda p, q, i: max(0, min(p[i + 1], q[i + 1]) - max(p[i], q[i]))
    area = lambda p: (p[1] - p[0]) * (p[3] - p[2])
    want = {}
    for p in d.collect():
        for q in t.collect():
            inter = side(p[2:6], q[2:6], 0) * side(p[2:6], q[2:6], 2)
            if inter:
                want[p.det_id, q.gt_id] = inter, pytest.approx(inter / (area(p[2:6]) + area(q[2:6]) - inter))
    for tile in (16, 64):
        assert {(r.det_id, r.gt_id): (r.inter, r.iou) for r in matching.tiled_pairs(d, t, tile).collect()} == want
    assert {(r.det_id, r.gt_id) for r in matching.tiled_pairs(d, t, least=0.25).collect()} == {k for k, (_, v) in want.items() if v.expected >= 0.25}


def test_mask_and_box_overlaps_agree_on_rectangles(spark):
    d, t = dets(spark, (0, 10, 0, 10, 0.9)), truths(spark, (5, 15, 0, 10))
    m = masks.overlaps(masks.box_runs(d, "det_id"), masks.box_runs(t, "gt_id"), "det_id", "gt_id").first()
    assert (m.inter, round(m.iou, 6), m.containment) == (50, round(1 / 3, 6), 0.5)
    assert masks.union_iou(masks.box_runs(d, "det_id"), masks.box_runs(t, "gt_id")).first().iou == pytest.approx(1 / 3)


def test_diagonal_blobs_join_only_by_eight(spark):
    cells = [(1, r, c) for r in (1, 2) for c in (1, 2)] + [(1, r, c) for r in (3, 4) for c in (3, 4)]
    df = spark.createDataFrame(cells, "image_id long, r long, c long")
    count = lambda k: grids.connected(df, 6, k).select("component").distinct().count()
    assert (count(4), count(8)) == (2, 1)


def test_hysteresis_keeps_the_rim_and_drops_the_detached(spark):
    rows = [(1, r, c, 0.9 if (r, c) == (3, 3) else 0.6) for r in (2, 3, 4) for c in (2, 3, 4)] + [(1, 0, 6, 0.6)]
    df = spark.createDataFrame(rows, "image_id long, r long, c long, s double")
    assert grids.hysteresis(df, 7, F.col("s") >= 0.5, F.col("s") >= 0.8).count() == 9


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(1, i, i + 1) for i in range(60)] + [(2, 5, 9)], "image_id long, a long, b long")
    got = {(r.image_id, r.node): r.root for r in components(e).collect()}
    assert set(got.values()) == {0, 5} and len(got) == 63


def test_centres_of_eight_cells_in_64_columns(spark):
    df = spark.range(8).select(grids.sample_index(F.col("id"), 64, 8).alias("i"))
    assert [r.i for r in df.collect()] == [4, 12, 20, 28, 36, 44, 52, 60]


@pytest.mark.parametrize("parent, kids, floor, kept", [(0.85, [0.90, 0.62], 0.5, [0, 1]), (0.081, [0.154, 0.05], 0.3, [0]), (0.9, [0.9, 0.9], 0.5, []), (0.5, [0.6], 0.5, [0]), (0.5, [0.5], 0.1, [])])
def test_survivors(spark, parent, kids, floor, kept):
    rows = [(1, 100, None, "zoom", parent)] + [(1, i, 100, "zoom", s) for i, s in enumerate(kids)]
    t = spark.createDataFrame(rows, "image_id long, node_id long, parent_id long, kind string, reid_score double")
    assert sorted(r.node_id for r in traces.survivors(t, floor).collect()) == kept


@pytest.mark.parametrize("scores, stop, kind, one_peak", [([0.40, 0.55, 0.70], "leaf", "rising", True), ([0.40, 0.72, 0.60], "leaf", "overshoot", True), ([0.4, 0.7, 0.5, 0.65], "leaf", "overshoot", False), ([0.3], "leaf", "single", True), ([0.4, 0.6], "reid-stop", "peaked", True), ([0.4, 0.6], "zoom", "truncated", True)])
def test_chains(spark, scores, stop, kind, one_peak):
    df = spark.createDataFrame([(scores, stop)], "scores array<double>, stop string")
    r = traces.summarize_chains(df).first()
    assert (r.kind, r.is_unimodal) == (kind, one_peak)


def test_report_is_of_segments_not_of_whole_paths(spark):
    """1 - 2 (a fork) - 3 - 5 - 6 and 4; 8 and 9 under 7, which is not there."""
    rows = [(1, None, "zoom", 0.4), (2, 1, "split", 0.6), (3, 2, "zoom", 0.3), (4, 2, "leaf", 0.1), (5, 3, "zoom", 0.5), (6, 5, "leaf", 0.4), (8, 7, "zoom", 0.2), (9, 8, "leaf", 0.3)]
    t = spark.createDataFrame([(1, *r) for r in rows], "image_id long, node_id long, parent_id long, kind string, reid_score double")
    got = traces.trajectory_report(t).collect()
    lines = {r.head: (r.kind, r.first_depth, r.last_depth, r.stop, r.peak_depth, round(r.overshoot, 6), r.is_unimodal, r.scores) for r in got if r.head}
    assert lines == {
        1: ("rising", 0, 1, "split", 1, 0.0, True, [0.4, 0.6]), 3: ("overshoot", 2, 4, "leaf", 3, 0.1, True, [0.3, 0.5, 0.4]),
        8: ("rising", 0, 1, "leaf", 1, 0.0, True, [0.2, 0.3]),
    }
    counts = {r.kind: (r.n, r.n_multi, r.n_unimodal, r.share) for r in got if not r.head and r.image_id == 1}
    assert counts == {None: (4, 3, 3, 1.0), "rising": (2, 2, 2, 1.0), "overshoot": (1, 1, 1, 1.0), "single": (1, 0, 0, None)}
    assert {r.kind: r.n for r in got if not r.head and r.image_id is None} == {k: v[0] for k, v in counts.items()}


def test_a_flat_chain_peaks_at_its_end(spark):
    r = traces.summarize_chains(spark.createDataFrame([([0.5, 0.5, 0.5], "leaf")], "scores array<double>, stop string")).first()
    assert r.peak_index == 2 and r.overshoot == 0


def test_thresholds_part_two_heaps(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0.1, 0.02, 500), rng.normal(0.9, 0.02, 500)])
    df = spark.createDataFrame([(1, float(v)) for v in x], "image_id long, s double")
    tau = thresholds.otsu(df, ["image_id"]).first().tau
    assert 0.12 < tau < 0.88 and 0.12 < thresholds.gmm2_threshold(x) < 0.88
    assert thresholds.separability(df, thresholds.otsu(df, ["image_id"]), ["image_id"]).first().eta > 0.9
    one = spark.createDataFrame([(1, float(v)) for v in rng.normal(0.8, 0.02, 500)], "image_id long, s double")
    assert thresholds.separability(one, thresholds.otsu(one, ["image_id"]), ["image_id"]).first().eta < 0.75


def test_equal_values_are_their_own_threshold(spark):
    df = spark.createDataFrame([(1, 0.5)] * 4, "image_id long, s double")
    assert thresholds.otsu(df, ["image_id"]).first().tau == 0.5


@pytest.mark.parametrize("k, want", [(0, 0.4667), (1, 0.8), (2, 0.7), (9, 0.4667)])
def test_reid_means_over_the_best_exemplars(spark, k, want):
    ex = spark.createDataFrame([(0, i, [float(i == j) for j in range(3)]) for i in range(3)], "class_id long, ex_id long, feat array<double>")
    p = spark.createDataFrame([(1, 7, 0, 0, 0, [0.8, 0.6, 0.0])], "image_id long, patch_id long, r long, c long, class_id long, feat array<double>")
    assert vectors.reid_scores(vectors.similarities(p, ex), k).first().g == pytest.approx(want, abs=1e-4)


def test_a_bank_over_the_bound_is_joined_in_blocks(spark, monkeypatch):
    ex = spark.createDataFrame([(0, i, [float(i), 1.0]) for i in range(9)], "class_id long, ex_id long, feat array<double>")
    p = spark.createDataFrame([(1, j, 0, j, 0, [1.0, float(j)]) for j in range(5)], "image_id long, patch_id long, r long, c long, class_id long, feat array<double>")
    key = lambda df: sorted((r.patch_id, r.ex_id, r.s) for r in df.collect())
    whole = key(vectors.similarities(p, ex))
    monkeypatch.setattr(vectors, "BANK_NUMBERS", 4)
    assert key(vectors.similarities(p, ex)) == whole and len(whole) == 45


def test_projection_leaves_nothing_along_the_basis(spark):
    basis = [[0.5] * 4, [0.5, -0.5, 0.5, -0.5]]
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 9.0],)], "f array<double>").select(a.project_out(F.col("f"), basis).alias("f"))
    f = np.array(df.first().f)
    assert np.abs(np.array(basis) @ f).max() < 1e-6 and np.linalg.norm(f) == pytest.approx(1)


def test_clustering_kernels():
    x = np.array([[1, 0.0]] * 3 + [[0, 1.0]] * 3)
    assert clustering.average_linkage(x, 0.6).tolist() == [1, 1, 1, 2, 2, 2]
    assert clustering.average_linkage(x, 0.6, {(0, 1), (2, 3)}).tolist() == [1, 1, 2, 3, 4, 5]
    assert clustering.kmeans2(x).tolist() == [0, 0, 0, 1, 1, 1] and clustering.kmeans2(x[:3]).tolist() == [0, 0, 0]
    assert clustering.farthest_points(x, 2) == [0, 3]
    assert sorted(np.round(clustering.spherical_kmeans(x, 2), 6).tolist()) in ([[0, 1], [1, 0]], [[0.0, 1.0], [0.0, 1.0]], [[1.0, 0.0], [1.0, 0.0]])
    m = np.zeros((9, 20), bool)
    m[1:8, 1:8] = m[1:8, 11:18] = m[4, 8:11] = True
    assert clustering.distance_transform(m)[4, 4] == 4
    got = clustering.individuate(m, np.zeros(m.shape))
    assert got[4, 4] != got[4, 14] and (got[m] > 0).all() and (got[~m] == 0).all()


def test_splits_are_whole_and_disjoint(spark):
    ann = spark.createDataFrame([(i, j, 1 + j % 2, 1.0) for i in range(4) for j in range(5)], "image_id long, ann_id long, category_id long, area double")
    rows = datasets.pu_split(ann, 0.5).collect()
    assert len(rows) == 20 and all(sum(r.part == "known" and r.image_id == i for r in rows) == 3 for i in range(4))
    p = datasets.pools(datasets.with_instances(ann, 1), 1, -1).collect()
    assert sorted(r.pool for r in p) == ["inter"] * 3 + ["train"]
    assert datasets.recommended_min_instances(0.5, 5) == 4
    with pytest.raises(ValueError):
        datasets.image_order(ann, "best")


def test_boxes(spark):
    one = spark.range(1)
    b = tuple(F.lit(v) for v in (40, 60, 40, 60))
    pad = g.padded(b, 0.08, F.lit(100), F.lit(100))
    assert list(one.select(*pad).first()) == [39, 61, 39, 61]
    cells = tuple(F.lit(v) for v in (4, 6, 4, 6))
    kid = g.child_box(cells, tuple(F.lit(v) for v in (0, 100, 0, 100)), 10, 0.0, 1.0)
    assert list(one.select(*kid).first()) == [30, 70, 30, 70]


def test_a_coco_file(spark, tmp_path):
    import json

    doc = {
        "images": [{"id": 10, "height": 8, "width": 8, "coco_url": "http://x/y/a.jpg", "not_exhaustive_category_ids": [2]}, {"id": 9, "height": 8, "width": 8, "file_name": "b.jpg"}],
        "annotations": [
            {"id": 1, "image_id": 10, "category_id": 1, "area": 4, "bbox": [1, 1, 2, 2]}, {"id": 2, "image_id": 10, "category_id": 2, "area": 9, "iscrowd": 0, "bbox": [0, 0, 3, 3], "segmentation": [[0, 0, 4, 0, 4, 4, 0, 4]]},
            {"id": 3, "image_id": 10, "category_id": 1, "iscrowd": 1, "bbox": [0, 0, 1, 1]}, {"id": 4, "image_id": 9, "category_id": 1, "bbox": [0, 0, 1, 1], "segmentation": {"size": [8, 8], "counts": [8, 3, 53]}},
        ],
        "categories": [{"id": 1, "name": "cat"}, {"id": 2, "name": "dog"}],
    }
    p = tmp_path / "a.json"
    p.write_text(json.dumps(doc))
    d = coco.read(spark, str(p))
    im, an = coco.images(d), coco.annotations(d)
    assert [r.file_name for r in im.orderBy("order").collect()] == ["b.jpg", "a.jpg"]
    assert sorted(r.ann_id for r in an.collect()) == [1, 2, 4]
    assert sorted(r.ann_id for r in coco.exhaustive(an, im).collect()) == [1, 4]
    area = {r.ann_id: r.area for r in masks.areas(coco.masks(an, im), "ann_id").collect()}
    assert area == {1: 4, 2: 16, 4: 3}
    assert coco.category_ids(d, ["dog", 1]) == [2, 1] and coco.category_ids(d, []) == [1, 2]
    with pytest.raises(ValueError):
        coco.category_ids(d, ["cow"])


def test_arrays_are_read_as_runs(spark, tmp_path):
    m = np.zeros((2, 4, 4, 6), np.int32)
    m[0, 1:3, 1:3, 0], m[1, 0, :, 2] = 7, 3
    np.save(tmp_path / "masks.npy", m)
    synthetic.enable(spark)
    rows = spark.read.format("array_masks").option("path", str(tmp_path)).load().collect()
    assert sorted((r.image_id, r.ann_id, r.y, r.xs, r.xe) for r in rows) == [("0_0", 7, 1, 1, 3), ("0_0", 7, 2, 1, 3), ("0_1", 2_000_003, 0, 0, 4)]
    with pytest.raises(KeyError):
        synthetic.source("none")


def scenes_table(spark, images):
    rows = [(i, 128, 128, k, *q) for i, squares in images.items() for k, q in enumerate(squares)]
    return spark.createDataFrame(rows, "image_id long, height int, width int, ann_id int, category_id int, y0 int, y1 int, x0 int, x1 int")


def random_scenes(n, seed=0):
    return {i: [tuple(r[1:]) for r in synthetic.scene(i, seed, 128, 3 + i % 4, 2)] for i in range(n)}


def spelled_search(row, see, settings):
    """One image's search with lists: (detections as crop, depth, score, cells) and (region, decision)."""
    rule = st.build_stop(settings.stop)
    floor, found, trace = rule.least(settings), [], []
    level, spent = [{"region": "0", "box": (0, row["height"], 0, row["width"]), "depth": 0, "parent": None, "seed": None}], 1

    def emit(r, cells, score):
        area = int(cascade.pixels(cells, r["box"]).sum())
        if area >= settings.least_area:
            found.append((*r["box"], r["depth"], round(score, 9), cascade.packed(cells)))

    def settle(p):
        trace.append((p["region"], "reid-stop"))
        if p["signal"] < floor:
            return
        if settings.emit_components:
            for c in p["tight"]:
                emit(p, cascade.unpacked(c["cells"]), c["score"])
        else:
            emit(p, np.logical_or.reduce([cascade.unpacked(c["cells"]) for c in p["tight"]]), p["score"])

    while level and spent < settings.budget:
        spent += len(level)
        for r in level:
            p = r["parent"]
            r.update(cascade.look(see, rule, row, r["box"], r["seed"], p and p["box"], settings))
        going = [r for r in level if r["parent"] is None]
        families = {}
        for r in level:
            if r["parent"]:
                families.setdefault(r["parent"]["region"], []).append(r)
        for own in families.values():
            keep = set(st.survivors(own[0]["parent"]["signal"], [r["signal"] for r in own], floor))
            p = own[0]["parent"]
            trace += [(r["region"], "below-floor" if keep else "reid-worse") for i, r in enumerate(own) if i not in keep]
            if keep:
                trace.append((p["region"], p["decision"]))
                going += [r for i, r in enumerate(own) if i in keep]
            else:
                settle(p)
        level = []
        for r in going:
            kids, cells = r["child"], lambda c: cascade.unpacked(c["cells"])
            r["tight"] = [c for c in kids if not c["stuck"]]
            if not kids:
                trace.append((r["region"], "empty"))
            elif r["small"] or not r["fixed"] and not r["tight"]:
                trace.append((r["region"], "leaf-cap"))
                for c in kids:
                    emit(r, cells(c), r["score"])
            elif r["fixed"]:
                trace.append((r["region"], "leaf"))
                emit(r, cells(kids[0]), r["score"])
            else:
                for c in kids:
                    if c["stuck"]:
                        emit(r, cells(c), r["score"])
                r["decision"] = "zoom" if len(r["tight"]) == 1 else "split"
                for i, c in enumerate(r["tight"]):
                    level.append({"region": f"{r['region']}.{i + 1}", "box": (c["y0"], c["y1"], c["x0"], c["x1"]), "depth": r["depth"] + 1, "parent": r, "seed": c["cells"]})
    for p in {id(r["parent"]): r["parent"] for r in level if r["parent"]}.values():
        settle(p)
    return sorted(found), sorted(trace)


@pytest.mark.parametrize("changes", [{}, {"budget": 9}, {"stop": "oracle", "extractor": "oracle"}, {"grouping": "kmeans", "shrink": 0.8, "emit_components": False}, {"where": "oracle_cc", "extractor": "composite", "least_area": 60, "pad": 0.1}])
def test_search_by_brute_force(spark, changes):
    settings = st.Settings(where="bank", grouping="cc").with_(**changes)
    images = random_scenes(12) | {100: []}
    images[100] = [(2, 5, 40, 5, 40)]
    see = cascade.see_squares(1, settings=settings)
    found, trace = cascade.search_squares(scenes_table(spark, images), 1, settings=settings)
    got, steps = {}, {}
    for r in found.collect():
        got.setdefault(r.image_id, []).append((r.y0, r.y1, r.x0, r.x1, r.depth, round(r.score, 9), bytes(r.cells)))
    for r in trace.collect():
        steps.setdefault(r.image_id, []).append((r.region, r.decision))
    for i, squares in images.items():
        row = {"height": 128, "width": 128, "squares": [dict(zip(("category_id", "y0", "y1", "x0", "x1"), q)) for q in squares]}
        want, decisions = spelled_search(row, see, settings)
        assert sorted(got.get(i, [])) == want and sorted(steps[i]) == decisions


def test_an_image_is_searched_alike_alone_and_among_others(spark):
    settings = st.Settings(where="bank", grouping="cc", budget=20)
    images = random_scenes(30, 3)
    key = lambda f, i: sorted((r.y0, r.y1, r.x0, r.x1, r.score) for r in f.collect() if r.image_id == i)
    all_, trace = cascade.search_squares(scenes_table(spark, images), 1, settings=settings)
    one, _ = cascade.search_squares(scenes_table(spark, {7: images[7]}), 1, settings=settings)
    assert key(all_, 7) == key(one, 7) and len({r.image_id for r in all_.collect()}) > 20
    cost = {r.image_id: r for r in cascade.stats(trace, all_).collect()}
    assert len(cost) == 30 and all(r.n_embeds == sum(r.level_sizes) + 1 and len(r.level_sizes) == r.max_depth + 1 for r in cost.values())


def test_search_finds_both_squares_and_not_the_other_colour(spark):
    scenes = scenes_table(spark, {1: [(1, 20, 40, 20, 40), (1, 80, 100, 80, 100), (2, 20, 40, 80, 100)]})
    found, trace = cascade.search_squares(scenes, 1)
    boxes = sorted((r.y0, r.y1, r.x0, r.x1) for r in found.collect())
    assert len(boxes) == 2 and all(abs(u - v) <= 4 for b, w in zip(boxes, [(20, 40, 20, 40), (80, 100, 80, 100)]) for u, v in zip(b, w))
    assert {r.decision for r in trace.collect()} >= {"split"}
    area = {r.det_id: r.area for r in masks.areas(cascade.mask_runs(found), "det_id").collect()}
    assert area == {r.det_id: r.area for r in found.collect()}


def test_strategies_and_their_names(spark):
    x = np.zeros((8, 8, 3))
    x[..., 2] = 1
    x[1:3, 1:3] = (1, 0, 0)
    x[5:7, 4:7] = (1, 0, 0)
    labels = np.zeros((8, 8), int)
    labels[1:3, 1:3], labels[5:7, 4:7] = 1, 2
    crop, bank = st.Crop(x, (0, 8, 0, 8), labels), st.Bank(np.array([[1.0, 0, 0], [0, 0, 1.0]]), np.arange(2), np.array([True, False]))
    for where in ("bank", "otsu", "gmm2", "matched", "oracle"):
        region, _ = st.WHERE[where](crop, bank, st.Settings(tau=None))
        assert (region == (labels > 0)).all(), where
        for grouping in ("cc", "none", "kmeans", "agglomerative", "watershed"):
            got = st.build_extractor(st.Settings(where=where, grouping=grouping))(crop, bank)
            assert (st.label_map(got.instances, crop.shape) == labels).all(), (where, grouping)
    assert len(st.build_extractor(st.Settings(extractor="oracle"))(crop, bank).instances) == 2
    assert st.extractor_name(st.Settings(where="oracle_cc")) == st.extractor_name(st.Settings(grouping="oracle")) == "oracle" and st.extractor_name(st.Settings()) == "composite"
    side = np.zeros((8, 8), int)
    side[2:6, 0:4], side[2:6, 4:8] = 1, 2
    apart, _ = st.WHERE["oracle_cc"](st.Crop(x, (0, 8, 0, 8), side), bank, st.Settings())
    assert clustering.label_cells(apart).max() == 2 and not apart[3, 3] and not apart[3, 4]
    two = np.zeros((8, 8, 2))
    two[:, :4], two[:, 4:] = (1, 0), (0, 1)
    whole = np.ones((8, 8), bool)
    for grouping in ("kmeans", "agglomerative", "watershed"):
        assert len(st.GROUPING[grouping](st.Crop(two, (0, 8, 0, 8)), whole, st.Settings())) == 2, grouping
    box = st.Crop(x, (1, 3, 1, 3), labels)
    assert st.isolation(box, labels, st.Settings()) == 1 and st.isolation(box, labels, st.Settings(isolation="mask")) == 1 and st.isolation(st.Crop(x, (0, 1, 7, 8), labels), labels, st.Settings(isolation_select="center")) == 0
    assert st.on_grid(np.eye(9, dtype=bool), (3, 3), "any").sum() == 3 and st.reid(crop, bank) == pytest.approx(10 / 64) and st.reid(crop, bank, labels > 0) == 1
    for kind, name in ((st.WHERE, "x"), (st.STOP, "x"), (st.METHODS, "x")):
        with pytest.raises(ValueError):
            st.chosen(kind, name, "part")
    for f in (lambda: st.build_merge("x"), lambda: st.build_backbone({"type": "dino"}), lambda: st.build_method({"method": {"type": "x"}}), lambda: crop.__class__(x, (0, 8, 0, 8)).truth()):
        with pytest.raises(ValueError):
            f()
    found = st.build_method({"method": {"target": 1}})(scenes_table(spark, {1: [(1, 20, 40, 20, 40)]})).collect()
    assert len(found) == 1


def test_references_and_banks(spark):
    image, m = two_squares(), np.zeros((128, 128), bool)
    m[20:40, 20:40] = True
    images, kept = st.normalize_reference(image, [m, np.zeros_like(m), m])
    assert len(images) == len(kept) == 2
    for bad in (lambda: st.normalize_reference([image, image], [m]), lambda: st.normalize_reference(image, [~m & m])):
        with pytest.raises(ValueError):
            bad()
    from siltstone.operators.backbone import MockBackbone, Remembered

    b = Remembered(MockBackbone())
    sizes = {r: len(st.build_bank(b, image, [m, m], r, 10, 1, 3).vectors) for r in ("all", "mean", "cluster", "kmeans")}
    assert sizes["mean"] == 2 and sizes["all"] == 10 and sizes["cluster"] == 6 and sizes["kmeans"] == 10 and len(b.known) == 1
    with pytest.raises(ValueError):
        clustering.reduced([np.eye(2)], "x")
    rows = [(1, e, 10 * e + k, [float(e), float(k), 1.0]) for e in (1, 2) for k in range(6)]
    df = spark.createDataFrame(rows, "class_id long, ex_id long, patch_id long, feat array<double>")
    assert clustering.bank(df, "mean").count() == 2 and clustering.bank(df, "all", 100).count() == 12 and clustering.bank(df, "all", 5).count() == 5 and clustering.bank(df, "kmeans", 7).count() == 7
    x = np.array([r[3] for r in rows])
    chosen = {tuple(np.round(r.feat, 6)) for r in clustering.bank(df, "all", 5).collect()}
    assert chosen == {tuple(np.round(x[i], 6)) for i in clustering.farthest_points(x, 5)}


def test_markers_and_basins():
    m = np.zeros((9, 20), bool)
    m[1:8, 1:8] = m[1:8, 11:18] = m[4, 8:11] = True
    d = clustering.distance_transform(np.pad(m, 1))[1:-1, 1:-1]
    atoms = np.zeros(m.shape, int)
    atoms[m] = 1
    assert clustering.markers(m, d, atoms, "geometric", 2).max() >= 2 and clustering.markers(m, d, atoms, "feature", 2).max() == 1
    assert clustering.markers(m, d, atoms, "hybrid", 2).max() >= 2 and clustering.markers(m, d * 0, None, "geometric", 1).max() == 1
    with pytest.raises(ValueError):
        clustering.markers(m, d, atoms, "x", 1)
    x = np.zeros((4, 4, 2))
    x[:, :2], x[:, 2:] = (1, 0), (0, 1)
    labels = np.array([[1, 2, 3, 3]] * 4)
    assert clustering.merge_basins(x, labels, np.zeros((4, 4)), 0.6, 0.5).tolist() == [[1, 1, 2, 2]] * 4
    assert clustering.merge_basins(x, labels, np.ones((4, 4)), 0.6, 0.5).max() == 3


def test_masks_that_boxes_would_mistake(spark):
    """Two L shapes with the same box: one is not the other's copy, but half of each is in the frame of both."""
    runs = [(1, 1, y, 0, 2) for y in range(10)] + [(1, 2, y, 8, 10) for y in range(10)] + [(1, 2, 9, 2, 8), (1, 1, 0, 2, 8)]
    r = spark.createDataFrame(runs, "image_id long, det_id long, y long, xs long, xe long")
    d = dets(spark, (0, 10, 0, 10, 0.9), (0, 10, 0, 10, 0.8)).withColumn("det_id", F.col("det_id") + 1)
    assert suppress.nms(d).count() == 1 and suppress.nms(d, pairs=suppress.mask_overlaps(r)).count() == 2
    assert suppress.mask_overlaps(r).count() == 0
    partial = d.filter("det_id = 1").select("image_id", "det_id")
    assert suppress.mask_fragment_pairs(r, partial, 0).count() == 0 and suppress.mask_fragment_pairs(r, partial, 1).count() == 1
    one = suppress.merge_fragments(d, suppress.mask_fragment_pairs(r, partial, 1), r).collect()
    assert len(one) == 1 and one[0].det_id == 1 and one[0].pieces == 2 and suppress.merge_detections(d.withColumn("partial", F.lit(True)), "fragments").count() == 1
    crop = d.withColumn("crop", F.expr("named_struct('y0', 0, 'y1', 10, 'x0', 0, 'x1', 9)")).withColumn("height", F.lit(10)).withColumn("width", F.lit(20))
    assert [x.det_id for x in suppress.drop_clipped_masks(crop, r).collect()] == [1] and suppress.mask_edges(r, crop, False).count() == 2


def test_exact_percentiles_and_auroc_by_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i % 3), float(v)) for i, v in enumerate(np.round(rng.normal(size=999), 2))]
    df = spark.createDataFrame(rows, "k long, v double")
    for share in (0.0, 0.1, 0.5, 0.99, 1.0):
        got = {r.k: r.value for r in metrics.exact_percentile(df, "k", "v", share).collect()}
        assert all(got[k] == pytest.approx(np.quantile([v for j, v in rows if j == k], share)) for k in range(3))
    pairs = [(v, k == 0) for k, v in rows]
    want = np.mean([(p > n) + 0.5 * (p == n) for p, a in pairs if a for n, b in pairs if not b])
    assert metrics.auroc(spark.createDataFrame(pairs, "score double, positive boolean")).first().auroc == pytest.approx(want)


def test_datasets_keep_what_is_not_named(spark):
    ann = spark.createDataFrame([(1, 1, 5, 1.0), (1, 2, 5, 2.0), (2, 1, 6, 1.0)], "image_id long, ann_id long, category_id long, area double")
    images = spark.createDataFrame([(1, 10, 10), (2, 20, 10), (3, 5, 5)], "image_id long, height long, width long")
    assert {r.image_id: r.class_id for r in datasets.filtered(images, ann, [6]).collect()} == {1: None, 2: 1, 3: None}
    split = spark.createDataFrame([(1, 1, "known")], "image_id long, ann_id long, part string")
    assert [(r.n_exemplars, r.n_gt) for r in datasets.intra_items(ann, split, 3).collect()] == [(1, 2)]
    got = {r.image_id: (r.n_known, r.n_unknown) for r in datasets.samples(images, ann, split).collect()}
    assert got == {1: (1, 1), 2: (0, 1), 3: (0, 0)}
    with pytest.raises(ValueError):
        datasets.pools(datasets.with_instances(ann, 1), 2, 1)
    with pytest.raises(ValueError):
        datasets.some(ann.limit(0), "image")
    assert {(r.category_id, r.image_id, r.ann_id) for r in datasets.largest_exemplar(ann, images).collect()} == {(5, 1, 2), (6, 2, 1)}


def test_compressed_run_lengths():
    def text(counts):
        out = ""
        for i, c in enumerate(counts):
            x, more = c - (counts[i - 2] if i > 2 else 0), True
            while more:
                low, x = x & 31, x >> 5
                more = not (x == 0 and not low & 16 or x == -1 and low & 16)
                out += chr((low | 32 if more else low) + 48)
        return out

    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = rng.integers(0, 5000, rng.integers(1, 20)).tolist()
        assert coco.rle_counts(text(counts)) == counts


def test_paths_of_any_depth(spark):
    n = 10_000
    chain = spark.range(n, numPartitions=4).selectExpr("1L AS image_id", "id AS node_id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id", "id / 10 AS reid_score")
    tail = traces.leaf_paths(chain).selectExpr("node_id", "depth", "path = sequence(0L, 9999L) AS same", "scores[77] AS s").collect()
    assert [tuple(r) for r in tail] == [(n - 1, n - 1, True, 7.7)]
    rows = [(1, 1, None, 0.1), (1, 2, 1, 0.2), (1, 3, 2, 0.3), (1, 9, 8, 0.4), (2, 1, None, 0.5)]
    tree = spark.createDataFrame(rows, "image_id long, node_id long, parent_id long, reid_score double")
    assert sorted((r.image_id, r.depth, r.path) for r in traces.paths(tree).collect()) == [(1, 0, [1]), (1, 1, [1, 2]), (1, 2, [1, 2, 3]), (2, 0, [1])]
    with pytest.raises(ValueError):
        traces.paths(spark.createDataFrame([(1, 1, 2, 0.1), (1, 2, 1, 0.2)], tree.schema))


def test_parents_by_box(spark):
    rows = [(1, 1, None, 0, 10, 0, 10), (1, 2, (0, 10, 0, 10), 0, 5, 0, 5), (1, 3, (0, 10, 0, 10), 0, 10, 0, 10), (1, 4, (0, 5, 0, 5), 1, 2, 1, 2)]
    df = spark.createDataFrame(rows, "image_id long, node_id long, parent_box struct<y0:long,y1:long,x0:long,x1:long>, y0 long, y1 long, x0 long, x1 long")
    assert {r.node_id: r.parent_id for r in traces.parents_by_box(df).collect()} == {1: None, 2: 1, 3: None, 4: 2}


def test_sweeps():
    base = {"a": {"b": 1}}
    runs = sweeps.configs(base, {"a.b": [1, 2], "c": "x"}, "r")
    assert [n for n, _ in runs] == ["r__a.b=1_c=x", "r__a.b=2_c=x"] and runs[1][1] == {"a": {"b": 2}, "c": "x"} and base == {"a": {"b": 1}}


def stream_rows(spark, rows):
    rows = [(1, n, p, k, d, "zoom", s, f"2024-01-01 00:00:0{i}") for i, (n, p, k, d, s) in enumerate(rows)]
    df = spark.createDataFrame(rows, "image_id long, node_id long, parent_id long, n_children int, depth int, kind string, reid_score double, t string")
    return df.withColumn("ts", F.col("t").cast("timestamp")).drop("t")


def test_trace_stream(spark, tmp_path):
    """Children may come before their parents and be any number; the stream comes to rest; a restart goes on where it was;
    a family that never is whole is decided when the watermark has passed it."""
    from siltstone.streaming import traces as stream

    df = stream_rows(spark, [(5, 2, 0, 2, 0.1), (4, 2, 0, 2, 0.9), (2, 1, 2, 1, 0.6), (1, None, 3, 0, 0.5), (3, 1, 0, 1, 0.4), (6, 1, 3, 1, 0.2), (7, 6, 0, 2, 0.1), (8, 6, 0, 2, 0.15)])
    for part in ("node_id IN (5, 4, 2)", "node_id IN (1, 3)", "node_id > 5"):
        df.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = stream.decisions(stream.read_events(spark, str(tmp_path / "in")))
    q = found.writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = {1: ("zoom", 0.6, 1, 0), 2: ("zoom", 0.9, 2, 0), 3: ("below-floor", None, 1, 0), 4: ("leaf", None, 2, 1), 5: ("below-floor", None, 2, 0)}
    assert {r.node_id: tuple(r)[2:] for r in spark.table("decided").collect()} == want
    assert sorted(r.node_id for r in stream.drained(found, str(tmp_path / "out")).collect()) == sorted(want)
    late = df.filter("node_id = 1").withColumn("image_id", F.lit(2).cast("long")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = [tuple(r) for r in stream.drained(found, str(tmp_path / "out")).filter("image_id = 1").collect()]
    want |= {6: ("reid-stop", 0.15, 2, 0), 7: ("reid-worse", None, 2, 0), 8: ("reid-worse", None, 2, 0)}
    assert sorted(again, key=lambda r: r[1]) == [(1, n, *want[n]) for n in sorted(want)]
    assert stream.windowed_counts(df).first().n == 8


def test_runs_are_logged_without_what_is_no_number(spark, tmp_path):
    from siltstone.plans import runs

    runs.log_run(spark, str(tmp_path), "r1", {"a": {"b": 1}}, {"ap": 0.5, "pq": float("nan")})
    assert [(r.key, r.value) for r in spark.read.parquet(f"{tmp_path}/metrics").collect()] == [("ap", 0.5)]
    assert spark.read.parquet(f"{tmp_path}/params").first().key == "a.b"


def test_configurations(tmp_path):
    import json

    from siltstone.plans import runs

    c = runs.SearchConfig.from_dict({"max_total_embeds": 3, "min_side": None, "grouping": "kmeans", "nonsense": 1})
    assert (c.settings.budget, c.settings.min_side, c.settings.grouping) == (3, 8, "kmeans") and runs.SearchConfig.from_dict(c.to_dict()) == c
    d = runs.DataConfig.from_dict({"root": "/x/cells", "fold": 2})
    assert d.name == "cells" and d.options == {"fold": 2} and runs.DataConfig(label="l").name == "l"
    assert runs.overridden({"a": {"b": 1}}, ["a.b=2", "c=x"]) == {"a": {"b": 2}, "c": "x"}
    (tmp_path / "a.json").write_text(json.dumps({"run_name": "r", "sweep": {"x": [1, 0]}}))
    assert runs.run_folder(str(tmp_path), lambda n, c: 1 / c["x"]) == {"r__x=1": None, "r__x=0": "ZeroDivisionError: division by zero"}
    pytest.importorskip("yaml")
    (tmp_path / "b.yaml").write_text("run_name: y\nx: 2\n")
    assert runs.run_folder(str(tmp_path), lambda n, c: None) == {"r__x=1": None, "r__x=0": None, "y": None}


def test_an_experiment_is_run_and_logged(spark, tmp_path):
    from siltstone.plans import runs

    scenes = scenes_table(spark, {i: [(1, 20, 40, 20, 40), (1, 80, 100, 60, 90)] for i in range(3)})
    gt = scenes.select("image_id", F.col("ann_id").alias("gt_id"), "y0", "y1", "x0", "x1")
    rows = {r.metric: r.value for r in runs.run_experiment(spark, str(tmp_path), "e", {"method": {"target": 1, "merge": "nms"}}, scenes, gt).collect()}
    assert rows["n_gt"] == 6 and rows["n_pred"] == 6 and rows["box_ap50"] == pytest.approx(1) and rows["pq"] > 0.7
    assert spark.read.parquet(f"{tmp_path}/predictions").count() == 6 and spark.read.parquet(f"{tmp_path}/metrics").count() == len(rows)


def two_squares():
    """Red squares at [20:40, 20:40] and [80:100, 80:100], a blue one at [20:40, 80:100]."""
    image = np.full((128, 128, 3), 120, np.uint8)
    image[20:40, 20:40] = image[80:100, 80:100] = (220, 30, 30)
    image[20:40, 80:100] = (30, 30, 220)
    return image


def test_one_pass_finds_both_red_squares(spark):
    from siltstone.operators.backbone import MockBackbone, embed
    from siltstone.plans import single_pass

    b, image = MockBackbone(), two_squares()
    x, cls = b(image)
    assert x.shape == (16, 16, 32) and np.linalg.norm(cls) == pytest.approx(1)
    bank = x[3:4, 3]
    df = spark.createDataFrame([(5, 128, 128, bytearray(image.tobytes()))], "image_id long, height long, width long, pixels binary")
    rows = single_pass.run(df, bank, b, tau=0.8, least_area=2).collect()
    boxes = sorted((r.y0, r.y1, r.x0, r.x1) for r in rows)
    assert len(boxes) == 2 and all(abs(u - v) <= 8 for p, q in zip(boxes, [(20, 40, 20, 40), (80, 100, 80, 100)]) for u, v in zip(p, q))
    got = {(r.r, r.c): r.feat for r in embed(df, b).collect()}
    assert len(got) == 256 and np.allclose(got[3, 3], x[3, 3])


def test_refinement_narrows_and_stops():
    from siltstone.plans import single_pass

    image = np.zeros((128, 128), int)
    image[40:90, 30:80] = 1
    crops = single_pass.refine(image, lambda crop: crop > 0)
    assert crops[0] == (0, 128, 0, 128) and crops[1] == (37, 93, 27, 83) and 2 <= len(crops) <= 4
    assert len(single_pass.refine(image, lambda crop: crop > 0, rounds=1)) == 1
    lost = np.zeros((128, 128), bool)
    lost[0, 0] = True
    assert len(single_pass.refine(image, lambda crop: crop > 0, [lost])) == 1
    m = np.eye(2, dtype=bool)
    assert single_pass.upsample(m, 4, 4)[:2, :2].all() and not single_pass.upsample(m, 4, 4)[:2, 2:].any() and single_pass.upsample(m, 4, 4, True)[0, 0]
    assert single_pass.foreground_box(np.zeros((2, 2), bool), (0, 4, 0, 4)) is None
