"""Merge rules over masks, scorers, centres, memory banks, zoom studies, pieces of COCO files and dataset files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import arrays as a
from siltstone.operators import clustering, masks, reid, study, suppress, traces, vectors
from siltstone.plans import cascade, runs
from siltstone.plans import strategies as st
from siltstone.sources import coco, coco_split

BOX = "image_id long, det_id long, y0 long, y1 long, x0 long, x1 long, score double"


def vectors_of(spark, x, first=0, **more):
    rows = [(first + i, [float(v) for v in r], *more.values()) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["patch_id long, feat array<double>", *[f"{k} long" for k in more]]))


# --- merge rules


def test_the_merge_chain_drops_joins_and_suppresses(spark):
    # crop of the first three: [0:20, 10:30] of 40 x 40; 1 is cut off at its lower edge, 2 and 3 are pieces of one object by the image's upper edge
    boxes = [(1, 1, 14, 20, 12, 18, 0.9), (1, 2, 0, 6, 12, 16, 0.5), (1, 3, 0, 6, 17, 22, 0.8), (1, 4, 1, 5, 12, 15, 0.4), (1, 5, 30, 38, 30, 38, 0.3)]
    dets = spark.createDataFrame(boxes, BOX).withColumns({"crop": F.expr("struct(0L AS y0, 20L AS y1, 10L AS x0, 30L AS x1)"), "height": F.lit(40), "width": F.lit(40)})
    dets = dets.withColumn("crop", F.when(F.col("det_id") == 5, F.expr("struct(20L AS y0, 40L AS y1, 20L AS x0, 40L AS x1)")).otherwise(F.col("crop")))
    runs_ = masks.box_runs(dets, "det_id")
    key = lambda df: sorted((r.det_id, r.y0, r.y1, r.x0, r.x1, r.score) for r in df.collect())
    for own in (None, runs_):
        chain = lambda rule, **o: key(suppress.merge_chain(dets, rule, runs=own, **o))  # noqa: B023, E731
        assert [r[0] for r in chain("none", drop=True)] == [1, 2, 3, 4, 5]
        assert [r[0] for r in chain("nms", drop=True)] == [2, 3, 5]
        assert chain("nms", drop=True, join=True, gap=2) == [(3, 0, 6, 12, 22, 0.8), (5, 30, 38, 30, 38, 0.3)]
        assert [r[0] for r in chain("nms", iou=1.0, contain=1.0)] == [1, 2, 3, 4, 5]
        soft = {r[0]: r[-1] for r in chain("soft", floor=0.0, contain=0.9)}
        assert soft[4] == 0 and soft[3] == 0.8
        gt = spark.createDataFrame([(1, 1, 0, 6, 12, 22), (1, 2, 31, 38, 30, 38)], "image_id long, gt_id long, y0 long, y1 long, x0 long, x1 long")
        assert [r[0] for r in chain("oracle", gt=gt, gt_runs=masks.box_runs(gt, "gt_id"))] == [3, 5]
    with pytest.raises(ValueError):
        suppress.merge_chain(dets, "oracle")
    with pytest.raises(ValueError):
        suppress.merge_detections(dets, "best")


def test_crowded_fragments_are_found_by_tiles(spark):
    rng = np.random.default_rng(3)
    boxes = [(1, i, *(int(v) for v in (y, y + h, x, x + w)), 0.5) for i, (y, h, x, w) in enumerate(zip(*rng.integers(1, 60, (4, 40))))]
    dets = spark.createDataFrame(boxes, BOX).withColumn("partial", F.col("det_id") % 3 == 0)
    for gap in (0, 1, 5):
        near = lambda p, q: p[2] < q[3] + gap and q[2] < p[3] + gap and p[4] < q[5] + gap and q[4] < p[5] + gap  # noqa: B023, E731
        want = {(p[1], q[1]) for p in boxes for q in boxes if p[1] < q[1] and (p[1] % 3 == 0 or q[1] % 3 == 0) and near(p, q)}
        got = [(r.a, r.b) for r in suppress.fragment_pairs(dets, gap).collect()]
        assert set(got) == want and len(got) == len(want)


def test_crowded_masks_are_measured_once_a_pair(spark):
    rng = np.random.default_rng(4)
    art = rng.random((12, 40, 40)) < 0.3
    rows = [(1, i, int(y), int(x), int(x) + 1) for i, m in enumerate(art) for y, x in zip(*np.nonzero(m))]
    r = spark.createDataFrame(rows, "image_id long, det_id long, y long, xs long, xe long")
    got = {(o.det_id, o.other): (o.inter, o.iou, o.containment, o.own) for o in suppress.mask_overlaps(r).collect()}
    for i in range(12):
        for j in range(12):
            n = int((art[i] & art[j]).sum())
            if i != j:
                assert got[i, j] == (n, pytest.approx(n / (art[i] | art[j]).sum()), pytest.approx(n / min(art[i].sum(), art[j].sum())), pytest.approx(n / art[i].sum()))
    assert len(got) == 132


# --- vectors


def test_the_positional_basis_is_what_noise_has_in_common(spark):
    rng = np.random.default_rng(0)
    hidden = np.linalg.qr(rng.normal(size=(6, 2)))[0].T
    noise = rng.normal(size=(400, 2)) * (9, 4) @ hidden + rng.normal(size=(400, 6)) * 0.01 + 3
    df = vectors_of(spark, noise).repartition(5)
    g = np.zeros((6, 6))
    for r in vectors.gram(df).collect():
        g[r.i - 1, r.j - 1] = r.value
    x = noise - noise.mean(axis=0)
    assert np.allclose(g, x.T @ x) and sum(r.value for r in vectors.gram(df, centred=False).filter("i = j").collect()) == pytest.approx((noise**2).sum())
    basis = vectors.positional_basis(df, 2)
    assert np.allclose(np.abs(np.array(basis) @ np.linalg.svd(x, full_matrices=False)[2][:2].T), np.eye(2), atol=1e-6)
    left = [r.u for r in df.select(a.project_out(F.col("feat"), basis).alias("u")).collect()]
    assert np.abs(np.array(left) @ np.array(basis).T).max() < 1e-9
    assert vectors.gram(df.limit(0)).count() == 0 and vectors.positional_basis(df.limit(0), 2) == []


def test_mini_batches_move_centres_as_numpy_does(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (60, 3)) for c in ([1, 0, 0], [0, 1, 0], [0, 0, 1])])
    df = vectors_of(spark, x).repartition(7)
    first = x[[0, 70, 130]]
    got = reid.minibatch_kmeans(df, 3, batches=4, epochs=2, seed=5, first=first)
    batch = {r.patch_id: r.b for r in df.select("patch_id", F.pmod(F.xxhash64(F.lit(5), F.col("patch_id")), F.lit(4)).alias("b")).collect()}
    centres, counts = first.copy(), np.zeros(3)
    for b in [*range(4), *range(4)]:
        rows = x[[i for i in range(len(x)) if batch[i] == b]]
        label = np.argmin(((rows[:, None] - centres[None]) ** 2).sum(axis=2), axis=1)
        for j in range(3):
            own = rows[label == j]
            counts[j] += len(own)
            if len(own):
                centres[j] += (own.sum(axis=0) - len(own) * centres[j]) / counts[j]
    assert np.allclose(got, centres / np.linalg.norm(centres, axis=1, keepdims=True), atol=1e-6)
    assert len(reid.minibatch_kmeans(df, 500, epochs=1)) == 180 and reid.minibatch_kmeans(df.limit(0), 3).size == 0


@pytest.mark.parametrize("bank_numbers", [4_000_000, 8])
def test_scores_by_mode(spark, monkeypatch, bank_numbers):
    monkeypatch.setattr(vectors, "BANK_NUMBERS", bank_numbers)
    rng = np.random.default_rng(2)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x, e = unit(rng.normal(size=(2, 9, 5))), unit(rng.normal(size=(3, 4, 5)))
    rows = [(i, 9 * i + p, p // 3, x[i, p].tolist()) for i in range(2) for p in range(9)]
    targets = spark.createDataFrame(rows, "image_id long, patch_id long, r long, feat array<double>")
    ex = spark.createDataFrame([(7 + k // 2, k, 10 * k + p, e[k, p].tolist()) for k in range(3) for p in range(4)], "class_id long, ex_id long, patch_id long, feat array<double>")
    basis = np.linalg.qr(rng.normal(size=(5, 1)))[0].T.tolist()
    free = lambda v: unit(v - np.outer(v @ basis[0], basis[0]))
    inside = F.expr("image_id = 0 AND r = 1")  # of image 1 nothing is: it counts whole
    for mode, debias in (("cls", False), ("mean", False), ("full", False), ("full", True), ("kmeans", True)):
        scorer = reid.build_scorer(mode, top=1, k=1, basis=basis if debias else ())
        got = {(r.image_id, r.class_id): r.g for r in scorer.score(targets, ex, inside).collect()}
        for i in range(2):
            own = x[i] if mode == "cls" or i else x[i, 3:6]
            own = free(own) if debias else own
            per = []
            for k in range(3):
                bank = free(e[k]) if debias else e[k]
                t, b = (own, bank) if mode == "full" else (unit(own.mean(axis=0))[None], unit(bank.mean(axis=0))[None])
                per.append((t @ b.T).max(axis=1).mean())
            assert got[i, 7] == pytest.approx(max(per[:2]), abs=1e-6) and got[i, 8] == pytest.approx(per[2], abs=1e-6)
    assert not reid.build_scorer("cls").needs_foreground and reid.build_scorer("full").needs_foreground
    two = reid.build_scorer("kmeans", k=2).sets(targets, ["image_id"])
    assert two.groupBy("image_id").count().filter("count = 2").count() == 2
    with pytest.raises(ValueError):
        reid.build_scorer("best")


def test_memory_finds_its_class_and_nothing_without(spark):
    rng = np.random.default_rng(6)
    kinds = np.eye(4)
    art = np.full((10, 10), 3)
    art[2:5, 2:5], art[6:9, 5:8] = 0, 1
    feats = kinds[art] + rng.normal(size=(10, 10, 4)) * 0.01
    feats /= np.linalg.norm(feats, axis=-1, keepdims=True)
    patches = spark.createDataFrame([(1, r, c, feats[r, c].tolist()) for r in range(10) for c in range(10)], "image_id long, r long, c long, feat array<double>")
    ref = vectors_of(spark, kinds[[0, 0, 1, 2]]).withColumn("class_id", F.element_at(F.array(*map(F.lit, [10, 10, 11, 12])), (F.col("patch_id") + 1).cast("int")).cast("long"))
    memory = reid.build_memory(ref, 1)
    found = reid.memory_matches(patches, memory, least=0.9, least_score=0.9, iou=0.3, contain=0.3).collect()
    assert sorted((r.class_id, r.y0, r.y1, r.x0, r.x1) for r in found) == [(10, 2, 5, 2, 5), (11, 6, 9, 5, 8)]
    assert reid.memory_matches(patches, memory.limit(0), least=0.9).count() == 0
    assert reid.build_memory(ref, 2).groupBy("class_id").count().count() == 3


def test_banks_are_built_once(spark):
    rng = np.random.default_rng(8)
    items = spark.createDataFrame([(i, i % 4, 100 + (i > 8), 1) for i in range(12)], "item_id long, image_id long, support_image_id long, class_id long")
    ex = vectors_of(spark, rng.normal(size=(9, 3))).select("patch_id", "feat", (100 + F.col("patch_id") % 3).alias("support_image_id"), F.lit(1).cast("long").alias("class_id"))
    patches = vectors_of(spark, rng.normal(size=(20, 3))).select((F.col("patch_id") % 4).alias("image_id"), "feat")
    builds = spark.sparkContext.accumulator(0)
    banks = reid.item_banks(items, ex, 1, builds)
    got = {r.item_id: r.g for r in reid.score_items(items, patches, banks, shares=3).collect()}
    assert builds.value == 2 and len(got) == 12  # of three support images two are asked for
    rows = {r.support_image_id: np.array(r.feat) for r in banks.collect()}
    for i in range(12):
        x = np.array([p.feat for p in patches.filter(F.col("image_id") == i % 4).collect()])
        assert got[i] == pytest.approx((x @ rows[100 + (i > 8)]).mean(), abs=1e-6)


# --- zooms


def test_the_ladder_peaks_at_the_frame(spark):
    gt = spark.createDataFrame([(1, 1, 80, 120, 80, 120), (1, 2, 0, 10, 0, 30)], "image_id long, gt_id long, y0 long, y1 long, x0 long, x1 long")
    crops = study.framing(study.ladder(gt, F.lit(200), F.lit(200)))
    assert crops.count() == 26
    square = {r.zoom: (r.pure, r.whole) for r in crops.filter("gt_id = 1").collect()}
    assert square[1.0] == (1.0, 1.0) and square[2.0] == (0.25, 1.0) and square[0.35] == (1.0, pytest.approx(0.1225))
    report = {r.scorer: r for r in study.ladder_report(study.scored(crops.filter("gt_id = 1"), study.SCORERS)).collect()}
    assert report["full"].refine_rise == 1 and report["full"].overzoom_fall == 1 and report["full"].anchor_rank == 1 and report["full"].best_zoom == 1 and report["full"].one_peak == 1
    assert report["mean"].refine_rise == 1 and report["mean"].overzoom_fall == 0


def test_zoom_rates_add_pixels_up(spark):
    crops = spark.createDataFrame([(1, 1, 0, 10, 0, 10, 0.0), (1, 2, 0, 40, 0, 40, 0.0), (2, 3, 0, 10, 0, 10, 0.0)], BOX)
    found = spark.createDataFrame([(1, 1, 0, 0, 8), (1, 2, 5, 0, 40), (2, 3, 0, 0, 5)], "image_id long, det_id long, y long, xs long, xe long")
    gt = spark.createDataFrame([(1, 1, 0, 2, 6), (1, 2, 0, 4, 10), (1, 3, 5, 10, 20)], "image_id long, gt_id long, y long, xs long, xe long")
    got = {r["size"]: (r.n, r.precision, r.recall) for r in traces.zoom_rates(crops, found, gt, 20.0).collect()}
    assert got == {"0.5-1x": (2, 6 / 13, 6 / 8), "2-4x": (1, 10 / 40, 10 / 18)}


# --- sources and runs


def document(n, seed=0):
    rng = np.random.default_rng(seed)
    odd = ['plain', 'with "quotes"', "back\\slash\\", "br{ack}[ets]", "end\\\\"]
    images = [{"id": i, "height": 10, "width": 20, "file_name": odd[i % 5] + f"{i}.jpg", "note": {"deep": [{"x": [1, {"y": 2}]}]}} for i in range(n)]
    ann = [{"id": k, "image_id": int(rng.integers(n)), "category_id": 1 + k % 2, "area": float(k), "iscrowd": int(k % 7 == 0), "bbox": [1, 2, 3, 4.5], "segmentation": [[0, 0, 4, 0, 4, 4]] if k % 2 else {"size": [10, 20], "counts": 'a"]}{'}} for k in range(3 * n)]
    return {"info": {"images": [{"id": -1}], "text": "[{"}, "images": images, "categories": [{"id": 1, "name": "one"}, {"id": 2, "name": "t{wo"}], "annotations": ann, "licenses": []}


@pytest.mark.parametrize("indent", [None, 1])
def test_pieces_of_a_file_give_all_its_rows(spark, tmp_path, indent):
    path = str(tmp_path / "a.json")
    (tmp_path / "a.json").write_text(json.dumps(document(60), indent=indent))
    doc = coco.read(spark, path)
    key = lambda df: sorted(map(str, df.collect()))
    for split in (300, 2000, 1 << 20):
        planned = coco_split.plan(spark, path, split)
        assert set(planned) == {"images", "annotations", "categories", "licenses"} and (split > 2000) == (len(planned["annotations"]) == 1)
        assert key(coco_split.images(spark, path, planned)) == key(coco.images(doc))
        own = coco_split.annotations(spark, path, planned)
        assert key(own.drop("segmentation")) == key(coco.annotations(doc).drop("segmentation"))
        assert {r.ann_id: json.loads(r.segmentation) for r in own.collect()} == {r.ann_id: json.loads(r.segmentation) for r in coco.annotations(doc).collect()}
    assert key(coco_split.class_names(spark, path)) == key(coco.class_names(doc))
    pruned = coco_split.read(spark, path, "annotations", ["id", "area"])
    assert pruned.columns == ["id", "area"] and pruned.count() == 180
    with pytest.raises(ValueError):
        coco_split.read(spark, path, "annotations", ["depth"])
    (tmp_path / "b.json").write_text(json.dumps(document(5))[:-40])
    with pytest.raises(ValueError):
        coco_split.plan(spark, str(tmp_path / "b.json"))


def test_no_piece_grows_with_the_file(spark, tmp_path):
    most = []
    for n in (30, 300):
        (tmp_path / f"{n}.json").write_text(json.dumps(document(n)))
        planned = coco_split.plan(spark, str(tmp_path / f"{n}.json"), 4096)
        most.append((len(planned["annotations"]), max(p.end - p.start for p in planned["annotations"])))
    assert most[0][1] == most[1][1] == 4096 and most[1][0] > 6 * most[0][0]


def test_dataset_files(spark, tmp_path):
    (tmp_path / "annotations.json").write_text(json.dumps(document(10)))
    own = runs.DatasetFile(str(tmp_path), [2], ["6", "0"], split={"6": {"train": [0], "val": [1]}}, target_size=(5, 5), channels=1)
    for name in ("d.json", "d.yaml"):
        if name.endswith("yaml"):
            pytest.importorskip("yaml")
        own.write(tmp_path / name)
        assert runs.DatasetFile.read(tmp_path / name) == own
    t = own.tables(spark)
    assert [(r.image_id, r.order, r.scale) for r in t["images"].orderBy("order").collect()] == [("6", 0, 0.25), ("0", 1, 0.25)]
    rows = t["annotations"].orderBy("image_id", "place").collect()
    assert {(r.class_id, r.class_name) for r in rows} == {(1, "t{wo")}
    assert [(r.image_id, r.place, r.part) for r in rows] == [*[("0", k, "unlabelled") for k in range(3)], ("6", 0, "train"), ("6", 1, "val")]


def test_a_search_is_merged_by_its_masks(spark):
    rows = [(1, k, 1, 128, 128, *b) for k, b in enumerate([(20, 40, 20, 40), (80, 110, 70, 100)])]
    scenes = spark.createDataFrame(rows, "image_id long, ann_id long, category_id long, height long, width long, y0 long, y1 long, x0 long, x1 long")
    for more, n in (({}, 2), ({"by": "masks"}, 2), ({"by": "masks", "join": True}, 2), ({"by": "masks", "drop": True}, 0)):  # each square reaches the edges of its crop
        found = st.build_method({"method": {"target": 1, "merge": "nms"} | more})(scenes)
        assert found.count() == n and ("cells" in found.columns) == ("join" not in more)
    with pytest.raises(ValueError):
        st.build_method({"method": {"by": "colour"}})


def test_masks_on_cells_give_each_patch_once(spark):
    art = np.zeros((2, 30, 20), bool)
    art[0, 3:17, 2:11], art[1, 10:30, 8:20] = True, True
    rows = [(1, k, int(y), int(x), int(x) + 1) for k in range(2) for y, x in zip(*np.nonzero(art[k]))]
    images = spark.createDataFrame([(1, 30, 20)], "image_id long, height long, width long")
    cells = masks.on_grid(spark.createDataFrame(rows, "image_id long, det_id long, y long, xs long, xe long"), "det_id", images, 7, 5)
    for k in range(2):
        grid = np.zeros((7, 5), bool)
        for r in cells.filter(F.col("det_id") == k).collect():
            grid[r.r, r.c] = True
        assert (grid == st.on_grid(art[k], (7, 5))).all()
    patches = spark.createDataFrame([(1, r, c) for r in range(7) for c in range(5)], "image_id long, r long, c long")
    got = vectors.stacked(patches, cells)
    assert got.count() == got.distinct().count() == (st.on_grid(art[0], (7, 5)) | st.on_grid(art[1], (7, 5))).sum()


def test_grids_of_any_size_are_packed():
    m = np.random.default_rng(0).random((300, 257)) < 0.5
    assert (cascade.unpacked(cascade.packed(m)) == m).all()


def test_instances_on_cells_and_in_boxes():
    labels = np.zeros((20, 20), int)
    labels[2:8, 3:9], labels[10:20, 10:20], labels[0, 19] = 1, 3, 7
    assert st.instance_boxes(labels).tolist() == [[2, 8, 3, 9, 36], [10, 20, 10, 20, 100], [0, 1, 19, 20, 1]]
    for coverage in ("center", "any"):
        cell, label = st.cell_labels(labels, (7, 7), coverage)
        for k in (1, 3, 7):
            grid = np.zeros(49, bool)
            grid[cell[label == k]] = True
            assert (grid.reshape(7, 7) == st.on_grid(labels == k, (7, 7), coverage)).all()
    crop = st.Crop(np.zeros((7, 7, 1)), (10, 20, 10, 20), labels)
    assert st.isolation(crop, labels, st.Settings(isolation="mask")) == 1 and st.isolation(crop, labels, st.Settings()) == 1
    assert st.isolation(st.Crop(np.zeros((7, 7, 1)), (0, 8, 0, 10), labels), labels, st.Settings(isolation_select="center")) == pytest.approx(36 / 80)
    assert st.isolation(crop, np.zeros((20, 20), int), st.Settings()) == 0


def test_components_are_components(spark):
    from siltstone.operators.backbone import MockBackbone

    image = np.full((128, 128, 3), 120, np.uint8)
    image[20:40, 20:40] = image[80:100, 80:100] = (220, 30, 30)
    x, _ = MockBackbone()(image)
    df = spark.createDataFrame([(5, 128, 128, bytearray(image.tobytes()))], "image_id long, height long, width long, pixels binary")
    method = lambda **o: st.build_method({"method": {"type": "components", "bank": [x[3, 3].tolist()], "tau": 0.8} | o})(df).collect()
    assert len(method()) == 2 and all(0.8 <= r.score < 1.001 for r in method()) and [r.score for r in method(score="one")] == [1.0, 1.0]
    assert method(least_area=10_000) == []
    fg = (x @ x[3, 3]) >= 0.8
    assert sum(r.area for r in method()) == fg.sum() == sum(m.sum() for m, _ in [(clustering.label_cells(fg, 8) > 0, 0)])
