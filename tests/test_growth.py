"""Tables that grow with the data: no side of their joins is sent to the driver, and what is shuffled stays small."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from siltstone.operators import masks, matching, metrics, packs, reid, suppress, traces
from siltstone.plans import catalog
from siltstone.sources import coco_split


def broadcasts(df) -> int:
    return len(re.findall(r"BroadcastHashJoin|BroadcastNestedLoopJoin", df._jdf.queryExecution().executedPlan().toString()))


def stored(spark, tmp_path, df, name):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def tree(spark, tmp_path):
    rows = spark.range(31).select(F.lit(1).cast("long").alias("image_id"), (F.col("id") + 1).alias("node_id"), F.when(F.col("id") > 0, F.expr("(id + 1) div 2")).alias("parent_id"), F.lit("zoom").alias("kind"), (F.col("id") / 31).alias("reid_score"))
    return stored(spark, tmp_path, rows, "trace")


def test_traces_send_no_table_to_the_driver(spark, tmp_path):
    t = tree(spark, tmp_path)
    for df in (traces.paths(t), traces.ended_paths(t), traces.terminal_chains(t), traces.survivors(t, 0.5)):
        assert broadcasts(df) == 0 and df.count() > 0
    assert sorted(len(r.path) for r in traces.leaf_paths(t).collect()) == [5] * 16


def scattered_masks(seed):
    """Masks of up to three runs a line, their rows in no order: {(image, id): set of pixels} and the rows."""
    rng = random.Random(seed)
    pixels, rows = {}, []
    for image in range(4):
        for mask in range(12):
            y0, x0 = rng.randrange(-5, 300), rng.randrange(-200, 200)
            own = []
            for y in range(y0, y0 + rng.randrange(1, 40)):
                at = x0
                for _ in range(rng.choice([1, 1, 1, 0, 3]) if mask % 3 else 1):
                    at += rng.randrange(0, 150)
                    end = at + rng.randrange(1, 90)
                    own.append((image, mask, y, at, end))
                    at = end
            if own:
                pixels[image, mask] = {(y, x) for *_, y, a, b in own for x in range(a, b)}
                rows += own
    rng.shuffle(rows)
    return pixels, rows


def test_packed_masks_share_what_pixels_share(spark):
    pixels, rows = scattered_masks(3)
    runs = spark.createDataFrame(rows, "image_id long, det_id long, y long, xs long, xe long").repartition(3)
    got = {(r.image_id, r.a, r.b): (r.inter, r.area_a, r.area_b) for r in packs.overlapping(runs, None, "det_id").collect()}
    want = {(i, a, b): (len(p & q), len(p), len(q)) for (i, a), p in pixels.items() for (j, b), q in pixels.items() if i == j and a < b and p & q}
    assert got == want and len(want) > 20
    odd, even = runs.filter("det_id % 2 = 1"), runs.filter("det_id % 2 = 0")
    union = lambda image, rest: set().union(*[p for (i, m), p in pixels.items() if i == image and m % 2 == rest])
    got = {(r.image_id, r.det_id): r.covered for r in masks.covered(odd, even, "det_id").collect()}
    assert got == {k: len(p & union(k[0], 0)) for k, p in pixels.items() if k[1] % 2 and p & union(k[0], 0)}
    got = {r.image_id: (r.size_a, r.size_b, r["size"]) for r in packs.union_sizes(odd, even).collect()}
    assert got == {i: (len(union(i, 1)), len(union(i, 0)), len(union(i, 1) | union(i, 0))) for i in range(4)}


def test_packed_masks_of_narrow_and_wide_ids(spark):
    """Masks of which one side's ids are int and the other's long meet as long."""
    long_, short = (spark.createDataFrame([(1, k, 0, 0, 9) for k in (3, 4)], f"image_id {t}, id {t}, y long, xs long, xe long") for t in ("long", "int"))
    for a, b in ((long_, short), (short, long_), (short, short)):
        assert sorted((r.p, r.q, r.iou) for r in masks.overlaps(a.withColumnRenamed("id", "p"), b.withColumnRenamed("id", "q"), "p", "q").collect()) == [(p, q, 1.0) for p in (3, 4) for q in (3, 4)]


def test_packed_masks_in_small_pieces(monkeypatch):
    """Few images, candidates and lines at a time give the same as all at once."""
    import pyarrow as pa

    _, rows = scattered_masks(5)
    rows.sort()
    cols = [pa.array(c, t) for c, t in zip(([r[0] for r in rows], [0] * len(rows), [r[1] for r in rows], *[[r[i] for r in rows] for i in (2, 3, 4)]), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
    whole = pa.RecordBatch.from_arrays(cols, ["image_id", "side", "id", "y", "xs", "xe"])

    def found(size):
        parts = [whole.slice(at, size) for at in range(0, len(rows), size)]
        return sorted(tuple(r.values()) for b in packs._by_images(packs._pairs(False, False))(packs._pack(iter(parts))) for r in b.to_pylist())

    want = found(len(rows))
    for name, value in (("TOGETHER", 64), ("CANDIDATES", 3), ("LINES", 5)):
        monkeypatch.setattr(packs, name, value)
    assert found(7) == want and len(want) > 10


def test_the_merge_chain_shuffles_no_runs_as_rows(spark, monkeypatch):
    """Masks that are dropped, are partial and lie near each other, in few images a batch; their runs are shuffled packed only."""
    monkeypatch.setattr(packs, "MASKS", 5)
    pixels, rows = scattered_masks(7)
    runs = spark.createDataFrame(rows, "image_id long, det_id long, y long, xs long, xe long").repartition(3)
    dets = spark.createDataFrame([(i, m, 0, 1, 0, 1, float(m % 5)) for i, m in pixels] + [(9, 1, 0, 1, 0, 1, 1.0)], "image_id long, det_id long, y0 long, y1 long, x0 long, x1 long, score double")
    dets = dets.withColumns({"crop": F.expr("struct(0L AS y0, 300L AS y1, -100L AS x0, 250L AS x1)"), "height": F.lit(300), "width": F.lit(400)})
    box = lambda p: (min(y for y, _ in p), max(y for y, _ in p) + 1, min(x for _, x in p), max(x for _, x in p) + 1)
    left = {k: p for k, p in pixels.items() if box(p)[3] < 250}
    partial = {k for k, p in left.items() if box(p)[0] <= 0 or box(p)[1] >= 300 or box(p)[2] <= -100}
    wide = {k: {(y + a, x + b) for y, x in p for a in range(-2, 3) for b in range(-2, 3)} for k, p in left.items() if k in partial}
    root = {k: k for k in left}
    for _ in left:
        for a in partial:
            for b in left:
                if a[0] == b[0] and wide[a] & left[b]:
                    root[a] = root[b] = min(root[a], root[b])
    groups = {}
    for k in left:
        groups.setdefault(root[k], []).append(k)
    want = {max(g, key=lambda k: (k[1] % 5, -k[1])): set().union(*[left[k] for k in g]) for g in groups.values()}
    merged, own = suppress.joined_masks(dets, runs, True, 2)
    got = {}
    for r in own.collect():
        assert not {(r.y, x) for x in range(r.xs, r.xe)} & got.setdefault((r.image_id, r.det_id), set())
        got[r.image_id, r.det_id] |= {(r.y, x) for x in range(r.xs, r.xe)}
    assert got == want and len(groups) < len(left) < len(pixels)
    assert {(r.image_id, r.det_id): (r.y0, r.y1, r.x0, r.x1) for r in merged.collect()} == {k: box(p) for k, p in want.items()}
    plan = suppress.merge_chain(dets, "nms", drop=True, join=True, gap=2, runs=runs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^)]*\by#", plan)
    stays, own = suppress.joined_masks(dets, runs, True, None)
    assert {(r.image_id, r.det_id) for r in stays.collect()} == {*left, (9, 1)} and {(r.image_id, r.det_id) for r in own.select("image_id", "det_id").distinct().collect()} == set(left)


def test_masks_are_shuffled_packed_and_once(spark, tmp_path):
    boxes = spark.range(40).select((F.col("id") % 4).alias("image_id"), F.col("id").alias("det_id"), F.col("id").alias("y0"), (F.col("id") + 20).alias("y1"), F.lit(3).alias("x0"), F.lit(30).alias("x1"))
    runs = masks.box_runs(stored(spark, tmp_path, boxes, "boxes"), "det_id")
    for df in (suppress.mask_overlaps(runs), masks.overlaps(runs, runs.withColumnRenamed("det_id", "gt_id"), "det_id", "gt_id"), masks.union_iou(runs, runs), masks.covered(runs, runs, "det_id")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert broadcasts(df) == 0 and len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_small_coco_pieces_share_tasks(spark, tmp_path):
    images = spark.range(400).select(F.col("id").alias("image_id"), F.lit(5).alias("height"), F.lit(6).alias("width"))
    ann = images.select("image_id", F.lit(1).cast("long").alias("ann_id"), F.lit(2).cast("long").alias("category_id"), F.lit(3.0).alias("area"))
    folder = str(tmp_path / "coco")
    coco_split.write_documents(images, ann, folder, 10)
    planned = coco_split.plan(spark, folder, 64)
    assert len(planned["annotations"]) > 200
    found = coco_split.annotations(spark, folder, planned, ())
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism + 1
    assert sorted(int(r.image_id) for r in found.collect()) == list(range(400))


def embeddings(spark, tmp_path, rows):
    """A folder whose only table is ``rows`` vectors: grids of 100 cells, of which the last may lack some."""
    rng = random.Random(4)
    table = [(i, [rng.gauss(i % 7 == j, 0.5) for j in range(8)], i * 7 % 3) for i in range(rows)]
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def by_sql(spark, name, folder):
    """A query's rows, and its SQL's, over a folder of embeddings."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.SQL[name]})").fetchall()
    plain = lambda rows: sorted(tuple(round(float(v), 6) for v in r) for r in rows)
    return plain(df.collect()), plain(want)


def test_tasks_without_rows_have_no_part_in_a_centre(spark, tmp_path):
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "patch_id long, feat array<double>").repartition(16)
    assert len(reid.minibatch_kmeans(few, 1, epochs=1)) == 1
    for rows in (5, 0):
        got, want = by_sql(spark, "minibatch_centre", embeddings(spark, tmp_path / str(rows), rows))
        assert got == want and len(got) == 8 * (rows > 0)


def test_cells_that_a_grid_lacks_are_no_area(spark, tmp_path):
    got, want = by_sql(spark, "memory_matches", embeddings(spark, tmp_path, 356))
    assert got == want and {3.0} < {r[0] for r in got}


def test_suppression_shuffles_pairs_once_and_one_way_round(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i % 3, i, y := rng.randrange(60), y + rng.randrange(5, 40), x := rng.randrange(60), x + rng.randrange(5, 40), float(rng.randrange(20))) for i in range(90)]
    dets = stored(spark, tmp_path, spark.createDataFrame(rows, "image_id long, det_id long, y0 long, y1 long, x0 long, x1 long, score double"), "dets")
    one, both = stored(spark, tmp_path, suppress.box_pairs(dets), "one"), stored(spark, tmp_path, suppress.box_overlaps(dets), "both")
    assert 2 * one.count() == both.count()
    for rule in (suppress.nms, suppress.suppress_directional, suppress.soft_nms):
        found = [rule(dets, pairs=p) for p in (one, both, None)]
        plan = found[0]._jdf.queryExecution().executedPlan().toString()
        assert broadcasts(found[0]) == 0 and len(re.findall(r"Exchange hashpartitioning", plan)) == 2
        key = lambda df: sorted(tuple(round(v, 9) for v in r) for r in df.collect())
        assert key(found[0]) == key(found[1]) == key(found[2])


def test_detections_are_ranked_once_for_all_thresholds(spark, tmp_path):
    rng = random.Random(9)
    box = lambda: (y := rng.randrange(50), y + rng.randrange(10, 40), x := rng.randrange(50), x + rng.randrange(10, 40))
    gt = [(i % 4, i, *box()) for i in range(24)]
    rows = [(i % 4, i, *(gt[i % 24][2:] if i % 3 == 0 else box()), float(rng.randrange(12))) for i in range(80)]
    dets = stored(spark, tmp_path, spark.createDataFrame(rows, "image_id long, det_id long, y0 long, y1 long, x0 long, x1 long, score double"), "dets")
    truth = stored(spark, tmp_path, spark.createDataFrame(gt, "image_id long, gt_id long, y0 long, y1 long, x0 long, x1 long"), "truth")
    found = metrics.coco_ap(dets, truth, [0.5, 0.7])
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # no row a detection and threshold
    got = {r.threshold: r.ap for r in found.collect()}
    size = lambda b: (b[1] - b[0]) * (b[3] - b[2])
    for t in (0.5, 0.7):
        taken, tp, points = set(), 0, []
        for k, d in enumerate(sorted(rows, key=lambda r: (-r[6], r[0], r[1])), 1):
            best = None
            for q in gt:
                inter = max(0, min(d[3], q[3]) - max(d[2], q[2])) * max(0, min(d[5], q[5]) - max(d[4], q[4]))
                iou = inter / (size(d[2:6]) + size(q[2:]) - inter)
                if d[0] == q[0] and q[1] not in taken and iou >= t and (best is None or (iou, q[1]) > best):
                    best = iou, q[1]
            if best:
                taken.add(best[1])
                tp += 1
                points.append((tp / len(gt), tp / k))
        want = sum(max((p for r, p in points if r >= level / 100 - 1e-9), default=0) for level in range(101)) / 101
        assert abs(got[t] - want) < 1e-9 and want > 0.05


def test_an_image_is_drawn_once_for_all_its_regions(monkeypatch):
    """What is seen of a region is the same as alone, but its image is drawn once for regions that follow each other."""
    import numpy as np

    from siltstone.operators import clustering
    from siltstone.plans import cascade, strategies as st

    rng, drawn, draw = random.Random(3), [], cascade.draw
    monkeypatch.setattr(cascade, "draw", lambda *a: drawn.append(1) or draw(*a))
    squares = [{"category_id": 1 + i % 2, "y0": (y := rng.randrange(50)), "y1": y + rng.randrange(3, 30), "x0": (x := rng.randrange(50)), "x1": x + rng.randrange(3, 30)} for i in range(9)]
    row, settings = {"height": 70, "width": 64, "squares": squares}, st.Settings(extractor="oracle", stop="oracle")
    see = cascade.see_squares(1, settings=settings)
    for box in ((0, 70, 0, 64), (5, 12, 3, 60), (20, 61, 10, 31)):
        _, found, labels = see(dict(row), box)
        cell, label = st.cell_labels(labels[box[0] : box[1], box[2] : box[3]], (16, 16), "any")
        assert [m.ravel().nonzero()[0].tolist() for m in found] == [cell[label == k].tolist() for k in np.unique(label)]
        parts = clustering.label_cells(found[0] | found[-1], 4)
        assert all(parts[y, x] == parts[y, x + 1] for y in range(16) for x in range(15) if parts[y, x] and parts[y, x + 1])
    assert len(drawn) == 2


def test_an_images_masks_travel_in_a_few_bytes_each():
    """Boxes of an image whose runs stand together are one packed row, of about as many bytes as their sides take."""
    import pyarrow as pa

    rng = random.Random(6)
    rows = [(i, 0, k, y, x, x + n) for i in range(5) for k in range(40) for y0, x, n in [(rng.randrange(80), rng.randrange(80), rng.randrange(5, 60))] for y in range(y0, y0 + rng.randrange(5, 55))]
    cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
    packed = list(packs._pack(iter([pa.RecordBatch.from_arrays(cols, ["image_id", "side", "id", "y", "xs", "xe"])])))
    assert sum(b.num_rows for b in packed) == 5 and sum(len(d) for b in packed for d in b.column("data").to_pylist()) < 200 * 14


def test_a_targets_ladder_is_never_shuffled(spark, tmp_path):
    from siltstone.operators import study

    rng = random.Random(7)
    rows = [(i % 5, i, y := rng.randrange(150), y + rng.randrange(1, 60), x := rng.randrange(150), x + rng.randrange(1, 60)) for i in range(900)]
    gt = stored(spark, tmp_path, spark.createDataFrame(rows, "image_id long, gt_id long, y0 long, y1 long, x0 long, x1 long"), "gt")
    size = F.lit(200)
    own = study.report(gt, size, size)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and len(re.findall(r"Exchange hashpartitioning", plan)) == 1  # of sums
    key = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert key(own) == key(study.ladder_report(study.scored(study.framing(study.ladder(gt, size, size)), study.SCORERS)))
    assert study.report(gt.limit(0), size, size).count() == 0


def test_evaluation_keeps_no_pair_below_its_thresholds(spark, monkeypatch):
    """Of boxes that overlap a little nearly everywhere only the close pairs are written, and the metrics are those of all pairs."""
    rng = random.Random(7)
    box = lambda: (lambda y, x: (y, y + rng.randrange(20, 60), x, x + rng.randrange(20, 60)))(rng.randrange(80), rng.randrange(80))
    truth = [(i, k, *box()) for i in range(12) for k in range(6)] + [(99, 0, 0, 9, 0, 9)]
    dets = [(i, k, float(rng.randrange(9)), *box()) for i in range(12) for k in range(20)] + [(i, 50 + k, 5.0, y0 + 2, y1, x0, x1) for i, k, y0, y1, x0, x1 in truth[:40]] + [(3, 99, 1.0, 5, 5, 0, 9)]
    d = spark.createDataFrame(dets, "image_id long, det_id long, score double, y0 long, y1 long, x0 long, x1 long")
    t = spark.createDataFrame(truth, "image_id long, gt_id long, y0 long, y1 long, x0 long, x1 long")
    for least in (0.0, 0.5):
        assert sorted(matching.image_pairs(d, t, least).collect()) == sorted(matching.tiled_pairs(d, t, least=least).collect())
    all_ = matching.tiled_pairs(d, t)
    want, ap = metrics.panoptic(d, t).first(), {r.threshold: r.ap for r in metrics.coco_ap(d, t, pairs=all_).collect()}
    kept, written = [], metrics.written

    def seen(df, name):
        out = written(df, name)
        if name == "pairs":
            kept.append(out)
        return out

    monkeypatch.setattr(metrics, "written", seen)
    got = metrics.evaluate(d, t).first()
    assert len(kept) == 1 and 0 < kept[0].count() == all_.filter("iou >= 0.5").count() < all_.count() / 4
    assert [round(got[c], 9) for c in ("pq", "sq", "rq", "count_error", "count_error_rel")] == [round(want[c], 9) for c in ("pq", "sq", "rq", "count_abs", "count_rel")]
    assert {t: round(got[f"box_ap_{t:.2f}"], 9) for t in ap} == {t: round(v, 9) for t, v in ap.items()}


def test_boxes_of_an_image_are_not_shuffled_again_for_their_pairs(spark, tmp_path):
    for name, cols in (("lineitem", "id AS l_orderkey, id % 7 AS l_linenumber, id * 1.5D AS l_extendedprice, id % 80 AS l_partkey, id % 90 AS l_suppkey, 5L AS l_quantity"), ("orders", "id AS o_orderkey, id % 50 AS o_custkey")):
        spark.range(40).selectExpr(*cols.split(", ")).write.parquet(str(tmp_path / f"{name}.parquet"))
    dets, truth = catalog.fx.detections(spark, str(tmp_path)), catalog.fx.ground_truth(spark, str(tmp_path))
    exchanges = lambda df: len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))
    pairs = matching.image_pairs(dets, truth, 0.5)
    assert exchanges(pairs) == 2 and broadcasts(pairs) == 0


def test_regions_looked_at_together_are_as_each_alone():
    """Regions of many images, of all sizes, with and without seeds: one call a batch of regions gives what ``look`` gives of each."""
    import numpy as np
    import pyarrow as pa

    from siltstone.plans import cascade, strategies as st

    rng, names = random.Random(5), ["image_id", "height", "width", "squares"]
    square = pa.struct([(c, pa.int64()) for c in ("ann_id", "category_id", "y0", "y1", "x0", "x1")])
    schema = pa.schema([("image_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("squares", pa.list_(square)), ("region", pa.string()), *[(c, pa.int32()) for c in ("y0", "y1", "x0", "x1")], ("seed", pa.binary()), *[(f"p{i}", pa.int32()) for i in range(4)]])

    def box(h, w):
        y, x = rng.randrange(h), rng.randrange(w)
        return y, rng.randrange(y + 1, h + 1), x, rng.randrange(x + 1, w + 1)

    for settings in (st.Settings(extractor="oracle", stop="oracle"), st.Settings(extractor="oracle", stop="oracle", pad=0.1, dilate=0.5, fixed=0.5, min_side=20)):
        see, rule, rows = cascade.see_squares(1, settings=settings), st.build_stop("oracle"), []
        for image in range(40):
            h, w = rng.choice([(128, 128), (40, 300), (9, 20), (500, 70)])
            squares = [dict(zip(square.names, (a, rng.choice([1, 2]), *box(h + 30, w + 30)))) for a in range(rng.choice([0, 1, 3, 10, 20]))]
            for r in range(rng.randrange(1, 6)):
                seed, (a, b, c, d) = np.zeros((16, 16), bool), box(16, 16)
                seed[a:b, c:d] = True
                seed = cascade.packed(seed) if rng.random() < 0.7 else None
                rows.append(dict(zip(schema.names, (image, h, w, squares, str(r), *box(h, w), seed, *(box(h, w) if seed else [None] * 4)))))
        got = cascade.look_at_many(see.many, rule, pa.RecordBatch.from_pylist(rows, schema=schema), names, settings).to_pylist()
        for r, g in zip(rows, got):
            want = cascade.look(see, rule, {n: r[n] for n in names}, tuple(r[c] for c in ("y0", "y1", "x0", "x1")), r["seed"], r["seed"] and tuple(r[f"p{i}"] for i in range(4)), settings)
            assert abs(g.pop("score") - want.pop("score")) < 1e-9
            scores = [[k.pop("score") for k in x["child"]] for x in (g, want)]
            assert np.allclose(*scores) and {k: g[k] for k in want} == want
    none = cascade.look_at_many(see.many, rule, pa.RecordBatch.from_pylist([dict(rows[0], squares=[])], schema=schema), names, settings).to_pylist()
    assert [(r["n"], r["score"], r["signal"], r["child"]) for r in none] == [(0, 0.0, 0.0, [])]
    many = [dict(rows[0], squares=[dict(zip(square.names, (a, 1, a, a + 1, 0, 1))) for a in range(64)])]  # more labels than bits
    assert cascade.look_at_many(see.many, rule, pa.RecordBatch.from_pylist(many, schema=schema), names, settings) is None


def test_grids_of_several_shapes_and_parts_are_measured(spark):
    import numpy as np

    from siltstone.plans import cascade

    rng, rows, want = np.random.default_rng(2), [], {}
    for i in range(30):
        shape = [(16, 16), (3, 5), (7, 20)][i % 3]
        parts = [rng.random(shape) < 0.3 for _ in range(1 + i % 4)]
        box = (2, 2 + int(rng.integers(1, 90)), 5, 5 + int(rng.integers(1, 90)))
        whole = np.logical_or.reduce(parts)
        want[i] = (cascade.packed(whole), int(cascade.pixels(whole, box).sum()))
        rows.append((i, "0", 0, 0, 0.5, *box, [bytearray(cascade.packed(p)) for p in parts]))
    df = spark.createDataFrame(rows, "image_id long, region string, place int, depth int, score double, y0 int, y1 int, x0 int, x1 int, parts array<binary>")
    assert {r.image_id: (bytes(r.cells), r.area) for r in cascade.measured(df).collect()} == want
