"""Operators against plain restatements in Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quire.functions import geom
from quire.functions import text as tx
from quire.operators import answers, diff, islands, order, raster, state
from quire.plans import catalog, surrogates
from quire.sources import documents
from quire.streaming import ledger


def iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h) if w > 0 and h > 0 else 0.0


def test_iou_properties_and_rounding(spark):
    rng = random.Random(1)
    rows = [tuple(rng.randint(0, 9) for _ in range(8)) for _ in range(300)] + [(0, 0, 5, 5, 5, 0, 5, 5), (0, 0, 0, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "ax int, ay int, aw int, ah int, bx int, by int, bw int, bh int")
    got = df.select("*", geom.iou(geom.box("a"), geom.box("b")).alias("i"), geom.iou(geom.box("b"), geom.box("a")).alias("j")).collect()
    for r in got:
        assert r.i == r.j == pytest.approx(iou(r[:4], r[4:8])) and 0 <= r.i <= 1
    values = [k / 800 for k in range(800)] + [k / 1071 for k in range(1072)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(geom.round4(F.col("v"))).collect()] == [round(v, 4) for v in values]


def test_greedy_match_holds_what_it_promises(spark):
    a, e = surrogates.crowded(spark, "/root/testdata/sf0.001")
    autos, edits = ({r.id: r for r in df.collect()} for df in (a, e))
    got = diff.greedy_match(a, e).collect()
    taken = {r.e_id: r.a_id for r in got}
    of = {r.a_id: r.e_id for r in got}
    assert got and len(taken) == len(of) == len(got)
    box = lambda r: (r.x, r.y, r.w, r.h)
    by_page = {}
    for r in edits.values():
        by_page.setdefault(r.page, []).append(r)
    for x in autos.values():
        # What was free at x's turn: taken by a later block, or by none.
        free = [y for y in by_page[x.page] if y.id not in taken or autos[taken[y.id]].ord >= x.ord]
        best = max(((iou(box(x), box(y)), -y.ord, y.id) for y in free), default=(0.0, 0, None))
        assert of.get(x.id) == (best[2] if best[0] >= 0.5 else None)


def test_order_is_a_permutation_and_places_attached(spark):
    rng = random.Random(3)
    rows, want = [], []
    for page in range(60):
        n = rng.randint(1, 9)
        ids = [f"i{k}" for k in range(n)]
        entries = [(page, i, k, rng.choice([None, None, "", "gone", *ids])) for k, i in enumerate(ids)]
        rows += entries
        roots = [x for x in entries if not x[3]]
        placed = []
        for x in roots:
            placed.append(x)
            placed += [y for y in entries if y[3] == x[1]]
        placed += [y for y in entries if y not in placed]
        want += [(page, x[1], k) for k, x in enumerate(placed)]
    df = spark.createDataFrame(rows, "page int, id string, rank int, attach_to string")
    assert sorted((r.page, r.id, r.place) for r in order.place_attached(df).collect()) == sorted(want)


def test_interpolation_like_a_loop(spark):
    known = {8: 1, 12: 3, 13: 9, 40: 10, 301: 77}
    got = {r.page: r.answer_page for r in answers.interpolated(spark.createDataFrame(list(known.items()), "k int, v int"), 50).collect()}
    for p in range(10, 292):
        if p in known:
            v = known[p]
        else:
            lo, hi = max(k for k in known if k < p), min(k for k in known if k > p)
            v = round(known[lo] + (p - lo) / (hi - lo) * (known[hi] - known[lo]))
        assert got[p] == max(1, min(50, v))
    assert {r.answer_page for r in answers.interpolated(spark.createDataFrame([], "k int, v int"), 50).collect()} == {None}


def masks(seed, n=12, height=14, width=23, share=0.4):
    rng = np.random.default_rng(seed)
    return {i: rng.random((height, width)) < share for i in range(n)}


def run_rows(spark, pages):
    rows = []
    for page, mask in pages.items():
        for y, line in enumerate(mask):
            edge = np.diff(np.concatenate(([0], line.astype(int), [0])))
            rows += [(page, y, a, z, z - a if a % 2 else 0) for a, z in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
    return spark.createDataFrame(rows, "page long, y long, x0 long, x1 long, tint long")


def test_density_and_row_bands_of_masks(spark):
    pages = masks(3)
    rows = run_rows(spark, pages)
    got = {}
    for r in islands.density(rows, ["page"]).collect():
        got.setdefault(r.page, np.zeros(23, int))[r.p0 : r.p1] = r.d
    assert all((got[p] == m.sum(0)).all() for p, m in pages.items())
    bands = {p: np.zeros(14, bool) for p in pages}
    for r in islands.row_bands(rows, ["page"], 8).collect():
        assert not bands[r.page][max(0, r.p0 - 1) : r.p1 + 1].any()
        bands[r.page][r.p0 : r.p1] = True
    assert all((bands[p] == (m.sum(1) > 8)).all() for p, m in pages.items())


def test_run_components_like_flooding(spark):
    pages = masks(4)
    got = {}
    for r in islands.run_components(run_rows(spark, pages), ["page"], ["page"]).collect():
        got.setdefault(r.page, []).append((r.x0, r.y0, r.w, r.h, r.area))
    for p, m in pages.items():
        want = []
        for part in flood(m):
            y, x = zip(*part, strict=True)
            want.append((min(x), min(y), max(x) - min(x) + 1, max(y) - min(y) + 1, len(part)))
        assert sorted(got[p]) == sorted(want)


def test_rows_in_boxes_and_spans(spark, monkeypatch):
    monkeypatch.setattr(islands, "STRETCH", 4)
    pages = masks(5, n=4)
    rng = random.Random(2)
    boxes = [(p, b, x, y, x + rng.randint(0, 15), y + rng.randint(0, 12)) for p in pages for b in range(6) for x, y in [(rng.randint(0, 20), rng.randint(0, 12))]]
    got = {}
    for r in islands.in_boxes(run_rows(spark, pages), spark.createDataFrame(boxes, "page long, box long, x0 long, y0 long, x1 long, y1 long"), ["page"], ["box"]).collect():
        got.setdefault((r.page, r.box), set()).update((r.y, x) for x in range(r.x0, r.x1))
    for p, b, x0, y0, x1, y1 in boxes:
        assert got.get((p, b), set()) == {(y, x) for y, x in zip(*np.nonzero(pages[p]), strict=True) if y0 <= y < y1 and x0 <= x < x1}
    rows = spark.createDataFrame([(1, v, "k") for v in range(12)] + [(2, 3, "k")], "page int, y int, p string")
    spans = spark.createDataFrame([(1, 2, 4), (1, 4, 5), (1, 9, 20), (3, 0, 99)], "page int, p0 int, p1 int")
    found = {(r.page, r.y): (r.p0, r.p1) for r in islands.within(rows, spans, ["page"], "y").collect()}
    assert found == {(1, v): s for v, s in [(2, (2, 4)), (3, (2, 4)), (4, (4, 5)), (9, (9, 20)), (10, (9, 20)), (11, (9, 20))]}


def test_blocks_cut_as_the_rules_say(spark):
    rows = []

    def ink(page, y0, y1, *spans, tint=()):
        rows.extend((page, y, a, z, z - a if (a, z) in tint else 0) for y in range(y0, y1) for a, z in spans)

    ink(1, 10, 22, (100, 140), (180, 220), (226, 300), (306, 400))  # a label before a wide gap
    ink(1, 28, 40, (100, 400))
    ink(2, 10, 22, (100, 140), (146, 400), tint=[(100, 140)])  # a coloured label before a narrow gap
    ink(3, 10, 20, (100, 400))  # two lines, then a tall one
    ink(3, 25, 35, (100, 380))
    ink(3, 40, 60, (140, 300))
    ink(4, 10, 14, (100, 400))  # debris
    ink(4, 50, 62, (960, 990))  # the chapter badge
    size = spark.createDataFrame([(p, 1000, 1000) for p in range(1, 6)], "page long, width long, height long")
    rle = spark.createDataFrame(rows, "page long, y long, x0 long, x1 long, tint long")
    got = sorted((r.page, r.x0, r.y0, r.x1, r.y1) for r in islands.text_blocks(rle, size, ["page"]).collect())
    assert got == [(1, 97, 7, 143, 25), (1, 177, 7, 403, 43), (2, 97, 7, 143, 25), (2, 143, 7, 403, 25), (3, 97, 7, 403, 43), (3, 137, 37, 303, 63)]


def test_islands_boundaries(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 5, 6), (1, 8, 9)], "k int, p0 int, p1 int")
    merged = lambda inclusive: sorted((r.p0, r.p1) for r in islands.merge_gaps(df, ["k"], F.lit(3), inclusive).collect())
    assert merged(True) == [(0, 9)] and merged(False) == [(0, 2), (5, 9)]


def flood(mask):
    seen, parts = set(), []
    for y in range(mask.shape[0]):
        for x in range(mask.shape[1]):
            if mask[y, x] and (y, x) not in seen:
                todo, part = [(y, x)], []
                seen.add((y, x))
                while todo:
                    a, b = todo.pop()
                    part.append((a, b))
                    for c in range(a - 1, a + 2):
                        for d in range(b - 1, b + 2):
                            if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and (c, d) not in seen:
                                seen.add((c, d))
                                todo.append((c, d))
                parts.append(part)
    return parts


def test_raster_operators():
    rng = np.random.default_rng(2)
    for _ in range(20):
        mask = rng.random((12, 17)) < 0.45
        labels = raster.components(mask)
        assert labels.max() == len(flood(mask))
        for i, part in enumerate(flood(mask), 1):
            assert {labels[p] for p in part} == {i}
    gray = np.concatenate([np.full(50, 20), np.full(50, 200)]).reshape(10, 10)
    assert 20 <= raster.otsu_threshold(gray) < 200
    ink = raster.ink_mask(np.where(np.eye(9) > 0, 10, 240).astype(int))
    assert ink.sum() == 9
    gap = np.zeros((9, 30), bool)
    gap[4, [5, 10]] = True
    assert raster.closed(gap, 9, 3)[4, 5:11].all() and not raster.closed(gap, 3, 3)[4, 7]
    assert not raster.blanked(np.ones((4, 4), bool), [(1, 1, 9, 3)])[1:3, 1:].any()
    red = np.zeros((5, 5, 3), np.uint8)
    red[..., 2] = 200
    assert raster.hsv(red)[0, 0].tolist() == [0, 255, 200]
    pink = np.full((8, 8, 3), 255, np.uint8)
    pink[2:7, 2:7] = (150, 30, 180)
    assert raster.number_coloured(pink) and not raster.number_coloured(red[:3, :3])
    page = np.full((300, 400, 3), 255, np.uint8)
    page[100:140, 50:100] = (160, 120, 20)
    assert raster.badges(page, 5) == [(50, 100, 100, 140)]
    columns = np.zeros(120, bool)
    columns[[2, 8, 20, 34, 60]] = True
    assert raster.extended(columns) == 35
    far = np.zeros(120, bool)
    far[[0, 28, 40]] = True  # the first ink may be farther off than the gap
    assert raster.extended(far) == 41 and raster.extended(far[:20]) == 0
    page[105:130, 125:140] = 0
    assert raster.icon_badges(page, 5) == [(50, 100, 140, 140)]
    assert raster.ellipse(5, 5).astype(int).tolist() == [[0, 0, 1, 0, 0], [1] * 5, [1] * 5, [1] * 5, [0, 0, 1, 0, 0]]


def test_frames_of_pictures(spark):
    page = np.full((300, 400, 3), 255, np.uint8)
    page[100:140, 50:100] = (160, 120, 20)
    schema = "id long, width int, height int, pixels array<int>"
    df = spark.createDataFrame([(1, 400, 300, page.ravel().tolist()), (2, 1, 1, [255, 255, 255])], schema)
    assert [tuple(r) for r in raster.picture_badges(df).collect()] == [(1, 50, 100, 100, 140)]
    assert raster.picture_badges(df.limit(0)).count() == 0
    pixels = spark.createDataFrame([(1, *map(int, c)) for c in page.reshape(-1, 3)[::997]] + [(2, 150, 30, 180)] * 25, "id long, blue int, green int, red int")
    got = {r.id: (r.ink, r.share, r.coloured) for r in raster.colour_shares(pixels, ["id"]).collect()}
    assert got[2] == (25, 1.0, True) and not got[1][2]
    rng = np.random.default_rng(6)
    colours = rng.integers(0, 256, (300, 3))
    shown = spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(colours)], "i long, b int, g int, r int")
    found = [(r.h, r.s, r.v) for r in shown.orderBy("i").select(*(c.alias(n) for c, n in zip(raster.hsv_columns(F.col("b"), F.col("g"), F.col("r")), "hsv", strict=True))).collect()]
    assert found == list(map(tuple, raster.hsv(colours).tolist()))


def test_state_is_idempotent_and_keeps_first_of_ties(spark):
    e = state.accepted(surrogates.ledger(spark, "/root/testdata/sf0.001"))
    once = state.latest(e)
    rows = sorted(map(str, once.collect()))
    assert sorted(map(str, state.latest(e.unionByName(e)).collect())) == rows
    assert sorted(map(str, state.merged(once, e).select(once.columns).collect())) == rows
    bad = spark.createDataFrame([("b", "nope", "k", "1", 1.0, 0, 1), ("b", "marks", "k", "1", float("nan"), 0, 2), ("b", "marks", "k", "1", None, 0, 3)], e.schema)
    assert state.accepted(bad).count() == 0


def test_streams_end_like_the_batch(spark, tmp_path):
    e = surrogates.ledger(spark, "/root/testdata/sf0.001")
    want = sorted((r.book, r.kind, r.key, r.v, r.t, r.d) for r in state.latest(state.accepted(e)).collect())
    source = str(tmp_path / "in")
    for n in range(3):
        e.filter(f"seq between {n * 340} and {n * 340 + 339}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)
    store = str(tmp_path / "store")
    ledger.upsert_batches(stream, store, str(tmp_path / "c1")).awaitTermination()
    last = spark.read.parquet(f"{store}/v=2")
    assert sorted((r.book, r.kind, r.key, r.v, r.t, r.d) for r in last.collect()) == want
    q = ledger.changes(stream).writeStream.format("memory").queryName("ledger_changes").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = {}
    for r in spark.table("ledger_changes").collect():
        k = (r.book, r.kind, r.key)
        if k not in seen or r.t > seen[k][1]:
            seen[k] = (r.v, r.t, r.d)
    assert sorted((*k, *v) for k, v in seen.items()) == want


def test_payload_and_legacy(spark):
    df = spark.createDataFrame([("b", 1, {"marks": {"1:2": ('"done"', 5.0, 0)}, "recent": {"7": (None, 4.0, 1)}})], "book string, seq long, state map<string,map<string,struct<v:string,t:double,d:int>>>")
    entries = state.from_payload(df)
    assert sorted((r.kind, r.key, r.v, r.t, r.d) for r in entries.collect()) == [("marks", "1:2", '"done"', 5.0, 0), ("recent", "7", None, 4.0, 1)]
    text = json.loads(state.to_payload(entries).first().state)
    assert text["marks"]["1:2"]["t"] == 5.0 and text["recent"]["7"]["d"] == 1
    assert [(r.page, r.number, r.mark) for r in state.split_marks(state.latest(entries)).collect()] == [(1, 2, '"done"')]
    old = spark.range(1).select(F.explode(state.legacy(F.lit("b"), F.array(F.lit(3)), F.array(F.lit(9), F.lit(8)), F.array(F.lit("1:1")), F.lit(100))).alias("e")).select("e.*")
    assert sorted((r.kind, r.key, r.t) for r in old.collect()) == [("favorites", "3", 100.0), ("marks", "1:1", 100.0), ("recent", "8", 99.0), ("recent", "9", 100.0)]


def test_documents(spark, tmp_path):
    book = {"schema_version": "1.0", "id": "b1", "title": "T", "page_count": 2, "created_at": "2024-01-01T00:00:00Z"}
    block = {"id": "p1_b00", "page": 1, "type": "text", "bbox": [0, 0, 0.5, 0.5], "lines": [{"bbox": [0, 0, 1, 1]}]}
    for name, kind, d in (("b1/book.json", "book", book), ("b1/blocks.json", "blocks", {"schema_version": "1.0", "book_id": "b1", "blocks": [block, {**block, "type": "poem"}]})):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(d, indent=2))
    good = documents.valid(documents.read_documents(spark, str(tmp_path / "b1/book.json"), "book"))
    assert good.first().title == "T"
    bad = documents.read_documents(spark, str(tmp_path / "b1/blocks.json"), "blocks")
    assert bad.first().violations == ["blocks[1] type"] and bad.first().blocks[0].bbox == [0, 0, 0.5, 0.5]
    with pytest.raises(ValueError, match="type"):
        documents.valid(bad)
    out = str(tmp_path / "out")
    documents.write_documents(good, out, "book")
    documents.ensure_book(good.withColumn("title", F.lit("other")), out)
    assert json.loads(spark.read.text(out).first().value) == book
    with pytest.raises(ValueError):
        documents.write_documents(good.withColumn("page_count", F.lit(-1)), out, "book")
    assert [(r.folder, r.title) for r in documents.book_index(spark, str(tmp_path)).collect()] == [("b1", "T")]
    assert [(r.folder, r.title, r.violations) for r in documents.book_documents(spark, str(tmp_path), "book").collect()] == [("b1", "T", [])]
    rows = spark.createDataFrame([('{"2": "a", "10": "b"}',), (None,), ("x",)], "j string").select(documents.map_rows(F.col("j")).alias("m")).collect()
    assert [[tuple(e) for e in r.m] for r in rows] == [[(2, "a"), (10, "b")], [], []]


def test_many_documents_go_out_and_in(spark, tmp_path):
    rows = [("1.0", f"b{i}", f"line\n{i}", i, "2024-01-01") for i in range(5)]
    books = spark.createDataFrame(rows, "schema_version string, id string, title string, page_count int, created_at string").coalesce(1)
    out = str(tmp_path / "many")
    documents.write_documents(books, out, "book")
    back = documents.valid(documents.read_documents(spark, out, "book"))
    assert sorted((r.schema_version, r.id, r.title, r.page_count, r.created_at) for r in back.collect()) == rows
    (tmp_path / "two.json").write_text('{"schema_version": "1.0"} {"schema_version": "1.0"}')
    assert documents.read_documents(spark, str(tmp_path / "two.json"), "book").first().violations == ["not an object"]


def test_last_page_images_and_stores(spark, tmp_path):
    where = str(tmp_path / "last_page.json")
    assert documents.read_last_page(spark, where) is None
    documents.write_last_page(spark, 31, where)
    documents.write_last_page(spark, 32, where)
    assert documents.read_last_page(spark, where) == 32
    (tmp_path / "pages").mkdir()
    for name in ("0001.png", "0001.webp", "0002.jpg", "0003.gif", "cover.png"):
        (tmp_path / "pages" / name).write_bytes(name.encode())
    got = sorted((r.page, r.ending, bytes(r.content)) for r in documents.page_images(spark, str(tmp_path / "pages")).collect())
    assert got == [(1, "webp", b"0001.webp"), (2, "jpg", b"0002.jpg")]
    store = str(tmp_path / "state")
    assert state.open_store(spark, store).count() == 0
    spark.createDataFrame([("b", "marks", "1:1", "1", 1.0, 0, 1)], state.STORED).write.mode("append").parquet(store)
    assert state.open_store(spark, store).count() == 1


def test_ledger_texts(spark):
    texts = [None, "", "oops", "[]", '{"marks": 5, "spam": {"k": {"v": 1, "t": 1}}}', '{"marks": {"1:2": {"v": "done", "t": 5, "d": 0}}, "bookmarks": {"7": {"v": {"at": 3}, "t": 4.5}}, "recent": {"9": {"v": null, "t": 2, "d": 1}}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [(r.i, *r.e) for r in df.select("i", F.explode(state.from_ledger(F.col("t"))).alias("e")).collect()]
    assert sorted(got) == [(5, "bookmarks", "7", '{"at":3}', 4.5, 0), (5, "marks", "1:2", "done", 5.0, 0), (5, "recent", "9", None, 2.0, 1)]


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert get(tx.duration_text(F.lit(125.9))) == "2분 5초" and get(tx.duration_text(F.lit(-3.0))) == "0초"
    assert get(tx.inclusive_range(F.lit("3-6"))) == [3, 4, 5, 6]
    assert get(tx.short_title(F.lit("Ⅰ-1. 평면좌표"))) == "Ⅰ-1"
    assert [get(tx.safe_book_id(F.lit(b))) for b in ("a-B_1", "a/b", "", "a\n")] == [True, False, False, False]
    assert get(tx.parse_reply(F.lit('x {"type": "text", "confidence": true}'))).confidence == 1.0
    assert get(tx.parse_reply(F.lit(None).cast("string"))).type == "text"
