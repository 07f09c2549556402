from tessella.operators import layout

NODE = "model string, view string, ord long, id string, x double, y double, width double, height double"
EDGE = "model string, view string, ord long, id string, source string, target string"


def nodes(spark, *places):
    return spark.createDataFrame([("m", "v", i, n, float(x), float(y), 100.0, 100.0) for i, (n, x, y) in enumerate(places)], NODE)


def edges(spark, *pairs):
    return spark.createDataFrame([("m", "v", i, f"{a}{b}", a, b) for i, (a, b) in enumerate(pairs)], EDGE)


def test_three_edges_to_the_right_share_a_magnet(spark):
    n = nodes(spark, ("h", 0, 0), ("a", 1000, 0), ("b", 1000, 100), ("c", 1000, -100), ("d", 0, 1000))
    e = edges(spark, ("h", "a"), ("b", "h"), ("h", "c"), ("h", "d"))
    got = sorted(tuple(r) for r in layout.edge_bundles(n, e).select("edge_id", "hub", "side", "mx", "my").collect())
    assert got == [("bh", "h", "right", 160.0, 50.0), ("ha", "h", "right", 160.0, 50.0), ("hc", "h", "right", 160.0, 50.0)]


def test_two_edges_make_no_hub(spark):
    n = nodes(spark, ("h", 0, 0), ("a", 1000, 0), ("b", 1000, 100))
    assert layout.edge_bundles(n, edges(spark, ("h", "a"), ("h", "b"))).isEmpty()


def test_points_face_each_other_and_spread(spark):
    n = nodes(spark, ("a", 0, 0), ("b", 400, 0), ("c", 0, 400))
    e = edges(spark, ("a", "b"), ("b", "a"), ("a", "c"), ("a", "lost"))
    got = {r.edge_id: (r.source_point, r.target_point) for r in layout.connection_points(n, e).collect()}
    assert got == {"ab": ("right", "left"), "ba": ("left", "right"), "ac": ("bottom", "top")}


def test_diagonal_neighbours_may_use_corners(spark):
    n = nodes(spark, ("a", 0, 0), ("b", 300, 300))
    (row,) = layout.connection_points(n, edges(spark, ("a", "b"))).collect()
    assert (row.source_point, row.target_point) == ("bottom-right", "top-left")


def test_placement_covers_all_nodes_without_overlap(spark):
    n = nodes(spark, *[(x, 0, 0) for x in "abcdefgh"])
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("f", "f"))
    got = {r.id: (r.x, r.y) for r in layout.placed(n, e).collect()}
    assert set(got) == set("abcdefgh") and len(set(got.values())) == 8
    assert all(x % layout.CELL_WIDTH == 0 and y % layout.CELL_HEIGHT == 0 for x, y in got.values())
    assert min(got[i][1] for i in "fgh") > max(got[i][1] for i in "abcde")
    assert {r.id for r in layout.isolates(n, edges(spark, ("a", "b"))).collect()} == set("cdefgh")


def test_leaves_are_stripped_to_the_core(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("f", "g"))
    assert sorted((r.a, r.b) for r in layout.leaves_stripped(e).collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
